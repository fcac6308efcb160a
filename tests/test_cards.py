"""Pool, register, counts and lines of cards on literal frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bidlake.operators import cards


def test_open_pool(spark):
    at = dt.datetime(2026, 3, 1, 12)
    schema = "notice_id int, source string, title string, buyer_name string, buyer_type string, region string, estimated_value double, notice_url string, closing_utc timestamp, status string, scale_band string, scale_source string, scale_confidence double"
    rows = [(1, "s", None, "B", None, "ON", 5.0, "u", at, "open", "", None, None), (2, "s", "t", None, None, None, None, None, at, "closed", "x", "y", 0.5), (3, "s", "t", None, None, None, None, None, None, "open", "x", "y", 0.5), (4, "s", "t", "", None, None, None, None, at, "open", "<$100K", "published", 1.0)]
    trades = spark.createDataFrame([(4, ["a"], "mapped")], "notice_id int, trade_slugs array<string>, mapping_status string")
    got = {r.notice_id: r for r in cards.open_pool(spark.createDataFrame(rows, schema), trades).collect()}
    assert set(got) == {1, 4}
    assert (got[1].title, got[1].closing_date, list(got[1].trade_slugs), got[1].mapping_status, got[1].scale_band, got[1].scale_source, got[1].scale_confidence) == ("", "2026-03-01", [], "unmapped", "unknown", "unknown", 0.0)
    assert (list(got[4].trade_slugs), got[4].mapping_status, got[4].scale_band, got[4].scale_confidence) == (["a"], "mapped", "<$100K", 1.0)


@pytest.mark.parametrize(
    ("closing", "want"),
    [
        (None, "Closing date unavailable"), ("2026-02-28 23:59:00", "Closed Feb 28, 2026 at 11:59 PM"), ("2026-03-01 00:05:00", "Mar 1, 2026 at 12:05 AM · closes in 0 days"), ("2026-03-02 14:00:00", "Mar 2, 2026 at 2:00 PM · closes in 1 day"),
        ("2026-03-14 09:30:00", "Mar 14, 2026 at 9:30 AM · closes in 13 days"), ("2026-03-15 09:30:00", "Mar 15, 2026 at 9:30 AM"),
    ],
)
def test_closing_text(spark, closing, want):
    row = spark.createDataFrame([(closing,)], "c string").select(cards.closing_text(F.col("c").cast("timestamp"), F.lit("2026-03-01").cast("date")))
    assert row.first()[0] == want


def test_titles(spark):
    rows = spark.createDataFrame([("rfp-2026_road-work", None, " "), ("t-1", "T-1", "The bridge"), ("x", "A title", None), ("a--b", None, None)], "i string, a string, b string")
    assert [r[0] for r in rows.select(cards.display_title(F.col("i"), F.col("a"), F.col("b"))).collect()] == ["RFP 2026 Road Work", "The bridge", "A title", "A B"]
    files = spark.createDataFrame([(None, ["notes.pdf", "rfso-5p300-26-0001-a.pdf"], "x-y"), (" ", None, "ab-12"), ("Title", ["rfp-a-1-2.pdf"], "z")], "t string, f array<string>, i string")
    assert [r[0] for r in files.select(cards.blocker_title(F.col("t"), F.col("f"), F.col("i"))).collect()] == ["RFSO 5P300-26-0001", "AB 12", "Title"]


def test_lines_of_submission(spark):
    bid = "bid_phase_mandatory"
    rows = [
        ("a", 3, bid, "submission", "submission_method", "portal", "x"), ("a", 1, bid, "submission", "submission_method", " email ", "x"), ("a", 5, bid, "submission", "submission_method", "email", "x"), ("a", 2, "contract_condition", "submission", "submission_method", "fax", "x"),
        ("b", 1, bid, "submission", None, None, "w " * 60), ("b", 2, bid, "bid_security", None, None, "10 percent"), ("c", 1, bid, "insurance", None, None, "x"), ("d", 1, bid, "submission", "submission_method", None, None), ("d", 2, bid, "bid_security", None, None, None),
    ]
    got = {r.tender_id: (r.submission, r.bid_security) for r in cards.submission_lines(spark.createDataFrame(rows, "tender_id string, pos int, phase string, category string, check_field string, check_value string, requirement_text string")).collect()}
    assert got["a"] == ("Submission: email / portal", None) and got["c"] == ("Submission: not identified", None) and got["d"] == ("Submission: see tender documents", "Bid security: requirement identified")
    assert got["b"] == ("Submission: " + ("w " * 60).strip()[:77].rstrip() + "...", "Bid security: 10 percent") and len(got["b"][0]) <= 92


def test_register_counts_and_small_things(spark):
    places = spark.createDataFrame([("b", "Bee", "lower", None, 5.0, "biddingo", "high", "biddingo", "u"), ("a", "Ay", "upper", "X", None, "new_class", None, None, None)], "slug string, name string, tier string, area string, population double, class string, confidence string, platform string, procurement_url string")
    assert [(r.slug, r.area, r.population, r.label) for r in cards.register(places).collect()] == [("a", "X", None, "new_class"), ("b", "", 5, "On Biddingo")]
    assert cards.counts({"x": places, "y": places.limit(0)}).first().asDict() == {"x": 2, "y": 0}
    runs = spark.createDataFrame([("parsed",), ("parsed",), (None,), (" ",)], "status string")
    assert {r.status: r.n for r in cards.tally(runs, "status").collect()} == {"parsed": 2, "unknown": 2}
    flags = spark.createDataFrame([(["trade_unmapped", "x"],), ([],), (None,)], "f array<string>")
    assert [r[0] for r in flags.select(cards.cohort(F.col("f"))).collect()] == ["unmapped", "mapped", "mapped"]
    said = spark.createDataFrame([("bid",), ("maybe",), (None,)], "v string")
    assert [r[0] for r in said.select(cards.shown_verdict(F.col("v"))).collect()] == ["bid", "not_analyzed", "not_analyzed"]
