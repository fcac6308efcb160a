"""Profiles, blockers, descriptions, labels and imports on literal frames."""

import base64
import collections
import datetime as dt
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidlake.functions import text
from bidlake.operators import blockers, census, profiles, scoring, sinks, trades

INTERACTIONS = "canonical_id string, ocid string, date date, won int, bid_amount double, buyer_id string, category string, region string"
NAMES = "canonical_id string, raw_name string, normalized_name string, observations int"
VECTORS = "canonical_id string, date date, vector array<double>"


def test_profiles_equal_counters(spark, tmp_path):
    r = random.Random(1)
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(k)
    rows = [(r.choice("aaab"), f"o{i}", day(r.randrange(60)), r.randrange(2), r.random() * 1000, f"b{int(r.expovariate(0.1))}", r.choice([None, "", "works", "goods"]), r.choice([None, "QC", "ON"])) for i in range(300)]
    rows += [("few", f"p{i}", day(1), 0, None, None, None, None) for i in range(4)] + [("late", f"q{i}", day(50), 0, None, None, None, None) for i in range(9)] + [("plain", f"s{i}", day(1), 1, None, None, None, None) for i in range(5)]
    names = [("a", "A Inc", "a", 2), ("a", "A INC.", "a", 5), ("a", "A ltd", "a", 5), ("b", "Bee", "bee", 1), ("x", "X", "x", 9)]
    vectors = [("a", day(3), [3.0, 4.0, 0.0]), ("a", day(4), [3.0, 4.0, 0.0]), ("a", day(55), [0.0, 0.0, 9.0]), ("a", day(1), None), ("a", day(1), [None, 1.0, 1.0]), ("b", day(2), [1.0, -1.0, 1.0]), ("few", day(2), [1.0, 1.0, 1.0])]
    frames = spark.createDataFrame(rows, INTERACTIONS), spark.createDataFrame(names, NAMES), spark.createDataFrame(vectors, VECTORS)
    made = profiles.profiles(*frames, F.lit("2024-02-10").cast("date"), most_keys=5)
    made.write.parquet(str(tmp_path / "profiles"))
    back = spark.read.parquet(str(tmp_path / "profiles"))
    got = {x.id: x for x in back.collect()}
    assert set(got) == {"a", "b", "plain"}
    for firm in "ab":
        past = [x for x in rows if x[0] == firm and x[2] < dt.date(2024, 2, 10)]
        buyers = sorted(collections.Counter(x[5] for x in past).items(), key=lambda kv: (-kv[1], kv[0]))[:5]
        x = got[firm]
        assert (x.bids, x.wins, x.first, x.last) == (len(past), sum(q[3] for q in past), min(q[2] for q in past), max(q[2] for q in past))
        assert x.buyers == dict(buyers) and x.categories == dict(collections.Counter(q[6] for q in past if q[6])) and x.features.firm_interactions == len(past)
    assert (got["a"].name, got["b"].normalized, got["plain"].name, got["plain"].buyers, got["plain"].centroid) == ("A INC.", "bee", "plain", {}, "")
    q = np.frombuffer(base64.b64decode(got["a"].centroid), np.int8)
    assert q.tolist() == [95, 127, 0] and abs(got["a"].centroid_scale - 0.8 / 127) < 1e-12
    again = back.where("id = 'b'").select(profiles.unpacked(F.col("centroid"), F.col("centroid_scale")).alias("v")).first().v
    assert np.allclose(again, np.array([1, -1, 1]) / 3**0.5)
    assert {x.normalized: list(x.ids) for x in profiles.name_index(back).collect()} == {"a": ["a"], "bee": ["b"], "plain": ["plain"]}
    s = {x.id: x for x in profiles.summary(back).collect()}
    assert s["a"].since_year == "2024" and len(s["a"].regions) == 2 and list(s["plain"].categories) == []
    assert profiles.profiles(*(f.limit(0) for f in frames), F.lit("2024-02-10").cast("date")).count() == 0


def test_problems_of_firms(spark):
    schema = "name string, trades array<string>, value_min double, value_max double, past_projects array<struct<type_slug:string>>"
    rows = [("A", ["roads"], 1.0, 2.0, [("roads",)]), (" ", ["roads", "x", "x"], 3.0, 2.0, [("",), ("y",), (None,)]), (None, None, None, 2.0, None), ("B", [], 2.0, 2.0, [])]
    got = [x.problems for x in profiles.problems(spark.createDataFrame(rows, schema), {"trades": ["roads"]}, ["roads"]).collect()]
    assert got == [[], ["name is required", "trades has values outside the vocabulary: ['x']", "value_min is greater than value_max", "past_projects[1].type_slug is outside the vocabulary: y"], ["name is required"], []]


def test_blockers(spark):
    decisions = spark.createDataFrame([("t2", "no_bid", ["r1", "r2"], []), ("t1", "no_bid", ["r9", "r1"], ["r3"]), ("t3", "review", [], ["r1"]), ("t0", "no_bid", [], [])], "tender_id string, verdict string, blockers array<string>, open_questions array<string>")
    needs = [("t2", "r1", "Deliver by hand", "hand it in", 4, "physical"), ("t2", "r2", "x", "Send a FAX", 5, None), ("t1", "r9", "no quote", None, 1, None), ("t1", "r1", None, "bonding", 2, "bond"), ("t3", "r1", "a", "b", 1, None)]
    needs = spark.createDataFrame(needs, "tender_id string, req_id string, requirement_text string, verbatim_quote string, page_number int, check_value string")
    found = blockers.evidence(decisions, needs)
    assert sorted((x.tender_id, x.pos, x.req_id) for x in found.collect()) == [("t1", 1, "r1"), ("t2", 0, "r1"), ("t2", 1, "r2")]
    assert [x.tender_id for x in blockers.first_of_each(decisions, needs).collect()] == ["t2"]
    assert blockers.preferred(found).first().req_id == "r2" and blockers.preferred(found, "nothing").first().tender_id == "t1" and blockers.preferred(found, None).first().tender_id == "t1"
    assert blockers.preferred(found.limit(0)).count() == 0
    assert [tuple(x) for x in blockers.strays(decisions, needs).collect()] == [("t1", "r3")]


@pytest.mark.parametrize(
    ("value", "quote", "words", "able", "want"),
    [
        ("fax", "", "", ["email"], "Requires fax submission — this firm submits electronically only."),
        (None, "by FACSIMILE", None, ["mail", "email"], "Requires fax submission — this firm submits by mail and email only."),
        ("Physical copy", None, None, None, "Requires physical delivery — this firm submits by other means only."),
        ("x", "must deliver", "", ["portal", "email"], "Requires physical delivery — this firm submits electronically only."),
        (None, None, None, [], "Requires a submission method this firm does not support — this firm submits by other means only."),
    ],
)
def test_reasons(spark, value, quote, words, able, want):
    row = spark.createDataFrame([(value, quote, words, able)], "v string, q string, w string, a array<string>")
    assert row.select(blockers.reason(*map(F.col, "vqwa"))).first()[0] == want


@pytest.mark.parametrize(
    ("said", "want"),
    [("around $2 million", 2e6), ("1,5 M$", 1.5e6), ("500 000 $", 5e5), ("$500K", 5e5), ("$1,250,000.", 1.25e6), ("12 thousand", 12e3), ("3 meters", None), ("$0", None), ("", None), (None, None), ("no sum", None), ("2m", 2e6), ("$ 7.5", 7.5), ("1.500.000 $", 1.5)],
)
def test_stated_values(spark, said, want):
    assert spark.createDataFrame([(said,)], "t string").select(text.stated_value(text.fold(F.col("t")))).first()[0] == want


def test_descriptions(spark):
    rules = trades.Rules.read({"families": {}, "construction_markers": {"category_normalized": [], "category_raw_keywords": []}, "rules": [{"slug": "b", "priority": 5, "keywords_en": ["road", "street work"]}, {"slug": "a", "priority": 5, "keywords_fr": ["égout"]}, {"slug": "c", "priority": 1, "keywords_en": ["bridge"]}]})
    rows = [(1, "Roads and égouts, bridges à Montréal for $2M"), (2, "broadway in ON"), (3, None), (4, "street  works on time, Qc"), (5, "thunder bay")]
    got = {x.i: (list(x.slugs), list(x.regions), x.value, x.hit) for x in trades.derived(spark.createDataFrame(rows, "i int, description string"), rules).collect()}
    assert got == {1: (["c", "a", "b"], ["QC"], 2e6, True), 2: ([], ["ON"], None, False), 3: ([], [], None, False), 4: (["b"], ["QC"], None, True), 5: ([], ["ON"], None, False)}


def test_labels_go_to_their_ranks_only(spark):
    snapshot = spark.createDataFrame([(1, "u1", None, "t1"), (2, "u2", "marginal", "t2"), (3, None, "relevant", "t3")], "rank int, notice_url string, label string, title string")
    rows = lambda *x: spark.createDataFrame(list(x), "line int, rank int, notice_url string, label string")
    out, tally = sinks.apply_labels(snapshot, rows((2, 1, "u1", "relevant"), (3, 2, " u2", None), (4, 3, "", "relevant")))
    assert sorted((x.rank, x.label, x.title) for x in out.collect()) == [(1, "relevant", "t1"), (2, None, "t2"), (3, "relevant", "t3")]
    assert tally == {"labelled": 1, "cleared": 1, "unchanged": 1, "labelled_total": 2, "rows": 3}
    for bad, why in (((2, 1, "u1", None), (3, 2, "u2", None)), "2 rows"), (((2, 1, "u1", None), (3, 2, "u9", None), (4, 3, "", None)), "line 3: 'u9'"), (((2, 7, "u1", None), (3, 2, "u9", None), (4, 3, "", None)), "line 2: rank 7"):
        with pytest.raises(ValueError, match=why):
            sinks.apply_labels(snapshot, rows(*bad))


def test_firms_keep_their_tokens(spark):
    old = spark.createDataFrame([(1, "A", "x", "tok1"), (4, "B", "y", "tok4")], "firm_id int, name string, trade string, board_token string")
    new = spark.createDataFrame([(" A ", "z", 1), ("A", "zz", 2), ("C", "q", 1), ("D", "r", 1), ("", "s", 1), (None, "s", 1)], "name string, trade string, pos int")
    got = sorted(map(tuple, sinks.firms_by_name(old, new, ["trade"], F.concat(F.lit("new-"), F.col("name"))).collect()))
    assert got == [(1, "A", "zz", "tok1"), (4, "B", "y", "tok4"), (5, "C", "q", "new-C"), (6, "D", "r", "new-D")]
    assert spark.range(1).select(sinks.token_key(F.lit("tok"))).first()[0] == hashlib.sha256(b"tok").hexdigest()


def test_run_logs(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "slug string, n int")
    new = spark.createDataFrame([("b", 5), ("c", 6), (None, 7)], "slug string, n int")
    assert sorted(map(tuple, sinks.run_log(old, new, ["slug"]).collect()), key=repr) == [("a", 1), ("b", 5), ("c", 6), (None, 7)]


def test_pages_worth_reading(spark):
    hits = [("q", 1, "http://a.ca/x"), ("q", 2, "https://www.linkedin.com/a"), ("q", 3, "https://a.ca/"), ("q", 4, "https://a.ca/services/y"), ("q", 5, "https://a.ca/z"), ("q", 6, "https://a.ca/"), ("q", 7, "not a url"), ("q", 8, "http://b.ca"), ("q", 9, "https://c.ca/news"), ("r", 1, "https://yelp.ca/")]
    got = sorted((x.place, x.url, x.score) for x in census.select_pages(spark.createDataFrame(hits, "q string, pos int, url string"), ["q"]).collect())
    assert got == [(1, "https://a.ca/", 4), (2, "https://a.ca/services/y", 3), (3, "http://b.ca", 3), (4, "https://a.ca/z", 1)]


def test_top_components(spark):
    row = spark.createDataFrame([({"trade": 36.0, "region": 20.0, "buyer": 20.0},), ({},), (None,)], "p map<string,double>").select(scoring.top_components(F.col("p")).alias("t")).collect()
    assert [x.t and [tuple(c) for c in x.t] for x in row] == [[("trade", 36.0), ("buyer", 20.0)], [], None]


def test_functions_of_statements(spark):
    text.register(spark)
    got = spark.sql("SELECT fold(' Été ß'), normalize_name('Groupe ABC Inc. Ltée'), band_of(CAST(NULL AS DOUBLE)), band_of(5e5), band_of(1e9), cosine(array(1D, 0D), array(0D, 0D)), cosine(array(1D, 1D), array(2D, 2D))").first()
    assert tuple(got)[:6] == ("ete ss", "groupe abc", "unknown", "$500K–2M", ">$10M", 0.0) and abs(got[6] - 1) < 1e-12
