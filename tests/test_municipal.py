"""Lists of tender documents on municipal pages."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bidlake.sources import municipal

def now():
    return F.lit("2026-08-01 00:00:00").cast("timestamp")


URL = "https://www.example.ca/business/tenders"
PAGES = "slug string, buyer_name string, url string, html string, documents_open boolean"


def found(spark, html, url=URL):
    rows = municipal.records(spark.createDataFrame([("town", "Town", url, html, True), ("town", "Town", url, html, True), ("other", "Other", url, None, False)], PAGES), now()).orderBy("notice_id").collect()
    return [r.asDict(recursive=True) for r in rows]


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [("t-2026-28-fuel-tanks", "t-2026-28"), ("RFP_2024 09 x", "rfp-2024-09"), ("ITT2026 4", "itt2026-4"), ("procurement-policy", None), ("cat-2026-28", None), ("", None), (None, None), ("draft 2026", None)],
)
def test_numbers(spark, text, want):
    assert one(spark, municipal.number_of, text) == want


def test_amendments(spark):
    names = {"t-2026-28-fuel-tanks-addendum-1": True, "rfp-2024-09-assessments-amendment": True, "t-2026-28-fuel-tanks": False, "t-2026-28-update 2": True, "addendum": False}
    assert {n: one(spark, municipal.is_addendum, n) for n in names} == names


@pytest.mark.parametrize(
    ("text", "want"),
    [("Closes July 30, 2026 at noon", dt.datetime(2026, 7, 30)), ("2026-08-15", dt.datetime(2026, 8, 15)), ("Aug 5 2026", dt.datetime(2026, 8, 5)), ("July 30, 2026 2:05 PM", dt.datetime(2026, 7, 30, 14, 5)), ("July 3, 2026 11:00am", dt.datetime(2026, 7, 3, 11)), ("Unofficial Results", None), ("Fooly 30, 2026", None), ("", None), (None, None)],
)
def test_dates(spark, text, want):
    assert one(spark, municipal.date_of, text) == want


def test_documents_of_a_number_are_one_notice(spark):
    got = found(spark, """
      <table><tr><td><a href="/media/a/t-2026-28-fuel-tanks-addendum-1.pdf">T-2026-28 Fuel Tanks Addendum 1 with a longer name</a></td><td>Closing: August 12, 2026 2:00 PM</td></tr>
      <tr><td><a href="/media/b/t-2026-28-fuel-tanks.pdf">T-2026-28 Fuel Tanks</a><td>open
      <tr><td><a href="/media/c/T-2026-31.pdf">Download</a> <a href="/media/c/T-2026-31.pdf">the same file again, with another text</a></td></tr></table>
      <a href="/media/a/procurement-policy-by-law.pdf">Procurement Policy</a> <a href="https://muni.bidsandtenders.ca/T-2026-99.pdf">T-2026-99 elsewhere</a> <a href="http://[bad/T-2026-98.pdf">x</a>
      <script>var a = '<a href="/T-2026-97.pdf">';</script>""")
    assert [(r["source_id"], r["title"], r["status"], r["closing_date"]) for r in got] == [("town:t-2026-28", "T-2026-28 Fuel Tanks", "open", dt.datetime(2026, 8, 12, 14)), ("town:t-2026-31", "T 2026 31", "unknown", None)]
    assert [(d["kind"], d["url"]) for d in got[0]["documents"]] == [("package", "https://www.example.ca/media/b/t-2026-28-fuel-tanks.pdf"), ("addendum", "https://www.example.ca/media/a/t-2026-28-fuel-tanks-addendum-1.pdf")]
    assert got[1]["documents"] == [{"url": "https://www.example.ca/media/c/T-2026-31.pdf", "filename": "T-2026-31.pdf", "link_text": "Download", "kind": "package"}]
    assert {r["buyer_name"] for r in got} == {"Town"} and all(r["documents_open"] for r in got)


def test_the_smallest_element_around_decides_each_field_by_itself(spark):
    got = found(spark, """<div>All tenders, last update 2020-01-01 <ul>
      <li>RFQ2026-7 <a href="RFQ2026-7.pdf">RFQ2026-7 Supply of salt</a> Awarded</li>
      <li>RFQ2026-7, closes on 2026-09-02: see the notes of the town and <a href="#notes">what it says there</a></li></ul></div>""")
    assert [(r["closing_text"], r["status_text"], r["status"]) for r in got] == [("2026-09-02", "awarded", "closed")]
    past = found(spark, '<p>T-2026-05 <a href="T-2026-05.pdf">T-2026-05 Bridge repair</a> July 30, 2026')
    assert [(r["status"], r["closing_text"]) for r in past] == [("closed", "July 30, 2026")]
    long = found(spark, f'<li>T-2026-05 <a href="T-2026-05.pdf">T-2026-05 Bridge repair</a> July 30, 2026 {"word " * 200}</li>')
    assert [(r["status"], r["closing_text"]) for r in long] == [("unknown", None)]


def test_titles(spark):
    page = '<a href="T-2026-05-a-b.pdf">click here to get it all</a><a href="/x/T-2026-06.pdf">T-2026-06 first</a><a href="/y/T-2026-06.pdf">T-2026-06 later</a><a href="t-2-1.pdf">x</a><a href="notes.pdf">Notes of RFP 2026 09 for all</a>'
    assert [(r["notice_id"], r["title"]) for r in found(spark, page)] == [("RFP-2026-09", "Notes of RFP 2026 09 for all"), ("T-2026-05", "T 2026 05 A B"), ("T-2026-06", "T-2026-06 first")]


def test_pages_without_notices(spark):
    assert found(spark, "") == [] and found(spark, "<p>nothing</p>") == []
    assert municipal.records(spark.createDataFrame([], PAGES), now()).count() == 0
    deep = "<div>" * 3000 + '<a href="T-2026-05.pdf">T-2026-05 Bridge repair</a>' + "</div>" * 3000
    assert [r["notice_id"] for r in found(spark, deep)] == ["T-2026-05"]
