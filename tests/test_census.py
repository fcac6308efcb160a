"""The census and the rankers on literal frames."""

import pytest
from pyspark.sql import functions as F

from bidlake.operators import census, rankers


def value(spark, expression, text):
    return spark.createDataFrame([(text,)], "v string").select(expression(F.col("v")).alias("v")).first().v


@pytest.mark.parametrize(("name", "want"), [("Hamilton, City of", "hamilton-city"), ("Frontenac, County of", "frontenac-county"), ("Halton, Regional Municipality of", "halton-region"), ("Val-Côté", "val-cote"), ("", "unnamed")])
def test_slugs(spark, name, want):
    assert value(spark, census.place_slug, name) == want


def test_names(spark):
    assert value(spark, census.name_forms, "Greater Sudbury / Grand Sudbury") == ["greater sudbury / grand sudbury", "greater sudbury", "grand sudbury"]
    assert value(spark, census.name_forms, "Blue Mountains (T)") == ["blue mountains"]
    assert value(spark, census.name_forms, "Mattice-Val CÃ´tÃ©, Township of") == ["mattice-val cote", "mattice val cote"]
    assert value(spark, census.name_forms, None) == []
    assert value(spark, census.repaired, "Ã alone") == "Ã alone"


def test_links(spark):
    html = """<a href="/bids-and-tenders">Bids and Tenders</a><a href='/bids-and-tenders'>Tender</a><a href="#tender">Tender</a><a href="mailto:tender@x.ca">tender</a>
    <a href="https://x.bidsandtenders.ca/m">Tenders</a><a href="/budget">Budget and purchasing</a><a href="http://[bad">tender</a><a>tender</a><a href="/rfp">RFP</a>"""
    rows = census.links(spark.createDataFrame([("https://www.town.ca/home", html), ("https://empty.ca", None)], "url string, html string")).orderBy(F.col("score").desc(), F.length("link")).collect()
    assert [(r.link, r.score, r.is_platform, r.same_host) for r in rows] == [("https://www.town.ca/bids-and-tenders", 28, False, True), ("https://www.town.ca/rfp", 14, False, True), ("https://x.bidsandtenders.ca/m", 14, True, False)]
    assert rows[0].text == "Bids and Tenders"


def judged(spark, *pages):
    rows = spark.createDataFrame([(f"https://t.ca/{i}", h) for i, h in enumerate(pages)], "url string, html string")
    return [r for r in census.judge(rows).orderBy("url").collect()]


def test_pages(spark):
    tender = "<a href='/f/RFP-2026-0{}.pdf'>Package</a>"
    policy = "<a href='/f/policy{}.pdf'>Purchasing policy</a>"
    out = judged(
        spark, tender.format(1) + tender.format(2), tender.format(1), tender.format(1) + tender.format(2) + "Vendor registration", "".join(map(tender.format, range(1, 6))) + "Vendor registration", policy.format(1),
        "<p>Closing date: May 1</p>", "<p>nothing</p><img src='/media/x.png'>", policy.format(1) + "<a href='https://t.merx.com/x'>Go</a>", "<p>we use Biddingo</p>", tender.format(1) * 2, None,
    )
    assert [(r["class"], r.confidence, r.platform, r.n_tender) for r in out if r.url in [f"https://t.ca/{i}" for i in range(10)]] == [
        ("own_site_open", "high", None, 2), ("own_site_open", "low", None, 1), ("own_site_open", "low", None, 2), ("own_site_open", "high", None, 5), ("own_site_notices", "low", None, 0), ("own_site_notices", "low", None, 0),
        ("no_procurement_page_found", None, None, 0), ("bidnet_or_other_platform", "high", "merx", 0), ("biddingo", "high", "biddingo", 0), ("own_site_open", "low", None, 1),
    ]
    by = {r.url: r for r in out}
    assert by["https://t.ca/6"].system == "media-hash-cms" and by["https://t.ca/0"].documents == ["https://t.ca/f/RFP-2026-01.pdf", "https://t.ca/f/RFP-2026-02.pdf"]
    assert by["https://t.ca/10"]["class"] == "no_procurement_page_found"


def test_verdicts(spark):
    sites = [(s, f"https://{s}.ca") for s in ("open", "plat", "robots", "gone", "hub", "path", "nothing", "away", "unseen")] + [("none", " "), ("null", None)]
    docs = "<a href='/RFP-2026-01.pdf'>a</a><a href='/RFP-2026-02.pdf'>b</a>"
    crawl = [
        ("https://open.ca", None, 200, None, True, "<a href='/gone-tender'>Tender</a><a href='/tenders-page'>Tenders list</a><a href='/third-tender'>Current tenders of ours</a>"), ("https://open.ca/tenders-page", None, 200, None, True, docs),
        ("https://open.ca/gone-tender", None, 404, None, True, None), ("https://plat.ca", None, 200, None, True, "<a href='/tenders'>Tenders</a><a href='https://p.biddingo.com/x'>bid here: tenders</a>"),
        ("https://robots.ca", None, None, "no", False, None), ("https://gone.ca", None, 403, None, True, None), ("https://hub.ca", None, 200, None, True, "<a href='/business'>Doing Business</a>"),
        ("https://hub.ca/business", None, 200, None, True, "<a href='/business/tender'>Tender</a>"), ("https://hub.ca/business/tender", None, 200, None, True, docs), ("https://path.ca", "https://www.path.ca/", 200, None, True, ""),
        ("https://www.path.ca/tenders", None, 200, None, True, "nothing of the kind"), ("https://www.path.ca/procurement", None, 200, None, True, "<p>Tender notices</p>"), ("https://nothing.ca", None, 200, None, True, "<p>x</p>"),
        ("https://away.ca", None, 200, None, True, "<a href='/tenders'>Tenders</a>"), ("https://away.ca/tenders", "https://a.merx.com/t", 302, census.REDIRECTED, True, None),
    ]
    rows = census.verdicts(spark.createDataFrame(sites, "slug string, website string"), spark.createDataFrame(crawl, "url string, final_url string, status int, error string, robots_ok boolean, html string")).collect()
    assert {r.slug: (r["class"], r.confidence, r.platform, r.procurement_url) for r in rows} == {
        "open": ("own_site_open", "high", None, "https://open.ca/tenders-page"), "plat": ("biddingo", "high", "biddingo.com", None), "robots": ("robots_disallowed", None, None, None), "gone": ("fetch_failed", None, None, None),
        "hub": ("own_site_open", "high", None, "https://hub.ca/business/tender"), "path": ("own_site_notices", "low", None, "https://www.path.ca/procurement"), "nothing": ("no_procurement_page_found", None, None, None),
        "away": ("bidnet_or_other_platform", "high", "merx.com", None), "unseen": ("no_procurement_page_found", None, None, None), "none": ("no_website_listed", None, None, None), "null": ("no_website_listed", None, None, None),
    }


def test_populations(spark):
    places = [(1, "Hamilton", "division", "25", 569353), (2, "Hamilton", "subdivision", "25", 569000), (3, "Hamilton", "subdivision", "14", 11059), (4, "Northumberland", "division", "14", 89365), (5, "Ajax", "subdivision", "18", 126666), (6, "Toronto", "division", "20", 2794356), (7, "Bare", "subdivision", "20", None)]
    roster = [("h-city", "Hamilton, City of", "single", "Hamilton"), ("h-town", "Hamilton, Township of", "lower", "Northumberland"), ("h-else", "Hamilton", "single", "Nowhere"), ("n", "Northumberland, County of", "upper", None), ("ajax", "Ajax", "lower", None), ("t", "Toronto", "single", None), ("low", "Toronto", "lower", None), ("x", None, None, None)]
    out = census.with_population(spark.createDataFrame(roster, "slug string, name string, tier string, area string"), spark.createDataFrame(places, "pos int, name string, level string, code string, population long"))
    assert {r.slug: (r.population, r.rule) for r in out.collect()} == {
        "h-city": (569000, "county"), "h-town": (11059, "county"), "h-else": (None, "ambiguous"), "n": (89365, "division"), "ajax": (126666, "subdivision"), "t": (2794356, "division"), "low": (None, "missing"), "x": (None, "missing"),
    }


def test_distribution_and_queue(spark):
    rows = spark.createDataFrame([("a", "own_site_open", 60), ("b", "own_site_open", 20), ("c", "biddingo", 20), ("d", "fetch_failed", None)], "slug string, class string, population long")
    out = census.distribution(rows, ["b"])
    got = {r["class"]: (r.places, r.share_of_places, r.population, r.share_of_population, r.unmatched, r.corrected_population) for r in out.collect()}
    assert got == {"own_site_open": (2, 50.0, 80, 80.0, 0, 60), "biddingo": (1, 25.0, 20, 20.0, 0, None), "fetch_failed": (1, 25.0, 0, 0.0, 1, None)}
    assert [(r.bucket, r.population, r.share_of_population) for r in census.bucketed(out).collect()] == [("bids_and_tenders", 0, 0.0), ("unknown", 0, 0.0), ("notices_gated", 0, 0.0), ("other_platforms", 20, 20.0), ("open", 60, 60.0)]
    assert census.distribution(rows.limit(0)).collect() == []
    queue = spark.createDataFrame([("a", "w", None, "pending", 5), ("b", "w", "2026-01-01", "open", None), ("c", "", None, "pending", 9), ("d", "w", "2026-03-01", "open", 7), ("e", "w", "2026-01-01", "pending", None)], "name string, website string, checked_at string, class string, population long")
    names = lambda **how: [r.name for r in census.pending(queue, **how).collect()]
    assert names() == ["a", "e"] and names(resume=False) == ["d", "a", "b", "e"] and names(before=F.lit("2026-02-01")) == ["a", "b", "e"] and names(classes=["open"]) == ["d", "a", "b", "e"]


def test_candidates_and_rankers(spark):
    pool = spark.range(200).select(F.col("id").alias("ocid"))
    positives = spark.createDataFrame([(f, o) for f in range(6) for o in range(f * 10, f * 10 + 10)], "firm_id long, ocid long")
    rows = rankers.candidates(positives, pool, 5)
    got = {(r.firm_id, r.ocid, r.label) for r in rows.collect()}
    assert {(f, o) for f, o, label in got if label} == {(r.firm_id, r.ocid) for r in positives.collect()} and len(got) == rows.count() > 200
    assert got == {(r.firm_id, r.ocid, r.label) for r in rankers.candidates(positives.repartition(7), pool.repartition(3), 5).collect()}
    assert rankers.candidates(positives, pool, 0).count() == 60
    x = rows.withColumns({"cross_a": F.col("label") + F.rand(1) / 4, "tender_b": F.rand(2)})
    for model in (rankers.fit_compact(x, ("cross_a", "tender_b")), rankers.fit_boosted(x, ("cross_a", "tender_b"), trees=5)):
        assert all(r.recall_10 == 1.0 and r.reciprocal_rank == 1.0 and r.positives == 10 for r in rankers.firm_results(rankers.scored(model, x)).collect())
    first = rankers.gains(rankers.fit_boosted(x, ("cross_a", "tender_b"), trees=5), ("cross_a", "tender_b")).first()
    assert first.feature == "cross_a" and first.group == "cross" and first.group_share > 90
    awards = spark.createDataFrame([(k, float(n), 10.0 ** (3 + (k == "b"))) for k in "ab" for n in range(20)] + [(None, None, -1.0)], "kind string, n double, amount double")
    model = rankers.fit_size(awards, ("kind",), ("n",), trees=5)
    sizes = rankers.sized(model, spark.createDataFrame([("a", 3.0), ("b", 4.0), ("zzz", None)], "kind string, n double"), ("kind",), ("n",)).collect()
    assert 900 < sizes[0].estimate < 1100 and 9000 < sizes[1].estimate < 11000 and sizes[2].estimate > 0


def test_document_links_of_pages(spark):
    page = """<a href="/files/A.PDF?x=1">one</a><a href="/files/A.PDF?x=1">again</a><a href="docs/b.zip">two</a><a href="/page">Bid  package here</a><a href="/download/9">x</a><a href="/about">About</a><a href="http://[bad/x.pdf">y</a>"""
    rows = spark.createDataFrame([(1, page), (2, None), (3, "")], "i int, html string").withColumn("url", F.lit("https://a.ca/t/"))
    got = {r.i: list(r.d) for r in rows.select("i", census.document_links(F.col("html"), F.col("url")).alias("d")).collect()}
    assert got == {1: ["https://a.ca/files/A.PDF?x=1", "https://a.ca/t/docs/b.zip", "https://a.ca/page", "https://a.ca/download/9"], 2: [], 3: []}


def test_runs_with_their_places(spark):
    places = spark.createDataFrame([("a", "Ajax", "own_site_open", "low"), ("b", "Barrie", "own_site_open", "high"), ("c", "Aurora", "x", None)], "slug string, name string, class string, confidence string")
    runs = spark.createDataFrame([("a", "parsed"), ("c", "failed"), ("b", "parsed"), ("z", "parsed")], "slug string, status string")
    assert [r.slug for r in census.run_report(runs, places).collect()] == ["b", "a", "c"]
