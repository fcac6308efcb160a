"""Web pages and the census, by its operators; the other engine's statements are written from the rules and from what the pages are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import census
from .registry import query, statement, table

STRIPPED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')"


@query("html_text", f"SELECT page_id, md5(trim({STRIPPED})) AS text_md5 FROM {{pages}}")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(F.trim(F.regexp_replace(census.bare_text(F.col("html")), r"\s+", " ")).cast("binary")).alias("text_md5"))


def menus(spark: SparkSession, sf_dir: str, shapes: tuple[tuple[str, str], ...]) -> DataFrame:
    """The pages, whose menus' links to words of some first letters get another shape: $1 is the word."""
    html = F.col("html")
    for letters, shape in shapes:
        html = F.regexp_replace(html, f'<a href="/([{letters}][A-Za-z]*)">[A-Za-z]+</a>', shape)
    return table(spark, sf_dir, "pages").select("page_id", "url", html.alias("html"))


WORDS = r"""words AS (SELECT page_id, url, regexp_extract(url, '^https?://[^/?#]+') AS host, w, pos, upper(w[1]) AS c FROM (
  SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="/([A-Za-z]+)">[A-Za-z]+</a>', 1)) AS w, generate_subscripts(regexp_extract_all(html, '<a href="/([A-Za-z]+)">[A-Za-z]+</a>', 1), 1) AS pos FROM {pages}))"""

LINKED = (
    ("a-dA-D", '<a href="/tenders/$1?x=1">Bid  opportunities: $1</a>'),
    ("e-hE-H", '<a href="https://sub.bidsandtenders.ca/$1">Budget & tax $1</a>'),
    ("i-oI-O", '<a href="#rfp-$1">tender $1</a> <a href="mailto:tender@$1">tender</a> <a href="../Request-for_Proposal/$1.html">Agenda</a>'),
    ("p-tP-T", '<a href="https://other.example.com/RFP/$1">Career news $1</a>'),
)
WEIGHTS = ", ".join(f"('{term}', {points})" for term, points in census.WEIGHTS)


@query(
    "link_scores",
    f"""WITH {WORDS}, weights(term, points) AS (VALUES {WEIGHTS}),
made AS (SELECT url, pos, w, host, CASE WHEN c <= 'D' THEN '/tenders/' || w || '?x=1' WHEN c <= 'H' THEN 'https://sub.bidsandtenders.ca/' || w WHEN c <= 'O' THEN '../Request-for_Proposal/' || w || '.html' WHEN c <= 'T' THEN 'https://other.example.com/RFP/' || w ELSE '/' || w END AS href,
  CASE WHEN c <= 'D' THEN 'Bid opportunities: ' || w WHEN c <= 'H' THEN 'Budget & tax ' || w WHEN c <= 'O' THEN 'Agenda' WHEN c <= 'T' THEN 'Career news ' || w ELSE w END AS text FROM words),
scored AS (SELECT url, href, text, pos, any_value(host) AS host, coalesce(sum(points), 0) AS score FROM (SELECT *, ' ' || regexp_replace(replace(lower(href), '-', ' '), '[ _]+', ' ', 'g') || ' ' || lower(text) || ' ' AS hay FROM made) m LEFT JOIN weights ON contains(hay, term) GROUP BY url, href, text, pos)
SELECT url, href AS link_end, arg_max(text, (score, -pos)) AS text, CAST(max(score) AS INT) AS score, contains(href, 'bidsandtenders') AS is_platform, NOT starts_with(href, 'http') AS same_host FROM scored WHERE score >= 4 GROUP BY url, href""",
)
def link_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the menus alone are shown, as pages have others that no statement can read; a relative link's end is shown as it was written."""
    best = census.links(menus(spark, sf_dir, LINKED))
    path = F.regexp_replace(F.try_parse_url(F.col("link"), F.lit("PATH")), "^.*(?=/Request-for)", "..")
    end = F.when(~F.col("same_host"), F.col("link")).otherwise(F.concat(path, F.when(F.col("link").endswith("?x=1"), "?x=1").otherwise("")))
    return best.select("url", end.alias("link_end"), "text", F.col("score").cast("int").alias("score"), "is_platform", "same_host").where(F.col("link_end").rlike(r"^(/tenders/|https://sub[.]bids|[.][.]/Req|https://other[.]example[.]com/RFP|/)[A-Za-z]+([?]x=1|[.]html)?$|^(https://other[.]example[.]com/RFP|[.][.]/Request-for_Proposal|/tenders|https://sub[.]bidsandtenders[.]ca)/"))


JUDGED = (
    ("a-dA-D", '<a href="/docs/T-2026-11-$1.pdf">$1</a> <a href="/docs/T-2026-11-$1.pdf">again $1</a>'),
    ("e-gE-G", '<a href="/docs/$1.PDF?v=2">Policy of $1</a>'),
    ("h-hH-H", '<a href="https://www.merx.com/$1/T-2026-40.pdf">$1</a>'),
    ("i-iI-I", '<a href="/$1">sign in to view plan takers</a>'),
    ("u-wU-W", '<a href="/$1.zip">Current opportunities</a>'),
)
PAGE_CLASS = f"""{WORDS}, facts AS (SELECT p.page_id, count(DISTINCT w) FILTER (c BETWEEN 'A' AND 'D') AS t, count(DISTINCT w) FILTER (c BETWEEN 'E' AND 'G') AS p, coalesce(bool_or(c = 'H'), false) AS platform, coalesce(bool_or(c = 'I'), false) AS gated,
  coalesce(bool_or(c BETWEEN 'U' AND 'W'), false) AS other FROM {{pages}} p LEFT JOIN words w USING (page_id) GROUP BY p.page_id),
classes AS (SELECT page_id, CASE WHEN platform THEN 'bidnet_or_other_platform' WHEN t > 0 THEN 'own_site_open' WHEN p > 0 OR other THEN 'own_site_notices' ELSE 'no_procurement_page_found' END AS class, CASE WHEN platform THEN 'merx' END AS platform,
  CASE WHEN platform OR t >= 2 AND t > p AND NOT (gated AND t < 5) THEN 'high' WHEN t > 0 OR p > 0 OR other THEN 'low' END AS confidence, CASE WHEN platform THEN 0 ELSE t END AS n_tender, CASE WHEN platform THEN 0 ELSE p END AS n_policy, gated FROM facts)"""


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census.judge(menus(spark, sf_dir, JUDGED))


@query("page_classify", f"WITH {PAGE_CLASS} SELECT page_id, class, platform, confidence, n_tender, n_policy, gated FROM classes")
def page_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark, sf_dir).select("page_id", "class", "platform", "confidence", F.col("n_tender").cast("long").alias("n_tender"), F.col("n_policy").cast("long").alias("n_policy"), "gated")


DOCUMENTS = (
    ("a-dA-D", '<a href="/x/$1">Bid  package $1</a>'), ("e-hE-H", '<a href="/files/$1.PDF?v=2">$1</a> <a href="/files/$1.PDF?v=2">again</a>'), ("i-oI-O", '<a href="/download/$1">$1</a>'), ("p-zP-Z", '<a href="/other/$1">$1</a>'),
)


@query(
    "document_links",
    f"""WITH {WORDS}, l AS (SELECT page_id, host || CASE WHEN c <= 'D' THEN '/x/' || w WHEN c <= 'H' THEN '/files/' || w || '.PDF?v=2' ELSE '/download/' || w END AS link, min(pos) AS pos FROM words WHERE c <= 'O' GROUP BY 1, 2)
SELECT p.page_id, count(link) AS n, coalesce(string_agg(link, ' ' ORDER BY pos), '') AS links FROM {{pages}} p LEFT JOIN l USING (page_id) GROUP BY p.page_id""",
)
def document_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = menus(spark, sf_dir, DOCUMENTS).select("page_id", census.document_links(F.col("html"), F.col("url")).alias("links"))
    return rows.select("page_id", F.size("links").cast("long").alias("n"), F.array_join("links", " ").alias("links"))


PEOPLE = "CASE WHEN page_id % 11 <> 3 THEN page_id * 37 % 1000 END"
DISTRIBUTION = f"""{PAGE_CLASS}, people AS (SELECT *, {PEOPLE} AS people, page_id NOT IN (1, 7, 20, 33) AS stays FROM classes),
d AS (SELECT class, count(*) AS places, coalesce(sum(people), 0)::BIGINT AS population, count(*) - count(people) AS unmatched, count(*) FILTER (stays) AS kept, coalesce(sum(people) FILTER (stays), 0)::BIGINT AS kept_people FROM people GROUP BY class)"""


def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = classes(spark, sf_dir).select(F.col("page_id").cast("string").alias("slug"), "class", F.expr(PEOPLE).alias("population"))
    return census.distribution(places, ["1", "7", "20", "33"])


@query(
    "municipality_distribution",
    f"""WITH {DISTRIBUTION} SELECT class, places, round(100.0 * places / sum(places) OVER (), 1)::DOUBLE AS share_of_places, population, round(100.0 * population / sum(population) OVER (), 1)::DOUBLE AS share_of_population, unmatched,
  CASE WHEN class = 'own_site_open' THEN kept END AS corrected_places, CASE WHEN class = 'own_site_open' THEN kept_people END AS corrected_population FROM d""",
)
def municipality_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution(spark, sf_dir)


@query(
    "bucket_rollup",
    f"""WITH {DISTRIBUTION}, b(bucket, class) AS (VALUES ('bids_and_tenders', 'bids_and_tenders'), ('unknown', 'no_procurement_page_found'), ('unknown', 'fetch_failed'), ('unknown', 'no_website_listed'), ('unknown', 'robots_disallowed'),
  ('notices_gated', 'own_site_notices'), ('other_platforms', 'biddingo'), ('other_platforms', 'bidnet_or_other_platform'), ('open', 'own_site_open'))
SELECT bucket, coalesce(sum(CASE WHEN class = 'own_site_open' THEN kept_people ELSE population END), 0)::BIGINT AS population, round(100.0 * coalesce(sum(CASE WHEN class = 'own_site_open' THEN kept_people ELSE population END), 0) / (SELECT sum(population) FROM d), 2)::DOUBLE AS share_of_population
FROM b LEFT JOIN d USING (class) GROUP BY bucket""",
)
def bucket_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census.bucketed(distribution(spark, sf_dir))


statement(
    "population_join",
    """WITH roster AS (SELECT c_custkey AS slug, c_mktsegment AS tier, c_nationkey AS place, c_custkey % 10 AS county FROM {customer}),
subdivisions AS (SELECT s_nationkey AS place, s_suppkey % 10 AS county, s_acctbal AS population FROM {supplier}),
unique_place AS (SELECT place, count(*) AS n, min(population) AS population FROM subdivisions GROUP BY place),
in_county AS (SELECT place, county, count(*) AS n, min(population) AS population FROM subdivisions GROUP BY place, county)
SELECT r.slug, CASE WHEN u.n = 1 THEN u.population WHEN k.n = 1 THEN k.population END AS population, CASE WHEN u.n = 1 THEN 'unique' WHEN k.n = 1 THEN 'county' WHEN u.n IS NULL THEN 'missing' ELSE 'ambiguous' END AS rule
FROM roster r LEFT JOIN unique_place u ON u.place = r.place LEFT JOIN in_county k ON k.place = r.place AND k.county = r.county""",
)

# Customers are places; what is due was never checked, is pending, was checked long ago or is of a class that is asked for again.
CHECKED = "CASE WHEN c_custkey % 3 <> 0 THEN make_date(2020 + CAST(c_custkey % 5 AS INT), 1, 1) END"
WEBSITE = "CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 7 <> 1 THEN c_name END"


@query("pending_queue", f"SELECT c_custkey, c_name AS name FROM {{customer}} WHERE coalesce({WEBSITE}, '') <> '' AND ({CHECKED} IS NULL OR {CHECKED} < DATE '2022-01-01' OR c_mktsegment IN ('pending', 'FURNITURE'))")
def pending_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.expr(WEBSITE).alias("website"), F.expr(CHECKED).alias("checked_at"), F.col("c_mktsegment").alias("class"), F.col("c_acctbal").alias("population"))
    return census.pending(places, before=F.lit("2022-01-01").cast("date"), classes=["FURNITURE"]).select("c_custkey", "name")
