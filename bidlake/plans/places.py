"""Populations of a roster over the test tables, by the census operator; the other engine's statement is written from the rules.

Customers are the roster, named after their nation; nations are divisions, and suppliers subdivisions that bear their nation's name and lie in
the division of their key's last two digits. So most names belong to several subdivisions, and the area decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import census
from ..sources import municipal
from .registry import query, table


@query(
    "place_populations",
    """WITH d AS (SELECT lower(n_name) AS key, CAST(n_nationkey AS VARCHAR) AS code, 1000 + n_nationkey AS population FROM {nation}),
s AS (SELECT lower(n_name) AS key, CAST(s_suppkey % 25 AS VARCHAR) AS code, s_suppkey AS pos, s_suppkey * 10 AS population FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey),
r AS (SELECT c_custkey AS slug, lower(n_name) AS key, ['upper', 'single', 'lower'][c_custkey % 3 + 1] AS tier, CAST(c_custkey % 25 AS VARCHAR) AS area FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey),
c AS (SELECT key, count(*) AS n, arg_min(population, pos) AS one FROM s GROUP BY key), k AS (SELECT key, code, arg_min(population, pos) AS inside FROM s GROUP BY key, code)
SELECT r.slug, CASE WHEN tier = 'upper' OR n IS NULL AND tier = 'single' THEN 'division' WHEN n = 1 THEN 'subdivision' WHEN inside IS NOT NULL THEN 'county' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS rule,
  CAST(CASE WHEN tier = 'upper' OR n IS NULL AND tier = 'single' THEN d.population WHEN n = 1 THEN one ELSE inside END AS BIGINT) AS population
FROM r LEFT JOIN d ON d.key = r.key LEFT JOIN c ON c.key = r.key LEFT JOIN k ON k.key = r.key AND k.code = r.area""",
)
def place_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    code = lambda c: c.cast("string")
    divisions = nation.select((-F.col("n_nationkey")).cast("long").alias("pos"), F.col("n_name").alias("name"), F.lit("division").alias("level"), code(F.col("n_nationkey")).alias("code"), (1000 + F.col("n_nationkey")).cast("long").alias("population"))
    suppliers = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    subdivisions = suppliers.select(F.col("s_suppkey").cast("long").alias("pos"), F.col("n_name").alias("name"), F.lit("subdivision").alias("level"), code(F.col("s_suppkey") % 25).alias("code"), (F.col("s_suppkey") * 10).cast("long").alias("population"))
    area = nation.select(F.col("n_nationkey").alias("_area"), F.col("n_name").alias("area"))
    roster = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(area), F.col("c_custkey") % 25 == F.col("_area"), "left")
    roster = roster.select(F.col("c_custkey").alias("slug"), F.col("n_name").alias("name"), F.element_at(F.array(F.lit("upper"), F.lit("single"), F.lit("lower")), (F.col("c_custkey") % 3 + 1).cast("int")).alias("tier"), "area")
    return census.with_population(roster, divisions.unionByName(subdivisions)).select("slug", "rule", "population")


# The menus of the pages become lists of documents: by its first letter a link is a package that closes on a day, an amendment, or awarded.
MENU = (
    ("[a-dA-D][A-Za-z]*", r'<li>T-2026-11 closes on: August 18, 2026 <a href="/docs/T-2026-11-$1.pdf">$2</a></li>'),
    ("[e-hE-H][A-Za-z]*", r'<li>t 2026 11 <b>closing</b> Sept 3 or 2031-01-02 <a href="../docs/t_2026_11-$1-addendum-1.pdf">$2</a></li>'),
    ("[i-oI-O][A-Za-z]*", r'<li><a href="/docs/policy-$1.pdf">RFQ2026-7 for the supply of $2</a> RFQ2026-7 Awarded</li>'),
    ("[p-zP-Z][A-Za-z]*", r'<li><a href="https://www.merx.com/$1/T-2026-40.pdf">T-2026-40 $2</a></li>'),
)


@query(
    "document_lists",
    r"""WITH menu AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+') AS host, url, unnest(regexp_extract_all(html, '<li><a href="/([A-Za-z]+)">[A-Za-z]+</a></li>', 1)) AS w,
  generate_subscripts(regexp_extract_all(html, '<li><a href="/([A-Za-z]+)">[A-Za-z]+</a></li>', 1), 1) AS pos FROM {pages}),
links AS (SELECT page_id, host, url, w, min(pos) AS pos, upper(w[1]) AS c FROM menu GROUP BY ALL),
docs AS (SELECT *, CASE WHEN c BETWEEN 'I' AND 'O' THEN 'RFQ2026-7' ELSE 'T-2026-11' END AS id, CASE WHEN c BETWEEN 'A' AND 'D' THEN 2 WHEN c BETWEEN 'E' AND 'H' THEN 1 ELSE 2 END AS kind,
  CASE WHEN c < 'I' AND length(w) > 12 THEN w WHEN c BETWEEN 'A' AND 'D' THEN 'T 2026 11 ' || upper(w[1]) || lower(w[2:]) WHEN c BETWEEN 'E' AND 'H' THEN 'T 2026 11 ' || upper(w[1]) || lower(w[2:]) || ' Addendum 1' ELSE 'RFQ2026-7 for the supply of ' || w END AS title,
  CASE WHEN c BETWEEN 'A' AND 'D' THEN 'T-2026-11 closes on: August 18, 2026 ' || w WHEN c BETWEEN 'E' AND 'H' THEN 't 2026 11 closing Sept 3 or 2031-01-02 ' || w ELSE 'RFQ2026-7 for the supply of ' || w || ' RFQ2026-7 Awarded' END AS row
  FROM links WHERE c < 'P'),
n AS (SELECT page_id, id, arg_max(title, (kind, length(title), -pos)) AS title, count(*) AS n_documents, arg_min(CASE WHEN c <= 'D' THEN 'August 18, 2026' ELSE '2031-01-02' END, (length(row), row)) AS said FROM docs GROUP BY page_id, id)
SELECT 'p' || page_id || ':' || lower(id) AS source_id, title, n_documents, CASE WHEN id[1] = 'T' THEN said END AS closing_text, CASE WHEN id[1] = 'T' AND said[1] = '2' THEN 'open' ELSE 'closed' END AS status,
  CASE WHEN id[1] = 'T' THEN CASE WHEN said[1] = '2' THEN TIMESTAMP '2031-01-02' ELSE TIMESTAMP '2026-08-18' END END AS closing_date FROM n""",
)
def document_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    for words, shape in MENU:
        html = F.regexp_replace(html, f'<li><a href="/({words})">([A-Za-z]+)</a></li>', shape)
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("slug"), F.lit("Town").alias("buyer_name"), "url", html.alias("html"), F.lit(True).alias("documents_open"))
    found = municipal.records(pages, F.lit("2027-01-01 00:00:00").cast("timestamp"))
    return found.select("source_id", "title", F.size("documents").cast("long").alias("n_documents"), "closing_text", "status", F.col("closing_date").cast("timestamp_ntz").alias("closing_date"))
