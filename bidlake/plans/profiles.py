"""Profiles, blockers, descriptions and pages to read over the test tables, by the operators; the other engine's statements are from the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import blockers, census, profiles, requirements, trades
from .features import DAY, RAW, interactions
from .registry import query, table
from .rules import OUTCOME, dealt, said

# A firm has two spellings of its name; lines of parts that have a vector point the way.
TOP = "string_agg({0} || ':' || n, ',' ORDER BY n DESC, {0}) FILTER (place <= 3)"


def firm_profiles(spark: SparkSession, sf_dir: str, most_keys: int) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier")
    first = suppliers.select(F.col("s_suppkey").alias("canonical_id"), F.col("s_name").alias("raw_name"), F.lit(3).alias("observations"))
    other = suppliers.select(F.col("s_suppkey").alias("canonical_id"), F.upper("s_name").alias("raw_name"), (F.col("s_suppkey") % 5).cast("int").alias("observations"))
    names = first.union(other).withColumn("normalized_name", text.firm_name(F.col("raw_name")))
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "embeddings"), F.col("l_partkey") == F.col("vec_id"))
    vectors = lines.select(F.col("l_suppkey").alias("canonical_id"), F.col("o_orderdate").cast("date").alias("date"), F.col("embedding").alias("vector"))
    return profiles.profiles(interactions(spark, sf_dir), names, vectors, F.lit(DAY).cast("date"), most_keys=most_keys)


@query(
    "firm_profiles",
    f"""WITH {RAW}, m AS (SELECT firm, count(*) AS bids, sum(won)::BIGINT AS wins, min(day) AS first, max(day) AS last FROM h GROUP BY firm HAVING count(*) >= 5),
c AS (SELECT firm, {TOP.format('category')} AS top FROM (SELECT firm, category, count(*) AS n, row_number() OVER (PARTITION BY firm ORDER BY count(*) DESC, category) AS place FROM h GROUP BY 1, 2) GROUP BY firm),
b AS (SELECT firm, count(*) AS buyers, sum(n)::BIGINT AS buyer_bids FROM (SELECT firm, buyer, count(*) AS n, row_number() OVER (PARTITION BY firm ORDER BY count(*) DESC, buyer) AS place FROM h GROUP BY 1, 2) WHERE place <= 40 GROUP BY firm),
v AS (SELECT l_suppkey AS firm, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS x FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{embeddings}} ON l_partkey = vec_id WHERE o_orderdate < TIMESTAMP '1999-01-01'),
a AS (SELECT firm, k, avg(x) AS x FROM v GROUP BY 1, 2), u AS (SELECT firm, k, x / sqrt(sum(x * x) OVER (PARTITION BY firm)) AS x FROM a), s AS (SELECT *, max(abs(x)) OVER (PARTITION BY firm) / 127 AS scale FROM u),
q AS (SELECT firm, to_base64(unhex(string_agg(printf('%02x', (round_even(x / scale, 0)::INT + 256) % 256), '' ORDER BY k))) AS centroid, round(any_value(scale), 9) AS centroid_scale FROM s GROUP BY firm)
SELECT firm AS id, CASE WHEN firm % 5 >= 3 THEN upper(s_name) ELSE s_name END AS name, bids, wins, first, last, top AS top_categories, buyers, buyer_bids, centroid, centroid_scale FROM m JOIN c USING (firm) JOIN b USING (firm) LEFT JOIN q USING (firm) JOIN {{supplier}} ON s_suppkey = firm""",
)
def firm_profiles_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty buyers are kept, so that there are firms with more."""
    rows = firm_profiles(spark, sf_dir, 40)
    ordered = F.array_sort(F.transform(F.map_entries("categories"), lambda e: F.struct((-e["value"]).alias("less"), e["key"].alias("key"))))
    top = F.array_join(F.transform(F.slice(ordered, 1, 3), lambda e: F.concat(e["key"], F.lit(":"), (-e["less"]).cast("string"))), ",")
    total = F.aggregate(F.map_values("buyers"), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("id", "name", "bids", "wins", "first", "last", top.alias("top_categories"), F.size("buyers").cast("long").alias("buyers"), total.alias("buyer_bids"), "centroid", F.round("centroid_scale", 9).alias("centroid_scale"))


VALUES, ABLE = ["Fax", "physical copies", None, "email", ""], [["email"], ["email", "portal"], ["mail", "email"], []]


@query(
    "blocker_reasons",
    f"""WITH r AS (SELECT conv_id, turn, substr(text, 1, 40) AS said, length(text) % 3 <> 0 AS quoted, {OUTCOME} AS outcome, {said(VALUES, 'turn')} AS v FROM {{conversations}} WHERE role <> 'system'),
f AS (SELECT conv_id, min(turn) AS turn FROM r WHERE outcome = 'fail' GROUP BY conv_id), t AS (SELECT r.*, lower(CASE WHEN quoted THEN said ELSE '' END || ' ' || said) AS hay, lower(coalesce(v, '')) AS method, {said(ABLE, 'conv_id')} AS able FROM f JOIN r USING (conv_id, turn) WHERE quoted)
SELECT conv_id AS tender_id, 'r' || turn AS req_id, 'Requires ' || CASE WHEN contains(hay, 'fax') OR contains(hay, 'facsimile') OR method = 'fax' THEN 'fax submission' WHEN contains(method, 'physical') OR contains(hay, 'deliver') THEN 'physical delivery' ELSE 'a submission method this firm does not support' END || ' — ' ||
  CASE WHEN conv_id % 4 IN (0, 1) THEN 'this firm submits electronically only' WHEN conv_id % 4 = 2 THEN 'this firm submits by mail and email only' ELSE 'this firm submits by other means only' END || '.' AS reason FROM t""",
)
def blocker_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role <> 'system'").withColumn("tender_id", F.col("conv_id")).withColumn("req_id", F.concat(F.lit("r"), F.col("turn").cast("string")))
    words = F.substring("text", 1, 40)
    decided = requirements.decide(turns.select("tender_id"), turns.select("tender_id", "req_id", F.col("turn").alias("pos"), words.alias("requirement_text"), F.expr(OUTCOME).alias("outcome"), F.lit(False).alias("fuzzy")))
    needs = turns.select("tender_id", "req_id", words.alias("requirement_text"), F.when(F.length("text") % 3 != 0, words).alias("verbatim_quote"), F.lit(1).alias("page_number"), dealt(VALUES, "turn").alias("check_value"))
    found = blockers.first_of_each(decided, needs)
    return found.select("tender_id", "req_id", blockers.reason(F.col("check_value"), F.col("verbatim_quote"), F.col("requirement_text"), dealt(ABLE, "tender_id")).alias("reason"))


SUMS = ["around $2 million", "1,5 M$ par an", "500 000 $", "$750K jobs", "12 thousand", "in Québec, no sum", "ON 3,000,000.", None]
WHERE = ["roads in Toronto", "égouts à Montréal", "on call", "work in ON and QC", "rive-sud", "Londonderry"]
DERIVING = trades.Rules.read({"families": {}, "construction_markers": {"category_normalized": [], "category_raw_keywords": []}, "rules": [
    {"slug": "roads", "priority": 20, "keywords_en": ["road"]}, {"slug": "metal", "priority": 10, "keywords_en": ["bolt", "red ring", "anvil"]}, {"slug": "sewers", "priority": 10, "keywords_fr": ["égout"]},
]})


@query(
    "descriptions_derived",
    f"""WITH t AS (SELECT p_partkey, p_name || ' ' || {said(WHERE, 'p_partkey')} AS words, p_partkey % 6 AS w, p_partkey % 8 AS s, p_name LIKE '%bolt%' OR p_name LIKE '%anvil%' OR p_name LIKE '%red ring%' AS metal FROM {{part}})
SELECT p_partkey, array_to_string(list_filter([CASE WHEN metal AND s <> 7 THEN 'metal' END, CASE WHEN w = 1 AND s <> 7 THEN 'sewers' END, CASE WHEN w = 0 AND s <> 7 THEN 'roads' END], lambda x: x IS NOT NULL), ',') AS slugs,
  CASE WHEN s = 7 THEN '' ELSE array_to_string(list_filter([CASE WHEN w IN (1, 3, 4) OR s = 5 THEN 'QC' END, CASE WHEN w IN (0, 3) OR s = 6 THEN 'ON' END], lambda x: x IS NOT NULL), ',') END AS regions,
  [2000000, 1500000, 500000, 750000, 12000, NULL, NULL, NULL][s + 1]::DOUBLE AS value FROM t""",
)
def descriptions_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" "), dealt(WHERE, "p_partkey"), F.lit(". "), dealt(SUMS, "p_partkey")).alias("description"))
    return trades.derived(parts, DERIVING).select("p_partkey", F.array_join("slugs", ",").alias("slugs"), F.array_join("regions", ",").alias("regions"), "value")


KINDS = ["BUILDING", "MACHINERY", "HOUSEHOLD"]
BAD = [["BUILDING"], ["BUILDING", "nothing", "nothing", "none"], None, []]


@query(
    "firm_problems",
    f"""SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 9 IN (0, 1) THEN 'name is required' END, CASE WHEN c_custkey % 4 = 1 THEN 'trades has values outside the vocabulary: [''nothing'', ''none'']' END, CASE WHEN c_acctbal > 500 THEN 'value_min is greater than value_max' END,
  CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 'past_projects[1].type_slug is outside the vocabulary: ' || c_mktsegment END], lambda x: x IS NOT NULL), '; ') AS problems FROM {{customer}}""",
)
def firm_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    project = lambda slug: F.struct(slug.alias("type_slug"))
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 9 == 0, " ").when(F.col("c_custkey") % 9 != 1, F.col("c_name")).alias("name"), dealt(BAD, "c_custkey").alias("trades"), F.col("c_acctbal").alias("value_min"), F.lit(500.0).alias("value_max"),
        F.array(project(F.lit("")), project(F.col("c_mktsegment"))).alias("past_projects"),
    )
    return profiles.problems(rows, {"trades": KINDS}, KINDS).select("c_custkey", F.array_join("problems", "; ").alias("problems"))


# Pages' urls, some of them changed, are hits of searches, one for each last digit of the page.
HIT = "CASE page_id % 5 WHEN 0 THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/' WHEN 1 THEN 'https://www.linkedin.com/company/' || page_id WHEN 2 THEN replace(url, '/en/', '/services/') WHEN 3 THEN 'no url at all' ELSE url END"


@query(
    "search_pages",
    f"""WITH hits AS (SELECT (page_id // 5) % 10 AS search, page_id AS pos, {HIT} AS url FROM {{pages}}),
s AS (SELECT search, url, min(pos) AS pos, (regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) IN ('', '/'))::INT * 3 + regexp_matches(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '(?i)/(services?|about|projects?|work|realisations?|apropos|a-propos)')::INT * 2 + starts_with(url, 'https')::INT AS score
  FROM hits WHERE starts_with(url, 'http') AND NOT contains(url, 'linkedin.') GROUP BY search, url)
SELECT search, url, score, row_number() OVER (PARTITION BY search ORDER BY score DESC, pos)::INT AS place FROM s QUALIFY place <= 4""",
)
def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "pages").select((F.floor(F.col("page_id") / 5) % 10).alias("search"), F.col("page_id").alias("pos"), F.expr(HIT).alias("url"))
    return census.select_pages(hits, ["search"])


@query(
    "sql_functions",
    """SELECT s_suppkey, 'equipe n°' || s_suppkey AS folded, regexp_replace(trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')), ' +$', '') AS name, CASE WHEN s_acctbal <= 0 THEN 'unknown' WHEN s_acctbal * 100 < 100000 THEN '<$100K' WHEN s_acctbal * 100 < 500000 THEN '$100–500K' ELSE '$500K–2M' END AS band,
  round((3 + 4.0 * (s_suppkey % 3)) / (5 * sqrt(1 + (s_suppkey % 3) * (s_suppkey % 3))), 6)::DOUBLE AS likeness FROM {supplier}""",
)
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions as statements of this library's users call them."""
    text.register(spark)
    table(spark, sf_dir, "supplier").createOrReplaceTempView("suppliers_of_sql_functions")
    return spark.sql(
        """SELECT s_suppkey, fold(concat('  Équipe N°', s_suppkey)) AS folded, normalize_name(concat(s_name, ' Ltée. Inc.')) AS name, band_of(s_acctbal * 100) AS band,
        round(cosine(array(3D, 4D), array(1D, CAST(s_suppkey % 3 AS DOUBLE))), 6) AS likeness FROM suppliers_of_sql_functions"""
    )
