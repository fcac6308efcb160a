"""Firms by typed names and firms that are one, over the test tables, each with a statement of its own for the other engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import firm_name
from ..operators import entities, firms
from ..operators.shared import kept
from .registry import lines_described, query, table

# Parts stand for firms: what they are called has five words, which many share, and a size for the number of bids.
RAW = "p_name || ' ' || replace(p_brand, '#', ' ') || ' ' || p_type"
TYPED = f"""CASE p_partkey % 7 WHEN 0 THEN {RAW} || ' Ltée. Inc.' WHEN 1 THEN p_name WHEN 2 THEN {RAW} || ' of the west' WHEN 3 THEN split_part({RAW}, ' ', 2) || ' ' || replace(p_brand, '#', ' ') || ' ' || p_type || ' inc'
  WHEN 4 THEN {RAW} || ' we do all the jobs that there are' WHEN 5 THEN 'Group ' || p_type || ' & ' || p_name || ' ' || replace(p_brand, '#', ' ') ELSE p_type || ' ' || p_name END"""


@query(
    "firm_lookup",
    rf"""WITH idx AS (SELECT p_partkey AS firm_id, trim(regexp_replace(lower({RAW}), '[^a-z0-9]+', ' ', 'g')) AS name, p_size AS bids FROM {{part}}),
typed AS (SELECT DISTINCT {TYPED} AS asked FROM {{part}}),
a AS (SELECT asked, regexp_replace(trim(regexp_replace(replace(lower(asked), 'é', 'e'), '[^a-z0-9]+', ' ', 'g')), '( (ltee|inc))+$', '') AS normal, regexp_matches(lower(asked), '\b(inc|group)\b|&') AS marked FROM typed),
w AS (SELECT *, string_split(normal, ' ') AS words FROM a),
n AS (SELECT name, string_split(name, ' ') AS words FROM (SELECT DISTINCT name FROM idx)),
exact AS (SELECT asked, name, 1 AS tier FROM w JOIN n ON w.normal = n.name),
rest AS (SELECT * FROM w WHERE len(words) <= 8 AND asked NOT IN (SELECT asked FROM exact)),
pre AS (SELECT asked, name, 2 AS tier FROM rest JOIN n ON starts_with(n.name, normal || ' ') OR starts_with(normal, n.name || ' ') WHERE length(normal) >= 6 AND len(rest.words) >= 2),
sim AS (SELECT asked, name, len(list_intersect(rest.words, n.words)) / len(list_distinct(rest.words || n.words)) AS score FROM rest JOIN n ON len(list_intersect(rest.words, n.words)) >= 0.75 * len(list_distinct(rest.words || n.words))
        WHERE marked AND length(normal) >= 5 AND asked NOT IN (SELECT asked FROM pre)),
fuz AS (SELECT asked, name, 3 AS tier FROM sim QUALIFY row_number() OVER (PARTITION BY asked ORDER BY score DESC, name) <= 6),
c AS (SELECT asked, tier, firm_id, row_number() OVER (PARTITION BY asked ORDER BY bids DESC, firm_id) AS place FROM (FROM exact UNION ALL FROM pre UNION ALL FROM fuz) JOIN idx USING (name)),
t AS (SELECT asked, min(tier) AS tier, string_agg(firm_id, ',' ORDER BY place) AS candidates, count(*) AS n FROM c WHERE place <= 6 GROUP BY asked)
SELECT a.asked, normal, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'match' ELSE 'ambiguous' END AS kind, CASE tier WHEN 1 THEN 'exact' WHEN 2 THEN 'prefix' WHEN 3 THEN 'fuzzy' END AS confidence, coalesce(candidates, '') AS candidates
FROM a LEFT JOIN t ON a.asked = t.asked""",
)
def firm_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    index = parts.select(F.col("p_partkey").alias("firm_id"), firm_name(F.expr(RAW)).alias("name"), F.col("p_size").alias("bids"), F.lit(None).cast("date").alias("last"))
    return firms.lookup(parts.select(F.expr(TYPED).alias("asked")), index).withColumn("candidates", F.array_join(F.col("candidates").cast("array<string>"), ","))


# A supplier's brands stand for firms. Each shares its name with a few; numbers make stars of ten, some of which share a member.
FIRM = "l_suppkey * 100 + CAST(replace(p_brand, 'Brand#', '') AS INT)"
ENTITIES = f"""WITH RECURSIVE bids AS (SELECT DISTINCT {FIRM} AS f, l_orderkey AS o FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey),
seen AS (SELECT {FIRM} AS f, count(*) AS n FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey GROUP BY 1),
firms AS (SELECT f, 'firm ' || (f * 7 % 977) AS name, n FROM seen),
numbers AS (SELECT f, f // 40 AS k FROM firms WHERE f % 4 = 0 UNION SELECT f, f // 40 + 1 FROM firms WHERE f % 28 = 0),
near AS (SELECT DISTINCT a.f, b.f AS g FROM numbers a JOIN numbers b USING (k)),
reach AS (SELECT f, f AS g FROM firms UNION SELECT r.f, n.g FROM reach r JOIN near n ON r.g = n.f),
biz AS (SELECT f, min(g) AS b FROM reach GROUP BY f),
named AS (SELECT DISTINCT name, b FROM firms JOIN biz USING (f)),
took AS (SELECT DISTINCT b, o FROM bids JOIN biz USING (f)),
rival AS (SELECT name FROM named JOIN took USING (b) GROUP BY name, o HAVING count(*) > 1),
free AS (SELECT * FROM named WHERE name NOT IN (SELECT name FROM rival) AND name IN (SELECT name FROM named GROUP BY name HAVING count(*) > 1)),
kin AS (SELECT DISTINCT x.b, y.b AS c FROM free x JOIN free y USING (name)),
far AS (SELECT b, b AS c FROM free UNION SELECT r.b, k.c FROM far r JOIN kin k ON r.c = k.b),
comp AS (SELECT b, min(c) AS c FROM far GROUP BY b),
broken AS (SELECT c FROM comp JOIN took USING (b) GROUP BY c, o HAVING count(*) > 1),
whole AS (SELECT * FROM comp WHERE c NOT IN (SELECT c FROM broken))"""


def entities_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines, n = lines_described(spark, sf_dir)
    bids = kept(lines.select(F.expr(FIRM).alias("firm_id"), F.col("l_orderkey").alias("ocid")), "bids")
    bidders = kept(bids.select("firm_id").repartition(n, "firm_id").distinct(), "bidders")
    names = bidders.withColumn("name", F.concat(F.lit("Firm "), (F.col("firm_id") * 7 % 977).cast("string"), F.lit(" Ltée")))
    star = F.floor(F.col("firm_id") / 40)
    numbers = names.where("firm_id % 4 = 0").select("firm_id", star.alias("number")).union(names.where("firm_id % 28 = 0").select("firm_id", star + 1))
    return entities.merged(names, numbers, bids)


@query(
    "entity_merge",
    ENTITIES
    + """ SELECT f AS firm_id, name AS normalized_name, coalesce(w.c, b) AS canonical_id, n AS observations,
CASE WHEN w.c IS NOT NULL THEN 'name_no_rivalry' WHEN (SELECT count(*) FROM biz z WHERE z.b = biz.b) > 1 THEN 'shared_number' ELSE 'identifier' END AS merge_rule FROM firms JOIN biz USING (f) LEFT JOIN whole w USING (b)""",
)
def entity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities_of(spark, sf_dir)[0]


@query(
    "entity_review",
    ENTITIES
    + """ SELECT name AS normalized_name, count(*) AS businesses, CASE WHEN name IN (SELECT name FROM rival) THEN 'rivals' ELSE 'chained_rivals' END AS why FROM named
WHERE name IN (SELECT name FROM rival) OR name IN (SELECT name FROM free JOIN comp USING (b) JOIN broken USING (c)) GROUP BY name""",
)
def entity_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities_of(spark, sf_dir)[1]
