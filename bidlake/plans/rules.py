"""Vocabularies, sizes, verdicts and labels over the test tables, by the operators. Wordings are dealt to rows by their keys; the other engine's
statements apply the rules to the same wordings, written anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize
from ..operators import awards, requirements, sinks
from .registry import query, table


def dealt(values: list, key: str) -> Column:
    """The value of a row by its key."""
    column = F.lit(None)
    for k, v in enumerate(values):
        column = F.when(F.col(key) % len(values) == k, F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list) else F.lit(v)).otherwise(column)
    return column


def said(values: list, key: str) -> str:
    """The same for the other engine."""
    text = lambda v: "NULL" if v is None else f"[{', '.join(map(text, v))}]" if isinstance(v, list) else "'" + v.replace("'", "''") + "'"
    return f"CASE {key} % {len(values)} {' '.join(f'WHEN {k} THEN {text(v)}' for k, v in enumerate(values))} END"


RAW = ["*CNST", "Public  works", "SRVTGD", "Services Professionnels", "Service de conciergerie", "*GD", "Biens divers", "", None, "a mystery", "Génie civil", "Bâtiment"]
TITLES = ["Road work", "broader review", "HVAC units", "sewer-line", "re_paving", "office chairs", None]
CODES = [["72101500"], ["UNSPSC-30.11"], ["81100000"], [], ["7", "2-2"]]
PLAIN = "strip_accents(lower(coalesce({}, '')))"


@query(
    "category_normalize",
    rf"""WITH t AS (SELECT o_orderkey, {PLAIN.format(said(RAW, "o_orderkey"))} AS raw, {PLAIN.format(said(TITLES, "o_orderkey"))} AS title, list_transform({said(CODES, "o_orderkey")}, lambda x: regexp_replace(x, '[^0-9]', '', 'g')[1:2]) AS codes FROM {{orders}})
SELECT o_orderkey, CASE WHEN regexp_matches(raw, 'cnst|\bworks\b|genie civil|batiment') THEN 'construction' WHEN contains(raw, 'services professionnels') THEN 'professional_services' WHEN regexp_matches(raw, '\bsrvtgd\b|service') THEN 'services' WHEN regexp_matches(raw, '\bgd\b|biens') THEN 'goods'
  WHEN list_has_any(codes, ['72', '30']) OR regexp_matches(title, '\b(road|hvac|sewer|paving)\b') THEN 'construction' ELSE 'other' END AS category FROM t""",
)
def category_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    of = lambda values: dealt(values, "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", normalize.category(of(RAW), none, of(TITLES), none, of(CODES)).alias("category"))


STATES = ["Open", "Ouvert aux soumissions", "CANCELLED", "Annulé et adjugé", "Awarded", "Contrat adjugé", "Planned", "planifié", "unplanned", "Expiré", "", None, "Publié"]


@query(
    "status_normalize",
    rf"""WITH t AS (SELECT o_orderkey, o_orderdate < TIMESTAMP '1998-08-02' AS past, {PLAIN.format(said(STATES, "o_orderkey"))} AS raw FROM {{orders}}),
s AS (SELECT *, CASE WHEN raw IN ('cancelled', 'annule et adjuge') THEN 'cancelled' WHEN raw IN ('awarded', 'contrat adjuge') THEN 'awarded' WHEN raw IN ('planned', 'planifie') THEN 'planned' WHEN raw IN ('open', 'ouvert aux soumissions', 'publie') THEN 'open' WHEN raw = 'expire' THEN 'closed' ELSE 'unknown' END AS said FROM t)
SELECT o_orderkey, CASE WHEN past AND said IN ('open', 'planned', 'unknown') THEN 'closed' ELSE said END AS status FROM s""",
)
def status_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("1998-08-01 23:59:59").cast("timestamp")
    return table(spark, sf_dir, "orders").select("o_orderkey", normalize.status(dealt(STATES, "o_orderkey"), F.col("o_orderdate").cast("timestamp"), now).alias("status"))


PLACES = ["Ontario", "Québec, Nouvelle-Écosse", "ON/QC", "across Canada", "Newfoundland and Labrador", "onward", "", None, "CANADA - BC", "Nationwide: Île-du-Prince-Édouard"]
WHERE = [None, "MB", "", "Yukon; ab"]
NAMES = ", ".join(f"('{name}', '{code}')" for name, code in normalize.PROVINCES.items())


@query(
    "region_normalize",
    f"""WITH t AS (SELECT o_orderkey, {PLAIN.format(said(PLACES, "o_orderkey"))} || ' ' || {PLAIN.format(said(WHERE, "o_orderkey"))} AS said FROM {{orders}}), names(name, code) AS (VALUES {NAMES}),
codes AS (SELECT DISTINCT said, code FROM (SELECT DISTINCT said FROM t), names WHERE contains(said, name) OR list_contains(regexp_split_to_array(said, '[^a-z]+'), lower(code))),
lists AS (SELECT said, string_agg(code, ',' ORDER BY code) AS codes FROM codes GROUP BY said)
SELECT o_orderkey, coalesce(codes, CASE WHEN contains(said, 'canada') OR contains(said, 'national') OR contains(said, 'nationwide') THEN 'CA' END) AS region FROM t LEFT JOIN lists USING (said)""",
)
def region_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", normalize.provinces(dealt(PLACES, "o_orderkey"), dealt(WHERE, "o_orderkey")).alias("region"))


BUYERS = ["City of Guelph", "Toronto District School Board", "CISSS de Laval", "Université Laval, hôpital", "Ville de Québec", "Ministry of Roads", "", None, "Township hospital"]


@query(
    "buyer_type_alias",
    rf"""WITH t AS (SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN 'municipal' WHEN 1 THEN 'education' WHEN 2 THEN 'health' WHEN 3 THEN 'education' WHEN 4 THEN 'municipal' WHEN 8 THEN 'health' ELSE CASE WHEN c_mktsegment = 'BUILDING' THEN 'unknown' ELSE lower(c_mktsegment) END END AS kind FROM {{customer}})
SELECT c_custkey, kind AS buyer_type, CASE kind WHEN 'health' THEN 'hospital' WHEN 'education' THEN 'school_board' WHEN 'municipal' THEN 'municipal' WHEN 'unknown' THEN NULL ELSE 'other' END AS preferred FROM t""",
)
def buyer_type_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    default = F.when(F.col("c_mktsegment") == "BUILDING", "unknown").otherwise(F.lower("c_mktsegment"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", normalize.buyer_type(dealt(BUYERS, "c_custkey"), default).alias("buyer_type"))
    return rows.withColumn("preferred", normalize.preferred_buyer(F.col("buyer_type")))


LARGE, SMALL = [r"(?<![a-z0-9])thing", r"(?<![a-z0-9])lich", r"phase [0-9]+"], [r"(?<![a-z0-9])(?:idiot|token|elle)(?![a-z0-9])"]


@query(
    "pattern_bands",
    r"""SELECT band, count(*) AS n FROM (SELECT CASE WHEN large AND NOT small THEN '>$10M' WHEN small AND NOT large THEN '<$100K' ELSE 'unknown' END AS band
  FROM (SELECT regexp_matches(replace(strip_accents(lower(text)), 'ß', 'ss'), '(^|[^a-z0-9])(thing|lich)|phase [0-9]+') AS large, regexp_matches(replace(strip_accents(lower(text)), 'ß', 'ss'), '(^|[^a-z0-9])(idiot|token|elle)($|[^a-z0-9])') AS small FROM {documents}) x) y GROUP BY band""",
)
def pattern_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = awards.pattern_band(F.col("text"), LARGE, SMALL, (">$10M", "<$100K"))
    return table(spark, sf_dir, "documents").select(band.alias("band")).groupBy("band").agg(F.count("*").alias("n"))


# Turns of a conversation are a tender's requirements; system turns are none, so some tenders have none.
OUTCOME = "CASE WHEN length(text) % 7 = 0 THEN 'fail' WHEN length(text) % 5 = 0 THEN 'unknown' WHEN length(text) % 13 <> 0 THEN 'pass' END"


@query(
    "qualification_verdict",
    f"""WITH o AS (SELECT conv_id, 'r' || turn AS id, min(turn) AS pos, arg_min(trim(text[1:18]), turn) AS text, arg_min(coalesce({OUTCOME}, 'unknown'), turn) AS outcome, arg_min(length(text) % 11 = 0, turn) AS fuzzy FROM {{conversations}} WHERE role <> 'system' GROUP BY conv_id, turn),
t AS (SELECT DISTINCT conv_id FROM {{conversations}}),
n AS (SELECT t.conv_id, count(id) AS mandatory, count(*) FILTER (outcome = 'pass') AS passed, coalesce(bool_or(fuzzy), false) AS fuzzy, coalesce(list(id || ' (' || text || ')' ORDER BY pos, id) FILTER (outcome = 'fail'), []) AS f, coalesce(list(id || ' (' || text || ')' ORDER BY pos, id) FILTER (outcome = 'unknown'), []) AS u
      FROM t LEFT JOIN o USING (conv_id) GROUP BY t.conv_id),
d AS (SELECT *, CASE WHEN len(f) > 0 THEN f ELSE u END AS said, CASE WHEN len(f) > 0 THEN 'Do not bid: ' ELSE 'Manual review required: ' END AS head FROM n)
SELECT conv_id AS tender_id, CASE WHEN mandatory = 0 THEN 'review' WHEN len(f) > 0 THEN 'no_bid' WHEN len(u) > 0 THEN 'review' ELSE 'bid' END AS verdict, CASE WHEN mandatory = 0 OR len(u) >= greatest(2, mandatory // 2) THEN 'low' WHEN fuzzy THEN 'medium' ELSE 'high' END AS confidence,
  mandatory, passed, len(f) AS failed, len(u) AS uncertain,
  CASE WHEN mandatory = 0 THEN 'No requirements extracted; manual review is required.' WHEN len(said) = 0 THEN 'Bid: the profile satisfies every extracted mandatory requirement.' ELSE head || array_to_string(said[1:3], '; ') || CASE WHEN len(said) > 3 THEN ' and ' || (len(said) - 3) || ' more' ELSE '' END || '.' END AS rationale FROM d""",
)
def qualification_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("tender_id", F.col("conv_id"))
    outcomes = turns.where("role <> 'system'").select("tender_id", F.concat(F.lit("r"), F.col("turn").cast("string")).alias("req_id"), F.col("turn").alias("pos"), F.substring("text", 1, 18).alias("requirement_text"), F.expr(OUTCOME).alias("outcome"), (F.length("text") % 11 == 0).alias("fuzzy"))
    found = requirements.decide(turns.select("tender_id"), outcomes)
    return found.select("tender_id", "verdict", "confidence", "mandatory", "passed", F.col("failed").cast("long").alias("failed"), F.col("uncertain").cast("long").alias("uncertain"), "rationale")


@query(
    "precision_at_k",
    """WITH ranked AS (SELECT CASE WHEN quality = 1 THEN 'relevant' WHEN toxic = 1 THEN 'irrelevant' WHEN l.doc_id % 2 = 0 THEN 'marginal' END AS label, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS place FROM {documents} LEFT JOIN {labels} l USING (doc_id)),
few AS (SELECT * FROM ranked WHERE place <= 50 AND label IS NOT NULL)
SELECT coalesce(lang, 'all') AS cohort, count(*) AS labelled, count(*) FILTER (label = 'relevant') AS relevant, count(*) FILTER (label = 'marginal') AS marginal, count(*) FILTER (label = 'irrelevant') AS irrelevant, round(count(*) FILTER (label = 'relevant') / count(*), 6) AS precision_at_k FROM few GROUP BY GROUPING SETS ((lang), ())""",
)
def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    label = F.when(F.col("quality") == 1, "relevant").when(F.col("toxic") == 1, "irrelevant").when(F.col("labelled_id") % 2 == 0, "marginal")
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").withColumn("labelled_id", F.col("doc_id")), "doc_id", "left")
    ranked = rows.select("doc_id", "lang", label.alias("label"), F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    each = sinks.precision(ranked, 50, ["lang"]).withColumnRenamed("lang", "cohort").unionByName(sinks.precision(ranked, 50).withColumn("cohort", F.lit("all")))
    return each.withColumn("precision_at_k", F.round("precision_at_k", 6))


# Parts are requirements of six fields, beside three profiles.
FIELDS, OPERATORS = ["certification", "bonding_capacity", "insurance_cgl", "region", "submission_method", "other"], ["==", "in", ">=", "!="]
CERTIFICATES, SUMS, PLACED, WAYS = ["COR", "ISO 9001", "", None, "x1"], ["1,000,000", "2 million", "10%", "", "500k"], ["Ontario", "quebec", "", None, "Yukon"], ["email", "fax", "hard copy", "as stated", ""]
HELD = [["cor ", "Other"], [], ["iso 9001"]]
ABLE, OWN = [["email", "portal"], ["courier"], []], [["ontario", "Quebec"], ["yukon"], []]


@query(
    "requirement_rules",
    f"""WITH t AS (SELECT p_partkey AS k, {said(FIELDS, 'p_partkey')} AS field, {said(OPERATORS, 'p_size')} AS op, {said(CERTIFICATES, 'p_size')} AS cert, [1000000, 2000000, NULL, NULL, 500000][p_size % 5 + 1] AS needed, lower({said(PLACED, 'p_size')}) AS place,
  [['email'], ['fax'], ['in_person', 'mail', 'physical'], CASE WHEN p_partkey % 4 < 2 THEN ['portal'] ELSE [] END, []][p_size % 5 + 1] AS wanted, p_partkey // 6 % 3 AS who, [NULL, 1500000, 400000, 5000000][p_partkey // 6 % 4 + 1] AS held, p_partkey % 31 <> 7 AS checkable FROM {{part}}),
u AS (SELECT *, [['cor', 'other'], [], ['iso 9001']][who + 1] AS certs, [['email', 'portal'], ['mail', 'physical', 'in_person'], []][who + 1] AS able, [['ontario', 'quebec'], ['yukon'], []][who + 1] AS regions FROM t)
SELECT k AS req_id, CASE WHEN NOT checkable THEN 'unknown' WHEN field = 'certification' THEN CASE WHEN coalesce(cert, '') = '' THEN 'unknown' WHEN list_contains(certs, lower(cert)) THEN 'pass' ELSE 'fail' END
  WHEN field IN ('bonding_capacity', 'insurance_cgl') THEN CASE WHEN needed IS NULL OR held IS NULL THEN 'unknown' WHEN held >= needed THEN 'pass' ELSE 'fail' END
  WHEN field = 'region' THEN CASE WHEN coalesce(place, '') = '' THEN 'unknown' WHEN list_contains(regions, place) THEN 'pass' ELSE 'fail' END
  WHEN field = 'submission_method' THEN CASE WHEN len(wanted) = 0 OR op = '>=' THEN 'unknown' WHEN op = '!=' THEN CASE WHEN len(list_filter(able, lambda x: NOT list_contains(wanted, x))) > 0 THEN 'pass' ELSE 'fail' END WHEN list_has_any(able, wanted) THEN 'pass' ELSE 'fail' END
  ELSE 'unknown' END AS outcome FROM u""",
)
def requirement_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    field, who, none = dealt(FIELDS, "p_partkey"), F.floor(F.col("p_partkey") / 6), F.array().cast("array<string>")
    value = F.when(field == "certification", dealt(CERTIFICATES, "p_size")).when(field == "region", dealt(PLACED, "p_size")).when(field == "submission_method", dealt(WAYS, "p_size")).otherwise(dealt(SUMS, "p_size"))
    held = F.get(F.array(F.lit(None), F.lit(1.5e6), F.lit(4e5), F.lit(5e6)), (who % 4).cast("int"))
    pairs = table(spark, sf_dir, "part").withColumn("who", who).select(
        F.col("p_partkey").alias("req_id"), field.alias("check_field"), dealt(OPERATORS, "p_size").alias("check_operator"), value.alias("check_value"), none.alias("check_values"), (F.col("p_partkey") % 31 != 7).alias("machine_checkable"),
        F.when(F.col("p_partkey") % 4 < 2, "bids come through MERX").otherwise("see the terms").alias("requirement_text"), F.lit("").alias("verbatim_quote"), dealt(HELD, "who").alias("certifications"), held.alias("bonding_capacity"), held.alias("cgl_limit"),
        F.lit(None).cast("double").alias("auto_limit"), dealt(OWN, "who").alias("regions"), dealt(ABLE, "who").alias("submission_capabilities"),
    )
    return requirements.evaluate_rules(pairs).select("req_id", "outcome")


# Turns are asked for by six ids a tender; every other turn is a judgment of one of eight, so some are missing, some twice there, some of no asked id.
SAID, WHY, PHASED = ["satisfied", " Not_Satisfied", "maybe", None], ["because", " ", None, "see 3"], ["contract_condition", "Bid_Phase_Mandatory ", "nonsense", None, "not_a_requirement"]


@query(
    "requirement_judgments",
    f"""WITH a AS (SELECT DISTINCT conv_id, 'r' || turn % 6 AS id FROM {{conversations}} WHERE role <> 'system'), j AS (SELECT conv_id, 'r' || turn % 8 AS id, turn, {said(SAID, 'turn // 2')} AS v, {said(WHY, 'turn // 2')} AS w, lower(trim({said(PHASED, 'turn')})) AS p FROM {{conversations}} WHERE turn % 2 = 0),
f AS (SELECT conv_id, id, arg_min(struct_pack(v := v, w := w), turn) AS j FROM j GROUP BY 1, 2), p AS (SELECT conv_id, id, arg_max(p, turn) AS p FROM j WHERE p IN ('contract_condition', 'bid_phase_mandatory', 'not_a_requirement') GROUP BY 1, 2)
SELECT a.conv_id AS tender_id, a.id AS req_id, CASE WHEN lower(trim(j.v)) IN ('satisfied', 'not_satisfied') THEN lower(trim(j.v)) ELSE 'uncertain' END AS verdict, CASE WHEN f.id IS NULL THEN 'No valid judgment was returned.' ELSE coalesce(nullif(trim(j.w), ''), 'The model did not provide a rationale.') END AS rationale,
  CASE WHEN f.id IS NULL THEN 'defaulted' WHEN j.v IS NULL OR lower(trim(j.v)) IN ('satisfied', 'not_satisfied') THEN 'explicit' ELSE 'coerced' END AS source, coalesce(p.p, 'bid_phase_mandatory') AS phase FROM a LEFT JOIN f ON f.conv_id = a.conv_id AND f.id = a.id LEFT JOIN p ON p.conv_id = a.conv_id AND p.id = a.id""",
)
def requirement_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumns({"tender_id": F.col("conv_id"), "half": F.floor(F.col("turn") / 2)})
    of = lambda n: F.concat(F.lit("r"), (F.col("turn") % n).cast("string")).alias("req_id")
    asked = turns.where("role <> 'system'").select("tender_id", of(6)).distinct()
    judged = turns.where("turn % 2 = 0").select("tender_id", of(8), F.col("turn").alias("pos"), dealt(SAID, "half").alias("verdict"), dealt(WHY, "half").alias("rationale"), dealt(PHASED, "turn").alias("phase"))
    found = requirements.with_phases(requirements.with_judgments(asked, judged), judged)
    return found.select("tender_id", "req_id", "verdict", "rationale", "source", "phase")
