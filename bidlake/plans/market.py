"""Interactions, histories, features, splits, ranking metrics, contract sizes and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import band
from ..operators import asof, awards, boards, divergence, entities, features, profiles, ranking
from ..operators.features import unit_dot
from ..operators.shared import kept, parts_for, small
from ..operators.trees import sample_forest, tree_scores
from ..sources import releases
from .frames import INTERACTIONS
from .registry import lines_joined, other_engine, query, table


@query("fold_interactions", other_engine(f"WITH {INTERACTIONS} SELECT firm_id, ocid, won, amount, day, buyer_id, category FROM interactions"))
def fold_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = lines_joined(spark, sf_dir)
    rows = raw.select(
        F.col("l_suppkey").alias("firm_id"), F.col("l_orderkey").alias("ocid"), F.col("l_linenumber").alias("pos"), F.col("l_extendedprice").alias("price"), (F.col("l_returnflag") == "R").alias("won"), F.col("l_extendedprice").alias("amount"),
        F.col("o_orderdate").cast("date").alias("day"), F.col("o_custkey").alias("buyer_id"), F.col("p_type").alias("category"),
    )
    return releases.folded(rows, ["firm_id", "ocid"], ["pos", "price"])


@query(
    "competitive_interactions",
    other_engine(f"WITH {INTERACTIONS}, bidders AS (SELECT ocid, count(*) AS bidders FROM interactions GROUP BY ocid HAVING count(*) > 1) SELECT i.firm_id, i.ocid, i.won, b.bidders FROM interactions i JOIN bidders b ON i.ocid = b.ocid"),
)
def competitive_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.competitive(interactions(spark, sf_dir).withColumnRenamed("firm_id", "canonical_id")).select(F.col("canonical_id").alias("firm_id"), "ocid", "won", "bidders")


ENTITIES = f"""{INTERACTIONS},
names AS (SELECT s_suppkey AS firm_id, concat('firm ', CAST(s_suppkey % 40 AS <<STRING||VARCHAR>>)) AS name FROM {{supplier}}),
rivals AS (SELECT DISTINCT a.name FROM (SELECT i.ocid, n.name, n.firm_id FROM interactions i JOIN names n ON i.firm_id = n.firm_id) a
           JOIN (SELECT i.ocid, n.name, n.firm_id FROM interactions i JOIN names n ON i.firm_id = n.firm_id) b ON a.ocid = b.ocid AND a.name = b.name AND a.firm_id < b.firm_id)"""


def resolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    firms = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("firm_id"), F.concat(F.lit("Firm "), (F.col("s_suppkey") % 40).cast("string"), F.lit(" Inc.")).alias("name"))
    return entities.merged(firms, spark.createDataFrame([], "firm_id long, number string"), interactions(spark, sf_dir).select("firm_id", "ocid"))


@query(
    "entity_resolution",
    other_engine(f"WITH {ENTITIES} SELECT n.firm_id, CASE WHEN r.name IS NULL THEN min(n.firm_id) OVER (PARTITION BY n.name) ELSE n.firm_id END AS canonical_id FROM names n LEFT JOIN rivals r ON n.name = r.name"),
)
def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir)[0].select("firm_id", "canonical_id")


@query("blocked_merges", other_engine(f"WITH {ENTITIES} SELECT n.name, count(*) AS firms FROM names n JOIN rivals r ON n.name = r.name GROUP BY n.name"))
def blocked_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir)[1].where("why = 'rivals'").select(F.col("normalized_name").alias("name"), F.col("businesses").alias("firms"))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each firm and order: lines of an order are folded, the first one's amount, category and title stay."""
    raw = lines_joined(spark, sf_dir)
    first = F.min(F.struct("l_linenumber", "l_extendedprice", "p_type", "p_name"))
    rows = raw.groupBy(F.col("l_suppkey").alias("firm_id"), F.col("l_orderkey").alias("ocid")).agg(F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("won"), F.max(F.col("o_orderdate").cast("date")).alias("day"), F.max("o_custkey").alias("buyer_id"), first.alias("f"))
    return rows.select("firm_id", "ocid", "won", "day", "buyer_id", F.col("f.l_extendedprice").alias("amount"), F.col("f.p_type").alias("category"), F.col("f.p_name").alias("title"))


# Strictly before the day: frames end on the day before.
@query(
    "firm_history_asof",
    other_engine(
        f"""WITH {INTERACTIONS},
firsts AS (SELECT firm_id, first_day AS day, count(*) AS n_new FROM (SELECT firm_id, buyer_id, min(day) AS first_day FROM interactions GROUP BY firm_id, buyer_id) x GROUP BY firm_id, first_day),
run AS (SELECT i.firm_id, i.day, count(*) OVER w AS bids, sum(won) OVER w AS wins, min(i.day) OVER w AS first_day, max(i.day) OVER w AS last_day, quantile_cont(amount, 0.5) OVER w AS median_bid, stddev_pop(ln(1 + amount)) OVER w AS spread
        FROM interactions i WINDOW w AS (PARTITION BY i.firm_id ORDER BY i.day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)),
days AS (SELECT DISTINCT * FROM run)
SELECT d.firm_id, d.day, coalesce(bids, 0) AS bids, CAST(coalesce(wins, 0) AS BIGINT) AS wins, (SELECT CAST(coalesce(sum(n_new), 0) AS BIGINT) FROM firsts f WHERE f.firm_id = d.firm_id AND f.day < d.day) AS buyers, first_day, last_day,
  round(median_bid, 4) AS median_bid, round(spread, 4) AS spread FROM days d"""
    ),
)
def firm_history_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = asof.histories(interactions(spark, sf_dir))
    return rows.select("firm_id", "day", "bids", "wins", "buyers", "first_day", "last_day", F.round("median_bid", 4).alias("median_bid"), F.round("spread", 4).alias("spread"))


HISTORY = f"""{INTERACTIONS},
past AS (SELECT * FROM interactions WHERE day < DATE '1999-01-01'),
counts AS (SELECT firm_id, category, count(*) AS n FROM past GROUP BY firm_id, category),
spread AS (SELECT firm_id, sum(CAST(n AS DOUBLE) * n) / (sum(n) * sum(n)) AS concentration, count(*) AS categories FROM counts GROUP BY firm_id),
history AS (SELECT firm_id, count(*) AS bids, sum(won) AS wins, count(DISTINCT buyer_id) AS buyers, quantile_cont(CASE WHEN amount > 0 THEN amount END, 0.5) AS median_amount,
                   stddev_pop(CASE WHEN amount > 0 THEN ln(1 + amount) END) AS spread_amount, max(day) AS last_day, min(day) AS first_day FROM past GROUP BY firm_id)"""
DAY = "1999-01-01"


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions as the features' operators take them."""
    return interactions(spark, sf_dir).drop("title").withColumnsRenamed({"firm_id": "canonical_id", "day": "date", "amount": "bid_amount"}).withColumn("region", F.lit(None).cast("string"))


def history_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The firms' histories before the day; there are no more interactions than lines."""
    return features.histories(featured(spark, sf_dir), F.lit(DAY).cast("date"), parts_for(table(spark, sf_dir, "lineitem")))


@query("firm_history_cutoff", other_engine(f"WITH {HISTORY} SELECT firm_id, bids, CAST(wins AS BIGINT) AS wins, buyers, round(median_amount, 4) AS median_amount, first_day, last_day FROM history"))
def firm_history_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history_of(spark, sf_dir)
    return h.select(F.col("canonical_id").alias("firm_id"), F.col("interactions").alias("bids"), "wins", "buyers", F.round("median_bid", 4).alias("median_amount"), F.col("first_date").alias("first_day"), F.col("last_date").alias("last_day"))


@query(
    "firm_features",
    other_engine(
        f"""WITH {HISTORY} SELECT s.s_suppkey AS firm_id, coalesce(h.bids, 0)::DOUBLE AS bids, round(coalesce(CAST(h.wins AS DOUBLE) / h.bids, 0.0), 6) AS win_rate, round(coalesce(ln(1 + h.median_amount), 0.0), 6) AS log_median, round(coalesce(h.spread_amount, 0.0), 6) AS spread,
  coalesce(date_diff('day', h.last_day, DATE '1999-01-01'), 3650)::DOUBLE AS days_since_last, round(coalesce(c.concentration, 0.0), 6) AS concentration, coalesce(c.categories, 0)::DOUBLE AS categories
  FROM {{supplier}} s LEFT JOIN history h ON s.s_suppkey = h.firm_id LEFT JOIN spread c ON s.s_suppkey = c.firm_id"""
    ),
)
def firm_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    firms = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("canonical_id"))
    found = features.firm_features(firms, history_of(spark, sf_dir), F.lit(DAY).cast("date"))
    r = lambda c, name: F.round(f"firm_{c}", 6).alias(name)
    return found.select(F.col("canonical_id").alias("firm_id"), F.col("firm_interactions").alias("bids"), r("win_rate", "win_rate"), r("log_median_bid", "log_median"), r("bid_spread", "spread"), F.col("firm_days_since_last").alias("days_since_last"), r("category_concentration", "concentration"), F.col("firm_distinct_categories").alias("categories"))


@query(
    "cross_features",
    other_engine(
        f"""WITH {HISTORY}, buyers AS (SELECT firm_id, buyer_id, count(*) AS n FROM past GROUP BY firm_id, buyer_id),
next AS (SELECT * FROM interactions WHERE day >= DATE '1999-01-01' AND day < DATE '1999-04-01')
SELECT i.firm_id, i.ocid, round(coalesce(CAST(c.n AS DOUBLE) / h.bids, 0.0), 6) AS category_share, CASE WHEN c.n IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS category_seen, coalesce(b.n, 0)::DOUBLE AS prior_bids, least(coalesce(b.n, 0), coalesce(h.wins, 0))::DOUBLE AS prior_wins
FROM next i LEFT JOIN history h ON h.firm_id = i.firm_id LEFT JOIN counts c ON c.firm_id = i.firm_id AND c.category = i.category LEFT JOIN buyers b ON b.firm_id = i.firm_id AND b.buyer_id = i.buyer_id"""
    ),
)
def cross_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, day = kept(featured(spark, sf_dir), "interactions"), F.lit(DAY).cast("date")
    pairs = rows.where((F.col("date") >= day) & (F.col("date") < F.lit("1999-04-01").cast("date"))).select("canonical_id", "ocid", "category", "buyer_id", "region", F.lit(None).cast("double").alias("value"))
    found = features.cross_features(pairs, rows, features.histories(rows, day), day)
    return found.select(F.col("canonical_id").alias("firm_id"), "ocid", F.round("cross_category_share", 6).alias("category_share"), F.col("cross_category_seen").alias("category_seen"), F.col("cross_buyer_prior_bids").alias("prior_bids"), F.col("cross_buyer_prior_wins").alias("prior_wins"))


SPLIT = f"""{INTERACTIONS},
train AS (SELECT firm_id, count(*) AS n_train FROM interactions WHERE day < DATE '1999-01-01' GROUP BY firm_id HAVING count(*) >= 5),
test AS (SELECT firm_id, count(*) AS n_test FROM interactions WHERE day >= DATE '1999-01-01' AND day < DATE '1999-07-01' GROUP BY firm_id HAVING count(*) >= 5)"""


@query("temporal_split", other_engine(f"WITH {SPLIT} SELECT t.firm_id, t.n_train, e.n_test FROM train t JOIN test e ON t.firm_id = e.firm_id"))
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.eligible(featured(spark, sf_dir), F.lit(DAY).cast("date"), F.lit("1999-07-01").cast("date")).withColumnRenamed("canonical_id", "firm_id")


RANKED = f"""{SPLIT},
pool AS (SELECT ocid, min(category) AS category, min(buyer_id) AS buyer_id FROM interactions WHERE day >= DATE '1999-01-01' AND day < DATE '1999-07-01' GROUP BY ocid),
eligible AS (SELECT t.firm_id, t.n_train FROM train t JOIN test e ON t.firm_id = e.firm_id),
likes AS (SELECT firm_id, category, CAST(count(*) AS DOUBLE) AS n FROM interactions WHERE day < DATE '1999-01-01' GROUP BY firm_id, category),
pairs AS (SELECT e.firm_id, e.n_train, p.ocid, round(coalesce(l.n, 0.0) / e.n_train, 6) AS score, CASE WHEN i.ocid IS NULL THEN 0 ELSE 1 END AS label
          FROM eligible e CROSS JOIN pool p LEFT JOIN likes l ON l.firm_id = e.firm_id AND l.category = p.category LEFT JOIN interactions i ON i.firm_id = e.firm_id AND i.ocid = p.ocid),
placed AS (SELECT firm_id, n_train, ocid, label, row_number() OVER (PARTITION BY firm_id ORDER BY score DESC, ocid) AS place FROM pairs),
metrics AS (SELECT firm_id, min(n_train) AS n_train, count(*) AS candidates, sum(label) AS positives, CAST(sum(CASE WHEN place <= 10 THEN label ELSE 0 END) AS DOUBLE) / nullif(sum(label), 0) AS recall_10,
            coalesce(1.0 / min(CASE WHEN label = 1 THEN place END), 0.0) AS rr FROM placed GROUP BY firm_id)"""
FROM, TO = "1999-01-01", "1999-07-01"


def split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Eligible firms with n_train, their scores by category, the pool, and the firms' positives in it."""
    raw = lines_joined(spark, sf_dir).where(F.col("o_orderdate").cast("date") < F.lit(TO).cast("date"))
    at = F.struct("l_linenumber", "l_extendedprice")
    rows = raw.groupBy(F.col("l_suppkey").alias("firm_id"), F.col("l_orderkey").alias("ocid")).agg(F.max(F.col("o_orderdate").cast("date")).alias("day"), F.min_by("p_type", at).alias("category"))
    rows = kept(rows, "split")
    old, new = rows.where(F.col("day") < F.lit(FROM).cast("date")), kept(rows.where(F.col("day") >= F.lit(FROM).cast("date")).select("firm_id", "ocid", "category"), "new")
    liked = kept(old.groupBy("firm_id", "category").agg(F.count("*").alias("n")), "liked")
    enough = lambda df, n, name: df.groupBy("firm_id").agg(n.alias(name)).where(F.col(name) >= 5)
    firms = kept(enough(liked, F.sum("n"), "n_train").join(enough(new, F.count("*"), "n_test"), "firm_id").select("firm_id", "n_train"), "eligible")
    scores = liked.join(firms, "firm_id").select("firm_id", "category", F.round(F.col("n") / F.col("n_train"), 6).alias("score"))
    pool = kept(new.groupBy("ocid").agg(F.min("category").alias("category")), "pool")
    return firms, scores, pool, new.select("firm_id", "ocid").join(firms.select("firm_id"), "firm_id", "left_semi")


@query("candidate_pairs", other_engine(f"WITH {RANKED} SELECT firm_id, count(*) AS candidates, CAST(sum(label) AS BIGINT) AS positives FROM pairs GROUP BY firm_id"))
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, pool, positives = split(spark, sf_dir)
    size = pool.agg(F.count("*").alias("candidates"))  # one row
    return positives.groupBy("firm_id").agg(F.count("*").alias("positives")).join(F.broadcast(size), how="cross")


def firm_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    firms, scores, pool, positives = split(spark, sf_dir)
    placed = ranking.metrics_of(pool, scores, positives)
    return placed.join(firms, "firm_id").join(F.broadcast(pool.agg(F.count("*").alias("candidates"))), how="cross")


@query("rank_metrics", other_engine(f"WITH {RANKED} SELECT firm_id, candidates, CAST(positives AS BIGINT) AS positives, CAST(round(recall_10, 6) AS DOUBLE) AS recall_10, CAST(round(rr, 6) AS DOUBLE) AS reciprocal_rank FROM metrics"))
def rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return firm_metrics(spark, sf_dir).select("firm_id", "candidates", "positives", F.round("recall_10", 6).alias("recall_10"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


@query(
    "cohort_metrics",
    other_engine(
        f"""WITH {RANKED} SELECT coalesce(cohort, 'all') AS cohort, count(*) AS firms, CAST(round(avg(recall_10), 6) AS DOUBLE) AS recall_10, CAST(round(avg(rr), 6) AS DOUBLE) AS mrr
FROM (SELECT m.*, CASE WHEN n_train < 20 THEN '5-19' WHEN n_train < 50 THEN '20-49' ELSE '50+' END AS cohort FROM metrics m) x GROUP BY GROUPING SETS ((cohort), ())"""
    ),
)
def cohort_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    cohort = F.when(F.col("n_train") < 20, "5-19").when(F.col("n_train") < 50, "20-49").otherwise("50+")
    rows = firm_metrics(spark, sf_dir).withColumn("cohort", F.explode(F.array(cohort, F.lit("all"))))
    return rows.groupBy("cohort").agg(F.count("*").alias("firms"), F.round(F.avg("recall_10"), 6).alias("recall_10"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"))



# Orders won are awards: a part's type is the trade, buyers and suppliers are dealt to types and regions. The series lacks two quarters.
INDEX = [(f"{y}-Q{q}", 90.0 + 4 * (y - 1995) + 1.5 * q) for y in range(1995, 2000) for q in range(1, 5) if (y, q) not in ((1996, 2), (1998, 4), (1999, 3), (1999, 4))]
SINCE, CUTOFF = "1995-04-01", "1999-01-01"
BUYER_TYPE, REGION, SLUG = "CAST(buyer_id % 5 AS STRING)", "CASE WHEN firm_id % 4 > 0 THEN CAST(firm_id % 4 AS STRING) END", "CASE WHEN ocid % 29 <> 0 THEN category END"
AWARDS = other_engine(
    f"""{INTERACTIONS}, idx(q, v) AS (VALUES {", ".join(f"('{q}', {v})" for q, v in INDEX)}),
won AS (SELECT ocid, firm_id, day, amount, title, {SLUG} AS slug, {BUYER_TYPE} AS buyer_type, {REGION} AS region, least(year(day) || '-Q' || quarter(day), (SELECT max(q) FROM idx)) AS q FROM interactions WHERE won = 1 AND amount BETWEEN 1000 AND 2000000000 AND day >= DATE '{SINCE}'),
awards AS (SELECT won.*, amount * (SELECT arg_max(v, q) FROM idx) / v AS adjusted FROM won JOIN idx USING (q))"""
)
BAND = "CASE WHEN {0} IS NULL OR {0} <= 0 THEN 'unknown' WHEN {0} < 100000 THEN '<$100K' WHEN {0} < 500000 THEN '$100–500K' WHEN {0} < 2000000 THEN '$500K–2M' WHEN {0} < 10000000 THEN '$2–10M' ELSE '>$10M' END"


def awarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = interactions(spark, sf_dir).select("ocid", "firm_id", "day", "won", "amount", "title", F.expr(SLUG).alias("slug"), F.expr(BUYER_TYPE).alias("buyer_type"), F.expr(REGION).alias("region"))
    return awards.corpus(rows, spark.createDataFrame(INDEX, "quarter string, value double"), SINCE)


@query("inflation_adjust", f"WITH {AWARDS} SELECT ocid, firm_id, CAST(floor(adjusted * 100 + 0.370313) AS BIGINT) AS adjusted_cents FROM awards")
def inflation_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return awarded(spark, sf_dir).select("ocid", "firm_id", F.floor(F.col("adjusted") * 100 + 0.370313).alias("adjusted_cents"))


LEVELS = "\nUNION ALL ".join(
    f"SELECT {k} AS level, {', '.join(c if c in keys else f'NULL AS {c}' for c in awards.KEYS[0])}, count(*) AS n, quantile_cont(adjusted, 0.5) AS median FROM {{0}} {'WHERE slug IS NOT NULL' if 'slug' in keys else ''} {'GROUP BY ' + ', '.join(keys) + ' HAVING count(*) >= 12' if keys else ''}"
    for k, keys in enumerate((*awards.KEYS, ()))
)


@query("scale_lookup", f"WITH {AWARDS} SELECT level, slug, buyer_type, region, n, CAST(floor(median * 100 + 0.370313) AS BIGINT) AS median_cents FROM ({LEVELS.format('awards')})")
def scale_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return awards.cells(awarded(spark, sf_dir)).select("level", "slug", "buyer_type", "region", "n", F.floor(F.col("median") * 100 + 0.370313).alias("median_cents"))


# Awards from the cutoff on are notices, of which some have published values, some a model's and some no trade.
PUBLISHED, MODELLED = "CASE WHEN firm_id % 9 = 0 THEN amount * 3 WHEN firm_id % 9 = 1 THEN -1 END", "CASE WHEN firm_id % 7 = 2 THEN amount * 40 END"
ESTIMATES = f"""{AWARDS}, fit AS (SELECT * FROM awards WHERE day < DATE '{CUTOFF}'), cells AS ({LEVELS.format('fit')}),
asked AS (SELECT *, {PUBLISHED} AS published, {MODELLED} AS modelled FROM awards WHERE day >= DATE '{CUTOFF}'),
hit AS (SELECT a.ocid, a.firm_id, min(level) AS level, arg_min(median, level) AS m FROM asked a JOIN cells c ON (level IN (4, 5) OR c.slug = a.slug) AND (level IN (2, 3, 5) OR c.buyer_type = a.buyer_type) AND (level IN (1, 3, 5) OR c.region IS NOT DISTINCT FROM a.region) GROUP BY a.ocid, a.firm_id),
est AS (SELECT a.*, level, m, CASE WHEN title LIKE '%anvil%' AND title NOT LIKE '%red%' THEN '$2–10M' WHEN title LIKE '%red%' AND title NOT LIKE '%anvil%' THEN '<$100K' ELSE 'unknown' END AS pattern FROM asked a LEFT JOIN hit h USING (ocid, firm_id)),
best AS (SELECT ocid, firm_id, adjusted, CASE WHEN published > 0 THEN {BAND.format('published')} WHEN slug IS NOT NULL AND modelled IS NOT NULL THEN {BAND.format('modelled')} WHEN slug IS NOT NULL AND m IS NOT NULL THEN {BAND.format('m')} ELSE pattern END AS band,
  CASE WHEN published > 0 THEN 'published' WHEN slug IS NOT NULL AND coalesce(modelled, m) IS NOT NULL THEN 'estimated_model' WHEN pattern <> 'unknown' THEN 'estimated_pattern' ELSE 'unknown' END AS source,
  CASE WHEN published > 0 THEN 1.0 WHEN slug IS NOT NULL AND modelled IS NOT NULL THEN 0.6 WHEN slug IS NOT NULL AND m IS NOT NULL THEN [0.7, 0.6, 0.6, 0.5, 0.35, 0.3][level + 1] WHEN pattern <> 'unknown' THEN 0.35 ELSE 0.0 END::DOUBLE AS confidence FROM est)"""


def estimated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Notices with their best estimates, and the awards before them."""
    rows = awarded(spark, sf_dir)
    old, new = (rows.where(F.col("day") < F.lit(CUTOFF).cast("date")), rows.where(F.col("day") >= F.lit(CUTOFF).cast("date")))
    asked = new.withColumns({"estimated_value": F.expr(PUBLISHED), "modelled": F.expr(MODELLED)})
    return awards.best_estimates(asked, awards.cells(old), [r"\banvil"], [r"\bred\b"], ("$2–10M", "<$100K")), old


@query("scale_estimate", f"WITH {ESTIMATES} SELECT ocid, firm_id, band, source, confidence FROM best")
def scale_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimated(spark, sf_dir)[0].select("ocid", "firm_id", "band", "source", "confidence")


PLACE = "list_position(['<$100K', '$100–500K', '$500K–2M', '$2–10M', '>$10M'], {0})"
SHARES = "count(*) AS n, round(count(*) FILTER (guess = truth AND truth <> 'unknown') / count(*), 4) AS exact, round(count(*) FILTER (abs({0} - {1}) <= 1) / count(*), 4) AS within_one".format(PLACE.format("guess"), PLACE.format("truth"))


@query(
    "scale_accuracy",
    f"""WITH {ESTIMATES}, usual AS (SELECT band FROM (SELECT {BAND.format('adjusted')} AS band, count(*) AS n, min((day, ocid, firm_id)) AS f FROM fit GROUP BY 1) ORDER BY n DESC, f LIMIT 1),
guesses AS (SELECT 'best' AS guesser, band AS guess, {BAND.format('adjusted')} AS truth FROM best UNION ALL SELECT 'usual', (SELECT band FROM usual), {BAND.format('adjusted')} FROM best) SELECT guesser, {SHARES} FROM guesses GROUP BY guesser""",
)
def scale_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best estimates beside always guessing the most frequent size of the past."""
    best, old = estimated(spark, sf_dir)
    truth = band(F.col("adjusted"))
    usual = awards.usual(old.withColumn("usual", truth), "usual", ["day", "ocid", "firm_id"])  # one row
    tries = (("best", best, F.col("band")), ("usual", best.join(F.broadcast(usual), how="cross"), F.col("usual")))
    parts = [awards.accuracy(rows, guess, truth).withColumn("guesser", F.lit(name)) for name, rows, guess in tries]
    return parts[0].unionByName(parts[1])


LONG_VECTORS = "<<SELECT vec_id, label, pos AS k, CAST(v AS DOUBLE) AS v FROM {embeddings} LATERAL VIEW posexplode(embedding) t AS pos, v||SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM {embeddings}>>"
CENTROIDS = f"long AS ({LONG_VECTORS}), means AS (SELECT label, k, avg(v) AS v FROM long GROUP BY label, k), sizes AS (SELECT label, sqrt(sum(v * v)) AS size FROM means GROUP BY label), centroids AS (SELECT m.label, m.k, m.v / s.size AS v FROM means m JOIN sizes s ON m.label = s.label)"


def vectors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))


@query("centroids", other_engine(f"WITH {CENTROIDS} SELECT label, k, round(v, 6) AS v FROM centroids"))
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = profiles.unit_means(vectors_of(spark, sf_dir).withColumnRenamed("label", "canonical_id"))
    return means.select(F.col("canonical_id").alias("label"), F.posexplode("vector").alias("k", "v")).select("label", F.col("k").cast("long").alias("k"), F.round("v", 6).alias("v"))


@query(
    "cosine_topk",
    other_engine(
        f"""WITH {CENTROIDS}, norms AS (SELECT vec_id, sqrt(sum(v * v)) AS size FROM long GROUP BY vec_id),
dots AS (SELECT l.vec_id, c.label, round(sum(l.v * c.v) / max(n.size), 6) AS cosine FROM long l JOIN centroids c ON l.k = c.k JOIN norms n ON n.vec_id = l.vec_id GROUP BY l.vec_id, c.label)
SELECT label, vec_id, cosine, CAST(place AS BIGINT) AS place FROM (SELECT d.*, row_number() OVER (PARTITION BY label ORDER BY cosine DESC, vec_id) AS place FROM dots d) x WHERE place <= 10"""
    ),
)
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are few, so their centroids go to all machines as arrays; each block of vectors passes on its ten nearest a label."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    means = rows.select("label", F.posexplode("v").alias("k", "x")).groupBy("label", "k").agg(F.avg("x").alias("m"))
    centroids = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda p: p["m"]).alias("c"))
    near = rows.select("vec_id", "v").join(small(centroids, 4096), how="cross").select("label", "vec_id", F.round(unit_dot(F.col("v"), F.col("c")), 6).alias("cosine"))
    order = [F.desc("cosine"), F.col("vec_id")]
    first = near.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(16))).withColumn("n", F.row_number().over(Window.partitionBy("label", "b").orderBy(*order))).where("n <= 10")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy(*order)).cast("long")).where("place <= 10").select("label", "vec_id", "cosine", "place")


INT8 = f"long AS ({LONG_VECTORS}), scales AS (SELECT vec_id, max(abs(v)) / 127 AS scale FROM long GROUP BY vec_id), packed AS (SELECT l.vec_id, l.k, l.v, s.scale, round_even(l.v / s.scale, 0) AS q FROM long l JOIN scales s ON l.vec_id = s.vec_id)"


def there_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, vector, its scale, and what is read back from its eight bits."""
    rows = vectors_of(spark, sf_dir).select("vec_id", "vector", profiles.packed(F.col("vector")).alias("p"))
    return rows.select("vec_id", "vector", F.col("p.scale").alias("scale"), profiles.unpacked(F.col("p.centroid"), F.col("p.scale")).alias("back"))


@query("int8_roundtrip", other_engine(f"WITH {INT8} SELECT vec_id, CAST(sum(q) AS BIGINT) AS sum_q, round(max(abs(v - q * scale)) / max(scale), 4) AS worst_step FROM packed GROUP BY vec_id"))
def int8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.aggregate(F.transform("back", lambda x: F.round(x / F.col("scale")).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    worst = F.array_max(F.zip_with("vector", "back", lambda a, b: F.abs(a - b))) / F.col("scale")
    return there_and_back(spark, sf_dir).select("vec_id", steps.alias("sum_q"), F.round(worst, 4).alias("worst_step"))


@query("quant_divergence", other_engine(f"WITH {INT8} SELECT vec_id, round(1 - sum(v * q) / sqrt(sum(v * v) * sum(q * q)), 6) AS cosine_error FROM packed GROUP BY vec_id"))
def quant_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return there_and_back(spark, sf_dir).select("vec_id", F.round(1 - unit_dot(F.col("vector"), F.col("back")), 6).alias("cosine_error"))


# Labels are firms, and their centroids, in eight bits, rank all vectors anew.
DIVERGENCE = f"""WITH {CENTROIDS}, q AS (SELECT label, k, v, round_even(v * 127 / max(abs(v)) OVER (PARTITION BY label), 0) AS q FROM centroids),
norms AS (SELECT vec_id, sqrt(sum(v * v)) AS size FROM long GROUP BY vec_id), whole AS (SELECT label, sqrt(sum(v * v)) AS nv, sqrt(sum(q * q)) AS nq FROM q GROUP BY label),
s AS (SELECT q.label, l.vec_id, round(sum(l.v * q.v) / any_value(n.size * w.nv), 12) AS e, round(sum(l.v * q.q) / any_value(n.size * w.nq), 12) AS a FROM q JOIN long l ON q.k = l.k JOIN norms n ON n.vec_id = l.vec_id JOIN whole w ON w.label = q.label GROUP BY q.label, l.vec_id),
p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY e DESC, vec_id) AS ep, row_number() OVER (PARTITION BY label ORDER BY a DESC, vec_id) AS ap, max(abs(e - a)) OVER (PARTITION BY label) AS err FROM s),
f AS (SELECT label, count(*) AS n, max(err) AS err, max(abs(ep - ap)) AS shift, bool_or(ep <> ap AND least(ep, ap) <= 10) AS changed FROM p GROUP BY label)"""


def divergence_of(spark: SparkSession, sf_dir: str, factor: float) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    means = rows.select("label", F.posexplode("vector").alias("k", "x")).groupBy("label", "k").agg(F.avg("x").alias("m"))
    firms = means.groupBy(F.col("label").alias("firm_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda p: p["m"]).alias("vector"))
    return divergence.by_firm(firms, rows.select(F.col("vec_id").alias("tender_id"), "vector"), factor)


@query(
    "rank_shifts",
    other_engine(
        DIVERGENCE
        + " SELECT f.label AS firm_id, n AS tenders, round(err, 8) AS max_cosine_error, shift AS max_rank_shift, changed AS changed_first, (SELECT count(*) FROM p x JOIN p y ON x.label = y.label AND x.e - y.e > x.err / 4 AND x.ap > y.ap WHERE x.label = f.label) AS reorderings FROM f"
    ),
)
def rank_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs count from a quarter of the error apart, so that there are some."""
    return divergence_of(spark, sf_dir, 0.25).withColumn("max_cosine_error", F.round("max_cosine_error", 8))


@query(
    "quantisation_report",
    other_engine(
        DIVERGENCE
        + """ SELECT count(*) AS firms, max(n) AS tenders, round(max(err), 8) AS max_cosine_error, max(shift) AS max_rank_shift, round(avg(shift), 4) AS mean_rank_shift, count(*) FILTER (changed) AS firms_with_changed_top10,
(SELECT count(*) FROM p x JOIN p y ON x.label = y.label AND x.e - y.e > 2 * x.err AND x.ap > y.ap) AS material_reorderings FROM f"""
    ),
)
def quantisation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.report(divergence_of(spark, sf_dir, 2.0))


@query("tree_score")
def tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small forest over vectors; rows only, as the walk is not a statement."""
    return table(spark, sf_dir, "embeddings").select("vec_id", tree_scores(F.col("embedding"), sample_forest()).alias("score"))


# Customers' nations lie in provinces, some of them in two; segments are firms.
@query(
    "province_skew",
    """WITH t AS (SELECT c_mktsegment AS segment, n_regionkey AS r FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey),
s AS (SELECT segment, count(*) AS n, count(*) FILTER (r = 0) AS onts, count(*) FILTER (r IN (1, 4)) AS qcs FROM t GROUP BY 1)
SELECT segment, CASE WHEN qcs > onts THEN 'QC' ELSE 'ON' END AS province, round(greatest(onts, qcs) / n, 6) AS share FROM s WHERE onts + qcs > 0""",
)
def province_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = F.get(F.array(*map(F.lit, ("ON", "QC", "ON, QC", "AB", " QC ,CA"))), F.col("n_regionkey"))
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("segment"), there.alias("region"))
    return boards.province_skew(rows, ["segment"]).withColumn("share", F.round("share", 6))
