"""Trained rankers and the size regressor, on Spark's own learners; candidates with sampled negatives; gains by group of features.

Where the usual gradient-boosted ranker learns from lists, the one here learns from single rows (GBTClassifier): Spark has no list loss.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .boards import deterministic_score
from .features import NAMES, group_of

#: What the compact model sees, and what is known only after bids have closed.
COMPACT = ("cross_embedding_similarity", "cross_buyer_prior_bids", "cross_category_share", "cross_region_share")
LEAKY = ("tender_bidder_count",)
SEED = 20260731


def candidates(positives: DataFrame, pool: DataFrame, negatives: int, seed: int = SEED) -> DataFrame:
    """(firm_id, ocid, label): the positives, and for each about `negatives` notices of the pool that are none of the firm's.

    The pool is dealt into as many cells as it has rows; a positive draws cells, and what lies in a cell is a negative. So no pairs of all firms
    and notices are made, and no order of the pool is needed. A firm gets a notice once, however often it is drawn.
    """
    cells = max(pool.count(), 1)
    cell = lambda *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(cells))
    mine = positives.select("firm_id", "ocid").distinct()
    drawn = mine.select("firm_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(negatives)), lambda k: cell(F.col("firm_id"), F.col("ocid"), k))).alias("cell")) if negatives else None
    if drawn is None:
        return mine.withColumn("label", F.lit(1))
    others = drawn.distinct().join(pool.select("ocid").distinct().withColumn("cell", cell(F.col("ocid"))), "cell").select("firm_id", "ocid").distinct().join(mine, ["firm_id", "ocid"], "left_anti")
    return mine.withColumn("label", F.lit(1)).unionByName(others.withColumn("label", F.lit(0)))


def balanced(rows: DataFrame, label: str = "label") -> DataFrame:
    """rows with weight, so that both labels weigh the same."""
    n = rows.groupBy(label).agg(F.count("*").alias("_n"))  # two rows
    total = n.agg(F.sum("_n").alias("_all"), F.count("*").alias("_labels"))
    return rows.join(F.broadcast(n), label).join(F.broadcast(total), how="cross").withColumn("weight", F.col("_all") / (F.col("_labels") * F.col("_n"))).drop("_n", "_all", "_labels")


def fit_compact(train: DataFrame, columns: tuple[str, ...] = COMPACT) -> PipelineModel:
    """Logistic regression over scaled columns with balanced labels."""
    steps = [VectorAssembler(inputCols=list(columns), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), LogisticRegression(featuresCol="x", weightCol="weight", maxIter=100)]
    return Pipeline(stages=steps).fit(balanced(train))


def fit_boosted(train: DataFrame, columns: tuple[str, ...] = NAMES, trees: int = 50, depth: int = 5) -> PipelineModel:
    """Boosted trees over columns; leave LEAKY out for what can be known when a notice is out."""
    steps = [VectorAssembler(inputCols=list(columns), outputCol="x"), GBTClassifier(featuresCol="x", maxIter=trees, maxDepth=depth, stepSize=0.05, minInstancesPerNode=20, seed=SEED)]
    return Pipeline(stages=steps).fit(train)


def scored(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with score, the chance of label 1."""
    return model.transform(rows).select(*rows.columns, vector_to_array("probability")[1].alias("score"))


def with_title(rows: DataFrame, title: str = "title", embedding: str | None = None, dim: int = 0) -> tuple[DataFrame, tuple[str, ...]]:
    """rows with what a size regressor sees of a title: its length, its words, and the numbers of its embedding; and the names of these columns.

    A null title has neither signs nor words; a null or shorter embedding is filled up with zeros.
    """
    text = F.coalesce(title, F.lit(""))
    columns = {"title_signs": F.length(text).cast("double"), "title_words": (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("double")}
    columns |= {f"title_{k}": F.coalesce(F.get(embedding, F.lit(k)).cast("double"), F.lit(0.0)) for k in range(dim if embedding else 0)}
    return rows.withColumns(columns), tuple(columns)


def fit_size(awards: DataFrame, kinds: tuple[str, ...], numbers: tuple[str, ...], amount: str = "amount", trees: int = 50) -> PipelineModel:
    """Boosted trees for log10 of a positive amount, over kinds as indicators and numbers; unseen kinds are one of their own."""
    steps = [
        StringIndexer(inputCols=list(kinds), outputCols=[f"{k}_nth" for k in kinds], handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=[f"{k}_nth" for k in kinds], outputCols=[f"{k}_is" for k in kinds], dropLast=False),
        VectorAssembler(inputCols=[*(f"{k}_is" for k in kinds), *numbers], outputCol="x"), GBTRegressor(featuresCol="x", labelCol="size", maxIter=trees, stepSize=0.1, seed=SEED),
    ]
    rows = awards.where(F.col(amount) > 0).fillna("", list(kinds)).fillna(0.0, list(numbers)).withColumn("size", F.log10(amount))
    return Pipeline(stages=steps).fit(rows)


def sized(model: PipelineModel, rows: DataFrame, kinds: tuple[str, ...], numbers: tuple[str, ...]) -> DataFrame:
    """rows with estimate, in units of the amounts."""
    return model.transform(rows.fillna("", list(kinds)).fillna(0.0, list(numbers))).select(*rows.columns, F.pow(F.lit(10.0), F.col("prediction")).alias("estimate"))


def gains(model: PipelineModel, columns: tuple[str, ...] = NAMES) -> DataFrame:
    """feature, group, gain, group_gain and group_share in percent, by gain; a row a feature."""
    from pyspark.sql import SparkSession

    found = model.stages[-1].featureImportances.toArray()
    rows = SparkSession.active().createDataFrame([(c, group_of(c), float(g)) for c, g in zip(columns, found, strict=True)], "feature string, group string, gain double")
    group, every = F.sum("gain").over(Window.partitionBy("group")), F.sum("gain").over(Window.partitionBy())
    share = F.coalesce(F.round(100.0 * group / F.nullif(every, F.lit(0.0)), 1), F.lit(0.0))
    return rows.select("feature", "group", "gain", group.alias("group_gain"), share.alias("group_share")).orderBy(F.col("gain").desc(), "feature")


def firm_results(rows: DataFrame, k: int = 10, score: Column | None = None) -> DataFrame:
    """firm_id, candidates, positives, recall at k and reciprocal rank, from (firm_id, ocid, label, score); equal scores by ocid.

    A firm's list is sorted in one task: its candidates are its positives and a stated number of negatives for each.
    """
    order = Window.partitionBy("firm_id").orderBy((F.col("score") if score is None else score).desc(), "ocid")
    placed = rows.withColumn("place", F.row_number().over(order))
    hit = F.col("label") == 1
    n = F.count(F.when(hit, 1))
    return placed.groupBy("firm_id").agg(
        F.count("*").alias("candidates"), n.alias("positives"), F.coalesce(F.count(F.when(hit & (F.col("place") <= k), 1)) / F.nullif(n, F.lit(0)), F.lit(0.0)).alias(f"recall_{k}"),
        F.coalesce(1.0 / F.min(F.when(hit, F.col("place"))), F.lit(0.0)).alias("reciprocal_rank"),
    )


#: Models of compared(), by name: how each is fitted and what it sees.
MODELS = ("deterministic", "embedding_only", "compact_linear", "boosted", "boosted_no_leakage")


def compared(train: DataFrame, test: DataFrame, columns: tuple[str, ...] = NAMES, k: int = 10, trees: int = 50) -> DataFrame:
    """model, firms, recall at k and mrr over all test firms, of every model of MODELS fitted on the same candidates.

    train and test have firm_id, ocid, label and the columns. The rule-based score and the similarity alone need no fitting; the last model does
    without what is known only after bids have closed, and is the one that can be used.
    """
    clean = tuple(c for c in columns if c not in LEAKY)
    rule = deterministic_score(F.col("cross_category_seen"), F.col("cross_buyer_prior_bids"), F.col("cross_region_seen"))
    runs = {
        "deterministic": lambda: test.withColumn("score", rule), "embedding_only": lambda: test.withColumn("score", F.col("cross_embedding_similarity")), "compact_linear": lambda: scored(fit_compact(train), test),
        "boosted": lambda: scored(fit_boosted(train, columns, trees), test), "boosted_no_leakage": lambda: scored(fit_boosted(train, clean, trees), test),
    }
    each = [firm_results(runs[name]().select("firm_id", "ocid", "label", "score"), k).withColumn("model", F.lit(name)) for name in MODELS]
    rows = reduce(DataFrame.unionByName, each)
    return rows.groupBy("model").agg(F.count("*").alias("firms"), F.avg(f"recall_{k}").alias(f"recall_{k}"), F.avg("reciprocal_rank").alias("mrr"))
