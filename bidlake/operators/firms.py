"""Resolving typed names to firms: exact, then by beginning, then by shared words; more than one candidate is an answer of its own.

index has firm_id, name (as firm_name() makes it), bids and last; asked has the typed texts. Nothing is compared all against all. A name meets
the texts it begins with, and those that begin with it, by equal runs of whole first words. Names that share enough words are found by a
prefix filter: with words ordered from the rarest, two sets at the wanted Jaccard share must share one of a few first ones, so only these are
joined, and whole sets are compared after that. Only the limit most active firms of a name or a beginning can be candidates, so a group limit
leaves those before rows are shuffled, however many firms share it.

Null and blank texts, and those of signs alone, match nothing. Firms with a null or empty name are not in the index. Of equally active
candidates the later last one comes first, then the smaller firm_id; of equally near names the smaller. A firm with several names counts once.
Texts, firms and hits by beginning are written to the shared folder once, as several steps read them; the result reads them from there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import firm_name
from .shared import kept

#: Words that mark a typed text as the name of a company, beside the sign "&".
MARKERS = (
    "inc", "ltee", "ltée", "ltd", "limitee", "limitée", "limited", "corp", "corporation", "senc", "sencrl", "srl", "enr", "cie", "compagnie", "company", "co", "llc", "lp",
    "group", "groupe", "entreprise", "entreprises", "construction", "excavation", "constructions",
)
#: What only a description has.
DESCRIBES = r"\$|\bjobs?\b|\bwe (?:do|build|install|lay)\b"
MOST_WORDS, LIMIT, SHARE = 8, 6, 0.75
LEAST_PREFIX, LEAST_FUZZY = 6, 5


def company_marked(c: Column) -> Column:
    """Whether a text holds a marker as a whole word, or "&"."""
    return c.rlike(rf"(?i)(?<![A-Za-z0-9_])(?:{'|'.join(MARKERS)})(?![A-Za-z0-9_])|&")


def could_be_name(c: Column) -> Column:
    """Whether a text is worth looking up: one to MOST_WORDS words, and nothing that only a description has."""
    normal = firm_name(F.coalesce(c, F.lit("")))
    return (normal != "") & (F.size(F.split(normal, " ")) <= MOST_WORDS) & ~F.coalesce(c, F.lit("")).rlike(f"(?i){DESCRIBES}")


def _heads(words: Column, least: int, most: int) -> Column:
    """Runs of first words shorter than the whole, of least to most words."""
    last = F.least(F.lit(most), F.size(words) - 1)
    return F.when(last >= least, F.transform(F.sequence(F.lit(least), last), lambda n: F.array_join(F.slice(words, 1, n), " "))).otherwise(F.array().cast("array<string>"))


def _busiest(rows: DataFrame, key: str, limit: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("bids"), F.desc_nulls_last("last"), "firm_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("place")


def similar_names(asked: DataFrame, names: DataFrame, share: float = SHARE) -> DataFrame:
    """(asked, name, score): the names (name, words) whose sets of words have at least this Jaccard share with those of asked (asked, words)."""
    both = asked.select(F.lit(True).alias("asks"), F.col("asked").alias("text"), F.array_distinct("words").alias("words"))
    most = asked.agg(F.max(F.size("words"))).first()[0] or 0
    both = both.unionByName(names.select(F.lit(False).alias("asks"), F.col("name").alias("text"), F.array_distinct("words").alias("words")).where(F.size("words") <= math.floor(most / share + 1e-9)))
    token = both.select("asks", "text", F.explode("words").alias("word"))
    rarity = token.where("not asks").groupBy("word").agg(F.count("*").alias("n"))
    ordered = token.join(rarity, "word", "left").groupBy("asks", "text").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))).alias("words"))
    size = F.size("words")
    first = size - F.ceil(size * share - 1e-9).cast("int") + 1
    keyed = ordered.select("asks", "text", F.transform("words", lambda w: w["word"]).alias("words"), F.explode(F.transform(F.slice("words", F.lit(1), first), lambda w: w["word"])).alias("word"))
    left = keyed.where("asks").select("word", F.col("text").alias("asked"), F.col("words").alias("a"))
    right = keyed.where("not asks").select("word", F.col("text").alias("name"), F.col("words").alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    score = shared / (F.size("a") + F.size("b") - shared)
    near = left.join(right, "word").where((F.size("b") >= share * F.size("a") - 1e-9) & (F.size("a") >= share * F.size("b") - 1e-9))
    return near.select("asked", "name", score.alias("score")).where(F.col("score") >= share).distinct()


def lookup(asked: DataFrame, index: DataFrame, limit: int = LIMIT) -> DataFrame:
    """asked, normal, kind (match, ambiguous or none), confidence (exact, prefix or fuzzy) and candidates, the busiest first, of each distinct text."""
    inputs = asked.select("asked").where(F.col("asked").isNotNull()).distinct().withColumn("normal", firm_name(F.col("asked")))
    inputs = kept(inputs, "asked").withColumn("words", F.split("normal", " "))
    firms = index.select("firm_id", "name", "bids", F.col("last").cast("string").alias("last")).where(F.col("name").isNotNull() & (F.col("name") != ""))
    best = kept(_busiest(firms, "name", limit), "firms")
    names = best.select("name").distinct().withColumn("words", F.split("name", " "))
    firm = ["firm_id", "bids", "last"]

    exact = inputs.join(best, F.col("normal") == F.col("name")).select("asked", F.lit(1).alias("tier"), *firm)
    more = inputs.where((F.col("normal") != "") & (F.size("words") <= MOST_WORDS)).join(exact.select("asked").distinct(), "asked", "left_anti")
    begins = more.where((F.length("normal") >= LEAST_PREFIX) & (F.size("words") >= 2))
    longer = _busiest(best.withColumn("head", F.explode(_heads(F.split("name", " "), 2, MOST_WORDS))), "head", limit)
    prefixed = begins.join(longer, F.col("normal") == F.col("head")).select("asked", *firm)
    shorter = begins.select("asked", F.explode(_heads(F.col("words"), 1, MOST_WORDS)).alias("name")).join(best, "name").select("asked", *firm)
    prefixed = kept(prefixed.unionByName(shorter).select("asked", F.lit(2).alias("tier"), *firm), "prefixed")
    fuzzy = more.where(company_marked(F.col("asked")) & (F.length("normal") >= LEAST_FUZZY)).join(prefixed.select("asked").distinct(), "asked", "left_anti")
    nearest = similar_names(fuzzy.select("asked", "words"), names).withColumn("place", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "name"))).where(F.col("place") <= limit)
    worded = nearest.select("asked", "name").join(best, "name").select("asked", F.lit(3).alias("tier"), *firm)

    found = exact.unionByName(prefixed).unionByName(worded).groupBy("asked", "tier", "firm_id").agg(F.max("bids").alias("bids"), F.max("last").alias("last"))
    found = _busiest(found, "asked", limit)
    order = F.array_sort(F.collect_list(F.struct("bids", F.coalesce("last", F.lit("")).alias("last"), "firm_id")), lambda a, b: F.when(a["bids"] != b["bids"], F.signum(b["bids"] - a["bids"]).cast("int")).when(a["last"] != b["last"], F.when(a["last"] > b["last"], -1).otherwise(1)).when(a["firm_id"] < b["firm_id"], -1).when(a["firm_id"] > b["firm_id"], 1).otherwise(0))
    answers = found.groupBy("asked").agg(F.min("tier").alias("tier"), order.alias("found"))
    kind = F.when(F.size("found") == 1, "match").when(F.size("found") > 1, "ambiguous").otherwise("none")
    confidence = F.when(F.col("tier") == 1, "exact").when(F.col("tier") == 2, "prefix").when(F.col("tier") == 3, "fuzzy")
    out = inputs.join(answers, "asked", "left")
    return out.select("asked", "normal", F.when(F.col("found").isNull(), "none").otherwise(kind).alias("kind"), confidence.alias("confidence"), F.coalesce(F.transform("found", lambda x: x["firm_id"]), F.array().cast(f"array<{dict(index.dtypes)['firm_id']}>")).alias("candidates"))
