"""Firm identifiers that are one business: by registration numbers they share, then by equal names unless they ever bid against each other.

Numbers link identifiers in chains, so their components are found by passing smallest labels over shared numbers and jumping to labels of labels;
rounds grow with the logarithm of a chain, and each is written to the shared folder. Rivalry needs no pairs of firms: a name is held apart
where one procurement has two businesses of that name, and a component that names made is taken apart again where one has two of its businesses.

Rows are dealt by counted rows before they are joined with bids or grouped, so no task's groups grow with the input; bids are dealt by firm or business and procurement.

Null or empty numbers and names link nothing. Repeated rows change nothing. Identifiers that only the bids or only the numbers know are left out;
firms without bids are never rivals. Labels are the smallest identifiers. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import firm_name
from .shared import dealt, dropped, kept, parts_for

MOST_ROUNDS = 60


def linked(members: DataFrame) -> DataFrame:
    """(id, component) of members (id, key): the smallest id that is reached over shared keys."""
    members = kept(members.where(F.col("key").isNotNull()).select("id", "key").distinct(), "members")
    labels = kept(members.select("id", F.col("id").alias("component")).distinct(), "labels")
    for _ in range(MOST_ROUNDS):
        of_key = members.join(labels, "id").groupBy("key").agg(F.min("component").alias("m"))
        of_id = members.join(of_key, "key").groupBy("id").agg(F.min("m").alias("m"))
        step = labels.join(of_id, "id")
        jump = labels.select(F.col("id").alias("m"), F.col("component").alias("far"))
        new = kept(step.join(jump, "m", "left").select("id", F.least("component", "m", F.coalesce("far", "m")).alias("component"), F.col("component").alias("was")), "labels")
        moved = new.where("component != was").limit(1).count()
        dropped(labels)
        labels = new.select("id", "component")
        labels.kept_path = new.kept_path
        if not moved:
            dropped(members)
            return labels
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")


def common_names(seen: DataFrame, order: list[str]) -> DataFrame:
    """firm_id and its most frequent name of seen (firm_id, name); of equally frequent ones that seen first, by the columns of order."""
    each = seen.where(F.col("firm_id").isNotNull() & (F.trim("name") != "")).groupBy("firm_id", F.trim("name").alias("name")).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    return each.groupBy("firm_id").agg(F.min_by("name", F.struct(-F.col("n"), F.col("first"), F.col("name"))).alias("name"))


def _by(key: str, a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """a joined with b on key, in n parts at least, whatever the session's shuffles make."""
    return dealt(a, n, key).join(dealt(b, n, key), key)


def _two(rows: DataFrame, key: str, n: int) -> DataFrame:
    """key values of rows (key, business, ocid), dealt in n parts, that have two businesses on one procurement."""
    met = rows.select(key, "business", "ocid").repartition(n, key, "ocid").groupBy(key, "ocid").agg(F.min("business").alias("a"), F.max("business").alias("b"))
    return met.where("a != b").select(key).distinct()


def merged(firms: DataFrame, numbers: DataFrame, bids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and what is held apart for review.

    firms has firm_id and name, numbers firm_id and number, bids firm_id and ocid. Entities: firm_id, normalized_name, canonical_id, merge_rule
    (shared_number and name_no_rivalry where such a merge gave the firm more company, else identifier) and observations. Held apart: normalized_name
    and businesses, how many share it, with why: rivals of that name, or rivals that a chain of names would have joined.
    """
    few, many = parts_for(firms), parts_for(bids)
    firms = firms.select("firm_id", F.nullif(firm_name(F.col("name")), F.lit("")).alias("normalized_name")).repartition(few, "firm_id").groupBy("firm_id").agg(F.min("normalized_name").alias("normalized_name"))
    firms = kept(firms, "firms")
    registered = linked(firms.select("firm_id").join(numbers.where(F.trim(F.col("number").cast("string")) != ""), "firm_id").select(F.col("firm_id").alias("id"), F.col("number").cast("string").alias("key")))
    firms = kept(firms.join(registered.withColumnRenamed("id", "firm_id"), "firm_id", "left").withColumn("business", F.coalesce("component", "firm_id")).drop("component"), "businesses")
    took = kept(_by("firm_id", bids.where("ocid is not null").select("firm_id", "ocid"), firms.select("firm_id", "business"), many).select("business", "ocid").repartition(many, "business", "ocid").distinct(), "took")

    named = firms.where("normalized_name is not null").select("normalized_name", "business").repartition(few, "normalized_name", "business").distinct()
    shared = kept(named.join(named.groupBy("normalized_name").agg(F.count("*").alias("businesses")).where("businesses > 1"), "normalized_name"), "shared")
    rivals = kept(_two(_by("business", shared, took, many), "normalized_name", many), "rivals")
    free = kept(shared.join(rivals, "normalized_name", "left_anti"), "free")
    joined = linked(free.select(F.col("business").alias("id"), F.col("normalized_name").alias("key"))).withColumnRenamed("id", "business")
    broken = kept(_two(_by("business", joined, took, many), "component", many), "broken")
    whole = joined.join(broken, "component", "left_anti")

    counts = bids.where("ocid is not null").select("firm_id").repartition(many, "firm_id").groupBy("firm_id").agg(F.count("*").alias("observations"))
    several = firms.select("business").repartition(few, "business").groupBy("business").agg(F.count("*").alias("members"))
    out = firms.join(whole, "business", "left").join(several, "business").join(counts, "firm_id", "left")
    rule = F.when(F.col("component").isNotNull(), "name_no_rivalry").when(F.col("members") > 1, "shared_number").otherwise("identifier")
    entities = out.select("firm_id", "normalized_name", F.coalesce("component", "business").alias("canonical_id"), rule.alias("merge_rule"), F.coalesce("observations", F.lit(0)).alias("observations"))
    chained = free.join(joined.join(broken, "component", "left_semi").select("business"), "business", "left_semi").select("normalized_name", "businesses").distinct()
    apart = shared.join(rivals, "normalized_name", "left_semi").select("normalized_name", "businesses").distinct().withColumn("why", F.lit("rivals")).unionByName(chained.withColumn("why", F.lit("chained_rivals")))
    return entities, apart
