"""The named queries and, side by side, their statements for an independent SQL engine."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import parts_for

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
EITHER = re.compile(r"<<(.*?)\|\|(.*?)>>", re.DOTALL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_described(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Lines with their parts, in as many parts as the lines make, and how many; so no task's rows grow with the input."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    n = parts_for(lines)
    return lines.repartition(n, "l_partkey").join(parts.repartition(n, "p_partkey"), F.col("l_partkey") == F.col("p_partkey")), n


def lines_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their orders and parts, those of an order together, in parts like those of lines_described."""
    (described, n), orders = lines_described(spark, sf_dir), table(spark, sf_dir, "orders")
    return described.repartition(n, "l_orderkey").join(orders.repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))


def statement(name: str, sql: str) -> None:
    """One statement for both engines. {table} names a table; <<a||b>> is a in Spark and b in the other engine."""
    used = [t for t in TABLES if f"{{{t}}}" in sql]
    here = EITHER.sub(lambda m: m[1], sql)
    ORACLE_SQL[name] = re.sub(r"\{(\w+)\}", r"\1", EITHER.sub(lambda m: m[2], sql))
    QUERIES[name] = lambda spark, sf_dir: spark.sql(here, **{t: table(spark, sf_dir, t) for t in used})


def other_engine(sql: str) -> str:
    """The text of a statement that is the other engine's alone."""
    return EITHER.sub(lambda m: m[2], sql)


def query(name: str, oracle: str | None = None):
    """Registers a function of (spark, sf_dir); oracle is the statement for the other engine."""

    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = re.sub(r"\{(\w+)\}", r"\1", oracle)
        return f

    return add


from . import boards, cards, census, documents, domain, features, lookups, market, matching, packages, places, profiles, rules, streams  # noqa: E402, F401
