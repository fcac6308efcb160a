"""Quotes and pages, chunks, requirements, verdicts and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fold
from ..operators import quotes
from ..operators.packing import greedy_dedup, pack_pages
from .registry import query, statement, table


# The other engine's own removal of accents is the check.
@query("text_fold", r"SELECT doc_id, md5(trim(regexp_replace(translate(replace(strip_accents(lower(text)), 'ß', 'ss'), '’‘`', ''), '\s+', ' ', 'g'))) AS folded FROM {documents}")
def text_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(fold(F.col("text")).cast("binary")).alias("folded"))


#: Bytes of quotes that go to all machines at once; more are matched in as many blocks as it takes.
QUOTE_BLOCK = 8 << 20
WORDS = 5


def spans(words: str) -> Column:
    """Hashes of each WORDS words in a row; those at the end are of fewer."""
    return F.transform(words, lambda w, k: F.xxhash64(w, *(F.get(words, k + j) for j in range(1, WORDS))))


# A quote's second to sixth word stand whole in a text that holds it, so texts and quotes meet by their hash and are compared afterwards.
# Quotes of fewer words are a stated query set against all rows, in blocks.
@query("quote_verify", "WITH found AS (SELECT b.item_id, min(d.doc_id) AS doc_id, count(*) AS pages FROM {benchmark} b JOIN {documents} d ON contains(lower(d.text), lower(b.text)) GROUP BY b.item_id) SELECT b.item_id, f.doc_id, coalesce(f.pages, 0) AS pages, f.doc_id IS NOT NULL AS verified FROM {benchmark} b LEFT JOIN found f ON f.item_id = b.item_id")
def quote_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("quote"))
    pages = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("page"))
    keyed = quotes.select("*", F.split("quote", r"\s+").alias("w")).select("item_id", "quote", F.when(F.size("w") >= WORDS + 2, F.xxhash64(*(F.get("w", F.lit(k)) for k in range(1, WORDS + 1)))).alias("h"))
    blocks = 1 + (quotes.agg(F.sum(F.octet_length("quote") + 24)).first()[0] or 0) // QUOTE_BLOCK
    parts = [keyed.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) for k in range(blocks)]
    said = pages.select("doc_id", "page", F.split("page", r"\s+").alias("w"))
    met = [said.select("doc_id", "page", F.explode(spans("w")).alias("h")).join(F.broadcast(part.where("h is not null")), "h").where(F.col("page").contains(F.col("quote"))).select("item_id", "doc_id") for part in parts]
    short = [pages.join(F.broadcast(part.where("h is null")), F.col("page").contains(F.col("quote"))).select("item_id", "doc_id") for part in parts]
    found = reduce(DataFrame.union, met + short).distinct().groupBy("item_id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("pages"))
    return quotes.join(found, "item_id", "left").select("item_id", "doc_id", F.coalesce("pages", F.lit(0)).alias("pages"), F.col("doc_id").isNotNull().alias("verified"))


statement(
    "page_repair",
    """SELECT conv_id, turn, CAST(length(concat(text, ' ', coalesce(next_text, ''))) AS BIGINT) AS pair_length FROM (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM {conversations}) x""",
)


@query("chunk_packing")
def chunk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("page"), "text")
    return pack_pages(pages, 600, 1)


@query("requirement_dedup")
def requirement_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("tender"), F.col("turn").alias("pos"), fold(F.col("text")).alias("quote"))
    return greedy_dedup(rows)




# Turns are pages of two files a conversation. A page's quote is its own, runs on into the next page, is of nowhere, or is empty; some name another page.
QUOTE = "CASE turn % 5 WHEN 0 THEN substr(text, 4, 40) WHEN 1 THEN substr(text, greatest(1, length(text) - 14), 15) || ' ' || coalesce(substr(next, 1, 12), '') WHEN 2 THEN 'zzz ' || substr(text, 1, 9) WHEN 3 THEN '  ' ELSE upper(substr(text, 2, 25)) END"
FORM = r"lower(trim(regexp_replace(replace(replace(replace({}, '’', ''''), '–', '-'), '—', '-'), '\s+', ' ', 'g')))"


@query(
    "quotes_located",
    f"""WITH t AS (SELECT conv_id, turn, 'f' || turn % 2 AS file, text, lead(text) OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS next, row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS place FROM {{conversations}}),
p AS (SELECT *, {FORM.format('text')} AS one, {FORM.format("text || ' ' || next")} AS two FROM t), q AS (SELECT conv_id, turn, file, CASE WHEN turn % 4 = 3 THEN turn + 2 ELSE turn END AS claimed, {FORM.format(QUOTE)} AS q FROM t),
m AS (SELECT q.conv_id, q.turn, arg_min(struct_pack(f := p.file, g := p.turn), (p.file <> q.file, CASE WHEN p.file = q.file THEN '' ELSE p.file END, CASE WHEN contains(one, q) THEN 0 ELSE 2 END, p.place)) AS b FROM q JOIN p ON p.conv_id = q.conv_id AND (contains(one, q) OR contains(two, q)) WHERE q <> '' GROUP BY 1, 2)
SELECT q.conv_id AS tender_id, q.turn AS req_id, CASE WHEN q = '' THEN 'empty_quote' WHEN b IS NULL THEN 'quote_not_found' WHEN b.f = file AND b.g = claimed THEN 'verified' ELSE 'page_repaired' END AS status, b.f AS found_file, b.g::VARCHAR AS found_page FROM q LEFT JOIN m ON m.conv_id = q.conv_id AND m.turn = q.turn""",
)
def quotes_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("file", F.concat(F.lit("f"), (F.col("turn") % 2).cast("string")))
    turns = turns.withColumn("next", F.lead("text").over(Window.partitionBy("conv_id", "file").orderBy("turn")))
    asked = turns.select(F.col("conv_id").alias("tender_id"), F.col("turn").alias("req_id"), F.expr(QUOTE).alias("quote"), F.col("file").alias("source_file"), F.when(F.col("turn") % 4 == 3, F.col("turn") + 2).otherwise(F.col("turn")).alias("page"))
    found = quotes.locate(asked, turns.select(F.col("conv_id").alias("tender_id"), "file", F.col("turn").alias("page"), "text"))
    return found.select("tender_id", "req_id", "status", "found_file", "found_page")
