"""A training corpus from documents: five stages, each over all that the one before kept.

Rows with null, empty or letterless texts go in the first stage, whatever their doc_id. Each row is judged on its own text, so null and
repeated doc_ids pass like others; of rows that share doc_id and text one stays. Texts of any length are read whole. Columns other than
doc_id, text, lang, source and n_chars are carried through by all stages but the last. An empty table gives an empty corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bidlake.llm import bpe, decontaminate, langid, minhash, pii
from bidlake.llm.common import Scratch, dropped_after
from bidlake.llm.queries import tokenizer_path


#: Similarity of shingles, in percent, from which documents are near-duplicates.
NEAR_PERCENT = 80


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in no learned language go: those without letters, and those most of whose letters no training text has."""
    return langid.keep_known(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, linked at four fifths of their shingles of five words, the document with the smallest id stays."""
    return minhash.keep_one(docs, NEAR_PERCENT)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it are replaced in the texts; n_chars follows."""
    return pii.sanitise(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus: doc_id, lang, source, n_tokens, ids and the digests of the ids and of the text decoded from them."""
    return bpe.tokenised(docs, tokenizer_path())


STAGES = [("language_id", known_languages), ("near_dedup", one_of_each), ("decontamination", no_benchmark), ("personal_data", no_personal_data), ("bpe", tokens)]

#: Not expressible in SQL (trained classifier, MinHash, BPE); tests hold it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written to the shared folder and read again as the next one's; what a stage read is then dropped."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = []
    for name, stage in STAGES:
        with dropped_after():
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(*before)
        before = [docs]
    return docs
