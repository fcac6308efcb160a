"""The queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, centroids, decontaminate, hilbert, langid, mainblocks, minhash, pii, spelling, urllists, vafile, vectors, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    judged = urllists.judged(urllists.captures_of(pages), urllists.sample_entries(pages))
    return judged.select("page_id", "host", "fetch_day", "matched_pattern", "category", "blocked")


QUERIES = {
    "op1_language_id": lambda spark, sf: langid.identify(_table(spark, sf, "documents")),
    "op2_hilbert_sharding": lambda spark, sf: hilbert.shard(_table(spark, sf, "documents")),
    "op3_minhash_dedup": lambda spark, sf: minhash.near_duplicates(_table(spark, sf, "documents")),
    "op4_url_lists": url_lists,
    "op5_bpe_round_trip": lambda spark, sf: bpe.round_trip(_table(spark, sf, "documents"), tokenizer_path()),
    "op6_main_text": lambda spark, sf: mainblocks.extract(_table(spark, sf, "pages")),
    "op7_decontamination": lambda spark, sf: decontaminate.contamination(_table(spark, sf, "documents"), _table(spark, sf, "benchmark")),
    "op8_vector_dedup": lambda spark, sf: vectors.near_duplicates(_table(spark, sf, "embeddings")),
    "op9_warc_index": lambda spark, sf: warc.round_trip(_table(spark, sf, "pages")),
    "op10_personal_data": lambda spark, sf: pii.personal_data(_table(spark, sf, "documents")),
    "op11_spelling_variants": lambda spark, sf: spelling.variants(_table(spark, sf, "documents")),
    "op12_centroid_clusters": lambda spark, sf: centroids.cluster(_table(spark, sf, "embeddings")),
    "op13_exact_top_k": lambda spark, sf: vafile.top_k(_table(spark, sf, "embeddings")),
}
ORACLE_SQL = {"op3_minhash_dedup": minhash.ORACLE_SQL, "op4_url_lists": urllists.ORACLE_SQL, "op8_vector_dedup": vectors.ORACLE_SQL, "op9_warc_index": warc.ORACLE_SQL, "op11_spelling_variants": spelling.ORACLE_SQL, "op12_centroid_clusters": centroids.ORACLE_SQL, "op13_exact_top_k": vafile.ORACLE_SQL}
