"""The registered queries of this subpackage, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(key: str, buckets: int) -> F.Column:
    """Whether crc32 of the id as text leaves 2; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(buckets)) == 2, F.lit(False))


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitescope.llm import media

    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    stored = media.encode(docs, "data").select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), "media")
    return media.analyse(stored, digests=True).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        media.feature().alias("feature"), "n_frames", F.size("clips").alias("n_clips"),
    )


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitescope.llm import mixing

    out = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select(F.col("mix_key").alias("doc_id"), "size", "source_size", "target", "taken")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitescope.llm import lines

    return lines.dedup(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitescope.llm import jaccard

    return jaccard.link_groups(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sitescope.llm import idfile

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return idfile.read(idfile.write(docs, public_tokenizers.path("byte_bpe_50k.json")))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitescope.llm import pages

    return pages.extract(read(spark, sf_dir, "pages"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitescope.llm import embeddings

    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sitescope.llm import packing

    return packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")).drop("row")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitescope.llm import language

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(~held_out("doc_id", 4)))
    out = language.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id", 4).alias("held_out"), "lang_pred", "score", "coverage")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitescope.llm import katz

    out = katz.score(read(spark, sf_dir, "documents"), ~held_out("doc_id", 7))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES: dict[str, Query] = {
    "op1_media_columns": op1_media_columns,
    "op2_source_mixing": op2_source_mixing,
    "op3_line_dedup": op3_line_dedup,
    "op4_token_id_files": op4_token_id_files,
    "op5_html_extraction": op5_html_extraction,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op9_language_id": op9_language_id,
    "op10_lm_scoring": op10_lm_scoring,
}

SQL: dict[str, str] = {}
