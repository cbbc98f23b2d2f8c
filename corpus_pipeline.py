"""A training-corpus pipeline over the operators in ``sitescope.llm``.

Stages, each written as Parquet and read again before the next: language ID
rejects what is in no learned language; line dedup removes lines that match an
earlier one; the n-gram Jaccard join keeps one document of each group; the mix
takes each source by its target; packing places everything into sequences.
All but the last return the columns of ``documents``.

The pipeline has no SQL form (learned language filters, a tokenizer); it is
tested against brute-force versions of its stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitescope.llm import common, jaccard, language, lines, mixing, packing

#: A document stays if its best language covers this share of its n-grams.
LEAST_COVERAGE = 0.25

#: Names that line dedup adds, and what such columns are called meanwhile.
OWN = {"n_lines": "n_lines__", "n_removed": "n_removed__"}

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of a learned language; null texts, texts without a
    letter and texts hardly any of whose n-grams belong to one language go."""
    model = language.train(docs)
    packed = docs.select("text", F.struct(*docs.columns).alias("doc"))
    out = language.identify(packed, model)
    return out.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("coverage") >= LEAST_COVERAGE)).select("doc.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that match an earlier line of the corpus; documents that
    lose all their lines go.  Null and empty texts stay as they are; of rows
    with an equal id and text all or none keep a line; other columns stay,
    clashing names too."""
    out = lines.dedup(docs.withColumnsRenamed(OWN))
    return out.where(F.col("text").isNull() | (F.col("text") != "") | (F.col("n_removed") == 0)).select(
        *[F.col(f"`{OWN.get(c, c)}`").alias(c) for c in docs.columns]
    )


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group linked at five words and 0.8:
    the one with the smallest id, null ids last, and one of repeated rows.
    Null, empty and blank texts link with nothing; an empty table stays empty."""
    return jaccard.keep_first(docs, width=5, num=80, den=100)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take every source up to its target; repeats are repeated rows.  A text
    without a word is never taken; a null source is one of its own; ties in
    the queue go by the row's number; other columns stay."""
    return mixing.mixed_documents(docs)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 2048 tokens.  A null or
    empty text is the end id alone; repeated rows are packed each; other
    columns go, as rows are pieces now."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("source_mix", source_mix),
    ("best_fit", best_fit),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
