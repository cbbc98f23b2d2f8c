"""Normalisation, conflict handling and completion of facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Least specific first.
METHOD_RANK = {"direct": 1, "aggregated": 2, "derived": 3, "inferred": 4}
CONFIDENCE_RANK = {"high": 3, "medium": 2, "low": 1}


def entity_id(national: Column, source: str, record: Column) -> Column:
    """The national id if there is one, else a hash under the source's name."""
    text = F.concat(F.lit(f"{source}:"), record.cast("string"))
    return F.coalesce(F.nullif(F.trim(national), F.lit("")), F.concat(F.lit(f"{source}:"), F.sha2(text, 256)))


def scored(completed: Column, residential: Column, house_type: Column) -> Column:
    return F.coalesce(completed, F.lit(False)) & (F.coalesce(residential, F.lit(False)) | house_type.isNotNull())


def code(value: Column, table: dict[str, str]) -> Column:
    """A code's token; null for unknown codes."""
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def finite(value: Column, *sentinels: float) -> Column:
    ok = ~F.isnan(value) & (F.abs(value) != float("inf"))
    for s in sentinels:
        ok = ok & (value != s)
    return F.when(ok, value)


def conflict_free(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """For each key and column: the value if all non-null ones are equal."""
    return df.groupBy(*keys).agg(*[F.when(F.min(v) == F.max(v), F.max(v)).alias(v) for v in values])


def resolve_evidence(df: DataFrame, keys: list[str], claim: str, method: str = "method", confidence: str = "confidence") -> DataFrame:
    """One claim: known; several: conflict and ``mixed``.  The method is the
    least specific, the confidence the lowest."""
    def rank(c, t):
        return F.element_at(F.create_map(*[F.lit(x) for kv in t.items() for x in kv]), F.col(c))
    one = F.min(claim) == F.max(claim)
    return df.where(F.col(claim).isNotNull()).groupBy(*keys).agg(
        F.when(one, "known").otherwise("conflict").alias("state"), F.when(one, F.max(claim)).otherwise("mixed").alias("value"),
        F.max_by(method, rank(method, METHOD_RANK)).alias("method"), F.min_by(confidence, rank(confidence, CONFIDENCE_RANK)).alias("confidence"), F.count("*").alias("n_records"),
    )


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an explicit order; rows without a key stay."""
    w = Window.partitionBy(*keys).orderBy(*order)
    have = df
    for k in keys:
        have = have.where(F.col(k).isNotNull())
    none = df.where(" OR ".join(f"{k} IS NULL" for k in keys))
    return have.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn").unionByName(none)


def complete(buildings: DataFrame, layers: list[str], values: DataFrame) -> DataFrame:
    """A row for every building and layer, unknown where there is none."""
    every = buildings.select("building_id", F.explode(F.array(*[F.lit(x) for x in layers])).alias("layer_id"))
    return every.join(values, ["building_id", "layer_id"], "left").withColumn("state", F.coalesce("state", F.lit("unknown")))


def attach_evidence(state: Column, evidence: Column) -> Column:
    return F.when(state != "unknown", F.array(evidence)).otherwise(F.array().cast("array<string>"))
