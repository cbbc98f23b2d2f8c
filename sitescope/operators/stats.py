"""Distributions, breaks, histograms and roll-ups of layer values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Percentiles of the colour breaks by layer.
PERCENTILES = {
    "income": (0.02, 0.15, 0.36, 0.56, 0.72, 0.84, 0.92),
    "building_year": (0.02, 0.12, 0.28, 0.44, 0.60, 0.76, 0.92),
    "default": (0.02, 0.08, 0.16, 0.28, 0.44, 0.64, 0.85),
}
BINS = 40


def number(state: Column, nums: Column) -> Column:
    """A row's one number: the value, or the median of finite values."""
    finite = F.filter(nums, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")))
    s, n = F.sort_array(finite), F.size(finite)
    mid = F.floor((n - 1) / 2).cast("int")
    median = (F.get(s, mid) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    return F.when(state.isin("known", "partial") & (n > 0), median)


def quantile_breaks(df: DataFrame, value: str, by: list[str], family: str = "default") -> DataFrame:
    """The distinct interpolated percentiles of each group, in order."""
    p = F.percentile(value, F.array(*[F.lit(x) for x in PERCENTILES[family]]))
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.array_distinct(F.transform(p, lambda x: F.round(x, 6))).alias("breaks"))


def histogram(df: DataFrame, value: str, by: list[str], bins: int = BINS) -> DataFrame:
    """Equal-width histogram of each group: (by, lo, hi, bin, n, known).

    The span runs between the 1st and 99th percentile, or to the extreme
    where that is within half of their distance; values outside are left
    out.  Bounds come from one aggregation and are joined to the values, a
    row for each group.
    """
    v = df.where(F.col(value).isNotNull())
    b = v.groupBy(*by).agg(
        F.min(value).alias("_mn"), F.max(value).alias("_mx"), F.round(F.percentile(value, 0.01), 6).alias("_p1"),
        F.round(F.percentile(value, 0.99), 6).alias("_p9"), F.count(value).alias("known"),
    )
    gap = (F.col("_p9") - F.col("_p1")) / 2
    lo = F.when((gap > 0) & (F.col("_p1") - F.col("_mn") <= gap), F.col("_mn")).otherwise(F.col("_p1"))
    hi = F.when((gap > 0) & (F.col("_mx") - F.col("_p9") <= gap), F.col("_mx")).otherwise(F.col("_p9"))
    b = b.withColumns({"lo": lo, "hi": hi})
    flat = F.col("hi") <= F.col("lo")
    b = b.withColumns({"lo": F.when(flat, F.col("_mn")).otherwise(F.col("lo")), "hi": F.when(flat, F.col("_mx")).otherwise(F.col("hi"))})
    b = b.withColumn("hi", F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1).otherwise(F.col("hi"))).select(*by, "lo", "hi", "known")
    v = v.join(b, by) if by else v.join(F.broadcast(b))
    v = v.where(F.col(value).between(F.col("lo"), F.col("hi")))
    cell = F.floor((F.col(value) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)).cast("int")
    return v.groupBy(*by, "lo", "hi", "known", F.least(F.greatest(cell, F.lit(0)), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))


def distributions(df: DataFrame, value: str, catalogue: DataFrame, by: str = "layer_id", bins: int = BINS) -> DataFrame:
    """The histogram of each layer in ``catalogue`` (by, breaks) with at least
    two breaks as one row (by, counts, known_count, lo, hi): empty bins are
    0, and a layer without values has all bins over the span of its breaks."""
    h = histogram(df, value, [by], bins).groupBy(by).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("known").alias("known"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("at"))
    out = catalogue.where(F.size("breaks") >= 2).join(h, by, "left")
    counts = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("at", i), F.lit(0).cast("long")))
    return out.select(
        by, counts.alias("counts"), F.coalesce("known", F.lit(0).cast("long")).alias("known_count"),
        F.coalesce("lo", F.col("breaks")[0]).alias("lo"), F.coalesce("hi", F.get("breaks", F.size("breaks") - 1)).alias("hi"),
    )


def layer_breaks(df: DataFrame, value: str, by: list[str], low: float, high: float, family: str = "default", discrete: bool = False) -> DataFrame:
    """Colour breaks of each group: its distinct percentiles, or all of its
    values if ``discrete``; steps of the span low to high where the group has
    less than two different values or break."""
    p = PERCENTILES[family]
    linear = F.array(*[F.lit(low + (high - low) * x) for x in p])
    v = df.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(x) for x in p])).alias("p"), F.sort_array(F.collect_set(value)).alias("every"))
    own = F.col("every") if discrete else F.array_distinct("p")
    return v.select(*by, F.when((F.size("every") > 1) & (F.size(own) > 1), own).otherwise(linear).alias("breaks"))


def one_category(cats: Column) -> Column:
    """A building's category: its only one, or mixed."""
    return F.when(F.size(F.array_distinct(cats)) == 1, cats[0]).when(F.size(cats) > 1, "mixed")


def composite_complete(buildings: DataFrame, composite: DataFrame, key: str = "building_id") -> DataFrame:
    """The composite of all buildings: unknown where none of the groups has a row."""
    return buildings.select(key).join(composite, key, "left").withColumns({"state": F.coalesce("state", F.lit("unknown")), "coverage": F.coalesce("coverage", F.lit(0.0))})


def fixed_histogram(df: DataFrame, value: Column, lo: float, hi: float, bins: int = BINS) -> DataFrame:
    cell = F.floor((value - lo) / ((hi - lo) / bins)).cast("int")
    inside = df.where(value.between(lo, hi))
    return inside.groupBy(F.least(F.greatest(cell, F.lit(0)), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))


def overview_numeric(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min(value).alias("least"), F.median(value).alias("median"), F.max(value).alias("most"), F.count("*").alias("n"))


def overview_categorical(df: DataFrame, category: str, by: list[str]) -> DataFrame:
    """Mode of each group with its share; a tie is ``mixed``."""
    n = df.where(F.col(category).isNotNull()).groupBy(*by, category).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by)
    n = n.withColumns({"most": F.max("_c").over(w), "total": F.sum("_c").over(w)}).where("_c = most")
    return n.groupBy(*by).agg(
        F.when(F.count("*") == 1, F.max(category)).otherwise("mixed").alias("mode"), (F.max("most") / F.max("total")).alias("mode_share")
    )


def state_counts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.count(F.when(F.col("state") == s, 1)).alias(s) for s in ("known", "partial", "unknown")])


def composite_minimum(df: DataFrame, groups: list[str], key: str = "building_id") -> DataFrame:
    """The least known value among selected groups of each building.

    ``df``: (key, grp, state, value).  partial if a selected group with a row
    has no value or a partial one; none with a value: unknown.
    """
    rank = F.array_position(F.array(*[F.lit(g) for g in groups]), F.col("grp"))
    sel = df.where(F.col("grp").isin(groups)).withColumn("_ok", F.col("state").isin("known", "partial") & F.col("value").isNotNull())
    agg = sel.groupBy(key).agg(
        F.min(F.when(F.col("_ok"), F.struct("value", rank.alias("rank"), "grp"))).alias("m"), F.count(F.when(F.col("_ok"), 1)).alias("n_ok"), F.count("*").alias("n"),
        F.count(F.when(~F.col("_ok") | (F.col("state") == "partial"), 1)).alias("n_less"),
    )
    state = F.when(F.col("n_ok") == 0, "unknown").when(F.col("n_less") > 0, "partial").otherwise("known")
    return agg.select(key, state.alias("state"), F.col("m.value").alias("value"), F.col("m.grp").alias("grp"), (F.col("n_ok") / F.col("n")).alias("coverage"))


def audit(df: DataFrame, municipality: str = "municipality") -> DataFrame:
    """Value rows by state at four grains in one pass."""
    df.createOrReplaceTempView("_audit_rows")
    return df.sparkSession.sql(
        f"SELECT {municipality} AS municipality, layer_id, state, count(*) AS n FROM _audit_rows "
        f"GROUP BY GROUPING SETS ((state), ({municipality}, state), (layer_id, state), ({municipality}, layer_id, state))"
    )
