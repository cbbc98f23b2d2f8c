"""Records: normalisation, admission, membership, viewports, labels and ticks.

Everything is a column expression or a join on keys, so that it stays inside
code generation; the nearness test of :func:`supplement` joins on grid cells.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Texts that stand for a missing value (fixed values).
MISSING_TEXTS = ("", "None", "NaN", "nan", "NaT", "<NA>")


def code(value: Column, names: Mapping[str, str], default: str = "unknown") -> Column:
    """The name of a code."""
    out = F.lit(default)
    for k, v in names.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def integral(value: Column) -> Column:
    """A number without a fraction as a long, else null."""
    return F.when(value == F.floor(value), value.cast("long"))


def count_or_null(value: Column) -> Column:
    """A count: integral and not negative, else null."""
    return F.when(value >= 0, integral(value))


def clean_text(value: Column) -> Column:
    """Trimmed text; null where it stands for a missing value."""
    t = F.trim(value)
    return F.when(~t.isin(*MISSING_TEXTS), t)


def clean_date(value: Column) -> Column:
    """The date of a timestamp's text."""
    return F.substring(clean_text(value), 1, 10)


def clean_number(value: Column) -> Column:
    """A finite number from text, else null."""
    n = clean_text(value).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def facts_to_values(facts: DataFrame, key: str, layers: Sequence[str]) -> DataFrame:
    """Wide facts as rows (key, layer_id, state, value); known if there is a value."""
    long = facts.select(key, *[F.col(c).cast("string").alias(c) for c in layers]).unpivot([key], list(layers), "layer_id", "value")
    return long.select(key, "layer_id", F.when(F.col("value").isNull(), "unknown").otherwise("known").alias("state"), "value")


def in_view(box: Sequence[Column], view: Sequence[float]) -> Column:
    """Whether a box (x0, y0, x1, y1) and the view have a point in common, edges included."""
    return (box[0] <= view[2]) & (box[2] >= view[0]) & (box[1] <= view[3]) & (box[3] >= view[1])


def admitted(required: Sequence[Column], status: Column) -> Column:
    """Whether a source has all its required fields and isn't excluded."""
    filled = [F.coalesce(F.trim(c.cast("string")) != "", F.lit(False)) for c in required]
    out = F.coalesce(status != "excluded", F.lit(True))
    for f in filled:
        out = out & f
    return out


def supplement(base: DataFrame, extra: DataFrame, x: str, y: str, radius: float) -> DataFrame:
    """``base``, and the rows of ``extra`` with no base point within ``radius``."""
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    cell = lambda c: F.floor(F.col(c) / F.lit(radius))
    near = base.select(F.col(x).alias("bx"), F.col(y).alias("by"), cell(x).alias("i"), cell(y).alias("j"))
    near = near.withColumn("i", F.explode(F.transform(step, lambda d: F.col("i") + d))).withColumn("j", F.explode(F.transform(step, lambda d: F.col("j") + d)))
    probe = extra.withColumns({"i": cell(x), "j": cell(y)})
    close = (F.col(x) - F.col("bx")) * (F.col(x) - F.col("bx")) + (F.col(y) - F.col("by")) * (F.col(y) - F.col("by")) <= radius * radius
    left = probe.join(near, (probe["i"] == near["i"]) & (probe["j"] == near["j"]) & close, "left_anti").drop("i", "j")
    return base.unionByName(left)


def one_sided(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one of two tables has, and which one; none if they are equal sets."""
    a, b = a.select(*keys).distinct(), b.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti").withColumn("only_in", F.lit("a")).unionByName(b.join(a, list(keys), "left_anti").withColumn("only_in", F.lit("b")))


def unresolved(rows: DataFrame, key: str, references: str, known: DataFrame, id_: str) -> DataFrame:
    """(key, reference) of references to an id that ``known`` doesn't have."""
    asked = rows.select(key, F.explode(references).alias("reference"))
    return asked.join(known.select(F.col(id_).alias("reference")), "reference", "left_anti").select(key, "reference")


def journey_maximum(samples: DataFrame, key: str, state: str, seconds: str) -> DataFrame:
    """(key, state, minutes, coverage): the longest successful sample; all of
    them successful is known, some partial, none unknown."""
    ok = (F.col(state) == "known") & F.col(seconds).isNotNull()
    g = samples.groupBy(key).agg(F.max(F.when(ok, F.col(seconds))).alias("most"), F.count(F.when(ok, 1)).alias("ok"), F.count("*").alias("n"))
    return g.select(
        key, F.when(F.col("ok") == 0, "unknown").when(F.col("ok") == F.col("n"), "known").otherwise("partial").alias("state"),
        (F.col("most") / 60).alias("minutes"), (F.col("ok") / F.col("n")).alias("coverage"),
    )


def nearest_rank(rows: DataFrame, by: Sequence[str], value: str, p: float) -> DataFrame:
    """The value at rank ``ceil(n * p)`` of each group."""
    n = F.count("*").over(Window.partitionBy(*by))
    at = F.row_number().over(Window.partitionBy(*by).orderBy(value))
    return rows.where(F.col(value).isNotNull()).withColumns({"_n": n, "_at": at}).where(F.col("_at") == F.ceil(F.col("_n") * F.lit(p))).select(*by, value)


def bike_minutes(metres: Column, kmh: float) -> Column:
    return metres / F.lit(kmh * 1000 / 60)


def first_name(*names: Column, fallback: str) -> Column:
    """The first name that isn't blank."""
    return F.coalesce(*[F.when(F.trim(n) != "", F.trim(n)) for n in names], F.lit(fallback))


def service_groups(classes: Column, groups: Mapping[str, Sequence[str]]) -> Column:
    """The sorted groups that have one of the classes."""
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(classes, F.array(*map(F.lit, c))), g) for g, c in sorted(groups.items())]))


def finnish_number(value: Column) -> Column:
    """One decimal at most, a comma before it, spaces that don't break between thousands."""
    grouped = F.regexp_replace(F.format_number(value, 1), r"\.0$", "")
    return F.translate(grouped, ",.", " ,")


def round_half_up(value: Column) -> Column:
    return F.floor(value + 0.5)


def nice(value: Column) -> Column:
    """Whole from 10 on, else one decimal."""
    return F.when(F.abs(value) >= 10, round_half_up(value)).otherwise(round_half_up(value * 10) / 10)


def default_ramp(breaks: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Ends of the ramp a numeric layer begins with: breaks at a quarter and
    three quarters of their number, or of the range where there are too few."""
    n = F.size(breaks)
    lower, upper = (F.get(breaks, F.greatest(F.lit(1), F.floor(n * 0.25).cast("int"))), F.get(breaks, F.least(n - 1, F.floor(n * 0.75).cast("int"))))
    return (nice(F.when(n >= 2, lower).otherwise(low + (high - low) * 0.25)), nice(F.when(n >= 2, upper).otherwise(low + (high - low) * 0.75)))


def tick_step(low: Column, high: Column, target: int = 7) -> Column:
    """Distance of axis ticks: 1, 2, 5 or 10 times a power of ten; null without a span."""
    rough = (high - low) / target
    magnitude = F.pow(F.lit(10.0), F.floor(F.log10(rough)))
    share = rough / magnitude
    return F.when(high > low, F.when(share >= 5, 10).when(share >= 2, 5).when(share >= 1, 2).otherwise(1) * magnitude)


def axis_ticks(low: Column, high: Column, target: int = 7) -> Column:
    """The ticks from ``low`` to ``high``; none without a span."""
    step = tick_step(low, high, target)
    first = F.ceil(low / step)
    last = F.floor((high + step * 1e-6) / step)
    some = F.when((high > low) & (last >= first), F.transform(F.sequence(first, last), lambda k: F.round(k * step, 6)))
    return F.coalesce(some, F.array().cast("array<double>"))


def tier(zoom: Column, tiers: Sequence[tuple[str, int, int]]) -> Column:
    """The first tier (name, least, most) of a fractional zoom, else null."""
    return F.coalesce(*[F.when((zoom >= a) & (zoom < b + 1), name) for name, a, b in tiers])


def batch_is_complete(rows: Column, expected: Column, stored: Column, wanted: Column, ignored: Sequence[str]) -> Column:
    """Whether a stored batch can be kept: all its rows, and parameters (maps)
    that are equal but for those that don't change the outcome."""
    same = lambda m: F.array_sort(F.map_entries(F.map_filter(m, lambda k, _: ~k.isin(*ignored))))
    return F.coalesce((rows == expected) & (same(stored) == same(wanted)), F.lit(False))
