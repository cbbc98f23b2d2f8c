"""Preference sets compiled to column expressions.

A preference set is checked and turned into one expression tree when the plan
is built; rows are never interpreted.  Statuses are nullable booleans (true:
pass, false: fail, null: unknown), so AND and OR are SQL's own.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ramp:
    """Full score at one end, none at the other; ``range`` is a closed band."""

    direction: str
    full: float
    zero: float

    def __post_init__(self) -> None:
        ok = {
            "lower_is_better": self.full < self.zero, "higher_is_better": self.full > self.zero, "range": self.full <= self.zero,
        }
        if self.direction not in ok:
            raise ValueError(f"unknown direction {self.direction!r}")
        if not ok[self.direction]:
            raise ValueError("the ends of the ramp are reversed")

    def score(self, v: Column) -> Column:
        if self.direction == "range":
            return F.when(v.between(self.full, self.zero), 1.0).otherwise(0.0)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - self.zero) / (self.full - self.zero)))


@dataclass(frozen=True)
class Criterion:
    layer_id: str
    minimum: float | None = None
    maximum: float | None = None
    categories: tuple[str, ...] = ()
    ramp: Ramp | None = None

    @property
    def configured(self) -> bool:
        return self.ramp is not None or self.minimum is not None or self.maximum is not None or bool(self.categories)

    @property
    def numeric(self) -> bool:
        return self.ramp is not None or not self.categories


@dataclass(frozen=True)
class Group:
    id: str
    criteria: tuple[Criterion, ...]
    operator: str = "and"
    weight: float = 1.0
    dealbreaker: bool = False

    def __post_init__(self) -> None:
        if self.operator not in ("and", "or"):
            raise ValueError(f"unknown operator {self.operator!r}")
        if not self.weight >= 0 or self.weight == float("inf"):
            raise ValueError("a weight is a finite number from 0")


@dataclass(frozen=True)
class Preferences:
    groups: tuple[Group, ...]
    missing_fails: bool = False

    @property
    def layer_ids(self) -> list[str]:
        """The layers that have to be read."""
        return sorted({c.layer_id for g in self.groups for c in g.criteria if c.configured})


@dataclass
class Result:
    passed: Column
    score: Column
    missing: Column
    parts: list = field(default_factory=list)


def evaluate(c: Criterion, value: Column) -> Result:
    """One configured criterion on ``struct<state, nums, cats>``: any of a
    layer's values may match."""
    values = value["nums"] if c.numeric else value["cats"]
    unknown = value.isNull() | (value["state"] == "unknown") | (F.coalesce(F.size(values), F.lit(0)) <= 0)
    if c.ramp:
        score = F.array_max(F.transform(values, c.ramp.score))
    else:
        def match(v: Column) -> Column:
            if not c.numeric:
                return v.isin(list(c.categories))
            tests = [t for t in (None if c.minimum is None else v >= c.minimum, None if c.maximum is None else v <= c.maximum) if t is not None]
            return reduce(lambda a, b: a & b, tests)

        score = F.when(F.exists(values, match), 1.0).otherwise(0.0)
    score = F.when(~unknown, score)
    return Result(score > 0, score, unknown | (value["state"] != "known"))


def evaluate_group(g: Group, values: dict[str, Column]) -> Result | None:
    got = [evaluate(c, values[c.layer_id]) for c in g.criteria if c.configured]
    if not got:
        return None
    any_missing = reduce(lambda a, b: a | b, [r.missing for r in got])
    scores = [r.score for r in got]
    least, most = (scores[0], scores[0]) if len(scores) == 1 else (F.least(*scores), F.greatest(*scores))
    if g.operator == "and":
        passed = reduce(lambda a, b: a & b, [r.passed for r in got])
        score = F.when(~passed, 0.0).when(passed, least)
    else:
        passed = reduce(lambda a, b: a | b, [r.passed for r in got])
        score = F.when(~passed, 0.0).when(passed, most)
    return Result(passed, score, any_missing)


def _total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms) if terms else F.lit(0.0)


def wide(values: DataFrame, layers: list[str], key: str = "building_id") -> DataFrame:
    """One row per building with a struct column for each layer: one exchange
    of partial aggregates, of the layers in question alone."""
    v = F.struct("state", "nums", "cats")
    return values.where(F.col("layer_id").isin(layers) | F.lit(not layers)).groupBy(key).agg(
        *[F.first(F.when(F.col("layer_id") == x, v), ignorenulls=True).alias(f"v_{x}") for x in layers] or [F.count("*").alias("n")]
    )


def suitability(values: DataFrame, buildings: DataFrame, prefs: Preferences, key: str = "building_id") -> DataFrame:
    """(key, eligible, score, failed, missing) of every building."""
    layers = prefs.layer_ids
    rows = buildings.select(key).join(wide(values, layers, key), key, "left")
    cols = {x: F.col(f"v_{x}") for x in layers}
    failed, missing, num, den = [], [], [], []
    for g in prefs.groups:
        r = evaluate_group(g, cols)
        if r is None:
            continue
        lost = F.coalesce(r.missing, F.lit(True))
        missing.append(F.when(lost, F.lit(g.id)))
        if g.dealbreaker:
            bad = F.coalesce(~r.passed, F.lit(False))
            failed.append(F.when(bad | lost if prefs.missing_fails else bad, F.lit(g.id)))
        if g.weight > 0:
            num.append(F.when(r.score.isNotNull(), r.score * g.weight).otherwise(0.0))
            den.append(F.when(r.score.isNotNull(), F.lit(float(g.weight))).otherwise(0.0))
    def ids(cs):
        return F.array_compact(F.array(*cs)) if cs else F.array().cast("array<string>")
    out = rows.select(key, ids(failed).alias("failed"), ids(missing).alias("missing"), _total(num).alias("_num"), _total(den).alias("_den"))
    return out.select(
        key, (F.size("failed") == 0).alias("eligible"), F.when(F.size("failed") == 0, F.try_divide("_num", "_den")).alias("score"), "failed", "missing"
    )


def suitability_by_layer(values: DataFrame, buildings: DataFrame, criteria: list[tuple[Criterion, float, bool]], missing_fails: bool = False, key: str = "building_id") -> DataFrame:
    """The older form: criteria with (weight, dealbreaker) of their own;
    dealbreakers stay out of the mean, and alone score 1 if none is missing."""
    used = [(c, w, d) for c, w, d in criteria if c.configured]
    layers = sorted({c.layer_id for c, _, _ in used})
    rows = buildings.select(key).join(wide(values, layers, key), key, "left")
    failed, missing, num, den = [], [], [], []
    for c, w, d in used:
        r = evaluate(c, F.col(f"v_{c.layer_id}"))
        lost = F.coalesce(r.missing, F.lit(True))
        missing.append(F.when(lost, F.lit(c.layer_id)))
        if d:
            bad = F.coalesce(~r.passed, F.lit(False))
            failed.append(F.when(bad | lost if missing_fails else bad, F.lit(c.layer_id)))
        elif w > 0:
            num.append(F.when(r.score.isNotNull(), r.score * w).otherwise(0.0))
            den.append(F.when(r.score.isNotNull(), F.lit(float(w))).otherwise(0.0))
    def ids(cs):
        return F.array_compact(F.array(*cs)) if cs else F.array().cast("array<string>")
    out = rows.select(key, ids(failed).alias("failed"), ids(missing).alias("missing"), _total(num).alias("_num"), _total(den).alias("_den"))
    mean = F.try_divide("_num", "_den")
    if not den:
        mean = F.when(F.size("missing") == 0, 1.0)
    return out.select(key, (F.size("failed") == 0).alias("eligible"), F.when(F.size("failed") == 0, mean).alias("score"), "failed", "missing")


def color_class(value: Column, breaks: list[float]) -> Column:
    """How many breaks a value has reached."""
    return reduce(lambda a, b: a + b, [(value >= b).cast("int") for b in breaks])


def display_status(eligible: Column, score: Column, n_missing: Column) -> Column:
    return F.when(~eligible, "failed_dealbreaker").when(score.isNull(), "no_score").when(n_missing > 0, "partial").otherwise("scored")
