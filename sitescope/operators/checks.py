"""Checks of a release: each returns the rows that break a rule, none if all is well."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitescope.operators import stats

# Fields that name a person and are never published.
PERSON_FIELDS = ("owner_name", "tenant_name", "leaseholder_name")
STATES = ("known", "partial", "unknown")


def forbidden_field(fields: Column) -> Column:
    """The first field, by name, that must not be published; null if none."""
    return F.array_min(F.array_intersect(fields, F.array(*[F.lit(f) for f in PERSON_FIELDS])))


def orphans(rows: DataFrame, record: Column, reference: str, known: DataFrame, id_: str, rule: str) -> DataFrame:
    """(rule, record) of rows whose reference nothing in ``known`` has."""
    lost = rows.join(known.select(F.col(id_).alias(reference)).distinct(), reference, "left_anti")
    return lost.select(F.lit(rule).alias("rule"), record.cast("string").alias("record"))


def release_faults(sources: DataFrame, evidence: DataFrame, buildings: DataFrame, values: DataFrame) -> DataFrame:
    """Broken references of a release as (rule, record).

    ``sources`` (source_id), ``evidence`` (evidence_id, source_id),
    ``buildings`` (building_id, source_id), ``values`` (value_id, building_id,
    state, evidence_ids).
    """
    cited = values.select("value_id", F.explode("evidence_ids").alias("evidence_id"))
    bare = values.where((F.col("state") != "unknown") & (F.size("evidence_ids") == 0))
    return (
        orphans(evidence, F.col("evidence_id"), "source_id", sources, "source_id", "evidence_source")
        .unionByName(orphans(buildings, F.col("building_id"), "source_id", sources, "source_id", "building_source"))
        .unionByName(orphans(values, F.col("value_id"), "building_id", buildings, "building_id", "value_building"))
        .unionByName(bare.select(F.lit("no_evidence").alias("rule"), F.col("value_id").cast("string").alias("record")))
        .unionByName(orphans(cited, F.col("value_id"), "evidence_id", evidence, "evidence_id", "value_evidence"))
    )


def attribute_faults(buildings: DataFrame, layers: DataFrame, values: DataFrame) -> DataFrame:
    """(rule, record): ids that two buildings have, values of unknown
    buildings or layers and values of no valid state."""
    twice = buildings.groupBy("building_id").count().where("count > 1")
    return (
        twice.select(F.lit("duplicate_building").alias("rule"), F.col("building_id").cast("string").alias("record"))
        .unionByName(orphans(values, F.col("value_id"), "building_id", buildings, "building_id", "unknown_building"))
        .unionByName(orphans(values, F.col("value_id"), "layer_id", layers, "layer_id", "unknown_layer"))
        .unionByName(values.where(~F.coalesce(F.col("state").isin(*STATES), F.lit(False))).select(F.lit("state").alias("rule"), F.col("value_id").cast("string").alias("record")))
    )


def distribution_faults(layers: DataFrame, distributions: DataFrame) -> DataFrame:
    """(layer_id, rule) of distributions (layer_id, counts, known_count, min,
    max) that can't be those of the numeric ``layers`` (layer_id, kind)."""
    numeric = layers.where("kind = 'numeric'").select("layer_id")
    rules = F.array_compact(F.array(
        F.when(F.size("counts") < 1, "empty"), F.when(F.exists("counts", lambda x: x < 0), "negative_count"),
        F.when(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x) > F.col("known_count"), "more_than_known"), F.when(F.col("max") < F.col("min"), "bounds"),
    ))
    own = distributions.select("layer_id", F.explode(rules).alias("rule"))
    twice = distributions.groupBy("layer_id").count().where("count > 1").select("layer_id", F.lit("duplicate").alias("rule"))
    extra = distributions.select("layer_id").distinct().join(numeric, "layer_id", "left_anti").withColumn("rule", F.lit("no_layer"))
    missing = numeric.join(distributions, "layer_id", "left_anti").withColumn("rule", F.lit("missing"))
    return own.unionByName(twice).unionByName(extra).unionByName(missing)


def audit_faults(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows that only a stored audit or only the recount of ``rows`` has."""
    again = stats.audit(rows)
    return stored.exceptAll(again).withColumn("only_in", F.lit("stored")).unionByName(again.exceptAll(stored).withColumn("only_in", F.lit("recount")))


def layer_faults(kind: Column, categories: Column, span: Column) -> Column:
    """The rules that a layer's definition breaks, in order."""
    numeric = kind == "numeric"
    ascending = (F.size(span) == 2) & (F.get(span, F.lit(0)) < F.get(span, F.lit(1)))
    return F.array_compact(F.array(
        F.when(numeric & (F.size(categories) > 0), "numeric_with_categories"), F.when(numeric & ~F.coalesce(ascending, F.lit(False)), "no_ascending_range"),
        F.when(~numeric & span.isNotNull(), "categorical_with_range"), F.when(F.array_contains(categories, "unknown"), "unknown_accepted"),
    ))


def active_layers(selected: Column, criteria: Column, expansions: dict[str, Sequence[str]]) -> Column:
    """Layers that a view needs: the shown one and those of all criteria,
    composite ones by their members, each once."""
    shown = F.when(selected.isin("overall", "none"), F.array().cast("array<string>")).otherwise(F.array(selected))

    def members(x: Column) -> Column:
        out = F.array(x)
        for name, parts in expansions.items():
            out = F.when(x == name, F.array(*[F.lit(p) for p in parts])).otherwise(out)
        return out

    return F.array_distinct(F.flatten(F.transform(F.concat(shown, criteria), members)))
