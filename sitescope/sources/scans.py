"""Scans of the registers: feature collections as rows of one kind.

All take what :func:`readers.geojson` returns.  A missing geometry drops a
row where the scan says so, and fails where the register must have one.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What marks a pending plan and a leased area.
PENDING_PLAN, LEASED = "Vireillä", "vuokraalue"


def prop(name: str) -> Column:
    return F.try_element_at("properties", F.lit(name))


def _has_shape() -> Column:
    return F.coalesce(F.size("polygons") > 0, F.lit(False)) | F.col("point").isNotNull()


def buildings(features: DataFrame, required: list[str]) -> DataFrame:
    """Properties of every building; fails if a required one is in no
    feature's properties or if a geometry is empty."""
    checks = [F.when(~F.map_contains_key("properties", name), F.raise_error(F.lit(f"a building has no property {name}"))) for name in required]
    checks.append(F.when(~_has_shape(), F.raise_error(F.lit("a building has an empty geometry"))))
    ok = features
    for check in checks:
        ok = ok.where(check.isNull())
    return ok.select(*[prop(name).alias(name) for name in required], "polygons", "point")


def register_classes(features: DataFrame, key: str, class_field: str) -> DataFrame:
    """(id, code): the first four characters of a register's class; rows
    without an id are dropped."""
    return features.select(F.trim(prop(key)).alias("id"), F.substring(prop(class_field), 1, 4).alias("code")).where("id <> ''")


def noise_zones(features: DataFrame, field: str = "db_hi") -> DataFrame:
    """(value, polygons) of zones with a level of 0 or more; one without a
    level is dropped, one whose level is no number fails."""
    raw = prop(field)
    value = raw.try_cast("double")
    wrong = raw.isNotNull() & value.isNull()
    value = F.when(wrong, F.raise_error(F.concat(F.lit("noise level "), raw)).cast("double")).otherwise(value)
    return features.select(value.alias("value"), "polygons").where("value >= 0")


def plan_areas(features: DataFrame, field: str = "luokka") -> DataFrame:
    return features.where(prop(field) == PENDING_PLAN).select("properties", "polygons")


def lease_areas(features: DataFrame, field: str = "tyyppi") -> DataFrame:
    return features.where(prop(field) == LEASED).select("polygons")


def city_land(features: DataFrame) -> DataFrame:
    """Geometries alone, empty ones dropped."""
    return features.where(F.size("polygons") > 0).select("polygons")


def services(features: DataFrame, field: str) -> DataFrame:
    """(service, point, polygons) with the text trimmed and in lower case;
    rows without a geometry are dropped."""
    return features.where(_has_shape()).select(F.lower(F.trim(prop(field))).alias("service"), "point", "polygons")


def named_services(features: DataFrame, labels: Mapping[str, str], group: str = "group", name: str = "name") -> DataFrame:
    """(group, name, point): a service without a name has its group's label,
    and the group's id where there is no label."""
    label = F.lit(None).cast("string")
    for g, text in labels.items():
        label = F.when(prop(group) == g, text).otherwise(label)
    return features.where(_has_shape()).select(prop(group).alias("group"), F.coalesce(F.nullif(F.trim(prop(name)), F.lit("")), label, prop(group)).alias("name"), "point")
