"""The bundle's sinks and readers, and the register scans."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sitescope.sources import bundle, readers, scans

SQUARE = [[[0, 0], [2, 0], [2, 2], [0, 0]]]


def features(spark, tmp_path, rows):
    shape = {"type": "Polygon", "coordinates": SQUARE}
    fs = [{"type": "Feature", "properties": p, "geometry": shape if g is True else g} for p, g in rows]
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": fs}))
    return readers.geojson(spark, str(tmp_path / "a.json"))


def test_bundle_round_trip(spark, tmp_path):
    path = str(tmp_path / "layers")
    tiles = spark.createDataFrame([(1, 5, 6), (1, 5, 7), (2, 5, 6)], "building_id long, tx int, ty int")
    rows = [(1, "year", "known", 1.0), (2, "year", "partial", 2.0), (2, "noise", "known", 3.0), (1, "noise", "unknown", None)]
    values = spark.createDataFrame(rows, "building_id long, layer_id string, state string, value double")
    bundle.write_layers(values, tiles, path)
    got = sorted(tuple(r) for r in bundle.read_layer(spark, path, "year").select("building_id", "state", "value", "tx", "ty").collect())
    assert got == [(1, "known", 1.0, 5, 6), (1, "known", 1.0, 5, 7), (2, "partial", 2.0, 5, 6)]
    assert {r["layer_id"]: r["tiles"] for r in bundle.availability(spark, path).collect()} == {"year": ["5/6", "5/7"], "noise": ["5/6"]}
    # a layer that is written again replaces its own tiles alone
    again = spark.createDataFrame([(2, "year", "known", 9.0), (1, "year", "unknown", None)], values.schema)
    bundle.write_layers(again, tiles, path)
    assert {r["layer_id"]: r["tiles"] for r in bundle.availability(spark, path).collect()} == {"year": ["5/6"], "noise": ["5/6"]}
    assert [r["value"] for r in bundle.read_layer(spark, path, "year").collect()] == [9.0]
    plan = bundle.read_layer(spark, path, "year")._jdf.queryExecution().executedPlan().toString()
    assert "layer_id" in plan.split("PartitionFilters")[1][:80]
    m = bundle.asset_metrics(spark, path).first()
    assert m["files"] == 2 and m["bytes"] >= m["largest"] > 0


def test_misplaced_values(spark, tmp_path):
    g, path = str(tmp_path / "g"), str(tmp_path / "layers")
    tiles = spark.createDataFrame([(1, 5, 6), (2, 5, 6)], "building_id long, tx int, ty int")
    bundle.write_geometries(spark.createDataFrame([(1, 7.0)], "building_id long, x double"), tiles, g)
    bundle.write_layers(spark.createDataFrame([(1, "a", "known", 1.0), (2, "a", "known", 1.0)], "building_id long, layer_id string, state string, value double"), tiles, path)
    geometries = spark.read.schema("building_id long, x double, tx int, ty int").json(g)
    assert [tuple(r) for r in bundle.misplaced(geometries, bundle.read_layer(spark, path, "a")).collect()] == [(2, 5, 6, "a")]


def test_register_scans(spark, tmp_path):
    f = features(spark, tmp_path, [
        ({"db_hi": 55, "luokka": "Vireillä", "tyyppi": "vuokraalue", "group": "g1", "name": " "}, True), ({"db_hi": -1, "luokka": "Lainvoimainen", "group": "g2", "name": " Asema "}, True),
        ({"db_hi": None, "luokka": "0110x", "group": "g3"}, None), ({"id": " a ", "luokka": "01124", "group": "g3"}, {"type": "Point", "coordinates": [1, 2]}),
    ])
    assert [r["value"] for r in scans.noise_zones(f).collect()] == [55.0]
    assert scans.plan_areas(f).count() == 1 and scans.lease_areas(f).count() == 1 and scans.city_land(f).count() == 2
    assert [tuple(r) for r in scans.register_classes(f, "id", "luokka").collect()] == [("a", "0112")]
    assert sorted(r["name"] for r in scans.named_services(f, {"g1": "Terveysasema"}).collect()) == ["Asema", "Terveysasema", "g3"]
    assert sorted(r["service"] for r in scans.services(f, "luokka").collect()) == ["01124", "lainvoimainen", "vireillä"]


def test_scans_that_fail(spark, tmp_path):
    f = features(spark, tmp_path, [({"db_hi": "loud", "id": "1"}, True), ({"id": "2"}, None)])
    with pytest.raises(Exception, match="noise level loud"):
        scans.noise_zones(f).collect()
    with pytest.raises(Exception, match="empty geometry"):
        scans.buildings(f, ["id"]).collect()
    with pytest.raises(Exception, match="no property db_hi"):
        scans.buildings(f.where(F.size("polygons") > 0).union(f.limit(0)).withColumn("properties", F.map_filter("properties", lambda k, v: k != "db_hi")), ["db_hi"]).collect()
