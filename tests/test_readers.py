"""Readers on small files."""

from __future__ import annotations

import json
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sitescope.operators import transit
from sitescope.sources import readers


def test_geojson(spark, tmp_path):
    square = [[[0, 0], [0, 2], [2, 2], [2, 0], [0, 0]]]
    features = [
        {"type": "Feature", "id": "a", "properties": {"db_hi": 55, "x": None}, "geometry": {"type": "Polygon", "coordinates": square}},
        {"type": "Feature", "properties": {"n": "ä"}, "geometry": {"type": "MultiPolygon", "coordinates": [square, square]}},
        {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [24.9, 60.2]}},
        {"type": "Feature", "properties": {}, "geometry": None},
    ]
    file = tmp_path / "f.geojson"
    file.write_text(json.dumps({"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::3067"}}, "features": features}, indent=1))
    rows = readers.geojson(spark, str(file), "EPSG:3067").collect()
    assert [r["kind"] for r in rows] == ["Polygon", "MultiPolygon", "Point", None]
    assert rows[0]["feature_id"] == "a" and rows[0]["properties"]["db_hi"] == "55" and rows[0]["polygons"] == [[[[float(c) for c in p] for p in square[0]]]]
    assert len(rows[1]["polygons"]) == 2 and rows[2]["point"] == [24.9, 60.2] and rows[3]["polygons"] is None
    with pytest.raises(Exception, match="EPSG:3879"):
        readers.geojson(spark, str(file), "EPSG:3879").collect()


def test_timetable_archive(spark, tmp_path):
    file = tmp_path / "gtfs.zip"
    with zipfile.ZipFile(file, "w") as z:
        z.writestr("calendar.txt", "﻿service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\ns,1,1,1,1,1,0,0,20260101,20261231\nt,0,0,0,0,0,1,1,20260101,20261231\n")
        z.writestr("trips.txt", "route_id,service_id,trip_id\nr,s,1\nr,s,2\nr,t,3\n")
        z.writestr("stop_times.txt", "trip_id,arrival_time,departure_time,stop_id,stop_sequence\n1,07:10:00,07:10:00,A,1\n1,07:30:00,07:30:00,C,2\n2,07:20:00,07:20:00,B,1\n2,07:25:00,07:25:00,C,10\n3,25:00:00,25:00:00,A,1\n3,25:10:00,25:10:00,B,2\n")
    t = {n: readers.gtfs(spark, str(file), n) for n in readers.GTFS}
    assert t["calendar_dates"].count() == 0 and t["stop_times"].count() == 6
    services = transit.active_services(t["calendar"], t["calendar_dates"], "20260105")
    got = transit.connections(t["stop_times"], t["trips"], services).collect()
    assert sorted(tuple(r) for r in got) == [("1", "A", 25800, "C", 27000), ("2", "B", 26400, "C", 26700)]


def test_ownership(spark, tmp_path):
    file = tmp_path / "o.csv"
    file.write_text("building_id,luokka\n1,kaupunki\n2,muu omistaja\n2,muu omistaja\n")
    assert sorted(tuple(r) for r in readers.ownership(spark, str(file)).collect()) == [("1", "city", "high"), ("2", "non_city", "low")]
    for text, said in (("3,kaupunki\n3,muu omistaja\n", "conflicting class: 3"), (",kaupunki\n", "empty building_id"), ("4,valtio\n", "unsupported class: valtio")):
        file.write_text("building_id,luokka\n" + text)
        with pytest.raises(Exception, match=said):
            readers.ownership(spark, str(file)).collect()
    file.write_text("id,luokka\n1,kaupunki\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.ownership(spark, str(file)).collect()


def test_samples_and_footers(spark, tmp_path):
    t = pa.table({"building_id": ["a", "b"], "departure_time": ["07:00", "07:00"], "state": ["known", "unknown"], "duration_seconds": [60.0, None]})
    pq.write_table(t.replace_schema_metadata({"transit_parameters": '{"version": 2}'}), tmp_path / "transit-1.parquet")
    pq.write_table(t.slice(0, 1), tmp_path / "transit-2.parquet")
    known = spark.createDataFrame([("a",)], "building_id string")
    assert readers.journey_samples(spark, str(tmp_path / "*.parquet"), known).count() == 2
    got = sorted((r["file"].rsplit("/")[-1], r["n_rows"], r["parameters"]) for r in readers.parquet_footers(spark, str(tmp_path / "*.parquet")).collect())
    assert got == [("transit-1.parquet", 2, '{"version": 2}'), ("transit-2.parquet", 1, None)]
