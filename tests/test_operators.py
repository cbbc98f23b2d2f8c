"""Closed forms and golden values of the operators."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitescope.functions import text as T
from sitescope.operators import geometry, graph, scoring, spatial, stats, transit, values


def square(x0, y0, x1, y1):
    return np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], float)


def test_slab_area():
    base = [square(0, 0, 10, 10)]
    assert spatial.slab_area(base, [[square(0, 0, 6, 10)], [square(6, 0, 8, 10)]]) == pytest.approx(80)
    assert spatial.slab_area(base, [[square(0, 0, 10, 10)], [square(0, 0, 10, 10)]]) == pytest.approx(100)
    assert spatial.slab_area(base, [[square(0, 0, 0.1, 10)]]) == pytest.approx(1)
    bow = np.array([(0, 0), (10, 10), (10, 0), (0, 10)], float)
    assert spatial.slab_area(base, [[bow]]) == pytest.approx(50)
    assert spatial.slab_area([square(0, 0, 6, 6), square(1, 1, 3, 3)], [[square(0, 0, 10, 10)]]) == pytest.approx(32)
    assert spatial.slab_area(base, []) == 0 and spatial.slab_area(base, [[square(20, 20, 30, 30)]]) == 0
    d = spatial.disc(0, 0, 3)
    assert spatial.slab_area([d], [[square(-5, -5, 5, 5)]]) == pytest.approx(32 * 9 * math.sin(2 * math.pi / 64))


def test_representative_point_is_inside():
    x, y = spatial.representative_point([square(0, 0, 4, 4), square(1, 1, 3, 3)])
    assert 0 < x < 4 and 0 < y < 4 and not (1 < x < 3 and 1 < y < 3)


def test_tiles_and_cells(spark):
    df = spark.createDataFrame([(1, 24.94, 60.17, 24.941, 60.171), (2, float("nan"), 0.0, 1.0, 1.0), (3, 170.0, 0.0, 190.0, 1.0)], "id int, w double, s double, e double, n double")
    got = spatial.tiles(df, "w", "s", "e", "n", 16).select("id", "tx", "ty").collect()
    assert [tuple(r) for r in got] == [(1, 37308, 18969)]
    low = spark.createDataFrame([(0.0, -1.0, 0.01, 1.0)], "w double, s double, e double, n double")
    assert sorted(tuple(r) for r in spatial.tiles(low, "w", "s", "e", "n", 1).select("tx", "ty").collect()) == [(1, 0), (1, 1)]
    cx, cy = spatial.mercator_cell(F.col("w"), F.col("s"), 1000.0)
    assert tuple(df.where("id = 1").select(cx, cy).first()) == (2776, 8437)


def test_breaks_and_histogram(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 10, 20, 30, 100)], "v double").withColumn("k", F.lit(1))
    assert stats.quantile_breaks(df, "v", ["k"], "income").first()["breaks"] == [0.8, 6.0, 14.4, 22.4, 28.8, 55.2, 77.6]
    assert stats.quantile_breaks(df, "v", ["k"]).first()["breaks"] == [0.8, 3.2, 6.4, 11.2, 17.6, 25.6, 58.0]
    flat = spark.range(101).select(F.col("id").cast("double").alias("v"), F.lit(1).alias("k"))
    rows = stats.histogram(flat, "v", ["k"], 10).collect()
    assert sum(r["n"] for r in rows) == 101 and {(r["lo"], r["hi"]) for r in rows} == {(0.0, 100.0)}
    odd = [1.0, 999_999_999.0] + [1900.0 + i % 120 for i in range(600)]
    rows = stats.histogram(spark.createDataFrame([(x, 1) for x in odd], "v double, k int"), "v", ["k"], 10).collect()
    assert 585 <= sum(r["n"] for r in rows) <= 595 and 2018 <= rows[0]["hi"] <= 2020 and rows[0]["known"] == 602 and 1900 <= rows[0]["lo"] <= 1902


@pytest.mark.parametrize(("ramp", "value", "score"), [
    (("lower_is_better", 25, 40), 20, 1), (("lower_is_better", 25, 40), 32.5, 0.5), (("lower_is_better", 25, 40), 45, 0),
    (("higher_is_better", 800, 300), 550, 0.5), (("range", 1930, 1939), 1939, 1), (("range", 1930, 1939), 1940, 0),
])
def test_ramps(spark, ramp, value, score):
    assert spark.range(1).select(scoring.Ramp(*map(lambda x: x if isinstance(x, str) else float(x), ramp)).score(F.lit(float(value)))).first()[0] == pytest.approx(score)


def test_reversed_ramp_and_bad_weight():
    with pytest.raises(ValueError):
        scoring.Ramp("lower_is_better", 40.0, 25.0)
    with pytest.raises(ValueError):
        scoring.Group("g", (), weight=-1.0)


def test_policy_and_denominator(spark):
    v = spark.createDataFrame([(1, "a", "partial", [5.0], []), (2, "a", "known", [1.0], [])], "building_id int, layer_id string, state string, nums array<double>, cats array<string>")
    b = spark.createDataFrame([(1,), (2,), (3,)], "building_id int")
    g = (scoring.Group("g", (scoring.Criterion("a", 2.0),), dealbreaker=True),)
    soft = {r["building_id"]: r for r in scoring.suitability(v, b, scoring.Preferences(g)).collect()}
    hard = {r["building_id"]: r for r in scoring.suitability(v, b, scoring.Preferences(g, True)).collect()}
    assert soft[1]["eligible"] and soft[1]["missing"] == ["g"] and not hard[1]["eligible"]
    assert not soft[2]["eligible"] and soft[2]["score"] is None
    assert soft[3]["eligible"] and soft[3]["score"] is None and not hard[3]["eligible"]


def test_conflicts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, None)], "k int, v string")
    assert {r["k"]: r["v"] for r in values.conflict_free(df, ["k"], ["v"]).collect()} == {1: "a", 2: None, 3: None}


def test_shortest_paths_and_components(spark):
    edges = [(i, i + 1, 1 + i % 3) for i in range(12)] + [(0, 6, 2), (20, 21, 1)]
    e = spark.createDataFrame(edges, "src long, dst long, w long")
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    want, todo = {}, [(0, 0)]
    while todo:
        d, n = heapq.heappop(todo)
        if n not in want:
            want[n] = d
            for m, w in near[n]:
                heapq.heappush(todo, (d + w, m))
    src = spark.createDataFrame([(0, 0)], "node long, d long")
    assert {r["node"]: r["d"] for r in graph.shortest_paths(e, src).collect()} == want
    by = graph.path_distances_by_group(e, src.select(F.lit(7).cast("long").alias("grp"), "node", F.col("d").cast("double").alias("d")))
    assert {r["node"]: r["d"] for r in by.collect()} == want
    comp = {r["node"]: r["component"] for r in graph.components(e).collect()}
    assert comp[12] == 0 and comp[21] == 20


def test_ease_score(spark):
    s = lambda *a: spark.range(1).select(graph.ease_score(*[F.lit(float(x)) for x in a])).first()[0]
    assert s(5000, 5000, 1, 1, 0) == 100 and s(300, 300, 1, 0, 0) > 80


def test_timetable(spark):
    cal = spark.createDataFrame([("s", "1", "1", "1", "1", "1", "0", "0", "20260101", "20261231")], "service_id string, monday string, tuesday string, wednesday string, thursday string, friday string, saturday string, sunday string, start_date string, end_date string")
    exc = spark.createDataFrame([("x", "20260902", "1"), ("y", "20260902", "2")], "service_id string, date string, exception_type string")
    act = transit.active_services(cal, exc, "20260902")
    assert sorted(r[0] for r in act.collect()) == ["s", "x"]
    trips = spark.createDataFrame([("r", "s", "t1"), ("r", "s", "t2")], "route_id string, service_id string, trip_id string")
    st = spark.createDataFrame([("t1", "07:10:00", "07:10:00", "A", "1"), ("t1", "07:30:00", "07:30:00", "C", "2"), ("t2", "07:20:00", "07:20:00", "B", "1"), ("t2", "07:25:00", "07:25:00", "C", "2")], "trip_id string, arrival_time string, departure_time string, stop_id string, stop_sequence string")
    con = transit.connections(st, trips, act)
    goals = spark.createDataFrame([(1, "C")], "grp long, stop string")
    prof = transit.profiles(con, goals)
    access = spark.createDataFrame([("o", "A", 0), ("o", "B", 900)], "origin string, stop string, walk_s int")
    assert transit.fastest_minutes(prof, access, goals, 7 * 3600).first()["minutes"] == 25


def test_worst_of_best(spark):
    df = spark.createDataFrame([(1, 31.5), (1, None), (1, 28.0)], "b int, m double")
    r = transit.worst_of_best(df, ["b"], "m").first()
    assert (r["value"], r["state"]) == (31.5, "partial") and r["coverage"] == pytest.approx(2 / 3)


def test_property_ids(spark):
    got = spark.range(1).select(T.property_ids(F.lit("91-437-1-14 ja 91–45–144–2, 91-437-1-14"))).first()[0]
    assert got == ["09143700010014", "09104501440002"]


def test_projection(spark):
    e, n = spatial.transverse_mercator(F.lit(27.0), F.lit(60.0), 27.0)
    x, y = spark.range(1).select(e, n).first()
    assert x == pytest.approx(500_000) and y == pytest.approx(6_654_072.8, abs=2)


def test_nearest_without_coordinates(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 3.0)], "k long, x double, y double")
    right = spark.createDataFrame([(7, 3.0, 4.0)], "r long, rx double, ry double")
    got = sorted(tuple(r) for r in spatial.nearest(left, right, "k", "x", "y", "r", "rx", "ry", 2.0).collect())
    assert got == [(1, 7, 5.0), (2, None, None)]


def test_geojson_ring(spark):
    row = spark.createDataFrame([('{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[1,2],[3,4]]]}}',), ('{"type":"Point"}',), (None,)], "t string")
    got = [r[0] for r in row.select(geometry.feature_ring(F.col("t"))).collect()]
    assert got == [[[1.0, 2.0], [3.0, 4.0]], None, None]
