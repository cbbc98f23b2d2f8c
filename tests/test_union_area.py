"""Areas of footprints under unions of boxes, against unit cells."""

from __future__ import annotations

import random

import duckdb
import pytest
from compare import connect, differences

from sitescope.operators import spatial
from sitescope.plans import catalog


def test_unit_cells(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for k in range(150):
        x, y, w, h = rng.randrange(-20, 20), rng.randrange(-20, 20), rng.randrange(1, 12), rng.randrange(1, 12)
        cells = set()
        for _ in range(rng.choice([1, 1, 2, 5, 30])):
            a, b = rng.randrange(x - 6, x + w + 3), rng.randrange(y - 6, y + h + 3)
            c, d = a + rng.randrange(0, 9), b + rng.randrange(0, 9)
            rows.append((k, x, y, x + w, y + h, a, b, c, d))
            cells |= {(i, j) for i in range(max(x, a), min(x + w, c)) for j in range(max(y, b), min(y + h, d))}
        if cells:
            want[k] = float(len(cells))
    rows += rows[:50]
    df = spark.createDataFrame(rows, "k long, x long, y long, x1 long, y1 long, a long, b long, c long, d long")
    got = spatial.union_area(df, ("x", "y", "x1", "y1"), ("a", "b", "c", "d"), ["k", "x", "y", "x1", "y1"])
    assert {r["k"]: r["covered"] for r in got.collect()} == want and len(want) > 50


@pytest.mark.parametrize("name", ["category_shares", "full_cover_class"])
def test_copies_of_sites_and_zones(spark, tmp_path, name):
    """Repeated with shifted keys, as larger tables are; no row goes through Python."""
    src = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t, k in (("customer", "c_custkey"), ("part", "p_partkey")):
        con.execute(f"COPY (SELECT t.* REPLACE ({k} + i * 20000 AS {k}) FROM '{src}/{t}.parquet' t, range(3) r(i)) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT * FROM '{src}/nation.parquet') TO '{tmp_path}/nation.parquet' (FORMAT parquet)")
    query = catalog.QUERIES[name]
    plan = query(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan
    assert differences(spark, connect(str(tmp_path)), query, catalog.SQL[name], str(tmp_path)) == ""


def test_outermost_boxes(spark):
    rows = [(c, 0, 0, x, y) for c in ("a", "b", None) for x, y in ((5, 5), (5, 5), (3, 3), (9, 2), (9, 1), (2, 9), (2, 8), (None, 4))]
    df = spark.createDataFrame([*rows, ("a", 1, 0, 2, 2)], "c string, x long, y long, x1 long, y1 long")
    got = spatial.outermost(df, ("x", "y", "x1", "y1"), ["c"]).where("x1 IS NOT NULL").select("c", "x", "y", "x1", "y1").collect()
    want = [(c, 0, 0, *e) for c in ("a", "b", None) for e in ((5, 5), (9, 2), (2, 9))] + [("a", 1, 0, 2, 2)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("name", ["category_shares", "full_cover_class"])
def test_copies_of_other_sizes_add_no_pairs(spark, tmp_path, name, monkeypatch):
    """Copies of zones that differ in size share a corner: one of them counts."""
    src = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("customer", "nation"):
        con.execute(f"COPY (SELECT * FROM '{src}/{t}.parquet') TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    con.execute(
        f"COPY (SELECT t.* REPLACE (p_partkey + i * 20000 AS p_partkey, 1 + (p_size + i * 7) % 50 AS p_size) FROM '{src}/part.parquet' t, range(6) r(i)) TO '{tmp_path}/part.parquet' (FORMAT parquet)"
    )
    taken = []
    area = spatial.union_area
    monkeypatch.setattr(spatial, "union_area", lambda pairs, *a: taken.append(pairs) or area(pairs, *a))
    assert differences(spark, connect(str(tmp_path)), catalog.QUERIES[name], catalog.SQL[name], str(tmp_path)) == ""
    of = ["x", "y", "w", "h", "zx", "zy", *(["category"] if name == "category_shares" else [])]
    assert taken[0].select(*of).distinct().count() == taken[0].count() > 0
