"""Graph queries over more parts and suppliers than the smallest tables have."""

from __future__ import annotations

import heapq
import random
from collections import defaultdict

import pytest

from sitescope.operators import graph
from sitescope.plans.catalog import QUERIES

PARTS, SUPPLIERS = 1000, 120


def both(edges):
    near = defaultdict(dict)
    for a, b, w in edges:
        if a != b:
            for x, y in ((a, b), (b, a)):
                near[x][y] = min(w, near[x].get(y, w))
    return near


def distances(near, sources):
    done, todo = {}, sorted((d, n) for n, d in sources)
    while todo:
        d, n = heapq.heappop(todo)
        if n not in done:
            done[n] = d
            for m, w in near[n].items():
                heapq.heappush(todo, (d + w, m))
    return done


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.range(PARTS).withColumnRenamed("id", "p_partkey").write.parquet(f"{path}/part.parquet")
    spark.range(SUPPLIERS).withColumnRenamed("id", "s_suppkey").write.parquet(f"{path}/supplier.parquet")
    return path


@pytest.fixture(scope="module")
def edges():
    return [(k, k + 1, k % 7 + 1) for k in range(PARTS)] + [(k, k + 20, k % 5 + 3) for k in range(PARTS)]


def test_all_edges(spark, sf, edges):
    got = {r["node"]: r["degree"] for r in QUERIES["node_degree"](spark, sf).collect()}
    assert got == {n: len(m) for n, m in both(edges).items()}
    rows = [(r["src"], r["dst"]) for r in QUERIES["cycling_cost"](spark, sf).collect()]
    assert sorted(rows) == sorted((a, b) for a, b, _ in edges)


def test_all_components(spark, sf, edges):
    near = both([e for e in edges if e[0] % 10 != 9 and e[2] != 3])
    want = {}
    for n in sorted(near):
        if n not in want:
            want.update({m: n for m in distances(near, [(n, 0)])})
    assert {r["node"]: r["component"] for r in QUERIES["components"](spark, sf).collect()} == want


def test_all_paths(spark, sf, edges):
    near = both(edges)
    assert {r["node"]: r["d"] for r in QUERIES["shortest_path"](spark, sf).collect()} == distances(near, [(0, 0)])
    want = {}
    for g in range(3):
        d = distances(near, [(s * 4, s % 5) for s in range(SUPPLIERS) if s % 3 == g])
        want |= {(g, n): float(v) for n, v in d.items()}
    assert {(r["grp"], r["node"]): r["d"] for r in QUERIES["route_to_sites"](spark, sf).collect()} == want


def test_paths_across_parts(spark):
    """Paths that leave a part and come back to it."""
    rng = random.Random(4)
    e = [(rng.randrange(-20, 60), rng.randrange(-20, 60), rng.randint(0, 9)) for _ in range(120)]
    src = [(rng.randrange(3), rng.randrange(-20, 60), float(rng.randint(0, 5))) for _ in range(6)] + [(5, 1000, 2.0)]
    df, s = spark.createDataFrame(e, "src long, dst long, w long"), spark.createDataFrame(src, "grp long, node long, d double")
    want = {(g, n): d for g in {x[0] for x in src} for n, d in distances(both(e), [(n, d) for h, n, d in src if h == g]).items()}
    got = graph.path_distances_by_group(df, s, part_bits=3).collect()
    assert {(r["grp"], r["node"]): r["d"] for r in got} == want and len(got) == len(want)
