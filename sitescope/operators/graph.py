"""Street graphs: degrees, components, shortest paths and cycling measures."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitescope.plans.lineage import cut

# Seconds lost at a signal, a crossing and a turn, the share of
# the speed that is left on slow surfaces, and the metres within which turns are one.
SIGNAL_S, CROSSING_S, TURN_S, SLOW_SHARE, TURN_GAP_M = 30.0, 2.0, 10.0, 0.65, 25.0
#: Nodes of a part in path searches, as a power of 2.
PART_BITS = 14


def both_ways(edges: DataFrame, weight: str = "w") -> DataFrame:
    """Undirected edges in both directions, the least weight of parallel ones."""
    e = edges.where("src <> dst").select("src", "dst", weight)
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), weight)).groupBy("src", "dst").agg(F.min(weight).alias(weight))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def shortest_paths(edges: DataFrame, sources: DataFrame, weight: str = "w", rounds: int = 100_000) -> DataFrame:
    """Distance of every reachable node from the nearest source.

    ``sources``: (node, d) with the cost to enter there.  Frontier
    relaxation: only nodes that got nearer are joined with their edges; the
    lineage is cut by checkpoints in the folder the session names.
    """
    e = both_ways(edges, weight).persist()
    best = cut(sources.groupBy("node").agg(F.min("d").alias("d")))
    front = best
    for i in range(rounds):
        step = front.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("d") + F.col(weight)).alias("n")).groupBy("node").agg(F.min("n").alias("n"))
        new = step.join(best, "node", "left").where("d IS NULL OR n < d").select("node", F.col("n").alias("d"))
        new = cut(new)
        if new.isEmpty():
            break
        best = cut(best.join(new.withColumnRenamed("d", "n"), "node", "full").select("node", F.least("d", "n").alias("d")))
        front = new
    e.unpersist()
    return best


def path_distances_by_group(edges: DataFrame, sources: DataFrame, weight: str = "w", part_bits: int = PART_BITS) -> DataFrame:
    """(grp, node, d): distance from the nearest source of each group.

    Nodes are dealt into parts of ``2 ** part_bits`` consecutive ids.  In each
    round a part searches by heap from its nodes that got nearer, and offers
    distances to the nodes of other parts that its edges lead to; it ends
    when no offer is nearer.  Weights are not negative.
    """
    part = lambda c: F.shiftright(F.col(c).cast("long"), part_bits).alias("part")
    e = cut(both_ways(edges, weight).select("src", "dst", weight, part("src")))

    def relax(t_state: pa.Table, t_edges: pa.Table) -> pa.Table:
        near: dict[int, list[tuple[int, float]]] = {}
        groups: dict[int, tuple[dict[int, float], list[tuple[float, int]]]] = {}
        for g, n, d, fresh in zip(*(t_state.column(c).to_pylist() for c in ("grp", "node", "d", "fresh")), strict=True):
            best, todo = groups.setdefault(g, ({}, []))
            best[n] = d
            if fresh:
                todo.append((d, n))
        if any(todo for _, todo in groups.values()):
            for a, b, w in zip(*(t_edges.column(c).to_pylist() for c in ("src", "dst", weight)), strict=True):
                near.setdefault(a, []).append((b, w))
        rows: list[tuple[int, int, float, bool]] = []
        for g, (best, todo) in groups.items():
            offers: dict[int, float] = {}
            heapq.heapify(todo)
            while todo:
                d, n = heapq.heappop(todo)
                if d > best[n]:
                    continue
                mine = n >> part_bits
                for m, w in near.get(n, ()):
                    to = best if m >> part_bits == mine else offers
                    if m not in to or d + w < to[m]:
                        to[m] = d + w
                        if to is best:
                            heapq.heappush(todo, (d + w, m))
            rows += [(g, n, float(d), False) for n, d in best.items()] + [(g, n, float(d), True) for n, d in offers.items()]
        types = (pa.int64(), pa.int64(), pa.float64(), pa.bool_())
        cols = zip(*rows, strict=True) if rows else ((),) * 4
        return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["grp", "node", "d", "fresh"])

    # of equal distances the one that was searched from already stays
    nearest = lambda s: cut(s.groupBy("grp", "node").agg(F.min(F.struct("d", "fresh")).alias("b")).select("grp", "node", "b.d", "b.fresh"))
    state = nearest(sources.select(F.col("grp").cast("long"), F.col("node").cast("long"), F.col("d").cast("double"), F.lit(True).alias("fresh")))
    while not state.where("fresh").isEmpty():
        out = state.withColumn("part", part("node")).groupBy("part").cogroup(e.groupBy("part")).applyInArrow(relax, "grp long, node long, d double, fresh boolean")
        state = nearest(out)
    return state.select("grp", "node", "d")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that is connected."""
    e = both_ways(edges)
    label = cut(e.select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        near = e.join(label, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("component").alias("m"))
        step = label.join(near, F.col("node") == F.col("src"), "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"))
        hop = step.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = cut(step.join(hop, "component").select("node", F.col("up").alias("component")))
        if new.join(label.withColumnRenamed("component", "old"), "node").where("component <> old").isEmpty():
            return new
        label = new


def main_component(edges: DataFrame) -> DataFrame:
    """(node) of the component with most nodes; of equal ones, the one whose
    smallest node is least."""
    labelled = components(edges)
    sizes = labelled.groupBy("component").agg(F.count("*").alias("n"))
    best = sizes.agg(F.max(F.struct("n", (-F.col("component")).alias("c"))).alias("m")).select((-F.col("m.c")).alias("component"))
    return labelled.join(F.broadcast(best), "component", "left_semi").select("node")


def cycling_cost(length: Column, speed: float, slow: Column, delay_a: Column, delay_b: Column) -> Column:
    """Seconds of an edge: its length, and half of each end's delay."""
    return length / F.when(slow, speed * SLOW_SHARE).otherwise(speed) + (delay_a + delay_b) / 2


def node_delay(signal: Column, crossing: Column) -> Column:
    return F.when(signal, SIGNAL_S).otherwise(0.0) + F.when(crossing, CROSSING_S).otherwise(0.0)


def effective_minutes(cost_s: Column, turns: Column) -> Column:
    return F.round((cost_s + turns * TURN_S) / 60, 1)


def _part(x: Column, good: float, poor: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(poor) - x) / (poor - good)))


def ease_score(route_m: Column, straight_m: Column, stops: Column, turns: Column, slow_m: Column) -> Column:
    """0 to 100: stops, turns, detour and comfort by their weights."""
    km = F.greatest(route_m / 1000, F.lit(1.0))
    detour = F.when(straight_m <= 0, 1.0).otherwise(F.try_divide(route_m, straight_m))
    comfort = 1 - F.least(F.coalesce(F.try_divide(slow_m, route_m), F.lit(0.0)), F.lit(1.0))
    s = _part(stops / km, 0.75, 1.65) * 0.35 + _part(turns / km, 1.0, 5.0) * 0.25 + _part(detour, 1.2, 1.6) * 0.20 + comfort * 0.20
    return F.round(s * 100, 1)


def heading_change(b1: Column, b2: Column) -> Column:
    return F.abs(F.pmod(b2 - b1 + 180, F.lit(360.0)) - 180)


def is_turn(b1: Column, b2: Column, degree: Column) -> Column:
    return (heading_change(b1, b2) >= 40) & (degree >= 3)
