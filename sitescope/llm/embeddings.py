"""Embedding near-dedup by hierarchical navigable small-world graphs.

Vectors of one label are dealt into shards of about ``SHARD`` by hash; each
shard gets a graph of its own, built by inserting one vector after another
through a search of the graph so far.  Every vector then queries every shard
of its label: a row for each pair of shards holds both graphs and answers the
queries both ways.  A query's beam widens while all of it is near enough, and
a shard's beam widens until an audit of some queries against brute force
reaches ``AUDIT_RECALL`` of their links - and, where links are rare, of the
nearest vectors of queries without one; where no beam does, the two shards
are compared by brute force.  Similarities that count are recomputed in double
precision.

Identical vectors of a label are one node with a multiplicity, so a group of
copies costs one vector; a pair of shards reports the number of links of each
vector and a spanning forest of its links, never all pairs.  Components are
united by distributed contraction.

Defined cases: null, empty and zero vectors, and those with null or
non-finite components, link with nothing, as do vectors with a null label;
vectors of different length don't link; rows with a null or repeated id are
rows of their own; a component is named by its smallest id, null if it has
none, and kept is false for a null id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitescope.llm.common import components, materialize

#: Vectors of a graph: each vector asks every graph of its label, so larger ones spare work; two must fit a task.
SHARD = 16384
THRESHOLD = 0.93
NEIGHBOURS = 12
BUILD_BEAM = 40
BEAM = 24
AUDITS = 48
#: Rows of a shard that are drawn at most to find queries with a link, and linked ones that are enough by themselves.
DRAW, FEW_LINKED = 4096, 16
NEAREST = 5
AUDIT_RECALL = 0.95


class Graph:
    """A navigable small-world graph over unit vectors."""

    def __init__(self, x: np.ndarray, neighbours: int = NEIGHBOURS, beam: int = BUILD_BEAM) -> None:
        self.x = np.ascontiguousarray(x, np.float32)
        self.m, self.beam = neighbours, beam
        n = len(x)
        # levels from a fixed stream: a lost task builds the same graph again
        u = np.random.default_rng(20_011).random(n)
        self.levels = np.minimum((-np.log(np.maximum(u, 1e-12)) / np.log(neighbours)).astype(np.int64), 8)
        self.links: list[np.ndarray] = []
        self.count: list[np.ndarray] = []
        top = int(self.levels.max()) if n else 0
        for lv in range(top + 1):
            self.links.append(np.full((n, self.width(lv)), -1, np.int32))
            self.count.append(np.zeros(n, np.int32))
        self.entry, self.high = 0, 0
        self._seen = np.zeros(n, np.int32)
        self._mark = 0
        for i in range(n):
            self._insert(i)

    def width(self, level: int) -> int:
        return self.m * 2 if level == 0 else self.m

    def _climb(self, q: np.ndarray, start: int, level: int) -> int:
        """Greedy walk to the best node of one upper level."""
        best, sim = start, float(self.x[start] @ q)
        while True:
            near = self.links[level][best, : self.count[level][best]]
            if not len(near):
                return best
            s = self.x[near] @ q
            k = int(s.argmax())
            if s[k] <= sim:
                return best
            best, sim = int(near[k]), float(s[k])

    def search(self, q: np.ndarray, beam: int, level: int, start: int, limit: int | None = None, near: float = 2.0) -> list[tuple[float, int]]:
        """Best nodes by similarity; the beam doubles while even its worst
        member has similarity ``near``."""
        self._mark += 1
        seen, mark = self._seen, self._mark
        links, count, x = self.links[level], self.count[level], self.x
        s = float(x[start] @ q)
        seen[start] = mark
        todo = [(-s, start)]
        found = [(s, start)]
        while todo:
            d, c = heapq.heappop(todo)
            if len(found) >= beam:
                if -d < found[0][0]:
                    if found[0][0] < near:
                        break
                    beam *= 2
            around = links[c, : count[c]]
            if limit is not None:
                around = around[around < limit]
            around = around[seen[around] != mark]
            if not len(around):
                continue
            seen[around] = mark
            sims = x[around] @ q
            worst = found[0][0]
            if len(found) >= beam and worst >= near:
                beam *= 2
            for sim, node in zip(sims.tolist(), around.tolist(), strict=True):
                if len(found) < beam:
                    heapq.heappush(found, (sim, node))
                    heapq.heappush(todo, (-sim, node))
                elif sim > found[0][0]:
                    if found[0][0] >= near:
                        beam *= 2
                        heapq.heappush(found, (sim, node))
                    else:
                        heapq.heapreplace(found, (sim, node))
                    heapq.heappush(todo, (-sim, node))
        return found

    def _pick(self, base: np.ndarray, cand: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Neighbours that aren't nearer to one already picked than to the node."""
        order = np.argsort(-sims, kind="stable")
        cand, sims = cand[order], sims[order]
        if len(cand) <= most:
            return cand
        between = self.x[cand] @ self.x[cand].T
        taken: list[int] = []
        for k in range(len(cand)):
            if all(between[k, j] <= sims[k] for j in taken):
                taken.append(k)
                if len(taken) == most:
                    break
        if len(taken) < most:
            chosen = set(taken)
            taken += [k for k in range(len(cand)) if k not in chosen][: most - len(taken)]
        return cand[taken]

    def _insert(self, i: int) -> None:
        lv = int(self.levels[i])
        if i == 0:
            self.entry, self.high = 0, lv
            return
        q, at = self.x[i], self.entry
        for level in range(self.high, lv, -1):
            at = self._climb(q, at, level)
        for level in range(min(lv, self.high), -1, -1):
            found = self.search(q, self.beam, level, at)
            sims = np.array([f[0] for f in found], np.float32)
            cand = np.array([f[1] for f in found], np.int64)
            at = int(cand[sims.argmax()])
            width = self.width(level)
            chosen = self._pick(q, cand, sims, self.m)
            links, count = self.links[level], self.count[level]
            links[i, : len(chosen)] = chosen
            count[i] = len(chosen)
            for c in chosen.tolist():
                k = count[c]
                if k < width:
                    links[c, k] = i
                    count[c] = k + 1
                else:
                    all_ = np.append(links[c], i)
                    kept = self._pick(self.x[c], all_, self.x[all_] @ self.x[c], width)
                    links[c, : len(kept)] = kept
                    links[c, len(kept) :] = -1
                    count[c] = len(kept)
        if lv > self.high:
            self.entry, self.high = i, lv

    def ask(self, q: np.ndarray, threshold: float, beam: int) -> list[tuple[float, int]]:
        """What a search of the whole graph ends with."""
        at = self.entry
        for level in range(self.high, 0, -1):
            at = self._climb(q, at, level)
        return self.search(q, beam, 0, at, near=threshold - 1e-4)

    def near(self, q: np.ndarray, threshold: float, beam: int) -> list[int]:
        # rounding in single precision must not cut off what double admits
        return [n for s, n in self.ask(q, threshold, beam) if s >= threshold - 1e-4]

    def to_bytes(self) -> bytes:
        import io

        out = io.BytesIO()
        arrays = {"x": self.x, "levels": self.levels.astype(np.int8), "at": np.array([self.entry, self.high, self.m, self.beam])}
        for k, (a, n) in enumerate(zip(self.links, self.count, strict=True)):
            rows = np.flatnonzero(self.levels >= k)
            arrays |= {f"l{k}": a[rows], f"c{k}": n[rows], f"r{k}": rows.astype(np.int32)}
        np.savez(out, **arrays)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Graph:
        import io

        z = np.load(io.BytesIO(data))
        g = cls.__new__(cls)
        g.x, g.levels = z["x"], z["levels"].astype(np.int64)
        g.entry, g.high, g.m, g.beam = (int(v) for v in z["at"])
        n = len(g.x)
        g.links, g.count = [], []
        k = 0
        while f"l{k}" in z:
            a, c, rows = np.full((n, g.width(k)), -1, np.int32), np.zeros(n, np.int32), z[f"r{k}"]
            a[rows], c[rows] = z[f"l{k}"], z[f"c{k}"]
            g.links.append(a)
            g.count.append(c)
            k += 1
        g._seen, g._mark = np.zeros(n, np.int32), 0
        return g


def _drawn(g: Graph, queries: np.ndarray, threshold: float, audits: int, own: bool) -> list[tuple[int, set[int]]]:
    """Queries to audit, each with what it should find.  Rows are drawn until
    ``audits`` of them have a link, ``DRAW`` at most; where fewer than
    ``FEW_LINKED`` have one, the ``NEAREST`` nearest vectors of some others,
    which every query has, are asked for too."""
    order = np.random.default_rng(20_021).permutation(len(queries))[:DRAW]
    linked: list[tuple[int, set[int]]] = []
    others: list[tuple[int, set[int]]] = []
    for at in range(0, len(order), 256):
        part = order[at : at + 256]
        sims = queries[part] @ g.x.T
        if own:
            sims[np.arange(len(part)), part] = -2.0
        for row, i in zip(sims, part.tolist(), strict=True):
            if len(linked) == audits:
                return linked
            near = np.flatnonzero(row >= threshold)
            if len(near):
                linked.append((i, set(near.tolist())))
            elif len(others) < audits:
                k = min(NEAREST, len(row) - own)
                others.append((i, set(np.argpartition(-row, k - 1)[:k].tolist())))
    return linked if len(linked) >= FEW_LINKED else linked + others


def audited_beam(g: Graph, queries: np.ndarray, threshold: float, beam: int = BEAM, audits: int = AUDITS, recall: float = AUDIT_RECALL,
                 own: bool = False) -> tuple[int | None, float]:
    """The beam at which drawn queries find what brute force finds, and the
    recall measured there, a mean over queries.  None if no beam short of the
    whole graph does.  ``own``: queries are the graph's vectors, and don't
    count themselves."""
    if not len(queries) or len(g.x) <= own:
        return beam, 1.0
    truth = _drawn(g, queries, threshold, audits, own)
    while beam < len(g.x):
        shares = [len(want & {n for _, n in g.ask(queries[i], threshold, beam)}) / len(want) for i, want in truth]
        if np.mean(shares) >= recall:
            return beam, float(np.mean(shares))
        beam *= 2
    return None, 1.0


def _all_near(g: Graph, queries: np.ndarray, threshold: float) -> Iterator[list[int]]:
    """:meth:`Graph.near` of each query by brute force, in parts."""
    for i in range(0, len(queries), 256):
        for sims in queries[i : i + 256] @ g.x.T:
            yield np.flatnonzero(sims >= threshold - 1e-4).tolist()


def pair_links(a: Graph, b: Graph, xa: np.ndarray, xb: np.ndarray, threshold: float, same: bool, audit: list[float] | None = None) -> Iterator[tuple[int, int]]:
    """Links between two shards (once each, in either's index), asked both
    ways; ``audit`` gets the recalls that were measured."""
    audit = [] if audit is None else audit

    def ask(g: Graph, queries: np.ndarray) -> Iterable[list[int]]:
        beam, recall = audited_beam(g, queries, threshold, own=same)
        audit.append(recall)
        return _all_near(g, queries, threshold) if beam is None else (g.near(q, threshold, beam) for q in queries)

    found: list[set[int]] = [set(near) for near in ask(b, a.x)]
    if same:
        for i, near in enumerate(found):
            for j in list(near):
                found[j].add(i)
    else:
        for j, near in enumerate(ask(a, b.x)):
            for i in near:
                found[i].add(j)
    for i, near in enumerate(found):
        if near:
            js = np.fromiter(near, np.int64, len(near))
            js = js[xb[js] @ xa[i] >= threshold]
            for j in js.tolist():
                if not same or i < j:
                    yield i, j


class _Forest(dict):
    def root(self, a: int) -> int:
        while self.setdefault(a, a) != a:
            self[a] = self[self[a]]
            a = self[a]
        return a


def _few(rows: DataFrame) -> DataFrame:
    """``rows``, to be broadcast if there are few."""
    return F.broadcast(rows) if rows.count() <= 100_000 else rows


def _normal(values: pa.Array) -> np.ndarray:
    x = np.array(values.to_pylist(), np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                    threshold: float = THRESHOLD, shard: int = SHARD) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept and
    audit_recall, the least recall that an audit of the vectors' label measured."""
    v = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists("x", lambda e: e != 0), F.lit(False))
    # + 0.0 makes one zero of both
    v = v.withColumn("x", F.transform("x", lambda e: e + F.lit(0.0))).select(
        F.monotonically_increasing_id().alias("uid"), "vec_id", "label", "x",
        F.when(usable, F.xxhash64("x")).alias("h"), F.when(usable, F.xxhash64(F.lit(1), "x")).alias("h2"),
    )
    member = materialize(v, "emb-rows")
    # the same vector under the same label is one node; its name is a row's number
    node = member.where("h IS NOT NULL").groupBy("label", "h", "h2").agg(F.min("uid").alias("node"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
    node = materialize(node, "emb-nodes")
    sizes = node.groupBy("label").agg(F.count("*").alias("in_label")).select(F.col("label").alias("l"), "in_label")
    named = node.join(_few(sizes), F.col("label") == F.col("l")).select(
        "node", "n", F.pmod(F.xxhash64("node"), F.ceil(F.col("in_label") / F.lit(shard)).cast("long")).alias("shard")
    )
    first = member.where("h IS NOT NULL").join(named, F.col("uid") == F.col("node")).select("label", "node", "n", "x", F.size("x").alias("dim"), "shard")

    def build(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("node").to_numpy())
        t = t.take(pa.array(order))
        x = _normal(t.column("x").combine_chunks())
        return pa.table({
            "label": t.column("label")[:1], "dim": t.column("dim")[:1], "shard": t.column("shard")[:1],
            "nodes": pa.array([t.column("node").to_numpy()], pa.list_(pa.int64())), "copies": pa.array([t.column("n").to_numpy()], pa.list_(pa.int64())),
            "vectors": pa.array([x.tobytes()], pa.binary()), "graph": pa.array([Graph(x).to_bytes()], pa.binary()),
        })

    label_type = first.schema["label"].dataType.simpleString()
    graphs = first.select("label", "dim", "shard", "node", "n", "x").groupBy("label", "dim", "shard").applyInArrow(
        build, f"label {label_type}, dim int, shard long, nodes array<long>, copies array<long>, vectors binary, graph binary"
    )
    graphs = materialize(graphs, "emb-graphs")

    # every query block (a shard's own vectors) against every graph of its label
    left = graphs.select("label", "dim", *[F.col(c).alias(f"a_{c}") for c in ("shard", "nodes", "copies", "vectors", "graph")])
    right = graphs.select("label", "dim", *[F.col(c).alias(f"b_{c}") for c in ("shard", "nodes", "copies", "vectors", "graph")])
    jobs = left.join(right, ["label", "dim"]).where("a_shard <= b_shard").repartition("label", "dim", "a_shard", "b_shard")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                r = {n: b.column(n)[k] for n in b.schema.names}
                same = r["a_shard"].as_py() == r["b_shard"].as_py()
                ga = Graph.from_bytes(r["a_graph"].as_py())
                gb = ga if same else Graph.from_bytes(r["b_graph"].as_py())
                na, nb = r["a_nodes"].values.to_numpy(), r["b_nodes"].values.to_numpy()
                ca, cb = r["a_copies"].values.to_numpy(), r["b_copies"].values.to_numpy()
                xa = np.frombuffer(r["a_vectors"].as_py(), np.float64).reshape(len(na), -1)
                xb = xa if same else np.frombuffer(r["b_vectors"].as_py(), np.float64).reshape(len(nb), -1)
                links: dict[int, int] = {}
                forest, tree = _Forest(), []
                audit: list[float] = []
                for i, j in pair_links(ga, gb, xa, xb, threshold, same, audit):
                    p, q = int(na[i]), int(nb[j])
                    links[p] = links.get(p, 0) + int(cb[j])
                    links[q] = links.get(q, 0) + int(ca[i])
                    rp, rq = forest.root(p), forest.root(q)
                    if rp != rq:
                        forest[rp] = rq
                        tree.append((p, q))
                n, t = len(links), len(tree)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*links.keys(), *(p for p, _ in tree), None], pa.int64()),
                     pa.array([*[None] * n, *(q for _, q in tree), None], pa.int64()),
                     pa.array([*links.values(), *[0] * t, 0], pa.int64()),
                     pa.array([*[None] * (n + t), min(audit)], pa.float64()), pa.concat_arrays([b.column("label").slice(k, 1)] * (n + t + 1))],
                    names=["node", "other", "links", "recall", "label"],
                )

    found = materialize(jobs.mapInArrow(ask, f"node long, other long, links long, recall double, label {label_type}"), "emb-links")
    comp = components(found.where("other IS NOT NULL").select(F.col("node").alias("src"), F.col("other").alias("dst")), "emb")
    links = found.where("node IS NOT NULL AND other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    audits = found.where("node IS NULL").groupBy("label").agg(F.min("recall").alias("audit_recall")).select(F.col("label").alias("r"), "audit_recall")
    facts = node.join(links, "node", "left").join(comp, "node", "left").withColumn("group", F.coalesce("component", "node"))
    facts = materialize(facts.select(
        F.col("label").alias("l"), F.col("h").alias("g"), F.col("h2").alias("g2"), "least", "group", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
    ), "emb-facts")
    # a component is named by its smallest id
    facts = facts.drop("least").join(facts.groupBy("group").agg(F.min("least").alias("component")), "group")
    out = member.select("vec_id", "label", "h", "h2").join(facts, (F.col("label") == F.col("l")) & (F.col("h") == F.col("g")) & (F.col("h2") == F.col("g2")), "left")
    out = out.join(_few(audits), F.col("label") == F.col("r"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), "audit_recall",
    )
