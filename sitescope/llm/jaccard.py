"""N-gram Jaccard self-join by adaptive multi-match prefixes.

A document is the set of its distinct word shingles.  Documents with equal
sets are one node.  Shingles are ordered by document frequency, rarest first
(exact counts over the corpus, exchanged between blocks).  Two sets of
similarity ``num / den`` or more share at least ``l`` of the tokens in their
prefixes of ``n - ceil(num * n / den) + l`` tokens, for any ``l``; each
document takes the ``l`` with the least estimated cost of lists read and pairs
verified, and a pair needs as many shared prefix tokens as the smaller of its
two numbers says.

Only the connected groups are asked for, so pairs inside a group that is
already connected are never made.  First every prefix token's documents are
compared with one centre (the document with the largest share of non-unique
shingles), twice; then the multi-match join runs between documents of
different groups only, which leaves exactly the links that can still join
groups.  All candidates are verified on the whole sets.

Defined cases: null and empty texts have no shingles and link with nothing;
a text with fewer words than the width is one shingle; repeated rows link
with each other; rows with a null id take part and are named by their group's
smallest id; an empty table gives an empty result; other columns are ignored
(or carried by :func:`keep_first`).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitescope.llm.blocks import Block, word_blocks
from sitescope.llm.common import components, drop_table, materialize, mix, pack, pack_sorted, partitions, unpack, unpack_sorted

WIDTH, NUM, DEN = 4, 85, 100
#: Most shared tokens asked for, and the cost of a verification in list entries.
MOST_MATCHES, VERIFY_COST = 8, 16
TOKENS_PER_REDUCER = 1 << 20
#: 64-bit words of a set's bitmap: sets differ in as many shingles as bits, at least.
BITMAP = 16
#: Words of a block, whose sets of shingles a task holds at once.
BLOCK_WORDS = 1 << 19


def _least_overlap(n: int | np.ndarray, num: int, den: int):
    return -(-num * n // den)


def _facts(blocks: DataFrame, width: int) -> DataFrame:
    """(uid, doc_id, tag, block_id, idx, n, f1, f2) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                k = Block(b, i)
                sets = k.sets(width)
                n = np.array([len(s) for s in sets], np.int64)
                f1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                f2 = np.array([np.bitwise_xor.reduce(s * np.uint64(0xC2B2AE3D27D4EB4F)) if len(s) else 0 for s in sets], np.uint64)
                idx = np.arange(len(n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((k.block_id << 20) + idx), k.doc_ids, k.tags, pa.array(np.full(len(n), k.block_id)), pa.array(idx),
                     pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64))],
                    names=["uid", "doc_id", "tag", "block_id", "idx", "n", "f1", "f2"],
                )

    return blocks.mapInArrow(run, "uid long, doc_id long, tag long, block_id long, idx long, n long, f1 long, f2 long")


def _choose_matches(df: np.ndarray, first: int, most: int) -> int:
    """The number of shared prefix tokens with the least estimated cost:
    entries of the lists that are read, and pairs left to verify."""
    cum = np.cumsum(df - 1)
    best, least = 1, None
    for k in range(1, most + 1):
        read = cum[first + k - 2] if first + k - 2 >= 0 else 0
        cost = read + VERIFY_COST * read / k
        if least is None or cost < least:
            best, least = k, cost
    return best


def _active(blocks: DataFrame, width: int, num: int, den: int, reducers: int) -> DataFrame:
    """Documents that can link: their prefix tokens, levels and whole sets.

    ``blocks`` has the list ``reps`` of the documents that stand for all with
    an equal set.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                k = Block(b, i)
                tokens, n = _tokens(k, b, i, width)
                cut = np.searchsorted(tokens, _edges(reducers))
                rows = [(r, x, y) for r, (x, y) in enumerate(zip(cut, cut[1:], strict=False)) if y > x]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r for r, _, _ in rows], pa.int32()), pa.array([k.block_id] * len(rows), pa.int64()),
                     pa.array([pack_sorted(tokens[x:y]) for _, x, y in rows], pa.binary()), pa.array([pack(n[x:y]) for _, x, y in rows], pa.binary())],
                    names=["r", "block_id", "tokens", "n"],
                )

    def answer(t: pa.Table) -> pa.Table:
        tokens = [unpack_sorted(x.as_py()) for x in t.column("tokens")]
        counts = [unpack(x.as_py()) for x in t.column("n")]
        all_, back = np.unique(np.concatenate(tokens), return_inverse=True)
        df = np.bincount(back, weights=np.concatenate(counts), minlength=len(all_)).astype(np.int64)
        mine = np.split(df[back], np.cumsum([len(x) for x in tokens])[:-1])
        return pa.table({"block_id": t.column("block_id"), "r": t.column("r"), "df": pa.array([pack(np.minimum(x, 0xFFFFFFFF).astype(np.uint32)) for x in mine], pa.binary())})

    requests = blocks.mapInArrow(ask, "r int, block_id long, tokens binary, n binary")
    answers = requests.groupBy("r").applyInArrow(answer, "block_id long, r int, df binary")
    answers = answers.groupBy("block_id").agg(F.collect_list(F.struct("r", "df")).alias("answers"))
    full = blocks.join(answers, "block_id")

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                k = Block(b, i)
                reps = _reps(b, i)
                sets = k.sets(width, reps)
                tokens, _ = _tokens(k, b, i, width, sets)
                got = sorted(b.column(b.schema.get_field_index("answers"))[i].as_py(), key=lambda x: x["r"])
                df_of = np.concatenate([unpack(x["df"]) for x in got]).astype(np.int64) if got else np.zeros(0, np.int64)
                rows: dict[str, list] = {c: [] for c in ("uid", "n", "m", "ell", "toks", "lev", "members", "bits")}
                for d, s in zip(reps.tolist(), sets, strict=True):
                    n = len(s)
                    df = df_of[np.searchsorted(tokens, s >> np.uint64(16))]
                    need = _least_overlap(n, num, den)
                    m = int((df > 1).sum())
                    if m < need:
                        continue  # too many shingles that no other set has
                    order = np.lexsort((s, df))
                    df = df[order]
                    first = n - need + 1
                    ell = _choose_matches(df, first, min(MOST_MATCHES, need))
                    at = np.arange(n - m, first + ell - 1)
                    rows["uid"].append((k.block_id << 20) + d)
                    rows["n"].append(n)
                    rows["m"].append(m)
                    rows["ell"].append(ell)
                    rows["toks"].append(s[order[at]].view(np.int64))
                    rows["lev"].append(np.maximum(1, at - first + 2))
                    rows["members"].append(s.view(np.int64))
                    rows["bits"].append(_bitmap(s))
                longs = pa.list_(pa.int64())
                for x in range(0, len(rows["uid"]), 2000):
                    part = {c: v[x : x + 2000] for c, v in rows.items()}
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(part[c], pa.int64()) for c in ("uid", "n", "m", "ell")), *(pa.array(part[c], longs) for c in ("toks", "lev", "members", "bits"))],
                        names=list(part),
                    )

    return full.mapInArrow(prefixes, "uid long, n long, m long, ell long, toks array<long>, lev array<long>, members array<long>, bits array<long>")


def _bitmap(s: np.ndarray) -> np.ndarray:
    """A bit for each shingle, by hash, in ``BITMAP`` words of 64."""
    out = np.zeros(BITMAP * 64, np.uint8)
    out[(s & np.uint64(BITMAP * 64 - 1)).astype(np.int64)] = 1
    return np.packbits(out).view(np.int64)


def _reps(b: pa.RecordBatch, i: int) -> np.ndarray:
    return np.sort(b.column(b.schema.get_field_index("reps"))[i].values.to_numpy())


def _tokens(k: Block, b: pa.RecordBatch, i: int, width: int, sets: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The block's distinct shingles by their upper 48 bits, with the number
    of its sets that hold them."""
    if sets is None:
        sets = k.sets(width, _reps(b, i))
    if not sets:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    tokens, n = np.unique(np.concatenate(sets) >> np.uint64(16), return_counts=True)
    return tokens, np.minimum(n, 0xFFFFFFFF).astype(np.uint32)


def _edges(reducers: int) -> np.ndarray:
    return np.array([(r << 48) // reducers for r in range(reducers)] + [1 << 48], np.uint64)


def _verified(pairs: DataFrame, active: DataFrame, num: int, den: int) -> DataFrame:
    a = active.select(F.col("uid").alias("src"), F.col("members").alias("sa"))
    b = active.select(F.col("uid").alias("dst"), F.col("members").alias("sb"))
    both = pairs.join(a, "src").join(b, "dst")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common * (num + den) >= num * (F.size("sa") + F.size("sb"))).select("src", "dst")


def link_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, num: int = NUM, den: int = DEN,
                tag=None) -> DataFrame:
    """One row per row of ``docs``: uid, doc_id, tag, n_shingles, group (a
    uid) and component_id (the group's smallest doc_id)."""
    spark = docs.sparkSession
    blocks = word_blocks(docs, key, text, F.lit(0).cast("long") if tag is None else tag, "jac-blocks", BLOCK_WORDS)
    facts = materialize(_facts(blocks, width), "jac-facts")
    same = facts.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("uid").alias("rep"))
    same = materialize(same, "jac-same")
    total = same.agg(F.sum("n")).first()[0] or 0
    reducers = max(2 * partitions(spark), -(-total // TOKENS_PER_REDUCER))
    reps = same.select(F.shiftright("rep", 20).alias("block_id"), F.col("rep").bitwiseAND((1 << 20) - 1).alias("idx"))
    reps = reps.groupBy("block_id").agg(F.collect_list("idx").alias("reps"))
    work = blocks.join(reps, "block_id")
    active = materialize(_active(work, width, num, den, reducers), "jac-active")
    drop_table(blocks)

    rows = active.select("uid", "n", "m", "ell", F.explode(F.arrays_zip("toks", "lev")).alias("e")).select(
        "uid", "n", "m", "ell", F.col("e.toks").alias("token"), F.col("e.lev").alias("lev")
    )
    # a centre for each token, then another of a different group
    edges = None
    for by in (F.col("m") / F.col("n"), F.xxhash64("uid")):
        if edges is None:
            labelled = rows.withColumn("lab", F.col("uid"))
        else:
            labelled = _labelled(rows, edges, "jac-star")
        # most of the documents of a token are in its largest group: its centre speaks for it
        centre = labelled.groupBy("token").agg(F.max_by("uid", by).alias("c"), F.max_by("lab", by).alias("c_lab"), F.count("*").alias("k")).where("k > 1")
        pairs = labelled.join(centre, "token").where("uid <> c AND lab <> c_lab").select(
            F.least("uid", "c").alias("src"), F.greatest("uid", "c").alias("dst")
        ).distinct()
        got = _verified(materialize(pairs, "jac-pairs"), active, num, den)
        edges = materialize(got if edges is None else edges.unionByName(got), "jac-edges")

    # what can still join two groups
    labelled = _labelled(rows, edges, "jac-close")
    mixed = labelled.groupBy("token").agg(F.min("lab").alias("lo"), F.max("lab").alias("hi")).where("lo <> hi").select("token")
    bits = active.select("uid", *[F.col("bits")[i].alias(f"w{i}") for i in range(BITMAP)])
    open_ = materialize(labelled.join(mixed, "token").join(bits, "uid"), "jac-open")
    cols = ("uid", "n", "m", "ell", "lev", "lab", *(f"w{i}" for i in range(BITMAP)))
    a = open_.select("token", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = open_.select("token", *[F.col(c).alias(f"b_{c}") for c in cols])
    differ = sum((F.bit_count(F.col(f"a_w{i}").bitwiseXOR(F.col(f"b_w{i}"))) for i in range(BITMAP)), F.lit(0))
    ell = F.least("a_ell", "b_ell")
    near = (
        (F.col("a_uid") < F.col("b_uid")) & (F.col("a_lab") != F.col("b_lab"))
        & (F.greatest("a_n", "b_n") * num <= F.least("a_n", "b_n") * den)
        & (F.least("a_m", "b_m") * (num + den) >= (F.col("a_n") + F.col("b_n")) * num)
        & (F.col("a_lev") <= ell) & (F.col("b_lev") <= ell)
        & (differ * (num + den) <= (F.col("a_n") + F.col("b_n")) * (den - num))
    )
    pairs = a.join(b, a["token"] == b["token"]).where(near).groupBy(F.col("a_uid").alias("src"), F.col("b_uid").alias("dst")).agg(
        F.count("*").alias("shared"), F.first(ell).alias("ell")
    ).where("shared >= ell").select("src", "dst")
    more = _verified(materialize(pairs, "jac-pairs"), active, num, den)
    edges = materialize(edges.unionByName(more), "jac-edges")
    groups = components(edges, "jac-all").select(F.col("node").alias("rep"), F.col("component").alias("grp"))

    name = same.join(groups, "rep", "left").select(
        F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("n").alias("gn"), F.coalesce("grp", "rep").alias("grp")
    )
    out = facts.join(name, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n") == F.col("gn")), "left")
    out = materialize(out.select("uid", "doc_id", "tag", F.col("n").alias("n_shingles"), F.coalesce("grp", "uid").alias("group")), "jac-members")
    least = out.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return out.join(least, "group").select("uid", "doc_id", "tag", "n_shingles", "group", "component_id")


def _labelled(rows: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    comp = components(edges, name).select(F.col("node").alias("uid"), F.col("component").alias("lab"))
    return rows.join(comp, "uid", "left").withColumn("lab", F.coalesce("lab", "uid"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each group: that with the smallest id
    (null ids last), and one row of those that repeat id and text."""
    cols = docs.columns
    tag = F.xxhash64(F.col(text))
    linked = link_groups(docs, key, text, width, num, den, tag)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tag", "uid")
    kept = linked.groupBy("group").agg(F.min(order).alias("k"))
    no_id = F.lit(-(1 << 63))
    kept = kept.select(F.coalesce("k.doc_id", no_id).alias("d_id"), F.col("k.tag").alias("d_tag")).distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("doc"), F.coalesce(F.col(key).cast("long"), no_id).alias("d_id"), tag.alias("d_tag"))
    # repeated rows that differ in other columns: one and the same in each run
    one = Window.partitionBy("d_id", "d_tag").orderBy(F.xxhash64(*[F.col(f"doc.`{c}`") for c, t in docs.dtypes if "map<" not in t]))
    return packed.join(kept, ["d_id", "d_tag"]).withColumn("copy", F.row_number().over(one)).where("copy = 1").select("doc.*")
