"""Best-fit packing of documents into sequences by hierarchical residuals.

Every partition tokenizes its documents, cuts those longer than the capacity
into pieces and packs the pieces best-fit, largest first.  Bins that are
nearly full are final.  The others become items of the next round, in which
fewer partitions merge them best-fit again; each round accepts emptier bins
as final.  A round gets as many partitions as its items need at
``ITEMS_PER_TASK`` each, so no task holds more than a bounded number of bins,
and a round's items are only ``(bin, fill)`` rows: pieces stay in the table of
the first round and are joined with the bins' final places.

Defined cases: a null or empty text is one piece with the end id alone;
repeated rows are separate documents, told apart by ``row``; null ids are
kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitescope.llm.common import chunks, materialize, trim
from sitescope.llm.tokens import cached_encoder

CAPACITY = 2048
END_ID = 0
ITEMS_PER_TASK = 20_000
#: Largest free part of a bin that is final after each round.
SLACK = (1 / 128, 1 / 64, 1 / 32, 1 / 16, 1 / 8, 1.0)
CHUNK = 4 << 20


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item, items taken largest first."""
    order = np.argsort(-sizes, kind="stable")
    place, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, 0
    for i in order.tolist():
        s = int(sizes[i])
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            b, room, bins = bins, capacity, bins + 1
        place[i], offset[i] = b, capacity - room
        if room > s:
            free[room - s].append(b)
            mask |= 1 << (room - s)
    return place, offset


def _fills(place: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.bincount(place, sizes).astype(np.int64) if len(place) else np.zeros(0, np.int64)


_PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, bin long, place long, fill long, final boolean"


def pack(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: row, doc_id, piece, start, length, ids_crc32,
    sequence_id and offset.  ``tokenizer``: path of a tokenizers file."""

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        encoder = cached_encoder(tokenizer, spaced=False)
        task = TaskContext.get().partitionId() << 32
        cols: dict[str, list[np.ndarray]] = {k: [] for k in ("row", "piece", "start", "length", "crc")}
        keys: list[pa.Array] = []
        seen = 0
        for b in batches:
            for c in chunks([b], "text", CHUNK):
                ids, n = encoder.encode([t or "" for t in c.column(1).to_pylist()])
                n_end = n + 1  # with the end id
                all_ids = np.full(int(n_end.sum()), end_id, np.uint32)
                ends = np.cumsum(n_end)
                body = np.ones(len(all_ids), bool)
                body[ends - 1] = False
                all_ids[body] = ids
                pieces = -(-n_end // capacity)
                doc = np.repeat(np.arange(len(n_end)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(n_end[doc] - start, capacity)
                at = (ends - n_end)[doc] + start
                raw = memoryview(all_ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
                for k, v in (("row", task + seen + doc), ("piece", piece), ("start", start), ("length", length), ("crc", np.array(crc, np.int64))):
                    cols[k].append(v)
                keys.append(c.column(0).take(pa.array(doc)))
                seen += len(n_end)
        del encoder
        trim()
        if not keys:
            return
        x = {k: np.concatenate(v) for k, v in cols.items()}
        place, offset = best_fit(x["length"], capacity)
        fill = _fills(place, x["length"])
        final = fill >= capacity * (1 - SLACK[0])
        key_col = pa.concat_arrays(keys)
        for i in range(0, len(place), 50_000):
            s = slice(i, i + 50_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x["row"][s]), key_col[s], pa.array(x["piece"][s].astype(np.int32)), pa.array(x["start"][s]), pa.array(x["length"][s]),
                 pa.array(x["crc"][s]), pa.array(task + place[s]), pa.array(offset[s]), pa.array(fill[place[s]]), pa.array(final[place[s]])],
                names=[f.split()[0] for f in _PIECES.split(", ")],
            )

    pieces = materialize(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(first_round, _PIECES), "pack-pieces")
    moved = _merge(pieces.where("NOT final").groupBy("bin").agg(F.first("fill").alias("fill")), capacity)
    out = pieces.select("row", "doc_id", "piece", "start", "length", "ids_crc32", "bin", "place")
    if moved is not None:
        out = out.join(moved, "bin", "left")
        sequence, offset = F.coalesce("sequence", "bin"), F.col("place") + F.coalesce("base", F.lit(0))
    else:
        sequence, offset = F.col("bin"), F.col("place")
    return out.select("row", "doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), offset.alias("offset"))


def _merge(bins: DataFrame, capacity: int) -> DataFrame | None:
    """``(bin, sequence, base)`` of bins that later rounds have moved."""
    items = materialize(bins, "pack-items")
    n = items.count()
    total, level = None, 1
    while n and level < len(SLACK):
        tasks = max(1, -(-n // ITEMS_PER_TASK))
        slack = 1.0 if tasks == 1 else SLACK[level]

        def merge(batches: Iterator[pa.RecordBatch], slack: float = slack) -> Iterable[pa.RecordBatch]:
            got = [b for b in batches if b.num_rows]
            if not got:
                return
            t = pa.Table.from_batches(got)
            name, fill = t.column("bin").to_numpy(), t.column("fill").to_numpy()
            order = np.argsort(name)
            name, fill = name[order], fill[order]
            place, base = best_fit(fill, capacity)
            total_fill = _fills(place, fill)
            head = np.full(len(total_fill), np.iinfo(np.int64).max)
            np.minimum.at(head, place, name)
            yield pa.RecordBatch.from_arrays(
                [pa.array(name), pa.array(head[place]), pa.array(base), pa.array(total_fill[place]), pa.array(total_fill[place] >= capacity * (1 - slack))],
                names=["bin", "sequence", "base", "fill", "final"],
            )

        step = materialize(items.repartition(tasks).mapInArrow(merge, "bin long, sequence long, base long, fill long, final boolean"), "pack-step")
        s = step.select("bin", "sequence", "base")
        if total is None:
            total = s
        else:
            later = s.select(F.col("bin").alias("sequence"), F.col("sequence").alias("next"), F.col("base").alias("more"))
            total = materialize(
                total.join(later, "sequence", "left").select(
                    "bin", F.coalesce("next", "sequence").alias("sequence"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base")
                ),
                "pack-total",
            )
        items = materialize(
            step.where("NOT final").groupBy(F.col("sequence").alias("bin")).agg(F.first("fill").alias("fill")), "pack-items"
        )
        n, level = items.count(), level + 1
    return total
