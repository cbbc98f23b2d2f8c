"""Token-id files: an adaptive context-mixing range coder in blocks.

A file is a table of segments in ascending document order.  A segment holds
whole documents: their ids and lengths, and their token ids in blocks of
``BLOCK`` ids.  Each block starts from a fresh model, has a CRC-32 of its ids
and decodes without any other block.

For each id the model makes three predictions: what followed the last two
ids (order 2), what followed the last id (order 1), and which id was last
seen in the id's slot of a recency table (order 0).  An event says which
prediction holds, or that none does; its distribution mixes three adaptive
tables - by the confidence of the order-2 entry, by that of the order-1 entry,
and the block's own - by the evidence in each.  A range coder writes events,
slots and ids that no order predicts.

Blocks are independent, so all blocks of a segment advance together, one id
of each at a time, as numpy lanes.

Layout of a segment (little endian): ``TIDS``, version u8, id bits u8, lanes
u32, ids u64; for each block its ids u32, words u32, CRC-32 u32; then the
words (u16) of all blocks.

Defined cases: a null or empty text is the end id alone; null ids come first;
repeated ids are ordered by text; an empty table gives an empty file; other
columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitescope.llm.common import chunks, materialize, trim
from sitescope.llm.tokens import cached_encoder

MAGIC, VERSION = b"TIDS", 1
BLOCK = 2048
SEGMENT = 4 << 20
END_ID = 2
ORDER2_BITS, ORDER1_BITS, ORDER0_BITS = 11, 11, 9
INCREMENT, LIMIT, EVERY = 48, 2048, 16
CHUNK = 4 << 20

_U = np.uint64
_ONES = _U(0x0001000100010001)
_HALF = _U(0x7FFF7FFF7FFF7FFF)
_FIELD = _U(0xFFFF)
_LOW48, _LOW32 = _U((1 << 48) - 1), _U((1 << 32) - 1)
_TOP = _U(1 << 32)
_STEP = _U(INCREMENT) << (_U(16) * np.arange(4, dtype=np.uint64))
_SHIFT = _U(16) * np.arange(4, dtype=np.uint64)


class _Model:
    """The state of all lanes; ``lanes`` are blocks side by side."""

    def __init__(self, lanes: int, id_bits: int) -> None:
        self.n = lanes
        lane = np.arange(lanes, dtype=np.int64)
        self.tab2 = np.zeros(lanes << ORDER2_BITS, np.int32)
        self.tab1 = np.zeros(lanes << ORDER1_BITS, np.int32)
        self.tab0 = np.full(lanes << ORDER0_BITS, -1, np.int32)
        self.base2, self.base1, self.base0 = lane << ORDER2_BITS, lane << ORDER1_BITS, lane << ORDER0_BITS
        start = _U(40) * _ONES
        self.by2 = np.full(lanes * 4, start, np.uint64)
        self.by1 = np.full(lanes * 4, start, np.uint64)
        self.own = np.full(lanes, start, np.uint64)
        self.four = lane * 4
        self.p1 = np.zeros(lanes, np.int64)
        self.p2 = np.zeros(lanes, np.int64)
        self.raw_bits = np.array([0, 0, ORDER0_BITS, id_bits], np.uint64)

    def look(self) -> None:
        """Predictions and event distribution for the next id."""
        h = (self.p1 * 40503) & 0xFFFFFFFF
        self.i1 = self.base1 + ((h >> 5) & ((1 << ORDER1_BITS) - 1))
        h = (h + self.p2 * 2654435761) & 0xFFFFFFFF
        self.i2 = self.base2 + ((h >> 15) & ((1 << ORDER2_BITS) - 1))
        self.e2, self.e1 = self.tab2[self.i2], self.tab1[self.i1]
        self.a2, self.a1 = self.four + (self.e2 & 3), self.four + (self.e1 & 3)
        self.f2, self.f1 = self.by2[self.a2], self.by1[self.a1]
        self.f = self.f2 + self.f1 + self.own
        self.cum = self.f * _ONES

    def slot(self, ids: np.ndarray) -> np.ndarray:
        return ((ids * 40503) >> 3) & ((1 << ORDER0_BITS) - 1)

    def learn(self, ids: np.ndarray, event: np.ndarray, slot: np.ndarray, t: int) -> None:
        step = _STEP[event]
        self.by2[self.a2] = self.f2 + step
        self.by1[self.a1] = self.f1 + step
        self.own += step
        if t % EVERY == EVERY - 1:
            for a in (self.by2, self.by1, self.own):
                big = ((a * _ONES) >> _U(48)) > _U(LIMIT)
                np.copyto(a, ((a >> _U(1)) & _HALF) + _ONES, where=big)
        fresh = (ids << 2).astype(np.int32)
        for tab, i, e in ((self.tab2, self.i2, self.e2), (self.tab1, self.i1, self.e1)):
            conf = e & 3
            hit = (e >> 2) == ids
            tab[i] = np.where(hit, e + (conf < 3), np.where(conf > 0, e - 1, fresh))
        self.tab0[self.base0 + slot] = ids
        self.p2, self.p1 = self.p1, ids


class _Writer:
    def __init__(self, lanes: int, steps: int) -> None:
        self.room = 2 * steps + 8
        self.out = np.zeros(lanes * self.room, np.uint32)
        self.base = np.arange(lanes, dtype=np.int64) * self.room
        self.at = self.base + 1  # a guard word before each lane takes carries of 0
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, _U(1) << _U(48), np.uint64)

    def put(self, r: np.ndarray, first: np.ndarray, width: np.ndarray) -> None:
        n = len(r)
        low = self.low[:n] + r * first
        rng = r * width
        self._settle(n, low, rng)

    def _settle(self, n: int, low: np.ndarray, rng: np.ndarray) -> None:
        at = self.at[:n]
        self.out[at - 1] += (low >> _U(48)).astype(np.uint32)
        low &= _LOW48
        small = rng < _TOP
        self.out[at] = (low >> _U(32)).astype(np.uint32)
        at += small
        by = small * _U(16)
        self.low[:n] = ((low << by) & _LOW48)
        self.range[:n] = rng << by

    def end(self) -> tuple[np.ndarray, list[np.ndarray]]:
        for shift in (32, 16, 0):
            self.out[self.at] = ((self.low >> _U(shift)) & _FIELD).astype(np.uint32)
            self.at += 1
        words = self.out.reshape(-1, self.room)
        while True:  # carries that were put off
            over = words >> 16
            if not over.any():
                break
            words &= 0xFFFF
            words[:, :-1] += over[:, 1:]
        n = self.at - self.base - 1
        return n, [words[i, 1 : 1 + k].astype("<u2") for i, k in enumerate(n.tolist())]


def _lanes(n: int, block: int) -> np.ndarray:
    full, rest = divmod(n, block)
    return np.array([block] * full + [rest] * (rest > 0), np.int64)


def encode_ids(ids: np.ndarray, id_bits: int = 16, block: int = BLOCK) -> bytes:
    """The segment of an id array; ``id_bits`` at most 16 here per coded id."""
    sizes = _lanes(len(ids), block)
    lanes = len(sizes)
    head = struct.pack("<4sBBIQ", MAGIC, VERSION, id_bits, lanes, len(ids))
    if not lanes:
        return head
    if int(ids.max()) >> id_bits:
        raise ValueError("an id needs more bits than the file has")
    grid = np.zeros((lanes, block), np.int64)
    grid.ravel()[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.T)
    m, w = _Model(lanes, id_bits), _Writer(lanes, block)
    for t in range(int(sizes[0])):
        x = grid[t]
        m.look()
        slot = m.slot(x)
        event = np.where((m.e2 >> 2) == x, 0, np.where((m.e1 >> 2) == x, 1, np.where(m.tab0[m.base0 + slot] == x, 2, 3)))
        s = _SHIFT[event]
        live = lanes if t < sizes[-1] else lanes - 1
        total = m.cum >> _U(48)
        w.put((w.range // total)[:live], (((m.cum << _U(16)) >> s) & _FIELD)[:live], ((m.f >> s) & _FIELD)[:live])
        bits = m.raw_bits[event]
        raw = np.where(event == 2, slot, np.where(event == 3, x, 0)).astype(np.uint64)
        w.put((w.range >> bits)[:live], raw[:live], np.ones(live, np.uint64))
        m.learn(x, event, slot, t)
    n, words = w.end()
    raw = memoryview(ids.astype("<u4").tobytes())
    edge = np.concatenate([[0], np.cumsum(sizes)]) * 4
    crc = [zlib.crc32(raw[a:b]) for a, b in zip(edge, edge[1:], strict=False)]
    table = np.stack([sizes, n, crc], axis=1).astype("<u4")
    return head + table.tobytes() + b"".join(x.tobytes() for x in words)


def decode_ids(data: bytes) -> np.ndarray:
    """The ids of a segment; ValueError if a block's checksum doesn't hold."""
    magic, version, id_bits, lanes, total_ids = struct.unpack_from("<4sBBIQ", data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token-id segment")
    if not lanes:
        return np.zeros(0, np.uint32)
    at = struct.calcsize("<4sBBIQ")
    table = np.frombuffer(data, "<u4", lanes * 3, at).reshape(lanes, 3).astype(np.int64)
    sizes, words = table[:, 0], table[:, 1]
    # three words past the end stand for a lane that has read all of its own
    src = np.concatenate([np.frombuffer(data, "<u2", int(words.sum()), at + lanes * 12), np.zeros(4, "<u2")]).astype(np.uint64)
    pos = np.cumsum(words) - words
    code = (src[pos] << _U(32)) | (src[pos + 1] << _U(16)) | src[pos + 2]
    pos = pos + 3
    rng = np.full(lanes, _U(1) << _U(48), np.uint64)
    m = _Model(lanes, id_bits)
    block = int(sizes[0])
    grid = np.zeros((block, lanes), np.int64)
    last = len(src) - 1

    def shrink(r: np.ndarray, first: np.ndarray, width: np.ndarray) -> None:
        nonlocal code, rng, pos
        code = code - r * first
        rng = r * width
        small = rng < _TOP
        by = small * _U(16)
        code = (code << by) | (src[np.minimum(pos, last)] & (small * _FIELD))
        rng = rng << by
        pos = pos + small

    for t in range(block):
        m.look()
        total = m.cum >> _U(48)
        r = rng // total
        v = np.minimum(code // r, total - _U(1))
        event = (v >= (m.cum & _FIELD)).astype(np.int64)
        event += v >= ((m.cum >> _U(16)) & _FIELD)
        event += v >= ((m.cum >> _U(32)) & _FIELD)
        s = _SHIFT[event]
        shrink(r, ((m.cum << _U(16)) >> s) & _FIELD, (m.f >> s) & _FIELD)
        bits = m.raw_bits[event]
        r = rng >> bits
        raw = np.minimum(code // r, (_U(1) << bits) - _U(1))
        shrink(r, raw, np.ones(lanes, np.uint64))
        raw = raw.astype(np.int64)
        x = np.where(event == 0, m.e2 >> 2, np.where(event == 1, m.e1 >> 2, raw))
        x = np.where(event == 2, m.tab0[m.base0 + np.where(event == 2, raw, 0)], x).astype(np.int64)
        if t >= sizes[-1]:
            x[-1] = 0  # idle lane
        grid[t] = x
        slot = m.slot(x)
        if t >= sizes[-1]:
            code[-1], rng[-1] = 0, _U(1) << _U(48)
        m.learn(x, event, slot, t)
    ids = np.ascontiguousarray(grid.T).ravel()[:total_ids].astype(np.uint32)
    raw_ids = memoryview(ids.astype("<u4").tobytes())
    edge = np.concatenate([[0], np.cumsum(sizes)]) * 4
    for a, b, c in zip(edge, edge[1:], table[:, 2].tolist(), strict=False):
        if zlib.crc32(raw_ids[a:b]) != c:
            raise ValueError("a block is damaged")
    return ids


# ---------------------------------------------------------------- files

_SEGMENTS = "shard int, part int, before long, n_ids long, doc_ids array<long>, n_tokens array<long>, data binary"


def write(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int = END_ID, id_bits: int = 16) -> DataFrame:
    """Encode ``docs`` into a token-id file in the shared folder; returns the
    table of its segments.  Shards follow each other in document order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        encoder = cached_encoder(tokenizer, spaced=True)
        shard, part, before = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        names: list[int | None] = []
        counts: list[np.ndarray] = []
        n_held = 0

        def segment() -> pa.RecordBatch:
            ids = np.concatenate(held)
            n = np.concatenate(counts)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()),
                 pa.array([names], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64())), pa.array([encode_ids(ids, id_bits)], pa.binary())],
                names=[f.split()[0] for f in _SEGMENTS.split(", ")],
            )

        for b in batches:
            for c in chunks([b], "text", CHUNK):
                ids, n = encoder.encode([t or "" for t in c.column(1).to_pylist()])
                n = n + 1
                ends = np.cumsum(n)
                whole = np.full(int(ends[-1]), end_id, np.uint32)
                body = np.ones(len(whole), bool)
                body[ends - 1] = False
                whole[body] = ids
                held.append(whole)
                counts.append(n)
                names += c.column(0).to_pylist()
                n_held += len(whole)
                if n_held >= SEGMENT:
                    yield segment()
                    part, before = part + 1, before + n_held
                    held, names, counts, n_held = [], [], [], 0
        if names:
            yield segment()
        del encoder, held, counts, names
        trim()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return materialize(ordered.mapInArrow(run, _SEGMENTS), "token-ids")


def read(segments: DataFrame, ids: bool = False) -> DataFrame:
    """Decode a token-id file: one row per document with doc_id, start,
    n_tokens and ids_crc32 (and the ids as an array, if asked for)."""
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select(F.col("shard").alias("of"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    # a row for each shard: as few as the tasks that wrote the file
    at = segments.join(F.broadcast(shards), F.col("shard") == F.col("of")).select(
        (F.col("ahead") + F.col("before")).alias("start"), "doc_ids", "n_tokens", "data"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                start = b.column(0)[i].as_py()
                names, n = b.column(1)[i].values, b.column(2)[i].values.to_numpy()
                got = decode_ids(b.column(3)[i].as_py())
                raw = memoryview(got.astype("<u4").tobytes())
                edge = np.concatenate([[0], np.cumsum(n)])
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(edge.tolist(), edge[1:].tolist(), strict=False)]
                cols = [names, pa.array(start + edge[:-1]), pa.array(n), pa.array(crc, pa.int64())]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(got.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return at.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)


def table(spark: SparkSession, path: str) -> DataFrame:
    """A token-id file written before."""
    return spark.read.parquet(path)
