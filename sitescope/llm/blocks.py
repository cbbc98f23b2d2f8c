"""Documents as compact blocks of words, and exchanges of counts between blocks.

A block holds some documents of one task: 64-bit hashes of its distinct words
once, and all its words as numbers into them.  Operators that need corpus-wide
counts send, for each block, its *distinct* items with their counts to the
reducer that owns them, and get an answer in the order of the request.  What
is shuffled is pre-aggregated, so a word or shingle that is everywhere costs
one entry per block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitescope.llm.common import chunks, materialize, mix, pack, trim, unpack

BLOCK_WORDS = 1 << 20
BLOCK_DOCS = 1 << 20
CHUNK = 4 << 20

BLOCK_SCHEMA = "block_id long, doc_ids array<long>, tags array<long>, n_words array<long>, vocab binary, words binary"


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def word_blocks(docs: DataFrame, key: str, text: str, tag, name: str, most_words: int = BLOCK_WORDS) -> DataFrame:
    """Materialized blocks of ``docs``.  Words are runs of bytes other than
    space and \\t..\\r after lower-casing A-Z; ``tag`` is a long column that
    is kept for each document."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), tag.alias("tag"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 20
        made = 0
        numbers: _Numbers = _Numbers()
        ids: list[np.ndarray] = []
        n_words: list[int] = []
        doc_ids: list[int | None] = []
        tags: list[int | None] = []
        held = 0

        def block() -> pa.RecordBatch:
            vocab = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))
            words = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array([first + made], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([tags], pa.list_(pa.int64())),
                 pa.array([n_words], pa.list_(pa.int64())), pa.array([pack(vocab)], pa.binary()), pa.array([pack(words)], pa.binary())],
                names=[f.split()[0] for f in BLOCK_SCHEMA.split(", ")],
            )

        for b in batches:
            for c in chunks([b], "text", CHUNK):
                doc_ids += c.column(0).to_pylist()
                tags += c.column(2).to_pylist()
                flat: list[int] = []
                for t in c.column(1).cast(pa.binary()).to_pylist():
                    w = t.lower().split() if t else []
                    n_words.append(len(w))
                    flat += map(numbers.__getitem__, w)
                ids.append(np.array(flat, np.int32))
                held += len(flat)
                if held >= most_words or len(doc_ids) >= BLOCK_DOCS // 2:
                    yield block()
                    made += 1
                    numbers, ids, n_words, doc_ids, tags, held = _Numbers(), [], [], [], [], 0
        if doc_ids:
            yield block()
        del numbers, ids, n_words, doc_ids, tags
        trim()

    return materialize(rows.mapInArrow(run, BLOCK_SCHEMA), name)


def shingle_hashes(words: np.ndarray, n_words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the shingle that starts at each position, and the number of
    shingles of each document (its first positions): one for a document with
    fewer words than ``width``, none without words."""
    n = len(words)
    odd = np.uint64(0x9E3779B97F4A7C15)
    h = np.zeros(n, np.uint64)
    left = np.repeat(np.cumsum(n_words), n_words) - np.arange(n)  # words up to the document's end
    for k in range(width):
        nxt = np.zeros(n, np.uint64)
        nxt[: n - k] = words[k:]
        nxt[left <= k] = np.uint64(k + 1)  # past the end of a short document
        h = mix(h * odd + nxt)
    return h, np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))


class Block:
    """A row of the block table, unpacked."""

    def __init__(self, batch: pa.RecordBatch, i: int) -> None:
        col = lambda name: batch.column(batch.schema.get_field_index(name))[i]
        self.block_id = col("block_id").as_py()
        self.doc_ids = col("doc_ids").values
        self.tags = col("tags").values
        self.n_words = col("n_words").values.to_numpy().astype(np.int64)
        self.vocab = unpack(col("vocab").as_py())
        self.ids = unpack(col("words").as_py()).astype(np.int64)

    def sets(self, width: int, only: np.ndarray | None = None) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each document (of ``only``)."""
        h, count = shingle_hashes(self.vocab[self.ids], self.n_words, width)
        start = np.cumsum(self.n_words) - self.n_words
        which = range(len(count)) if only is None else only.tolist()
        out = []
        for d in which:
            s = np.sort(h[start[d] : start[d] + count[d]])
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            out.append(s)
        return out
