"""Language-model scoring by Katz backoff.

Counts are exact over all training documents.  ``P(w | h)`` is the
Good-Turing discounted relative frequency if ``h w`` was seen, else
``alpha(h) * P(w)``; ``P(w)`` is the discounted unigram frequency, or, for a
word never seen, the mass that discounting left.  ``alpha(h)`` divides what
discounting left of ``h`` by the unigram mass of the words not seen after
``h``, so every distribution sums to 1.

The n-gram tables are partitioned and written to the shared folder; they are
evaluated from bigram to unigram to unknown for each token.  Documents are
blocks of words (:mod:`blocks`); a block sends its distinct words, then its
distinct word pairs, with their training counts to the reducers that own
them, and gets counts back in the order sent, with the backoff weights of its
histories in double precision.  The
pairs of a history belong to one reducer, except for the few histories with
more than a part of all tokens: their pairs are dealt out and their sums,
at most ``4 * reducers`` histories', are collected.

Defined cases: a null or empty text is the end token alone; without training
documents all tokens are unknown with probability 1; repeated rows count as
often as they stand there; rows with a null id train and are scored; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitescope.llm.blocks import Block, word_blocks
from sitescope.llm.common import drop_table, materialize, mix, pack, pack_sorted, partitions, trim, unpack, unpack_sorted

#: Counts up to this one are discounted.
MOST_DISCOUNTED = 5
PAIRS_PER_REDUCER = 1 << 18
#: The hash of the end token, and the ids of the start before a document and
#: of any word that training doesn't have.
END, START, UNSEEN = np.uint64(0x5EED0E4D00000001), np.uint64(1 << 62), np.uint64((1 << 62) + 1)


def discounts(n_of: np.ndarray, most: int = MOST_DISCOUNTED) -> np.ndarray:
    """Katz discounts of counts 1..most from counts of counts 1..most+1.

    Where the Good-Turing estimate is not between 0 and 1 (small or odd
    samples), a count ``r`` keeps ``(r - 0.5) / r``.
    """
    d = np.ones(most + 1)
    n = np.asarray(n_of, float)
    a = (most + 1) * n[most + 1] / n[1] if n[1] else 0.0
    for r in range(1, most + 1):
        ok = n[r] > 0 and a < 1
        x = (((r + 1) * n[r + 1] / (r * n[r])) - a) / (1 - a) if ok else -1.0
        d[r] = x if 0 < x < 1 else (r - 0.5) / r
    return d


@dataclass
class Unigrams:
    """Totals that give every unigram probability from a count."""

    tokens: int
    types: int
    keep: np.ndarray
    unknown: float
    scale: float

    @classmethod
    def of(cls, tokens: int, types: int, n_of: np.ndarray) -> Unigrams:
        keep = discounts(n_of)
        if not tokens:
            return cls(0, 0, keep, 1.0, 1.0)
        r = np.arange(1, MOST_DISCOUNTED + 1)
        lost = float((n_of[r] * r * (1 - keep[r])).sum()) / tokens
        if lost > 0:
            return cls(tokens, types, keep, lost, 1.0)
        return cls(tokens, types, keep, 1 / (tokens + 1), tokens / (tokens + 1))

    def p(self, c: np.ndarray) -> np.ndarray:
        c = c.astype(np.int64)
        kept = np.where(c <= MOST_DISCOUNTED, self.keep[np.minimum(c, MOST_DISCOUNTED)], 1.0)
        return np.where(c > 0, c * kept * self.scale / max(1, self.tokens), self.unknown)


def _stretch(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token numbers with an end after each document, the position of each
    document's first token, and token counts.  The end has the number after
    the vocabulary's."""
    n = block.n_words + 1
    ends = np.cumsum(n)
    out = np.full(int(ends[-1]) if len(n) else 0, len(block.vocab), np.int64)
    body = np.ones(len(out), bool)
    body[ends - 1] = False
    out[body] = block.ids
    return out, ends - n, n


def _hashes(block: Block) -> np.ndarray:
    return np.append(block.vocab, END)


def _order(h: np.ndarray, reducers: int) -> tuple[np.ndarray, np.ndarray]:
    """Words by hash, and where each reducer's begin."""
    order = np.argsort(h, kind="stable")
    edges = np.array([(r << 64) // reducers for r in range(1, reducers)], np.uint64)
    return order, np.concatenate([[0], np.searchsorted(h[order], edges), [len(h)]])


def _split(blob: list[dict], key: str) -> np.ndarray:
    got = sorted(blob, key=lambda x: x["r"])
    return np.concatenate([unpack(x[key]) for x in got]) if got else np.zeros(0, np.int64)


def _words(blocks: DataFrame, reducers: int) -> DataFrame:
    """The unigram table: for each reducer its words and counts, the answers
    to the blocks, and counts of counts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                k = Block(b, i)
                seq, _, n = _stretch(k)
                h = _hashes(k)
                train = np.repeat(k.tags.to_numpy(zero_copy_only=False).astype(np.int64), n)
                c = np.bincount(seq, weights=train, minlength=len(h)).astype(np.uint32)
                order, cut = _order(h, reducers)
                rows = [(r, x, y) for r, (x, y) in enumerate(zip(cut, cut[1:], strict=False)) if y > x]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r for r, _, _ in rows], pa.int32()), pa.array([k.block_id] * len(rows), pa.int64()),
                     pa.array([pack_sorted(h[order[x:y]]) for _, x, y in rows], pa.binary()), pa.array([pack(c[order[x:y]]) for _, x, y in rows], pa.binary())],
                    names=["r", "block_id", "words", "n"],
                )

    def count(t: pa.Table) -> pa.Table:
        words = [unpack_sorted(x.as_py()) for x in t.column("words")]
        n = np.concatenate([unpack(x.as_py()) for x in t.column("n")])
        all_, back = np.unique(np.concatenate(words), return_inverse=True)
        c = np.bincount(back, weights=n, minlength=len(all_)).astype(np.int64)
        # a seen word's id: the reducer, then its rank there, frequent words first
        seen = c > 0
        rank = np.zeros(len(c), np.uint64)
        order = np.argsort(-c, kind="stable")
        rank[order] = np.arange(len(c), dtype=np.uint64)
        ids = (np.uint64(t.column("r")[0].as_py()) << np.uint64(32)) | rank
        cuts = np.cumsum([len(x) for x in words])[:-1]
        answers = zip(t.column("block_id").to_pylist(), np.split(c[back], cuts), np.split(np.where(seen, ids, 0)[back], cuts), strict=True)
        n_of = np.bincount(np.minimum(c[seen], MOST_DISCOUNTED + 2), minlength=MOST_DISCOUNTED + 3)
        return pa.table({
            "r": t.column("r")[:1], "words": pa.array([pack_sorted(all_[seen])], pa.binary()), "counts": pa.array([pack(c[seen])], pa.binary()),
            "tokens": [int(c.sum())], "types": [int(seen.sum())], "n_of": pa.array([n_of.tolist()], pa.list_(pa.int64())),
            "answers": pa.array([[{"block_id": i, "n": pack(_narrow(x)), "ids": pack(y)} for i, x, y in answers]],
                                pa.list_(pa.struct([("block_id", pa.int64()), ("n", pa.binary()), ("ids", pa.binary())]))),
        })

    asked = blocks.mapInArrow(ask, "r int, block_id long, words binary, n binary")
    out = asked.groupBy("r").applyInArrow(
        count, "r int, words binary, counts binary, tokens long, types long, n_of array<long>, answers array<struct<block_id:long,n:binary,ids:binary>>"
    )
    return materialize(out, "katz-unigrams")


class _Pairs:
    """The distinct pairs of a block whose history is known, in the order they
    are sent; all unknown words after a history are one pair."""

    def __init__(self, block: Block, counts: np.ndarray, ids: np.ndarray, hot_from: int, n_train_docs: int, reducers: int) -> None:
        seq, first, n = _stretch(block)
        v = len(ids)
        before = np.empty_like(seq)
        before[1:] = seq[:-1]
        before[first] = v  # the start
        id_all, c_all = np.concatenate([ids, [START, UNSEEN]]), np.concatenate([counts, [n_train_docs, 0]])
        self.seq, self.first, self.n = seq, first, n
        at = np.flatnonzero(c_all[before] > 0)
        next_ = np.where(counts[seq[at]] > 0, seq[at], v + 1)
        code, self.back = np.unique(before[at] * np.int64(v + 2) + next_, return_inverse=True)
        self.at = at
        del before, next_
        prev, word = code // (v + 2), code % (v + 2)
        train = np.repeat(block.tags.to_numpy(zero_copy_only=False).astype(np.int64), n)[at]
        own = np.bincount(self.back, weights=train, minlength=len(code)).astype(np.uint32)
        hist, succ = id_all[prev], id_all[word]
        hot = c_all[prev] >= hot_from
        place = np.where(hot, mix(hist ^ mix(succ)), mix(hist))
        r = (place >> np.uint64(32)) * np.uint64(reducers) >> np.uint64(32)
        self.order = np.lexsort((succ, hist, r))
        self.r = r[self.order].astype(np.int64)
        self.hist, self.succ = hist[self.order], succ[self.order]
        self.own, self.word_count = own[self.order], c_all[word][self.order]
        self.hot = hot[self.order]

    def run_of(self) -> np.ndarray:
        """For each pair, in the order they are sent, the number of its history."""
        new = np.ones(len(self.r), bool)
        new[1:] = (self.r[1:] != self.r[:-1]) | (self.hist[1:] != self.hist[:-1])
        return np.cumsum(new) - 1

    def requests(self):
        cut = np.flatnonzero(np.concatenate([[True], self.r[1:] != self.r[:-1], [True]])) if len(self.r) else np.zeros(1, np.int64)
        for x, y in zip(cut, cut[1:], strict=False):
            new = np.concatenate([[True], self.hist[x + 1 : y] != self.hist[x : y - 1]])
            runs = np.diff(np.append(np.flatnonzero(new), y - x))
            yield (int(self.r[x]), pack_sorted(self.hist[x:y][new]), pack(runs.astype(np.uint32)), pack(self.hot[x:y][new].astype(np.uint8)),
                   pack(self.succ[x:y]), pack(self.own[x:y]), pack(_narrow(self.word_count[x:y])))


def _narrow(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint32 if a.max(initial=0) < 1 << 32 else np.uint64)


_PAIR_REQUEST = "r int, block_id long, hist binary, runs binary, hot binary, succ binary, own binary, words binary"
_PAIR_TABLE = (
    "r int, hist binary, runs binary, hot binary, succ binary, counts binary, words binary, n_of array<long>, "
    "hot_hist array<long>, hot_sums array<array<double>>, asked array<struct<block_id:long,at:binary>>"
)


def _sums(group: np.ndarray, n: int, counts: np.ndarray, p: np.ndarray) -> np.ndarray:
    """For each history: pairs of count 1..most, tokens of higher counts, and
    the unigram mass of its successors."""
    seen = counts > 0
    g, c = group[seen], counts[seen]
    out = np.zeros((n, MOST_DISCOUNTED + 2))
    for r in range(1, MOST_DISCOUNTED + 1):
        out[:, r - 1] = np.bincount(g[c == r], minlength=n)
    big = c > MOST_DISCOUNTED
    out[:, MOST_DISCOUNTED] = np.bincount(g[big], weights=c[big], minlength=n)
    out[:, MOST_DISCOUNTED + 1] = np.bincount(g, weights=p[seen], minlength=n)
    return out


def _backoff(sums: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each history: the tokens that counts are divided by, and alpha."""
    r = np.arange(1, MOST_DISCOUNTED + 1)
    small, big, mass = sums[:, :MOST_DISCOUNTED], sums[:, MOST_DISCOUNTED], sums[:, MOST_DISCOUNTED + 1]
    total = (small * r).sum(1) + big
    lost = (small * r * (1 - keep[r])).sum(1)
    # a history without a discounted count keeps back one token
    none = lost <= 0
    total, lost = np.where(none, total + 1, total), np.where(none, 1.0, lost)
    rest = np.maximum(1 - mass, 1e-12)
    return total, lost / total / rest


def _pair_table(blocks: DataFrame, uni: Unigrams, hot_from: int, n_train_docs: int, reducers: int) -> DataFrame:
    """The bigram table: for each reducer its histories, successors and
    counts, where each block's pairs are in it, and sums of hot histories.
    ``blocks`` has the words' counts as ``answers``."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                k = Block(b, i)
                pairs = _Pairs(k, *_counts(k, b, i, reducers), hot_from, n_train_docs, reducers)
                cols = list(zip(*pairs.requests(), strict=True))
                del pairs
                if not cols:
                    continue
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int32()), pa.array([k.block_id] * len(cols[0]), pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])],
                    names=[f.split()[0] for f in _PAIR_REQUEST.split(", ")],
                )
                del k, cols
                trim()

    def count(t: pa.Table) -> pa.Table:
        got = {c: [x.as_py() for x in t.column(c)] for c in ("hist", "runs", "hot", "succ", "own", "words")}
        runs = [unpack(x).astype(np.int64) for x in got["runs"]]
        hist = np.concatenate([np.repeat(unpack_sorted(x), n) for x, n in zip(got["hist"], runs, strict=True)])
        hot = np.concatenate([np.repeat(unpack(x), n) for x, n in zip(got["hot"], runs, strict=True)])
        succ = np.concatenate([unpack(x) for x in got["succ"]])
        own = np.concatenate([unpack(x) for x in got["own"]]).astype(np.int64)
        words = np.concatenate([unpack(x) for x in got["words"]]).astype(np.int64)
        sizes = [int(n.sum()) for n in runs]
        order = np.lexsort((succ, hist))
        h, s = hist[order], succ[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (s[1:] != s[:-1])])
        number = np.cumsum(new) - 1
        back = np.empty(len(order), np.int64)
        back[order] = number
        c = np.bincount(back, weights=own, minlength=int(number[-1]) + 1).astype(np.int64)
        h, s, w, o = h[new], s[new], words[order][new], hot[order][new]
        head = np.concatenate([[True], h[1:] != h[:-1]])
        group = np.cumsum(head) - 1
        names, is_hot = h[head], o[head] > 0
        sums = _sums(group, len(names), c, uni.p(w))
        n_of = np.bincount(np.minimum(c[c > 0], MOST_DISCOUNTED + 2), minlength=MOST_DISCOUNTED + 3)
        at, asked = 0, []
        for block_id, n in zip(t.column("block_id").to_pylist(), sizes, strict=True):
            asked.append({"block_id": block_id, "at": pack(np.diff(back[at : at + n], prepend=0).astype(np.uint32))})
            at += n
        return pa.table({
            "r": t.column("r")[:1], "hist": pa.array([pack_sorted(names)], pa.binary()),
            "runs": pa.array([pack(np.diff(np.append(np.flatnonzero(head), len(h))).astype(np.uint32))], pa.binary()),
            "hot": pa.array([pack(is_hot.astype(np.uint8))], pa.binary()), "succ": pa.array([pack(s)], pa.binary()),
            "counts": pa.array([pack(_narrow(c))], pa.binary()), "words": pa.array([pack(_narrow(w))], pa.binary()),
            "n_of": pa.array([n_of.tolist()], pa.list_(pa.int64())),
            "hot_hist": pa.array([names[is_hot].view(np.int64).tolist()], pa.list_(pa.int64())),
            "hot_sums": pa.array([sums[is_hot].tolist()], pa.list_(pa.list_(pa.float64()))),
            "asked": pa.array([asked], pa.list_(pa.struct([("block_id", pa.int64()), ("at", pa.binary())]))),
        })

    asked = blocks.mapInArrow(ask, _PAIR_REQUEST)
    return materialize(asked.groupBy("r").applyInArrow(count, _PAIR_TABLE), "katz-bigrams")


def _counts(k: Block, b: pa.RecordBatch, i: int, reducers: int) -> tuple[np.ndarray, np.ndarray]:
    """Training counts and ids of the block's words, from the answers beside it."""
    order, _ = _order(_hashes(k), reducers)
    got = b.column(b.schema.get_field_index("answers"))[i].as_py()
    n, ids = np.zeros(len(order), np.int64), np.zeros(len(order), np.uint64)
    n[order], ids[order] = _split(got, "n"), _split(got, "ids")
    return n, ids


def _pair_answers(table: DataFrame, uni: Unigrams, keep: np.ndarray, hot: dict[int, tuple[float, float]]) -> DataFrame:
    """For each block's pairs: (block_id, r, c, totals, alphas), the counts of
    the pairs, and what each of its histories divides by and backs off with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = {n: b.column(n)[i].as_py() for n in ("r", "hist", "runs", "hot", "counts", "words", "asked")}
                names, runs, is_hot = unpack_sorted(x["hist"]), unpack(x["runs"]).astype(np.int64), unpack(x["hot"]) > 0
                c, w = unpack(x["counts"]).astype(np.int64), unpack(x["words"]).astype(np.int64)
                group = np.repeat(np.arange(len(names)), runs)
                total, alpha = _backoff(_sums(group, len(names), c, uni.p(w)), keep)
                for j in np.flatnonzero(is_hot).tolist():
                    total[j], alpha[j] = hot[int(names[j].view(np.int64))]
                cols: list[list[bytes]] = [[], [], []]
                for a in x["asked"]:
                    at = np.cumsum(unpack(a["at"]).astype(np.int64))
                    g = group[at]
                    g = g[np.concatenate([[True], g[1:] != g[:-1]])]
                    for col, v in zip(cols, (pack(_narrow(c[at])), total[g].tobytes(), alpha[g].tobytes()), strict=True):
                        col.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a["block_id"] for a in x["asked"]], pa.int64()), pa.array([x["r"]] * len(x["asked"]), pa.int32()), *(pa.array(v, pa.binary()) for v in cols)],
                    names=["block_id", "r", "c", "totals", "alphas"],
                )

    return table.mapInArrow(run, "block_id long, r int, c binary, totals binary, alphas binary")


def score(docs: DataFrame, train, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, train, n_tokens, n_known, train_tokens,
    base_score and score.  ``train``: boolean column of the documents that
    are learned from."""
    spark = docs.sparkSession
    raw = word_blocks(docs, key, text, train.cast("long"), "katz-blocks")
    size = raw.select(F.aggregate("n_words", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"), F.aggregate("tags", F.lit(0).cast("long"), lambda a, x: a + x).alias("d")).agg(F.sum("n"), F.sum("d")).first()
    n_words, n_train_docs = size[0] or 0, size[1] or 0
    reducers = max(2 * partitions(spark), -(-n_words // PAIRS_PER_REDUCER))

    # order 1
    words = _words(raw, reducers)
    tokens, types, n_of = 0, 0, np.zeros(MOST_DISCOUNTED + 3, np.int64)
    facts = words.agg(F.sum("tokens"), F.sum("types"), *[F.sum(F.col("n_of")[i]) for i in range(MOST_DISCOUNTED + 3)]).first()
    if facts[0] is not None:
        tokens, types, n_of = facts[0], facts[1], np.array(facts[2:], np.int64)
    uni = Unigrams.of(tokens, types, n_of)
    answers = words.select("r", F.explode("answers").alias("a")).select("r", "a.block_id", "a.n", "a.ids")
    answers = answers.groupBy("block_id").agg(F.collect_list(F.struct("r", "n", "ids")).alias("answers"))
    blocks = materialize(raw.join(answers, "block_id"), "katz-counted")
    drop_table(raw)
    drop_table(words)

    # order 2: histories with a large part of all tokens are dealt out by pair
    hot_from = max(1000, tokens // (4 * reducers) + 1)
    table = _pair_table(blocks, uni, hot_from, n_train_docs, reducers)
    facts = table.agg(*[F.sum(F.col("n_of")[i]) for i in range(MOST_DISCOUNTED + 3)]).first()
    keep = discounts(np.array([x or 0 for x in facts], np.int64))
    sums = table.select(F.explode(F.arrays_zip("hot_hist", "hot_sums")).alias("h")).select("h.hot_hist", "h.hot_sums")
    sums = sums.groupBy("hot_hist").agg(*[F.sum(F.col("hot_sums")[i]).alias(f"s{i}") for i in range(MOST_DISCOUNTED + 2)])
    rows = sums.collect()  # 4 * reducers histories at most
    total, alpha = _backoff(np.array([r[1:] for r in rows], float).reshape(-1, MOST_DISCOUNTED + 2), keep)
    hot = {r[0]: (float(t), float(a)) for r, t, a in zip(rows, total, alpha, strict=True)}
    answers = _pair_answers(table, uni, keep, hot).groupBy("block_id").agg(F.collect_list(F.struct("r", "c", "totals", "alphas")).alias("pairs"))
    full = blocks.join(answers, "block_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                k = Block(b, i)
                counts, ids = _counts(k, b, i, reducers)
                pairs = _Pairs(k, counts, ids, hot_from, n_train_docs, reducers)
                got = sorted(b.column(b.schema.get_field_index("pairs"))[i].as_py() or [], key=lambda x: x["r"])
                logp = np.zeros(len(pairs.order))
                if got:
                    c = np.concatenate([unpack(x["c"]) for x in got]).astype(np.int64)
                    total, alpha = (np.concatenate([np.frombuffer(x[k], np.float64) for x in got])[pairs.run_of()] for k in ("totals", "alphas"))
                    kept = np.where(c <= MOST_DISCOUNTED, keep[np.minimum(c, MOST_DISCOUNTED)], 1.0)
                    p = np.where(c > 0, c * kept / total, alpha * uni.p(pairs.word_count))
                    logp[pairs.order] = np.log10(np.maximum(p, 1e-300))
                    del c, total, alpha, kept, p
                # a word after a history that training doesn't have backs off to the word
                lower = np.log10(np.maximum(uni.p(counts), 1e-300))
                per_token = lower[pairs.seq]
                per_token[pairs.at] = logp[pairs.back]
                base = np.log10((counts + 1.0) / (tokens + types + 1.0))[pairs.seq]
                sums = [np.add.reduceat(x, pairs.first) if len(x) else np.zeros(0) for x in (per_token, base, (counts > 0)[pairs.seq].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [k.doc_ids, pa.array(k.tags.to_numpy(zero_copy_only=False) > 0), pa.array(pairs.n), pa.array(sums[2]),
                     pa.array(np.full(len(pairs.n), tokens)), pa.array(sums[1]), pa.array(sums[0])],
                    names=["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
                del k, pairs, got, logp, lower, per_token, base, sums
                trim()

    return full.mapInArrow(run, "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
