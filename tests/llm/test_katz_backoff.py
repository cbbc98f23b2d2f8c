"""Katz scores of unknown words after seen histories."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sitescope.llm import katz

DOCS = "doc_id long, text string"


def plain(train: list[list[str]]):
    """p(h, w) of plain Katz: after a seen history all else is alpha * p(w)."""
    def discounts(counts):
        n = Counter(counts.values())
        a = 6 * n[6] / n[1] if n[1] else 0.0
        out = {}
        for r in range(1, 6):
            x = ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) if n[r] and a < 1 else -1.0
            out[r] = x if 0 < x < 1 else (r - 0.5) / r
        return out

    uni = Counter(w for t in train for w in t)
    bi = Counter(p for t in train for p in zip(["<s>", *t], t, strict=False))
    n, d1, d2 = sum(uni.values()), discounts(uni), discounts(bi)
    unknown = sum(c * (1 - d1.get(c, 1)) for c in uni.values()) / n
    scale = 1.0 if unknown > 0 else n / (n + 1)
    unknown = unknown or 1 / (n + 1)
    p1 = lambda w: uni[w] * d1.get(uni[w], 1) * scale / n if uni[w] else unknown
    after = defaultdict(dict)
    for (h, w), c in bi.items():
        after[h][w] = c

    def p(h, w):
        if h not in after:
            return p1(w)
        s = after[h]
        total, left = sum(s.values()), sum(c * (1 - d2.get(c, 1)) for c in s.values())
        if left <= 0:
            total, left = total + 1, 1.0
        c = s.get(w)
        return c * d2.get(c, 1) / total if c else left / total / max(1 - sum(map(p1, s)), 1e-12) * p1(w)

    return p


def corpus():
    rng = random.Random(8)
    word = lambda: f"w{min(int(rng.paretovariate(0.8)), 60)}"
    return [[word() for _ in range(rng.randint(1, 40))] for _ in range(60)]


def test_unknown_words_back_off(spark):
    train = corpus()
    held = [["w1", "new", "w2"], ["new"], ["new", "newer", "w1"], ["w3", "w2", "other", "other", "w1", "new"], ["w1", "w2"]]
    rows = [(i, " ".join(t)) for i, t in enumerate(train + held)]
    got = {r["doc_id"]: r["score"] for r in katz.score(spark.createDataFrame(rows, DOCS).repartition(3), F.col("doc_id") < len(train)).collect()}
    p = plain([[*t, "</s>"] for t in train])
    want = {i: sum(math.log10(p(h, w)) for h, w in zip(["<s>", *t.split()], [*t.split(), "</s>"], strict=True)) for i, t in rows}
    assert got == pytest.approx(want, rel=1e-5)


def test_scores_sum_to_one(spark):
    """P(w | h) over all words and one unknown word, from score() alone."""
    train = corpus()
    words = sorted({w for t in train for w in t}) + ["unseen"]
    n, hists = len(train), ("w1", "w2", "w7")
    rows = [(i, " ".join(t)) for i, t in enumerate(train)]
    # a document "h w" is the start, the step asked for, and an end
    texts = {(h, w): f"{h} {w}" for h in hists for w in words} | {(h, None): h for h in hists}
    keys = sorted(texts, key=str)
    rows += [(n + i, texts[k]) for i, k in enumerate(keys)]
    score = {r["doc_id"]: r["score"] for r in katz.score(spark.createDataFrame(rows, DOCS), F.col("doc_id") < n).collect()}
    s = {k: score[n + i] for i, k in enumerate(keys)}
    p = plain([[*t, "</s>"] for t in train])
    for h in hists:
        start = math.log10(p("<s>", h))
        total = 10 ** (s[h, None] - start)  # the end token after h
        total += sum(10 ** (s[h, w] - start - math.log10(p(w, "</s>"))) for w in words)
        assert total == pytest.approx(1, rel=1e-4)
