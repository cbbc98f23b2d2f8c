"""Which documents the mix takes, against a plain queue."""

from __future__ import annotations

import hashlib
import random

import brute
import pytest

from sitescope.llm import mixing


def plain(rows, weights=(5, 2, 1), most=3):
    """id -> takes: all takes sorted by virtual finish time, cut at the budget."""
    size = {d: len(brute.words(t)) for d, t, _ in rows}
    queues = {}
    for d, _, s in rows:
        queues.setdefault(s, []).append(d)
    order = sorted(queues, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = {s: sum(size[d] for d in queues[s]) for s in order}
    capped: set = set()
    while True:
        free = [s for s in order if s not in capped]
        rest = sum(total.values()) - sum(most * total[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * total[s]}
        if not over:
            break
        capped |= over
    target = {s: most * total[s] if s in capped else share[s] for s in order}
    takes = []
    for s in order:
        cum = 0
        key = lambda d: hashlib.md5(f"wfq:{d}".encode()).hexdigest()
        for d in sorted(queues[s], key=key):
            cum += size[d]
            if size[d] and target[s] > 0:
                takes += [((cum + p * total[s]) / target[s], s is None, s or "", key(d), p, d) for p in range(most) if p < target[s] / total[s]]
    out, run = dict.fromkeys(size, 0), 0
    for t in sorted(takes):
        run += size[t[-1]]
        if run > sum(total.values()):
            break
        out[t[-1]] += 1
    return out


@pytest.mark.parametrize(("n", "per_slice"), [(5, 1 << 15), (400, 1 << 15), (400, 7)])
def test_takes(spark, monkeypatch, n, per_slice):
    monkeypatch.setattr(mixing, "ROWS_PER_SLICE", per_slice)
    rng = random.Random(n)
    rows = [(i, None if i % 17 == 0 else " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "b", "b", "b", "b", "c", None, "d"])) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = {r["mix_key"]: r["takes"] for r in mixing.mix(df).collect()}
    want = plain(rows)
    assert got == want


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c", "x")] * 3 + [(None, "d e", "y")] * 4 + [(None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == 8 and all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mix(df.limit(0)).collect() == []
