"""Rarity levels and bitmaps of line dedup."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from sitescope.llm import lines


def test_rarer_words_come_first(spark, monkeypatch):
    """Words in 63 and 150 lines each: the prefixes hold the first, of whom no list is long."""
    rng = random.Random(5)
    rare, common = [f"a{i % 38}" for i in range(2400)], [f"b{i % 24}" for i in range(3600)]
    rng.shuffle(rare)
    rng.shuffle(common)
    rows = [(i, " ".join(rare[2 * i : 2 * i + 2] + common[3 * i : 3 * i + 3])) for i in range(1200)]
    long = []
    real = lines.materialize

    def counted(df, name):
        out = real(df, name)
        if name == "lines-rows":
            long.append(out.where("token IS NOT NULL").count())
        return out

    monkeypatch.setattr(lines, "materialize", counted)
    lines.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(long) == lines.PASSES and sum(long) == 0


def test_bitmaps_of_long_and_short_lines(spark):
    """They differ in as many bits at most as the sets in words, whether one, both or none has a second bitmap."""
    rng = random.Random(6)
    every = [rng.getrandbits(lines.HASH_BITS) for _ in range(80)]
    sets = [rng.sample(every, n) for n in (4, 30, 47, 48, 49, 50, 60, 79)]
    sets += [sorted(set(s) ^ set(rng.sample(every, 2))) for s in sets]
    df = spark.createDataFrame([(i, len(s), s) for i, s in enumerate(sets)], "i int, n int, tokens array<long>")
    w0, w1 = lines._bitmaps()
    a, b = (df.select(*[x.alias(f"{p}{c}") for c, x in (("i", F.col("i")), ("w0", w0), ("w1", w1))]) for p in "ab")
    got = {(r["ai"], r["bi"]): r["d"] for r in a.crossJoin(b).select("ai", "bi", lines._differ("a", "b").alias("d")).collect()}
    assert len(got) == len(sets) ** 2
    assert all(d <= len(set(sets[i]) ^ set(sets[j])) for (i, j), d in got.items())
    assert got[6, 7] > 0
