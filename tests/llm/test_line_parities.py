"""The bitmap filter of line dedup, on lines that fill a bitmap."""

from __future__ import annotations

import random

from sitescope.llm import lines


def test_long_lines_are_told_apart(spark, monkeypatch):
    """150 of 300 words each: no pair comes near 0.8, and hardly any is verified."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows = [(k, " ".join(rng.sample(words, 150))) for k in range(60)]
    line = rng.sample(words, 150)
    rows += [(100, " ".join(line)), (101, " ".join([*line[:145], "a", "b", "c", "d", "e"]))]  # these do match
    pairs = []
    real = lines.materialize

    def counted(df, name):
        out = real(df, name)
        if name == "lines-pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(lines, "materialize", counted)
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0").collect()
    assert [r["doc_id"] for r in got] == [101]
    assert 1 <= sum(pairs) <= 30


def test_parities_lose_nothing(spark):
    """They differ in as many bits at most as the sets in words."""
    rng = random.Random(2)
    every = [rng.getrandbits(58) for _ in range(400)]
    sets = [rng.sample(every, rng.choice([1, 5, 40, 200, 390])) for _ in range(40)]
    sets += [sorted(set(s) ^ set(rng.sample(every, 3))) for s in sets]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "i int, tokens array<long>")
    every_bit, upper = lines._parities()
    bits = {r["i"]: (r["a"] ^ r["b"], r["b"]) for r in df.select("i", every_bit.alias("a"), upper.alias("b")).collect()}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            differ = sum(((x ^ y) & ((1 << 64) - 1)).bit_count() for x, y in zip(bits[i], bits[j], strict=True))
            assert differ <= len(set(a) ^ set(b))


def test_halves_sum_each_word_once(spark):
    middle = 1 << (lines.HASH_BITS - 1)
    sets = [[5, middle + 9], [middle], [middle - 1, middle, 3], [64, 128, middle + 64], []]
    df = spark.createDataFrame(list(enumerate(sets)), "i int, tokens array<long>")
    lower, upper = lines._halves()
    got = {r["i"]: (r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in df.select("i", lower.alias("a"), upper.alias("b")).collect()}
    for i, s in enumerate(sets):
        want = [0, 0]
        for x in s:
            want[x >= middle] ^= 1 << (x & 63)
        assert got[i] == tuple(want)


def test_parts_of_keys_are_all_keys(spark):
    """A part makes its own keys alone; each key, of two words too, is in one part."""
    rng = random.Random(4)
    rows = [(i, 20, 4, sorted((rng.randrange(4) << lines.HASH_BITS) | rng.getrandbits(57) for _ in range(6)), 1, 2) for i in range(50)]
    pre = spark.createDataFrame(rows, "rank long, n int, free int, pre array<long>, w0 long, w1 long")

    def keys(*a):
        return sorted((r["token"], r["rank"], r["pos"]) for r in lines._keys(pre, 2, *a).collect())

    parts = [keys(p, 3) for p in range(3)]
    assert sorted(x for p in parts for x in p) == keys() and all(parts)
    tokens = [{x[0] for x in p} for p in parts]
    assert not (tokens[0] & tokens[1] or tokens[0] & tokens[2] or tokens[1] & tokens[2])
