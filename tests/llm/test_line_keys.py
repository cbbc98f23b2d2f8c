"""Keys of line dedup: made once for each part, whatever words are frequent."""

from __future__ import annotations

import random
import re

from sitescope.llm import lines


def test_one_generator_makes_single_keys_and_pairs(spark):
    """Rows of prefixes with a frequent word are no count of their own, which would grow as words become frequent."""
    rng = random.Random(7)
    bits = lines.HASH_BITS
    pres = [sorted({(rng.randrange(5) << bits) | rng.getrandbits(40) for _ in range(rng.randint(2, 7))}) for _ in range(80)]
    rows = [(i, 20, len(p) - 2, p, 1, 2) for i, p in enumerate(pres)]
    pre = spark.createDataFrame(rows, "rank long, n int, free int, pre array<long>, w0 long, w1 long")
    for hot in (2, 4, 9):
        want = []
        for i, p in enumerate(pres):
            for k, t in enumerate(p):
                if t >= hot << bits:
                    want += [(i, k, t, u) for u in p[k + 1 :]]
                elif t >= 1 << bits and k <= len(p) - 2:
                    want.append((i, k, t, None))
        keys = lines._keys(pre, hot)
        got = sorted((r["rank"], r["pos"], r["token"]) for r in keys.collect())
        ids = spark.createDataFrame(want, "rank long, pos int, t long, u long").selectExpr("rank", "pos", "CASE WHEN u IS NULL THEN hash(t) ELSE hash(t, u) END AS token")
        assert got == sorted((r["rank"], r["pos"], r["token"]) for r in ids.collect())
        assert "Union" not in keys._jdf.queryExecution().optimizedPlan().toString()


def test_plans_of_a_part_share_one_exchange(spark, monkeypatch):
    rows = [(i, f"a{i % 40} b{i % 40} c d e f g h i j{i % 3}") for i in range(300)]
    plans = []
    real = lines.materialize

    def seen(df, name):
        if name == "lines-rows":
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
        return real(df, name)

    monkeypatch.setattr(lines, "materialize", seen)
    lines.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(plans) == lines.PASSES
    for plan in plans:
        assert len(re.findall(r"[-:] Exchange hashpartitioning\(token", plan)) == 1
        assert len(re.findall(r"ReusedExchange", plan)) == 2
