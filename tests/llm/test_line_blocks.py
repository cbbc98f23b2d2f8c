"""Documents with many lines, in one task."""

from __future__ import annotations

import brute

from sitescope.llm import lines


def test_documents_with_many_lines(spark):
    line = lambda i: " ".join(f"w{(i * j) % 97}" for j in range(1, 8))
    rows = [(1, "\n".join(line(i) for i in range(1, 40))), (2, "\n".join(line(i) + (" x" if i % 2 else "") for i in range(20, 60))), (3, "a\nb\nc\n" * 30)]
    rows.append((4, "\n".join(f"n{i} m{i % 7}" for i in range(30_000))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    assert {r["doc_id"]: r["text"] for r in lines.dedup(df).collect()} == brute.dedup_lines(rows)
