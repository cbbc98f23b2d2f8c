"""Repeated ids, null ids and audits of embedding near-dedup."""

from __future__ import annotations

import numpy as np

from sitescope.llm import embeddings

SCHEMA = "vec_id long, embedding array<double>, label string"


def rows_of(df):
    return [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect()]


def test_a_repeated_id_hides_no_vector(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(5, a, "x"), (5, b, "x"), (7, [0.0, 1.0, 0.01], "x"), (8, [0.0, 1.0, 0.02], "x"), (9, a, "y"), (None, a, "x"), (3, [0.0, -0.0, 0.0], "x")]
    got = rows_of(embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)))
    assert sorted(x for x in got if x[0] == 5) == [(5, 1, 5, True), (5, 2, 5, True)]
    assert sorted(x for x in got if x[0] in (7, 8, 9)) == [(7, 2, 5, False), (8, 2, 5, False), (9, 0, 9, True)]
    assert [x for x in got if x[0] is None] == [(None, 1, 5, False)] and (3, 0, 3, True) in got


def test_only_null_ids(spark):
    got = rows_of(embeddings.near_duplicates(spark.createDataFrame([(None, [1.0, 2.0], "x")] * 2, SCHEMA)))
    assert got == [(None, 1, None, False)] * 2


def test_audit_without_links():
    """Random vectors have no link, and their nearest vectors are found all the same."""
    x = np.random.default_rng(2).normal(size=(1500, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = embeddings.Graph(x)
    beam, recall = embeddings.audited_beam(g, g.x, 0.93, own=True)
    assert recall >= embeddings.AUDIT_RECALL
    if beam is not None:
        truth = [set(np.argsort(-(g.x @ q))[:6].tolist()) for q in g.x[::7]]
        found = [{n for _, n in g.ask(q, 0.93, beam)} for q in g.x[::7]]
        assert np.mean([len(t & f) / len(t) for t, f in zip(truth, found, strict=True)]) >= 0.9


def test_brute_force_where_no_beam_passes(monkeypatch):
    x = np.random.default_rng(4).normal(size=(80, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(embeddings, "AUDIT_RECALL", 2.0)
    monkeypatch.setattr(embeddings, "audited_beam", lambda *a, **k: (None, 1.0))
    g = embeddings.Graph(x)
    got = set(embeddings.pair_links(g, g, x, x, 0.93, True))
    assert got == {(i, j) for i in range(80) for j in range(i + 1, 80) if x[i] @ x[j] >= 0.93}


def test_audit_draws_linked_queries():
    """Few rows of a shard have a link: those are found and audited, and all links come out."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 24))
    x[1000:1060] = x[:60] + rng.normal(size=(60, 24)) * 0.02
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = embeddings.Graph(x)
    drawn = embeddings._drawn(g, g.x, 0.93, embeddings.AUDITS, True)
    assert len(drawn) == embeddings.AUDITS and all(len(want) == 1 for _, want in drawn)
    got = set(embeddings.pair_links(g, g, x, x, 0.93, True))
    want = {(int(i), int(j)) for i, j in np.argwhere(np.triu(x @ x.T >= 0.93, 1))}
    assert len(want) == 60 and got <= want and len(got) >= 57
