"""Blocks that the page doesn't mark as main text."""

from __future__ import annotations

from sitescope.llm import pages

QUOTE, OWN = " ".join(f"q{i}" for i in range(12)), " ".join(f"o{i}" for i in range(8))


def test_unique_runs_stay():
    """60 % of the first page's block is on another page."""
    ps = [pages.blocks(f"<div>{QUOTE} {OWN}</div>"), pages.blocks(f"<div>{QUOTE}</div>")]
    assert [t for t, _, _ in pages.main_texts(ps)] == [OWN, ""]


def test_copies_of_a_page():
    ps = [pages.blocks(f"<div>{QUOTE} {OWN}</div>")] * 2
    assert [t for t, _, _ in pages.main_texts(ps)] == [f"{QUOTE} {OWN}"] * 2


def test_shards_change_nothing(spark):
    """Runs that pages of other shards repeat leave as those of the same shard."""
    def row(k, html, host="h.com"):
        return k, f"http://{host}/{k}", html

    long = " ".join(f"l{i}" for i in range(30))
    rows = [row(k, f"<div>{QUOTE}</div><div>{k} " + " ".join(f"x{k}y{i}" for i in range(10)) + "</div>") for k in range(40)]
    rows += [row(k, f"<main><p>{long}</p></main>") for k in range(40, 43)]  # marked: repeats stay
    rows += [row(43, f"<div>own words first {long}</div>")]  # repeated by main text elsewhere
    rows += [row(k, "<div>" + " ".join(f"c{i}" for i in range(20)) + "</div>") for k in range(44, 60)]  # copies of one page
    rows += [row(60, f"<p>{OWN}</p><p>short</p>"), row(61, f"<p>{OWN}</p><p>other</p>"), row(62, None), row(63, f"<div>{QUOTE}</div>", "elsewhere.org")]
    rows += [rows[0]] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(tuple, pages.extract(df).collect()))
    assert len(want) == len(rows)
    assert {r[0]: r[2] for r in want}[5] == "5 " + " ".join(f"x5y{i}" for i in range(10))
    assert {r[0]: r[2] for r in want}[43] == "own words first"
    for per_shard in (1, 3, 20):
        assert sorted(map(tuple, pages.extract(df, per_shard=per_shard).collect())) == want


def test_shards_where_many_hosts_are_hot(spark, monkeypatch):
    rows = [(k, f"http://h{k % 3}.com/{k}", f"<div>{QUOTE}</div><div>{OWN} {k} a{k}</div>") for k in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(tuple, pages.extract(df).collect()))
    monkeypatch.setattr(pages, "HOT_HOSTS", 1)
    assert sorted(map(tuple, pages.extract(df, per_shard=2).collect())) == want
