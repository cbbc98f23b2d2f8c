"""The training-data operators against brute force, and their defined cases."""

from __future__ import annotations

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from sitescope.llm import common, embeddings, idfile, jaccard, katz, language, lines, media, mixing, packing, pages
from sitescope.llm.queries import QUERIES
from sitescope.llm.tokens import CachedEncoder

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz".split()) + rng.choice("xyzuvw") for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Edge cases, copies, near copies, ties and one very long text."""
    rng = random.Random(3)
    base = words(rng, 120)
    rows = [(i, words(rng, rng.randint(1, 60)) + "\n" + words(rng, 12), "en" if i % 2 else "de", f"s{i % 4}", i) for i in range(40)]
    rows += [(100 + i, base, "en", "s0", 1) for i in range(6)]
    rows += [(110 + i, base + f" extra{i} tail", "en", "s0", 1) for i in range(12)]
    rows += [(130, None, None, None, None), (131, "", "de", "s1", 0), (132, "   \n\t ", "de", None, 3), (133, "a b", "de", "s2", 3), (134, "A B", "de", "s2", 3)]
    rows += [(135, words(rng, 30_000), "en", "s3", 9), (136, "1234 5678", "en", "s9", 9), (137, "line one two three four five\nline one two three four five\nline one two three four five six", "en", "s1", 9)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def plain(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


# ---- media

def test_media_round_trip():
    for data in (b"", b"x", bytes(range(256)) * 9, b"\xff" * 1000, os.urandom(777)):
        file = media.encode_payload(data)
        got = media.analyse_file(file, media.JpegDecoder())
        assert got["payload"].rstrip(b" ") == data.rstrip(b" ") and len(got["payload"]) % 192 == 0
        assert sum(c["n_frames"] for c in got["clips"]) == got["n_frames"]
    with pytest.raises(ValueError):
        media.riff_frames(b"RIFF0000WAVE")


def test_lossless_without_the_fixed_table():
    """A decoder that knows nothing of the fixed table gets the same samples."""
    x = np.random.default_rng(0).integers(0, 256, (2, 12, 16)).astype(np.uint8)
    d = media.JpegDecoder()
    frames = media.encode_frames(x)
    assert all((d._slow(f, d.header(f)) == y).all() for f, y in zip(frames, x, strict=True))


def test_baseline_frame():
    """A constant 8 x 8 block: one DC difference, end of block."""
    dht = lambda cls, bits, vals: media._segment(0xC4, bytes([cls]) + bits + vals)
    one = bytes([1] + [0] * 15)
    frame = (b"\xff\xd8" + media._segment(0xDB, b"\x00" + bytes([1] * 64)) + dht(0x00, one, bytes([8])) + dht(0x10, one, bytes([0]))
             + media._segment(0xC0, b"\x08\x00\x08\x00\x08\x01\x01\x11\x00") + media._segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"))
    bits = "0" + format(200, "08b") + "0"  # category 8, value 200, end of block
    raw = int(bits.ljust(16, "1"), 2).to_bytes(2, "big")
    got = media.JpegDecoder().decode([frame + raw.replace(b"\xff", b"\xff\x00") + b"\xff\xd9"])
    assert (got[0] == 128 + 200 // 8).all()


def test_shots():
    h = np.zeros((40, 16))
    h[:20, 2], h[20:, 11] = 1, 1
    first, d = media.shots(h)
    assert first.tolist() == [0, 20] and d[20] == 1
    assert media.shots(np.zeros((0, 16)))[0].tolist() == []


def test_media_columns(spark, docs):
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"), F.lit("x").alias("media"), F.lit(1).alias("clips"))
    rows = media.analyse(media.encode(d, "data"), digests=True).join(docs.select("doc_id", "text"), "doc_id").collect()
    for r in rows:
        data = (r["text"] or "").encode()
        data = data.ljust(max(1, -(-len(data) // 192)) * 192)
        assert r["payload_sha256"] == hashlib.sha256(data).hexdigest() and r["tail_crc32"] == zlib.crc32(data[-16:])
    null = spark.createDataFrame([(1, None)], "k int, media binary")
    assert media.analyse(null).first()["n_frames"] is None


# ---- mixing

def test_mixing(docs):
    out = mixing.mix(docs).collect()
    sizes, src = {}, {}
    for r in docs.collect():
        sizes[r["doc_id"]], src[r["doc_id"]] = len(brute.words(r["text"])), r["source"]
    total = Counter()
    for k, n in sizes.items():
        total[src[k]] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:  # plain water filling
        rest = sum(total.values()) - sum(3 * total[s] for s in capped)
        free = [s for s in order if s not in capped]
        w = sum(weight[s] for s in free)
        target = {s: 3.0 * total[s] if s in capped else rest * weight[s] / w for s in order}
        over = {s for s in free if target[s] > 3 * total[s]}
        if not over:
            break
        capped |= over
    for r in out:
        assert r["size"] == sizes[r["mix_key"]] and r["target"] == pytest.approx(target[src[r["mix_key"]]]) and r["taken"] <= 3 * r["size"]
    taken = sum(r["taken"] for r in out)
    assert taken <= sum(sizes.values()) and taken >= sum(sizes.values()) - max(sizes.values())
    again = {(r["mix_key"], r["taken"]) for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {(r["mix_key"], r["taken"]) for r in out}
    assert mixing.mixed_documents(docs).columns == docs.columns


# ---- line dedup

def test_line_dedup(docs):
    got = {r["doc_id"]: r["text"] for r in lines.dedup(docs.withColumn("n_lines", F.lit(1))).collect()}
    assert got == brute.dedup_lines(plain(docs))
    assert got[130] is None and got[137] == "line one two three four five"


def test_line_dedup_shared_ids(spark):
    """Rows of one id are ordered by text, so a line that two of them have stays once; null ids come first."""
    df = spark.createDataFrame([(1, "a b c d\nq r s t"), (1, "a b c d\nu v w x"), (None, "q r s t"), (2, "u v w x")], "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in lines.dedup(df).collect()]
    assert (None, "q r s t") in got and (2, "") in got
    assert sorted(t for d, t in got if d == 1) in (["", "a b c d\nu v w x"], ["a b c d", "u v w x"])
    same = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e f"), (5, "x y"), (5, "x y")], "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in lines.dedup(same).collect()]
    assert sorted(t for d, t in got if d is None) in (["", "a b c d e"], ["", "a b c d e f"])
    assert [t for d, t in got if d == 5] == ["x y", "x y"]


def test_line_dedup_keeps_the_earlier_line(spark):
    rows = [(1, "zz yy\na b c d e\nqq ww\na b c d e f"), (7, "a b c d e f"), (8, "zz\tyy\r\n\n a  b c d\x0be ")]
    got = {r["doc_id"]: r["text"] for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.dedup_lines(rows)
    assert got[1] == "zz yy\na b c d e\nqq ww" and got[7] == ""


@pytest.mark.parametrize(("hot", "few"), [(4096, 64), (3, 2)])
def test_line_dedup_small_vocabulary(spark, monkeypatch, hot, few):
    """Many similar lines over few words; with few words frequent, and with nearly all."""
    monkeypatch.setattr(lines, "HOT_COUNT", hot)
    monkeypatch.setattr(lines, "FEW_LINES", few)
    rng = random.Random(11)
    base = [[f"w{rng.randint(0, 60)}" for _ in range(rng.randint(1, 40))] for _ in range(30)]
    rows = []
    for d in range(60):
        ls = []
        for _ in range(8):
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"w{rng.randint(0, 90)}"
            ls.append(" ".join(w))
        rows.append((d, "\n".join(ls)))
    got = {r["doc_id"]: r["text"] for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute.dedup_lines(rows)


# ---- token ids and packing

def tokenizer(name):
    return pytest.importorskip("public_tokenizers").path(name)


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_cached_encoder(name, spaced):
    from tokenizers import Tokenizer

    e, t = CachedEncoder(tokenizer(name), spaced), Tokenizer.from_file(tokenizer(name))
    rng = random.Random(1)
    texts = ["", " ", "a", " lead", "trail ", "two  spaces", "tab\tand\nline\n\nend", "it's, isn't. 12,5 !? ...", "Ärger naïve été", "<|endoftext|> x", "nbsp x y", "日本 語 ",
             "　x y", "é ́x", "İstanbul ΣΑΣ", *[words(rng, 50) + "." for _ in range(50)]]
    for _ in range(2):
        ids, n = e.encode(texts)
        want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
        assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 9001])
def test_range_coder(n):
    rng = np.random.default_rng(n)
    for ids in (np.minimum(rng.zipf(1.2, n), 65535), rng.integers(0, 65536, n), np.zeros(n, int)):
        data = idfile.encode_ids(ids.astype(np.uint32))
        assert (idfile.decode_ids(data) == ids).all()
    if n > 3000:
        assert len(idfile.encode_ids(np.tile(np.arange(50, dtype=np.uint32), n // 50))) < n
        broken = bytearray(data)
        broken[-40] ^= 0x55
        with pytest.raises(ValueError):
            idfile.decode_ids(bytes(broken))


def test_id_file(docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in idfile.read(idfile.write(docs, path), ids=True).collect()}
    start = 0
    for k, text in sorted(plain(docs)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        r = got[k]
        assert r["ids"] == ids and r["start"] == start and r["n_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert idfile.read(idfile.write(empty, path)).count() == 0


def check_packing(rows, expected_tokens):
    by = defaultdict(list)
    for r in rows:
        assert r["length"] <= 2048
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert sum(r["length"] for r in rows) == expected_tokens
    return len(by)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = packing.pack(docs, path).collect()
    total = 0
    pieces = {(r["doc_id"], r["piece"]): r for r in rows}
    for k, text in plain(docs):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        for p in range(-(-len(ids) // 2048)):
            part = ids[p * 2048 : (p + 1) * 2048]
            r = pieces[k, p]
            assert (r["start"], r["length"], r["ids_crc32"]) == (p * 2048, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    n = check_packing(rows, total)
    assert n <= -(-total // 2048) + 2
    assert packing.pack(empty, path).count() == 0


def test_best_fit():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 2049, 3000)
    place, offset = packing.best_fit(sizes, 2048)
    # what best-fit decreasing is proven to need at most
    assert np.bincount(place, sizes).max() <= 2048 and len(np.unique(place)) <= 11 / 9 * sizes.sum() / 2048 + 1
    small = rng.integers(1, 300, 3000)
    assert len(np.unique(packing.best_fit(small, 2048)[0])) == -(-small.sum() // 2048)


# ---- html

def test_main_text():
    html = ("<html><head><title>T</title><script>x<p>no</p></script></head><body><nav><ul><li>menu</ul></nav><div class='cookie-notice'>ok</div>"
            "<article><h1>Head &amp; more</h1><p>One <b>bold</b>\n text<br>line<p>Two &lt;2&gt; &nbsp;x<aside>side</aside><div class=comments><p>me</p></div></article>"
            "<footer>foot</footer></body>")
    got, n, c = pages.main_texts([pages.blocks(html)])[0]
    assert got == "Head & more\nOne bold text line\nTwo <2> x"
    assert pages.main_texts([pages.blocks(""), pages.blocks("plain text")])[1][0] == "plain text"


def test_repeats_leave():
    boiler = " ".join(f"w{i}" for i in range(20))
    ps = [pages.blocks(f"<div>{boiler}</div><div>{i} pages say something of their own</div>") for i in range(3)]
    assert [t for t, _, _ in pages.main_texts(ps)] == [f"{i} pages say something of their own" for i in range(3)]
    rng = np.random.default_rng(5)
    tok, page = rng.integers(0, 3, 400), np.sort(rng.integers(0, 6, 400))
    tok[np.flatnonzero(np.diff(page))] = -1 - page[np.flatnonzero(np.diff(page))]
    want = np.zeros(400, bool)
    seen = defaultdict(set)
    for i in range(400 - 5 + 1):
        seen[tuple(tok[i : i + 5])].add(page[i])
    for i in range(400 - 5 + 1):
        if len(seen[tuple(tok[i : i + 5])]) > 1:
            want[i : i + 5] = True
    assert (pages.repeated(tok, page, 5) == want).all()
    s = rng.integers(0, 4, 60)
    assert pages.suffix_array(s).tolist() == sorted(range(60), key=lambda i: s[i:].tolist())


def test_pages(spark):
    rows = [(1, "http://a.com/x", "<article><p>same</p></article>"), (2, "http://a.com/y", "<article><p>same</p></article>"), (3, None, None), (3, None, None)]
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), per_shard=1).collect())
    assert got == [(1, "same", 4), (2, "same", 4), (3, "", 0), (3, "", 0)]


# ---- jaccard

@pytest.mark.parametrize(("width", "num", "den"), [(4, 85, 100), (5, 80, 100), (2, 60, 100)])
def test_jaccard(docs, width, num, den):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link_groups(docs, width=width, num=num, den=den).collect()}
    assert got == brute.jaccard_components(plain(docs), width, num, den)


def test_keep_first(spark, docs):
    kept = jaccard.keep_first(docs.unionByName(docs.where("doc_id = 7")))
    want = {c for _, c in brute.jaccard_components(plain(docs), 5, 80, 100).values()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want) and kept.columns == docs.columns


# ---- embeddings

def test_embeddings(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16))
    for i in range(40):
        x[200 + i] = x[i] + rng.normal(size=16) * 0.05
    x[300:310] = x[0]
    rows = [(i, v.tolist(), int(i % 3 == 0)) for i, v in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, x[0].tolist(), None), (904, [1.0, None], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, shard=64).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows[:400]])
    link = (u @ u.T >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(link, False)
    found = sum(got[i]["n_links"] for i in range(400))
    assert found >= 0.97 * link.sum() and all(got[i]["n_links"] <= link[i].sum() for i in range(400))
    uf = brute.Union()
    for i, j in np.argwhere(link):
        uf.join(int(i), int(j))
    assert np.mean([got[i]["component_id"] == uf.root(i) for i in range(400)]) >= 0.97
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in (900, 901, 902, 903, 904))


# ---- language

def test_language(spark, docs, empty):
    m = language.LanguageModel.build({"xx": np.arange(50, dtype=np.uint64) * 7919, "yy": np.arange(40, 90, dtype=np.uint64) * 7919})
    masks = m.masks(np.arange(90, dtype=np.uint64) * 7919)
    assert (masks[:40] & 1).all() and (masks[40:50] == 3).all() and (masks[50:] & 2).all()
    model = language.train(docs.select("text", "lang"), min_count=1)
    got = {r["doc_id"]: r for r in language.identify(docs.withColumn("score", F.lit(1)), model).collect()}
    assert got[130]["lang_pred"] == got[131]["lang_pred"] == got[136]["lang_pred"] == "und" and got[130]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values()) and {r["lang_pred"] for r in got.values()} <= {"de", "en", "und"}
    none = language.train(empty)
    assert {r["lang_pred"] for r in language.identify(docs, none).collect()} == {"und"}


@needs_data
def test_language_held_out(spark):
    d = QUERIES["op9_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    assert d.where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.97


# ---- language model

def test_katz_sums_to_one():
    """All words after a seen history: seen ones, backed-off ones, the unknown."""
    rng = np.random.default_rng(1)
    seq = np.minimum(rng.zipf(1.6, 5000), 300)
    uni = Counter(seq.tolist())
    n_of = np.bincount(np.minimum(list(uni.values()), katz.MOST_DISCOUNTED + 2), minlength=katz.MOST_DISCOUNTED + 3)
    u = katz.Unigrams.of(len(seq), len(uni), n_of)
    p1 = {w: float(u.p(np.array([c]))[0]) for w, c in uni.items()}
    assert sum(p1.values()) + u.unknown == pytest.approx(1)
    bi = Counter(zip(seq.tolist(), seq[1:].tolist(), strict=False))
    keep = katz.discounts(np.bincount(np.minimum(list(bi.values()), katz.MOST_DISCOUNTED + 2), minlength=katz.MOST_DISCOUNTED + 3))
    for h in (1, 2, 7):
        succ = {b: c for (a, b), c in bi.items() if a == h}
        c, p = np.array(list(succ.values())), np.array([p1[w] for w in succ])
        total, alpha = katz._backoff(katz._sums(np.zeros(len(c), int), 1, c, p), keep)
        seen = sum(x * (keep[x] if x <= katz.MOST_DISCOUNTED else 1) / total[0] for x in c.tolist())
        rest = alpha[0] * (sum(v for w, v in p1.items() if w not in succ) + u.unknown)
        assert seen + rest == pytest.approx(1)


def test_katz(docs, empty):
    train = F.col("doc_id") % 3 != 0
    got = {r["doc_id"]: r for r in katz.score(docs, train).collect()}
    tok = {k: [*brute.words(t), "</s>"] for k, t in plain(docs)}
    uni = Counter(w for k, ws in tok.items() if k % 3 for w in ws)
    n, v = sum(uni.values()), len(uni)
    for k, ws in tok.items():
        r = got[k]
        base = sum(np.log10((uni[w] + 1) / (n + v + 1)) for w in ws)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(uni[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0
    want = brute.katz(tok, [k for k in tok if k % 3])
    assert all(got[k]["score"] == pytest.approx(want[k], rel=1e-9) for k in tok)
    assert katz.score(empty, train).count() == 0


# ---- shared parts, all queries

def test_components(spark):
    e = [(1, 2), (2, 3), (9, 3), (20, 21), (30, 30)] + [(100 + i, 101 + i) for i in range(30)] + [(500, 600 + i) for i in range(50)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(e, "src long, dst long"), "t").collect()}
    u = brute.Union()
    for a, b in e:
        u.join(a, b)
    assert got == {k: u.root(k) for a in e for k in a if k != 30}


def test_packed_arrays():
    for a in (np.zeros(0, np.uint64), np.arange(9, dtype=np.uint32), np.array([2**63, 1], np.uint64)):
        assert (common.unpack(common.pack(a)) == a).all()


def test_empty_tables(empty, spark):
    assert mixing.mix(empty).count() == lines.dedup(empty).count() == jaccard.link_groups(empty).count() == 0
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@needs_data
def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = p.language_id(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() >= 0.9 * docs.count()
    slim = p.line_dedup(spark, common.materialize(kept, "t"), SF)
    want = brute.dedup_lines(plain(kept))
    slim = common.materialize(slim, "t")
    assert dict(plain(slim)) == {k: t for k, t in want.items() if t != ""}
    one = common.materialize(p.ngram_jaccard(spark, slim, SF), "t")
    assert {r["doc_id"] for r in one.collect()} == {c for _, c in brute.jaccard_components(plain(slim), 5, 80, 100).values()}
    mixed = common.materialize(p.source_mix(spark, one, SF), "t")
    assert mixed.columns == docs.columns and max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 3
    rows = p.best_fit(spark, mixed, SF).collect()
    assert check_packing(rows, sum(r["length"] for r in rows)) > 0
