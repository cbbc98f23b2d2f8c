"""Main text of web pages by host suffix arrays.

A page is cut into blocks with the elements around them.  The pages of a host
are dealt into shards of about ``PAGES`` pages; in each shard the tokens of
all blocks are concatenated, a suffix array with its longest common prefixes
finds the substrings of ``RUN`` tokens or more that distinct pages share, and
their tokens count as covered.

A block is removed if it lies in an element that is never main text (menus,
headers, footers, sidebars, notices, adverts, forms, comments, scripts,
styles).  A block that the page doesn't mark as main text keeps its unique
runs.  Pages of a shard with equal blocks count as one page.  Blocks of
``article`` or ``main`` stay whole even if another page repeats them: a copied
article is still that page's main text.

Hosts of any size are dealt out, so a hot host is many shards.  What repeats is
the same whatever the shards: where a host of several shards has a block that
isn't marked, its shards exchange hashes of their runs, dealt by the run, and
each shard gets back those of its open blocks that another page has too.

Defined cases: null html gives an empty text; unclosed elements end with
their parent; rows with a null url form hosts of their own by page id; an
unfinished character reference stays as it is; repeated rows give repeated
rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitescope.llm.common import chunks, drop_table, materialize, mix, pack, pack_sorted, unpack, unpack_sorted

PAGES = 512
RUN = 8
CHUNK = 4 << 20
#: Pages whose runs are sent together.
SENT = 512

_TAG = re.compile(r"<!--.*?(?:-->|$)|<(?:!|\?)[^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "iframe", "textarea", "title")}
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPACE = re.compile(r"\s+")

#: Elements that begin and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul head title".split()
)
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never main text.
CHROME = frozenset(
    "nav header footer aside form script style noscript template iframe textarea head title menu dialog button select option "
    "input label fieldset svg canvas object video audio map search".split()
)
#: Words in class, id or role that say the same.
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner promo promoted promotion sponsor sponsored sponsors nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie cookies consent notice notices notification gdpr popup modal overlay "
    "newsletter subscribe subscription signup login search share sharing social related recommended recommendations comment comments respond "
    "discussion disqus replies reactions form toolbar pagination pager copyright legal alert skip hidden complementary contentinfo dialog".split()
)
#: Elements, or words, that say that a block is main text.
MAIN = frozenset(("article", "main"))
MAIN_WORDS = frozenset("article main content post entry story body-content article-body post-content entry-content main-content".split())
#: Words that can as well be about the article: inside main text they don't count.
AMBIGUOUS = frozenset("aside alert banner copyright discussion footer form header hidden legal masthead notice notices notification notifications reactions recommended recommendations related respond search skip widget".split())
_WORD = re.compile(r"[A-Za-z0-9]+")


@dataclass
class Block:
    text: str
    chrome: bool
    main: bool


def _is_chrome(value: str, inside: bool) -> bool:
    """Whether a class, id or role says that this isn't main text; a name that
    also says main text (``article-header``) doesn't."""
    return any(words & CHROME_WORDS and not words & MAIN_WORDS and not (inside and words & CHROME_WORDS <= AMBIGUOUS)
               for words in (set(_WORD.findall(name)) for name in value.split()))


def _flags(tag: str, attrs: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is chrome, or main text; ``inside``: of main text."""
    chrome, main = tag in CHROME, tag in MAIN
    if attrs:
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                chrome = True
            elif name in ("class", "id", "role"):
                if tag not in ("body", "html", "article", "main") and _is_chrome(value, inside):
                    chrome = True
                if set(_WORD.findall(value)) & MAIN_WORDS or set(value.split()) & MAIN_WORDS:
                    main = True
    return chrome, main


def blocks(html: str) -> list[Block]:
    """The blocks of a page in order, white space collapsed."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []
    buf: list[str] = []
    at, end = 0, len(html)
    # of the open elements: how many are chrome, main text, and of each name
    open_chrome = open_main = 0
    open_tags: Counter[str] = Counter()

    def close() -> None:
        if buf:
            text = _SPACE.sub(" ", html_lib.unescape("".join(buf))).strip()
            if text:
                out.append(Block(text, open_chrome > 0, open_main > 0))
            buf.clear()

    def pop(k: int) -> None:
        """Close the elements from the ``k``-th on."""
        nonlocal open_chrome, open_main
        for name, is_chrome, is_main in stack[k:]:
            open_chrome -= is_chrome
            open_main -= is_main
            open_tags[name] -= 1
        del stack[k:]

    while at < end:
        m = _TAG.search(html, at)
        if m is None:
            buf.append(html[at:])
            break
        if m.start() > at:
            buf.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS:
                close()
            # a name that isn't open closes nothing, and isn't looked for
            for k in range(len(stack) - 1, -1, -1) if open_tags[tag] else ():
                if stack[k][0] == tag:
                    if any(s[1] or s[2] or s[0] in BLOCKS for s in stack[k:]):
                        close()
                    pop(k)
                    break
                # inline end tags don't reach out of their block
                if tag not in BLOCKS and stack[k][0] in BLOCKS:
                    break
            continue
        if tag == "br":
            buf.append(" ")
            continue
        if tag in _RAW:
            stop = _RAW[tag].search(html, at)
            at = stop.end() if stop else end
            continue
        chrome, main = _flags(tag, m[3], open_main > 0)
        if tag in BLOCKS or chrome or main:
            close()
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or tag in BLOCKS:
            # an unclosed paragraph ends where a block begins, with what is open in it
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or (stack[k][0] == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
                    pop(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
        if tag not in VOID and not m[3].rstrip().endswith("/"):
            stack.append((tag, chrome, main))
            open_chrome, open_main = open_chrome + chrome, open_main + main
            open_tags[tag] += 1
        elif tag not in VOID and tag in BLOCKS:
            close()
    close()
    return out


# ---------------------------------------------------------------- suffix arrays

def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of an integer array in order (prefix doubling)."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    k = 1
    while n and int(rank.max()) < n - 1:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1 if k < n else 0
        pair = rank * (n + 1) + second
        order = np.argsort(pair, kind="stable")
        sorted_ = pair[order]
        step = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = step
        k *= 2
        if k >= 2 * n:
            break
    return order


def repeated(tokens: np.ndarray, page: np.ndarray, run: int = RUN) -> np.ndarray:
    """Which tokens lie in a substring of ``run`` or more tokens that two
    distinct pages share.  Pages are ended by tokens of their own.

    Neighbours in the suffix array with a common prefix of ``run`` form
    groups; a group over two pages or more covers its suffixes' prefixes.
    Sorting stops at ``run`` tokens: longer repeats are unions of such runs.
    """
    n = len(tokens)
    covered = np.zeros(n, bool)
    if n < run:
        return covered
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    # ranks of prefixes of 1, 2, 4, ... tokens, and at last of exactly ``run``
    k = 1
    while k < run:
        step = min(k, run - k)
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        pair = rank * (n + 1) + second
        order = np.argsort(pair, kind="stable")
        sorted_ = pair[order]
        level = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = level
        k += step
    order = np.argsort(rank, kind="stable")
    r, p = rank[order], page[order]
    same = r[1:] == r[:-1]
    differ = same & (p[1:] != p[:-1])
    group = np.concatenate([[0], np.cumsum(~same)])
    shared = np.zeros(int(group[-1]) + 1, bool)
    shared[group[1:][differ]] = True
    start = order[shared[group]]
    return _covered(start[start <= n - run], n, run)


def _sequence(pages: list[list[Block]]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]], list[str]]:
    """Tokens of all pages, the page of each, (page, begin, end) of each block
    and the words that the tokens stand for.  A page ends with a token below 0."""
    ids: dict[str, int] = {}
    seq: list[int] = []
    page: list[int] = []
    spans: list[tuple[int, int, int]] = []
    first: dict[tuple[str, ...], int] = {}
    for i, bs in enumerate(pages):
        for b in bs:
            begin = len(seq)
            seq += [ids.setdefault(w, len(ids)) for w in b.text.split(" ")]
            spans.append((i, begin, len(seq)))
        seq.append(-i - 1)  # ends the page; occurs nowhere else
        # pages with equal blocks are one page: a copy repeats nothing
        same = first.setdefault(tuple(b.text for b in bs), i)
        page += [same] * (len(seq) - len(page))
    return np.array(seq, np.int64), np.array(page, np.int64), spans, list(ids)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def run_hashes(seq: np.ndarray, words: list[str], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of ``run`` tokens within a page begin, and their hashes,
    which don't depend on the other pages."""
    n = max(0, len(seq) - run + 1)
    token = np.append(np.array([_hash(w) for w in words], np.uint64), np.uint64(0))[np.maximum(seq, -1)]
    acc = np.zeros(n, np.uint64)
    for j in range(run):
        acc = mix(acc ^ token[j : j + n]) + np.uint64(j + 1)
    ends = np.concatenate([[0], np.cumsum(seq < 0)])
    at = np.flatnonzero(ends[run:] == ends[: len(ends) - run]) if n else np.zeros(0, np.int64)
    return at, acc[at]


def _covered(start: np.ndarray, n: int, run: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + run, -1)
    return np.cumsum(edge[:n]) > 0


def main_texts(pages: list[list[Block]], run: int = RUN, also: np.ndarray | None = None) -> list[tuple[str, int, int]]:
    """Main text, number of tokens, and number of covered tokens in blocks that
    aren't marked, of each page of one shard; ``also``: hashes of runs that
    pages of other shards repeat."""
    seq, page, spans, words = _sequence(pages)
    hit = repeated(seq, page, run)
    if also is not None and len(also):
        at, hashes = run_hashes(seq, words, run)
        hit |= _covered(at[np.isin(hashes, also)], len(seq), run)
    ends = np.concatenate([[0], np.cumsum(hit)])
    texts: list[list[str]] = [[] for _ in pages]
    n, c = [0] * len(pages), [0] * len(pages)
    flat = (b for bs in pages for b in bs)
    for (i, a, z), b in zip(spans, flat, strict=True):
        n[i] += z - a
        if b.chrome:
            continue
        if b.main:
            texts[i].append(b.text)
            continue
        k = int(ends[z] - ends[a])
        c[i] += k
        kept = " ".join(w for w, h in zip(b.text.split(" "), hit[a:z].tolist(), strict=True) if not h) if k else b.text
        if kept:
            texts[i].append(kept)
    return [("\n".join(t), x, y) for t, x, y in zip(texts, n, c, strict=True)]


# ---------------------------------------------------------------- runs of all shards of a host

_SENT = "host string, bucket int, runs binary, classes binary, who binary, shards binary, flags binary"
_WANT, _SEVERAL = 1, 2


def _blocks_of(texts: pa.Array | pa.ChunkedArray, flags: pa.Array | pa.ChunkedArray) -> list[list[Block]]:
    return [[Block(x, bool(f & 1), bool(f & 2)) for x, f in zip(a, b, strict=True)] for a, b in zip(texts.to_pylist(), flags.to_pylist(), strict=True)]


def _heads(*sorted_: np.ndarray) -> np.ndarray:
    """Where rows of sorted columns differ from the row before."""
    new = np.ones(len(sorted_[0]), bool)
    new[1:] = np.logical_or.reduce([a[1:] != a[:-1] for a in sorted_])
    return np.flatnonzero(new)


def sent_runs(host: str, pages: list[list[Block]], shard: np.ndarray, n_buckets: int) -> Iterator[tuple]:
    """Rows of ``_SENT``: the distinct runs of some pages of a host, each with
    its shard and a class of equal pages; flags tell whether a block that isn't
    marked has it, and whether pages of several classes have it."""
    seq, page, spans, words = _sequence(pages)
    at, runs = run_hashes(seq, words)
    if not len(at):
        return
    bare = np.zeros(len(seq) + 1, np.int64)
    for (_, a, z), b in zip(spans, (b for bs in pages for b in bs), strict=True):
        if not (b.chrome or b.main):
            bare[a + 1 : z + 1] = 1
    bare = np.cumsum(bare)
    want = bare[at + RUN] > bare[at]
    classes = np.array([_hash("\n".join(b.text for b in bs)) for bs in pages], np.uint64)
    of = np.repeat(np.arange(len(pages)), np.diff(np.flatnonzero(seq < 0), prepend=-1))[at]
    bucket = (runs >> np.uint64(20)) % np.uint64(n_buckets)
    order = np.lexsort((shard[of], runs, bucket))
    runs, bucket, want, same, who = runs[order], bucket[order], want[order], page[at][order], shard[of][order]
    head = _heads(runs, who)
    several = np.minimum.reduceat(same, head) != np.maximum.reduceat(same, head)
    flags = _WANT * np.logical_or.reduceat(want, head) + _SEVERAL * several
    runs, bucket, same, who, flags = runs[head], bucket[head], same[head], who[head], flags.astype(np.uint8)
    cuts = [*_heads(bucket).tolist(), len(runs)]
    for a, z in zip(cuts, cuts[1:], strict=False):
        own, index = np.unique(same[a:z], return_inverse=True)
        yield (host, int(bucket[a]), pack_sorted(runs[a:z]), pack(classes[own]), pack(index.astype(np.uint16)),
               pack(who[a:z].astype(np.uint32)), pack(flags[a:z]))


def shared_runs(t: pa.Table) -> Iterator[tuple[int, bytes]]:
    """(shard, runs) of one bucket of a host: the runs of blocks that aren't
    marked which pages of two classes or more have."""
    cols = [t.column(c).to_pylist() for c in ("runs", "classes", "who", "shards", "flags")]
    runs = np.concatenate([unpack_sorted(x) for x in cols[0]])
    classes = np.concatenate([unpack(c)[unpack(w)] for c, w in zip(cols[1], cols[2], strict=True)])
    shards, flags = (np.concatenate([unpack(x) for x in c]) for c in cols[3:])
    order = np.argsort(runs, kind="stable")
    runs, classes, shards, flags = runs[order], classes[order], shards[order], flags[order]
    head = _heads(runs)
    shared = (np.minimum.reduceat(classes, head) != np.maximum.reduceat(classes, head)) | (np.bitwise_or.reduceat(flags, head) & _SEVERAL > 0)
    asked = np.repeat(shared, np.diff(head, append=len(runs))) & (flags & _WANT > 0)
    runs, shards = runs[asked], shards[asked]
    order = np.lexsort((runs, shards))
    runs, shards = runs[order], shards[order]
    if len(runs):
        head = _heads(shards)
        for part in np.split(np.arange(len(runs)), head[1:]):
            yield int(shards[part[0]]), pack_sorted(np.unique(runs[part]))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", per_shard: int = PAGES) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_tokens, n_covered (of
    blocks that aren't marked)."""
    p = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.concat(F.lit("?"), F.col("page_id").cast("string")), F.lit("?"))
    p = p.withColumn("host", host)
    key_type, url_type = (p.schema[c].dataType.simpleString() for c in ("page_id", "url"))

    # hosts with more pages than a shard holds; the others need no number
    hot = p.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > per_shard)
    hot = hot.select(F.col("host").alias("hot"), F.ceil(F.col("n") / per_shard).cast("int").alias("n_shards"))
    many = [tuple(r) for r in hot.limit(HOT_HOSTS + 1).collect()]
    if len(many) <= HOT_HOSTS:
        hot = F.broadcast(pages.sparkSession.createDataFrame(sorted(many), "hot string, n_shards int"))

    def with_shards(df: DataFrame) -> DataFrame:
        df = df.join(hot, F.col("host") == F.col("hot"), "left") if many else df.withColumn("n_shards", F.lit(1))
        n = F.coalesce("n_shards", F.lit(1))
        return df.withColumns({"n_shards": n, "shard": F.pmod(F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 40)), n).cast("int")}).drop("hot")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for c in chunks([b], "html", CHUNK):
                got = [blocks(h or "") for h in c.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [c.column(0), c.column(1), c.column(3),
                     pa.array([[x.text for x in g] for g in got], pa.list_(pa.string())),
                     pa.array([[x.chrome + 2 * x.main for x in g] for g in got], pa.list_(pa.int8()))],
                    names=["page_id", "url", "host", "texts", "flags"],
                )

    def parsed(df: DataFrame) -> DataFrame:
        df = df.select("page_id", "url", "html", "host")
        return with_shards(df.mapInArrow(parse, f"page_id {key_type}, url {url_type}, host string, texts array<string>, flags array<tinyint>"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        fields = [f.split()[0] for f in _SENT.split(", ")]
        for b in batches:
            for i in range(0, b.num_rows, SENT):
                t = pa.Table.from_batches([b.slice(i, SENT)])
                hosts, n, shard = t.column("host").to_pylist(), t.column("n_shards").to_pylist(), t.column("shard").to_numpy()
                all_pages = _blocks_of(t.column("texts"), t.column("flags"))
                rows = []
                for h in sorted(set(hosts)):
                    at = [k for k, x in enumerate(hosts) if x == h]
                    rows += sent_runs(h, [all_pages[k] for k in at], shard[at], n[at[0]])
                if rows:
                    cols = list(zip(*rows, strict=True))
                    types = [pa.string(), pa.int32()] + [pa.binary()] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, types, strict=True)], names=fields)

    def bucket_runs(keys: tuple, t: pa.Table) -> pa.Table:
        got = list(shared_runs(t))
        return pa.table({"host": pa.array([keys[0].as_py()] * len(got), pa.string()), "shard": pa.array([g[0] for g in got], pa.int32()), "runs": pa.array([g[1] for g in got], pa.binary())})

    def with_texts(t: pa.Table, also: np.ndarray | None) -> pa.Table:
        got = main_texts(_blocks_of(t.column("texts"), t.column("flags")), also=also)
        return pa.table({
            "page_id": t.column("page_id"), "url": t.column("url"), "text": pa.array([g[0] for g in got], pa.string()),
            "n_tokens": pa.array([g[1] for g in got], pa.int64()), "n_covered": pa.array([g[2] for g in got], pa.int64()),
        })

    def shard_text(t: pa.Table) -> pa.Table:
        return with_texts(t, None)

    def shard_text_with(t: pa.Table, shared: pa.Table) -> pa.Table:
        runs = [unpack_sorted(x) for x in shared.column("runs").to_pylist()]
        return with_texts(t, np.concatenate(runs) if runs else None)

    result = f"page_id {key_type}, url {url_type}, text string, n_tokens long, n_covered long"
    every = parsed(p).select("page_id", "url", "host", "shard", "texts", "flags")
    open_hosts = None
    if many:
        # hosts of several shards where a block isn't marked
        dealt = parsed(p.join(hot.select("hot"), F.col("host") == F.col("hot"), "left_semi") if len(many) <= HOT_HOSTS else p).where("n_shards > 1")
        open_hosts = materialize(dealt.where(F.exists("flags", lambda f: f == 0)).select("host").distinct(), "pages-open")
    if open_hosts is None or open_hosts.isEmpty():
        out = every.groupBy("host", "shard").applyInArrow(shard_text, result)
    else:
        few = F.broadcast(open_hosts) if len(many) <= HOT_HOSTS else open_hosts
        dealt = parsed(p.join(few, "host", "left_semi") if len(many) <= HOT_HOSTS else p).where("n_shards > 1").join(few, "host", "left_semi")
        sent = dealt.select("host", "n_shards", "shard", "texts", "flags").mapInArrow(send, _SENT)
        shared = materialize(sent.groupBy("host", "bucket").applyInArrow(bucket_runs, "host string, shard int, runs binary"), "pages-runs")
        out = every.groupBy("host", "shard").cogroup(shared.groupBy("host", "shard")).applyInArrow(shard_text_with, result)
    if open_hosts is not None:
        drop_table(open_hosts)
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_tokens", "n_covered")


#: Hosts with more than one shard whose numbers may be held by the driver.
HOT_HOSTS = 10_000
