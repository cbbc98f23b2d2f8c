"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line is the set of its distinct words, each a 57-bit hash.  Lines with equal sets are one class.  Words are ordered by rarity: a
table of ``2**BUCKET_BITS`` counts, of fixed size whatever the corpus, gives
the level, and the hash decides within a level.  Two sets of Jaccard
similarity ``num / den`` or more share a word of their prefixes, the first
``n - ceil(n * num / den) + 1`` words; a word that no other line has is in no
prefix.  A frequent word is no key of its own: lines whose first shared word
is frequent share two words of prefixes that are one word longer, and both
together are the key.  Candidates pass a length, a positional and a bitmap
filter (of parities, in which common words cancel out) and are verified on
their whole sets.

The place of a class is its first line, by document id, then text, then line.
A line is removed unless it is at the place of its class, and also there if
it matches any line with an earlier place.  As only that is asked for, the
lines of a key that many have are first compared with the earliest of them
alone; lines that are thereby removed need no other partner, which leaves few
for the join of open lines with all earlier ones.

Defined cases: lines without a word match nothing; a null text stays null; a
document keeps its text to the letter unless a line of it is removed, and
then its other lines with words are joined by \\n (empty if none is left);
rows with equal ids and different texts are ordered by a hash of the text;
rows with equal ids and texts are handled alike; null ids come first; an
empty table gives an empty result; other columns are carried, and those that
clash with ``n_lines`` or ``n_removed`` are replaced.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitescope.llm.common import drop_table, materialize, without

NUM, DEN = 80, 100
#: Bits of a word's hash, below the rarity level.
HASH_BITS = 57
#: Levels of rarity for each doubling of a word's count: the fewer, the more
#: frequent words get into prefixes before rarer ones of the same level, and
#: their lists grow with the corpus.
LEVELS = 1.6
#: Lines with more words have a second bitmap.
ONE_BITMAP = 48
#: The counts are a square table: half of the bits are the row.
BUCKET_BITS = 20
#: A word is frequent from this count on, or this many times the mean count.
HOT_COUNT, HOT_MEANS = 4096, 8
#: Lines of a key that are all compared with each other at once.
FEW_LINES = 64
#: Keys are taken in so many parts, one after another, as their exchange takes
#: more disk than anything else.
PASSES = 3
#: Most rows of one number that are broadcast; more are joined by exchange.
BROADCAST_ROWS = 500_000
#: Null ids come before all others.
NO_ID = -(1 << 63)


def _has_word(line):
    return line.rlike(r"[^\x20\x09-\x0D]")


def _lines(text):
    """Distinct lines, in order."""
    return F.array_distinct(F.split(text, "\n"))


def _level(count: Column) -> Column:
    """0 for a word seen once; else 1 to 63."""
    return F.when(count <= 1, 0).otherwise(F.least(F.lit(63), 1 + F.floor(LEVELS * F.log2(count)))).cast("long")


def _place(doc: str | Column, text) -> list[Column]:
    doc = F.col(doc) if isinstance(doc, str) else doc
    return [F.coalesce(doc.cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("th")]


def _words(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(uid, doc, th, no, n, f1, f2, tokens) of each document's distinct
    lines; equal n, f1 and f2 are an equal set.  Lines without a word have
    n = 0."""
    t = F.col(f"`{text}`")
    other = r"[\t\x0b\f\r]"
    plain = ~(t.contains("\t") | t.contains("\x0b") | t.contains("\f") | t.contains("\r"))
    # lines are told apart as they stand, and split at any space
    spaced = F.when(plain, _lines(t)).otherwise(F.transform(_lines(t), lambda x: F.regexp_replace(x, other, " ")))
    rows = docs.where(t.isNotNull()).select(*_place(F.col(f"`{key}`"), t), F.posexplode(spaced).alias("no", "line"))
    mask = F.lit((1 << HASH_BITS) - 1)
    hashes = F.transform(F.split("line", " "), lambda w: F.xxhash64(w).bitwiseAND(mask))
    none = F.xxhash64(F.lit("")).bitwiseAND(mask)
    rows = rows.select("doc", "th", "no", F.sort_array(F.array_remove(F.array_distinct(hashes), none)).alias("tokens"))
    return rows.select(
        F.monotonically_increasing_id().alias("uid"), "doc", "th", "no", F.size("tokens").alias("n"),
        F.xxhash64(F.lit(1), "tokens").alias("f1"), F.xxhash64(F.lit(2), "tokens").alias("f2"), "tokens",
    )


def _rarity(words: DataFrame) -> tuple[DataFrame, int]:
    """The levels of all buckets, each above a word's hash, as rows (hi,
    levels), and the first level that is frequent."""
    spark = words.sparkSession
    half = BUCKET_BITS // 2
    bucket = F.col("t").bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)).cast("int").alias("b")
    counts = words.select(F.explode("tokens").alias("t")).groupBy(bucket).agg(F.count("*").alias("n"))
    every = spark.range(1 << BUCKET_BITS).select(F.col("id").cast("int").alias("b"), F.lit(0).cast("long").alias("n"))
    counts = counts.unionByName(every).groupBy("b").agg(F.sum("n").alias("n"))
    entry = F.struct(F.col("b").bitwiseAND((1 << half) - 1).alias("lo"), F.shiftleft(_level(F.col("n")), HASH_BITS).alias("level"))
    rows = counts.groupBy(F.shiftright("b", half).alias("hi")).agg(
        F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["level"]).alias("levels"), F.sum("n").alias("n")
    )
    rows = materialize(rows, "lines-rarity")
    total = rows.agg(F.sum("n")).first()[0] or 0
    hot = max(HOT_COUNT, HOT_MEANS * total / (1 << BUCKET_BITS))
    return rows, min(63, 1 + math.floor(LEVELS * math.log2(hot)))


def _parities() -> tuple[Column, Column]:
    """The parities of 64 buckets of all words, and of those above the middle
    of all hashes.  Sets differ in as many words at least as their parities in
    bits: words that both have cancel out, so that long lines tell apart too."""

    def parity(bit) -> Column:
        return F.aggregate("tokens", F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(F.call_function("shiftleft", bit(x), x.bitwiseAND(F.lit(63)).cast("int"))))
    return parity(lambda x: F.lit(1).cast("long")), parity(lambda x: (x >= F.lit(1 << (HASH_BITS - 1))).cast("long"))


def _halves() -> tuple[Column, Column]:
    """The parities of the words below the middle, and of those above."""
    every, upper = _parities()
    return every.bitwiseXOR(upper), upper


def _bitmaps() -> tuple[Column, Column]:
    """The parities of all words, and for long lines those above the middle."""
    every, upper = _parities()
    return every, F.when(F.col("n") > ONE_BITMAP, upper)


def _differ(a: str, b: str) -> Column:
    """Bits in which the bitmaps of two lines differ; both halves count where
    both lines are long."""
    every, upper = (F.col(f"{a}{w}").bitwiseXOR(F.col(f"{b}{w}")) for w in ("w0", "w1"))
    return F.coalesce(F.bit_count(upper) + F.bit_count(every.bitwiseXOR(upper)), F.bit_count(every))


def _need(n: str, num: int, den: int) -> Column:
    """Words that a set of ``n`` shares with any match."""
    return F.ceil(F.col(n) * num / F.lit(den)).cast("int")


def _prefixes(words: DataFrame, rarity: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """(rank, n, free, pre, w0, w1) of one line of each class that may match
    another: its first words by rarity, then hash, one more than its prefix."""
    table = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("hi", "levels"))), lambda x: x["levels"]))
    rows = words.withColumn("table", rarity.agg(table.alias("t")).scalar())
    mask = F.lit((1 << BUCKET_BITS) - 1)
    by_rarity = F.transform("tokens", lambda x: x.bitwiseOR(F.get("table", x.bitwiseAND(mask).cast("int"))))
    # lines this short match equal sets only
    rows = rows.where(F.col("n") * den >= (F.col("n") + 1) * num)
    rows = rows.select("uid", "n", "tokens", F.sort_array(by_rarity).alias("toks"))
    free = F.col("n") - _need("n", num, den)
    w0, w1 = _bitmaps()
    rows = rows.select("uid", "n", free.alias("free"), F.slice("toks", F.lit(1), free + 2).alias("pre"), w0.alias("w0"), w1.alias("w1"))
    return rows.join(classes.select("uid", "rank"), "uid").select("rank", "n", "free", "pre", "w0", "w1")


def _keys(prefixes: DataFrame, hot: int, part: int = 0, parts: int = 1) -> DataFrame:
    """(token, pos, rank, n, w0, w1): the keys of each prefix, or the part of
    them that begins with some of the words."""
    seen, hot_key = F.lit(1 << HASH_BITS), F.lit(hot << HASH_BITS)
    at = prefixes.select("rank", "n", "free", "pre", "w0", "w1", F.posexplode("pre").alias("pos", "t"))
    at = at.where((F.col("t") >= seen) & ((F.col("t") >= hot_key) | (F.col("pos") <= F.col("free"))) & (F.pmod("t", F.lit(parts)) == part))
    # a frequent word goes with each word after it, which is as frequent
    after = F.slice("pre", F.col("pos") + 2, F.size("pre"))
    at = at.withColumn("u", F.explode(F.when(F.col("t") < hot_key, F.array(F.lit(None).cast("long"))).otherwise(after)))
    # the hash of a word and null is that of the word
    return at.select(F.hash("t", "u").alias("token"), "rank", "n", "pos", "w0", "w1")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", num: int = NUM, den: int = DEN) -> DataFrame:
    """``docs`` with matching later lines removed from the text, and the
    columns n_lines (distinct lines with a word) and n_removed.  ``num / den``
    is 3/5 at least."""
    if num * 5 < den * 3:
        raise ValueError("similarity must be 3/5 at least")
    docs = without(docs, ["n_lines", "n_removed"])
    words = materialize(_words(docs, key, text), "lines-words")
    # one row per class, numbered in the order of places
    classes = words.where("n > 0").groupBy("n", "f1", "f2").agg(F.min(F.struct("doc", "th", "no", "uid")).alias("p")).select("p.*")
    classes = classes.orderBy("doc", "th", "no", "uid").select("doc", "th", "no", "uid", F.monotonically_increasing_id().alias("rank"))
    classes = materialize(classes, "lines-classes")
    rarity, hot = _rarity(words)
    prefixes = materialize(_prefixes(words, rarity, classes, num, den), "lines-prefixes")
    drop_table(rarity)

    def may_match(a: str, b: str):
        """Length, positional and bitmap filters for two rows of a key."""
        na, nb, pa, pb = (F.col(f"{x}{c}") for c in ("n", "pos") for x in (a, b))
        n = na + nb
        # words from the shared one on, and those before it, bound the overlap
        position = F.least(na - pa, nb - pb) + F.least(pa, pb)
        return (F.greatest(na, nb) * num <= F.least(na, nb) * den) & (position * (num + den) >= n * num) & (_differ(a, b) * (num + den) <= n * (den - num))

    cols = ("rank", "n", "pos", "w0", "w1")
    of = Window.partitionBy("token")

    def pairs_or_lines(part: int) -> DataFrame:
        """Pairs (a, rank) that may match; the lines of keys that many have
        come with their key, as pairs with the earliest one."""
        # the join asks for these anyway; as all plans do, they share one exchange
        keys = _keys(prefixes, hot, part, PASSES).where("rank IS NOT NULL AND n IS NOT NULL").repartition("token")
        lines = keys.withColumn("k", F.count("*").over(of)).where("k > 1")
        # all pairs of a few lines
        a, b = (x.select("token", *[F.col(c).alias(f"{n}_{c}") for c in cols]) for x, n in ((keys, "a"), (lines.where(F.col("k") <= FEW_LINES), "b")))
        pairs = b.join(a, "token").where((F.col("a_rank") < F.col("b_rank")) & may_match("a_", "b_"))
        pairs = pairs.select(F.col("a_rank").alias("a"), F.col("b_rank").alias("rank"))
        # many: each line and the earliest one
        lines = lines.where(F.col("k") > FEW_LINES).withColumn("e", F.min(F.struct(*cols)).over(of)).select("token", *cols, *[F.col(f"e.{c}").alias(f"e_{c}") for c in cols])
        star = F.when((F.col("e_rank") < F.col("rank")) & may_match("", "e_"), F.col("e_rank"))
        return lines.select("token", star.alias("a"), *cols).unionByName(pairs, allowMissingColumns=True)

    passes = [materialize(pairs_or_lines(p), "lines-rows") for p in range(PASSES)]
    drop_table(prefixes)
    rows = functools.reduce(DataFrame.unionByName, passes)

    def small(ranks: DataFrame) -> DataFrame:
        return F.broadcast(ranks) if ranks.count() <= BROADCAST_ROWS else ranks

    def matching(pairs: DataFrame) -> DataFrame:
        """The later lines ``b`` of pairs that do match."""
        asked = materialize(classes.select("rank", "uid").join(pairs.select(F.explode(F.array("a", "b")).alias("rank")).distinct(), "rank"), "lines-asked")
        sets = materialize(words.select("uid", "tokens").join(small(asked), "uid").select("rank", "tokens"), "lines-sets")
        a = sets.select(F.col("rank").alias("a"), F.col("tokens").alias("sa"))
        b = sets.select(F.col("rank").alias("b"), F.col("tokens").alias("sb"))
        common = F.size(F.array_intersect("sa", "sb"))
        out = pairs.join(a, "a").join(b, "b").where(common * (num + den) >= (F.size("sa") + F.size("sb")) * num).select(F.col("b").alias("rank")).distinct()
        out = materialize(out, "lines-gone")
        drop_table(asked)
        drop_table(sets)
        return out

    def verified(pairs: DataFrame) -> DataFrame:
        """:func:`matching`, first for the pair of each line with the most
        keys, then for all pairs of the lines that are left."""
        pairs = materialize(pairs.groupBy("a", "b").agg(F.count("*").alias("c")), "lines-pairs")
        best = materialize(pairs.groupBy("b").agg(F.max(F.struct("c", (-F.col("a")).alias("a"))).alias("m")).select((-F.col("m.a")).alias("a"), "b"), "lines-best")
        gone = matching(best)
        rest = materialize(pairs.select("a", "b").join(small(gone.withColumnRenamed("rank", "b")), "b", "left_anti"), "lines-rest")
        gone = gone.unionByName(matching(rest))
        for t in (pairs, best, rest):
            drop_table(t)
        return gone

    # pairs of short lists, and each line of a long one with its earliest
    gone = verified(rows.where("a IS NOT NULL").select("a", F.col("rank").alias("b")))
    # lines of long lists that are still open, against all earlier ones
    def open_pairs(part: DataFrame) -> DataFrame:
        more = part.where("token IS NOT NULL")
        earlier = more.select("token", *[F.col(c).alias(f"a_{c}") for c in cols])
        later = more.join(small(gone), "rank", "left_anti").select("token", *[F.col(c).alias(f"b_{c}") for c in cols])
        pairs = later.join(earlier, "token").where((F.col("a_rank") < F.col("b_rank")) & may_match("a_", "b_"))
        return pairs.select(F.col("a_rank").alias("a"), F.col("b_rank").alias("b"))

    found = [materialize(open_pairs(p), "lines-open") for p in passes]
    gone = gone.unionByName(verified(functools.reduce(DataFrame.unionByName, found)))

    stay = classes.join(gone, "rank", "left_anti").groupBy("doc", "th").agg(F.sort_array(F.collect_list("no")).alias("stay"))
    stay = materialize(stay, "lines-stay")
    for t in (words, classes, *passes, *found):
        drop_table(t)
    t = F.col(f"d.`{text}`")
    body = docs.select(*_place(F.col(f"`{key}`"), F.col(f"`{text}`")), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    out = body.join(stay, ["doc", "th"], "left").withColumn("stay", F.coalesce("stay", F.array().cast("array<int>")))
    out = out.withColumn("n_lines", F.coalesce(F.size(F.filter(_lines(t), _has_word)), F.lit(0)))
    whole = t.isNull() | ((F.size("stay") == F.col("n_lines")) & (F.size(F.filter(F.split(t, "\n"), _has_word)) == F.col("n_lines")))
    out = out.withColumn("all", _lines(t))
    left = F.array_join(F.transform("stay", lambda i: F.get("all", i)), "\n")
    new_text = F.when(whole, t).otherwise(left)
    cols_out = [new_text.alias(text) if c == text else F.col(f"d.`{c}`").alias(c) for c in docs.columns]
    return out.select(*cols_out, "n_lines", (F.col("n_lines") - F.size("stay")).alias("n_removed"))
