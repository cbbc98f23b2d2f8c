"""Language identification by language-bitmask n-gram filters.

A Bloom filter is kept for every language, bit-sliced: slot ``i`` of the table
is a 64-bit word (one for each 64 languages) whose bit ``l`` belongs to the
filter of language ``l``.  One
lookup (the AND of an n-gram's slots) returns all languages that contain the
n-gram.  A text's n-grams are looked up, the bits are counted for each
language, the counts are corrected for the filters' false positive rates, and
the language with the largest corrected share decides.

Texts are lower-cased; runs of characters that aren't letters become one
space; n-grams of 3 and 4 characters include the spaces at word ends.

Training uses a bounded sample: about ``per_lang`` distinct labelled texts for
each language, chosen by hash.  Counts over the sample are summed in Spark;
only n-grams that pass ``min_count``, which is less in proportion for
languages with fewer texts than ``per_lang``, and that are not ``ratio`` times rarer
than in another language go to the driver.

Defined cases: null texts, and texts without a letter, are ``und`` with score
0; rows with a null language are not learned from; without any labelled row
all is ``und``; a text none of whose n-grams is known gets the first learned
language with score 0; columns that clash with the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitescope.llm.common import chunks, mix, without

ORDERS = (3, 4)
SLOT_BITS = 20
PER_LANG = 1200
MIN_COUNT = 4
RATIO = 0.12
UNKNOWN = "und"
CHUNK = 1 << 18
_FIELDS = ["lang_pred", "score", "coverage"]
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_is_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Whether a code point of the basic plane is a letter; above it, all are."""
    global _is_letter
    if _is_letter is None:
        _is_letter = np.fromiter((chr(i).isalpha() for i in range(0x10000)), bool, 0x10000)
    return _is_letter


def text_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts, and the number of each text."""
    joined = "\x01" + "\x01".join(t.replace("\x01", " ") for t in texts).lower() + "\x01"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint32)
    sep = cp == 1
    low = np.minimum(cp, 0xFFFF)
    space = ~_letters()[low] & (cp < 0x10000)
    # a run of spaces is one space; next to a separator it is none
    after = np.concatenate([[False], space[:-1]])
    drop = space & ~sep & (after | np.concatenate([sep[1:], [False]]))
    # the last of a run may have gone with its separator: drop what precedes it as well
    keep = ~drop
    cp, sep, space = cp[keep], sep[keep], space[keep]
    cp = np.where(space, np.uint32(32), cp)
    again = space & ~sep & np.concatenate([sep[1:], [False]])
    cp, sep = cp[~again], sep[~again]
    doc = np.cumsum(sep) - 1
    hs, ds = [], []
    wide = mix(cp.astype(np.uint64) + np.uint64(11))
    for n in ORDERS:
        if len(cp) < n:
            continue
        h = wide[: len(cp) - n + 1].copy()
        inner = np.zeros(len(h), bool)
        for k in range(1, n):
            h *= np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(29)
            h += wide[k : len(cp) - n + 1 + k]
            if k < n - 1:
                inner |= sep[k : len(cp) - n + 1 + k]
        ok = ~inner
        hs.append(h[ok])
        ds.append(doc[: len(h)][ok])  # a window that begins at a separator belongs to the text after it
    if not hs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hs), np.concatenate(ds)


def _slots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((h * m) >> np.uint64(64 - bits)).astype(np.int64) for m in _MULT]


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray
    bits: int = SLOT_BITS

    def __post_init__(self) -> None:
        self.rates = self.false_positive_rates()

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], bits: int = SLOT_BITS) -> LanguageModel:
        langs = sorted(grams)
        table = np.zeros((-(-len(langs) // 64), 1 << bits), np.uint64)
        for k, lang in enumerate(langs):
            for s in _slots(grams[lang], bits):
                table[k // 64, s] |= np.uint64(1 << k % 64)
        return cls(langs, table, bits)

    def false_positive_rates(self) -> np.ndarray:
        fill = [float(((self.table[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean()) for k in range(len(self.langs))]
        return np.array(fill) ** len(_MULT)

    def masks(self, h: np.ndarray) -> np.ndarray:
        """The languages that contain each n-gram, as bitmasks; in rows of 64
        languages where there are more."""
        first, *more = _slots(h, self.bits)
        out = self.table[:, first]
        for s in more:
            out &= self.table[:, s]
        return out[0] if len(out) == 1 else out

    def shares(self, texts: list[str]) -> np.ndarray:
        """Share of each text's n-grams that each language contains, corrected."""
        h, doc = text_grams(texts)
        m = np.atleast_2d(self.masks(h))
        n = np.bincount(doc, minlength=len(texts)).astype(float)[: len(texts)]
        fp = self.rates
        out = np.zeros((len(texts), len(self.langs)))
        for k in range(len(self.langs)):
            hit = np.bincount(doc[(m[k // 64] >> np.uint64(k % 64)) & np.uint64(1) == 1], minlength=len(texts))[: len(texts)]
            out[:, k] = np.clip((hit / np.maximum(n, 1) - fp[k]) / (1 - fp[k]), 0, 1)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (its part of all corrected shares) and coverage."""
        real = [i for i, t in enumerate(texts) if t and self.langs and any(map(str.isalpha, t))]
        lang, score, cover = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        if real:
            s = self.shares([texts[i] for i in real])
            best, total = s.argmax(1), s.sum(1)
            top = s[np.arange(len(s)), best]
            score[real], cover[real] = np.divide(top, total, out=np.zeros(len(s)), where=total > 0), top
            for i, b in zip(real, best, strict=True):
                lang[i] = self.langs[b]
        return lang, score, cover


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", per_lang: int = PER_LANG,
          min_count: int = MIN_COUNT, ratio: float = RATIO, bits: int = SLOT_BITS) -> LanguageModel:
    """Fit the filters on about ``per_lang`` distinct texts of each language."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    # distinct texts: copies must not thin out the sample
    n_texts = F.approx_count_distinct(F.xxhash64("text"), 0.02)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(n_texts.alias("n")).collect()}
    if not sizes:
        return LanguageModel([], np.zeros((0, 1 << bits), np.uint64), bits)
    # chosen by the text's hash: all copies of a text or none, and then one of them
    unit = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    limit, least = F.lit(0.0), F.lit(min_count)
    for name, n in sizes.items():
        limit = F.when(F.col("lang") == name, F.lit(per_lang / n)).otherwise(limit)
        # a smaller sample asks for less
        least = F.when(F.col("lang") == name, F.lit(max(1, round(min_count * min(1.0, n / per_lang))))).otherwise(least)
    sample = rows.where(unit < limit).groupBy("lang", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for c in chunks([b], "text", CHUNK):
                names = np.asarray(c.column(c.schema.get_field_index("lang")).to_pylist())
                texts = c.column(c.schema.get_field_index("text")).to_pylist()
                for name in sorted(set(names.tolist())):
                    h, _ = text_grams([texts[i] for i in np.flatnonzero(names == name)])
                    u, n = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(u), pa.string()), pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))],
                        names=["lang", "gram", "n"],
                    )

    grams = sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = grams.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    grams = grams.withColumn("most", F.max("rate").over(Window.partitionBy("gram")))
    kept = grams.where((F.col("n") >= least) & (F.col("rate") >= F.col("most") * ratio)).select("lang", "gram").toPandas()
    return LanguageModel.build(
        {name: kept["gram"].to_numpy()[(kept["lang"] == name).to_numpy()].astype(np.int64).view(np.uint64) for name in sizes}, bits
    )


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred string, score double and coverage double added.
    Only the text goes through Python."""
    docs = without(docs, ["lang_pred", "score", "coverage"])
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.table, model.bits))

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = LanguageModel(*shared.value)
        for column in columns:
            parts = [pa.StructArray.from_arrays([pa.array([], pa.string()), pa.array([], pa.float64()), pa.array([], pa.float64())], _FIELDS)]
            for c in chunks([pa.RecordBatch.from_arrays([column], ["text"])], "text", CHUNK):
                lang, score, cover = m.predict(c.column(0).to_pylist())
                parts.append(pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(cover)], _FIELDS))
            yield pa.concat_arrays(parts)

    guess = F.arrow_udf(run, "lang_pred string, score double, coverage double")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return docs.select(*columns, guess(F.col(f"`{text}`")).alias("_guess")).select(*columns, *[F.col(f"_guess.{c}") for c in _FIELDS])
