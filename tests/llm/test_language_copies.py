"""Language filters of a language most of whose rows are copies of one text."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from sitescope.llm import language


def test_copies_do_not_thin_the_sample(spark):
    rng = random.Random(6)
    make = lambda letters: ["".join(rng.choice(letters) for _ in range(rng.randint(3, 7))) for _ in range(80)]
    vocab = {"aa": make("abcdefgh"), "zz": make("efghijkl")}
    text = lambda lang: " ".join(rng.choice(vocab[lang]) for _ in range(25))
    rows = [(text(lang), lang) for lang in vocab for _ in range(60)]
    df = spark.createDataFrame(rows, "text string, lang string")
    copies = spark.range(100_000).select(F.lit(text("zz")).alias("text"), F.lit("zz").alias("lang"))
    model = language.train(df.unionByName(copies))
    fresh = [(text(lang), lang) for lang in vocab for _ in range(100)]
    lang, _, cover = model.predict([t for t, _ in fresh])
    assert sum(a == b for a, (_, b) in zip(lang, fresh, strict=True)) >= 195
    assert min(c for c, (_, b) in zip(cover, fresh, strict=True) if b == "zz") >= 0.25
