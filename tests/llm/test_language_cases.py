"""Edge cases of language ID."""

from __future__ import annotations

import numpy as np

from sitescope.llm import language


def test_many_languages():
    rng = np.random.default_rng(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    text = {f"l{k:03}": " ".join("".join(letters[i] for i in rng.integers(k % 20, k % 20 + 6, 6)) + chr(0x4E00 + k) for _ in range(40)) for k in range(70)}
    grams = {k: np.unique(language.text_grams([t])[0]) for k, t in text.items()}
    model = language.LanguageModel.build(grams)
    assert model.table.shape[0] == 2
    lang, score, cover = model.predict(list(text.values()))
    assert lang == list(text) and min(cover) > 0.9 and max(score) <= 1


def test_numbers_and_signs_are_no_letters(spark):
    rows = [(i, "der hund und die katze", "de") for i in range(5)] + [(i, "the dog and the cat", "en") for i in range(5, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df)
    odd = spark.createDataFrame([(1, "½ ² Ⅷ 12 _ -"), (2, ""), (3, None), (4, "der hund"), (5, "😀"), (4, "der hund")], "doc_id long, text string")
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(odd, model).collect()]
    assert sorted(g[:2] for g in got) == [(1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "de"), (5, "und")]
    assert all(0 <= g[2] <= 1 for g in got)
