"""Every language is learned, and scores are calibrated at every size."""

import random

from tidemark.llm import langid


def test_all_languages_are_learned(spark):
    draw, rows = random.Random(0), []
    pairs = [a + b for a in "bcdfghjkl" for b in "aeiouyxz"][:70]
    for k, syllable in enumerate(pairs):
        # The last languages are the rarest; the last two have no doc_id.
        for n in range(14 if k < 64 else 6):
            text = " ".join(syllable * draw.randint(1, 3) for _ in range(20))
            rows.append((None if k >= 68 else 100 * k + n, text, f"l{k:02}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.languages == [f"l{k:02}" for k in range(70)]
    assert [model.predict(" ".join([s * 2] * 10))[0] for s in pairs] == model.languages


def test_small_tables_are_calibrated(spark):
    one, two = "the cat sat on the mat and looked at dog".split(), "le chat est sur la table avec un chien".split()
    draw = random.Random(1)
    docs = [(k, " ".join(draw.choice(one if k % 2 else two) for _ in range(8)), "en" if k % 2 else "fr") for k in range(40)]
    model = langid.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert model.temperature != 1.0
    assert {model.predict(text)[0] == lang for _, text, lang in docs} == {True}
    # One row of each language tells nothing of a temperature.
    assert langid.train(spark.createDataFrame([(1, "abc", "x"), (4, "def", "y")], "doc_id long, text string, lang string")).temperature == 1.0
