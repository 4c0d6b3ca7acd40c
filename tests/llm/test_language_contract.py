"""Letters, samples and predictions of the language operator."""

import numpy as np

from serialspark.llm import langid

DOCS = "doc_id long, text string, lang string"


def test_numerals_are_no_letters(spark):
    model = langid.train([("en", "the words of a text"), ("de", "die Wörter eines Textes")])
    for text in ("½", "²", "Ⅷ", "①", "½ ² Ⅷ ① 12 _", None, "", "٣"):
        assert list(model.predict([text])) == [("und", 0.0)]
    assert langid.words_of("Ab½c Éß_x") == ["ab", "c", "éß", "x"]


def test_the_sample_is_bounded_and_takes_an_id_once(spark):
    rows = [(7, f"text {i}", "en") for i in range(300)] + [(i, f"a{i}", "en") for i in range(100, 160)] + [(i, "b", "de") for i in range(3)] + [(None, "x", "en"), (1, None, "en"), (2, "x", None)]
    got = langid.sample(spark.createDataFrame(rows, DOCS), per_language=20)
    assert sum(lang == "en" for lang, _ in got) == 20 and sum(lang == "de" for lang, _ in got) == 3
    assert sum(t.startswith("text") for _, t in got) <= 1
    assert langid.sample(spark.createDataFrame([], DOCS)) == []


def test_the_gradient_reaches_a_better_likelihood():
    rows = [("a", "aba abba baab " * 6), ("b", "cdc ddcc cddc " * 6), ("b", "cd dc"), ("a", "ab ba")]
    few, many = langid.train(rows, rounds=1), langid.train(rows, rounds=30)

    def loss(model):
        out = 0.0
        for lang, text in rows:
            p = langid.forward_backward(model.emissions(langid.words_of(text)), model.transition, np.array([0]), np.array([len(langid.words_of(text))]))
            out -= np.log(p[:, model.languages.index(lang)]).sum()
        return out

    assert loss(many) < loss(few)
    assert [x for _, x in many.label_words("abba ddcc")][0] == "a"


def test_ties_go_to_the_first_language():
    model = langid.Model(["de", "en"], np.zeros((langid.BUCKETS, 2), np.float32), np.ones((2, 2), np.float32))
    assert list(model.predict(["same same"])) == [("de", 0.5)]
    assert list(langid.train([]).predict(["x", None])) == [("und", 0.0)] * 2


def test_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(i, "the and of with", "en", "kept") for i in range(30)] + [(i, "der die und das", "de", "kept") for i in range(30, 60)], DOCS + ", _lang string")
    out = langid.keep_known(df, df)
    assert out.columns == df.columns and out.count() == 60
    assert langid.identify(df.limit(0), df).count() == 0 and langid.keep_known(df.limit(0), df.limit(0)).count() == 0
