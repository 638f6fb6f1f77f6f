"""op3 reads whole words and whole texts without spaces."""

import numpy as np
import pytest
from brindle.llm import language

PAIRS = [("the cat sat on the mat with another dog", "en"), ("der hund saß auf der matte mit einem vogel", "de")] * 10


def test_all_letters_count():
    assert language.word_features("abcdefghijklmnopqrst", {}) != language.word_features("abcdefghijklXnopqrst", {})
    a, b = (set(language.word_features(w, {})) for w in ("abcdefghijklmnopqrst", "abcdefghijklmnopqrstu"))
    assert len(a & b) >= 20  # trigrams: 20 of the shorter one, all but its last in the longer one, and prefixes
    assert language.pieces("ab " + "x" * 50) == ["ab", "x" * 24, "x" * 24, "xx"] and language.pieces(None) == []


def test_features_of_many_words_are_those_of_each():
    words = ["a", "ab", "abc", "straße", "İ".lower() * 24, "x" * 24, "é", "abcd"]
    fixed, grams, starts = language.features(words, {"abc": 1})
    for i, w in enumerate(words):
        end = starts[i + 1] if i + 1 < len(words) else len(grams)
        assert [*fixed[i], *grams[starts[i] : end]] == language.word_features(w, {"abc": 1}) and end - starts[i] == len(w)
    assert (fixed[:, 1] > 0).tolist() == [w == "abc" for w in words] and fixed[:, [0, 2, 3, 4, 5, 6, 7]].min() > 0


def test_text_without_spaces_is_labelled_whole():
    model = language.fit(PAIRS)
    text = "derhundsaß" + "thecatsatonthemat" * 200 + "vogel"
    rows, lengths = language.Emissions(model).of([text])
    assert lengths[0] == -(-len(text) // 24)
    post = language.posteriors(rows, lengths, model.trans, model.start)
    assert model.languages[int(np.argmax(post[0]))] == "en"


def test_no_language_is_dropped(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"text {i}", f"l{i % 3}") for i in range(60)], "doc_id long, text string, lang string")
    assert {y for _, y in language.sampled(df)} == {"l0", "l1", "l2"}
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError, match="more than 2"):
        language.sampled(df)
