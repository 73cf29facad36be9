import zlib

import numpy as np
import pytest

from stockroom.llm import language_id as L
from stockroom.llm.queries import op5_language_id
from texts import MEDIUM, docs_frame, table_rows


def test_held_out_accuracy_on_the_table(spark):
    rows = {i: (lang, text) for i, lang, text in table_rows(MEDIUM, "doc_id, lang, text")}
    got = op5_language_id(spark, MEDIUM).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    held = [r for r in got if r.held_out and rows[r.doc_id][0]]
    right = sum(r.lang_pred == rows[r.doc_id][0] for r in held)
    assert right / len(held) > 0.97


def grams(text):
    t = " " + "".join(c.lower() if c.isalpha() else " " for c in text) + " "
    return {t[i:i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}


def test_kernel_equals_its_definition():
    texts = ["The cat, the hat!", "Das Haus ist groß", "été à Paris 123", "x"]
    sets = [L.ngrams(t) for t in texts]
    assert [len(s) for s in sets] == [len(grams(t)) for t in texts]
    model = L.solve(sets, ["a", "b", "c", "a"])
    want = [[len(grams(x) & grams(y)) / np.sqrt(len(grams(x)) * len(grams(y))) for y in texts] for x in texts]
    assert np.allclose(model.kernel(sets), want, atol=1e-6)


def test_the_model_is_the_ridge_solution():
    """With every sample a landmark, predictions are those of exact kernel ridge regression."""
    texts = [a + " " + b for a in ("uno dos", "one two", "eins zwei") for b in ("abc", "xyz", "klm")]
    labels = [x for x in ("es", "en", "de") for _ in range(3)]
    sets = [L.ngrams(t) for t in texts]
    model = L.solve(sets, labels)
    k = model.kernel(sets).astype(float)
    y = np.where(np.array(labels)[:, None] == np.array(model.langs), 1.0, -1.0)
    exact = k @ np.linalg.solve(k + L.RIDGE * len(sets) * np.eye(len(sets)), y)
    assert np.allclose(k @ model.weights, exact, atol=1e-2)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "123 ... \n"), (None, "hello"), (4, "é"), (5, "word " * 50_000), (5, "word")]
    docs = docs_frame(spark, rows)
    model = L.fit(docs)
    got = [(r.doc_id, r.lang_pred) for r in L.predict(docs, model).collect()]
    assert [x for _, x in got] == ["und", "und", "und", "en", "en", "en", "en"]
    nothing = L.fit(docs.where("false"))
    assert {r.lang_pred for r in L.predict(docs, nothing).collect()} == {"und"}
    assert L.predict(docs_frame(spark, []), model).count() == 0
    assert L.predict(docs, model).columns == docs.columns + ["lang_pred", "score"]


def test_no_label_is_left_out(spark):
    words = {"aa": "bada gada", "bb": "weli meli", "cc": "koro toro", "dd": "ziku riku"}
    rows = [(100 * i + j, f"{words[lang]} {j}", lang) for i, lang in enumerate(words) for j in range(12 - i)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(df, per_lang=10, max_langs=2)
    assert model.langs == sorted(words)
    assert model.predict(list(words.values()))[0] == list(words)
    with pytest.raises(ValueError):
        L.fit(df, per_lang=1, max_langs=3)


def test_equal_scores_go_to_the_first_language_in_order():
    sets = [L.ngrams(t) for t in ("same words here", "same words here", "other")]
    model = L.solve(sets, ["zz", "mm", "nn"])
    value = model.kernel(sets[:1]) @ model.weights
    assert abs(value[0][model.langs.index("mm")] - value[0][model.langs.index("zz")]) < 1e-6
    model.weights[:, model.langs.index("zz")] = model.weights[:, model.langs.index("mm")]
    assert model.predict(["same words here"])[0] == ["mm"]


def test_the_landmark_matrix_is_bounded_in_bytes(monkeypatch):
    texts = [f"{a}{b} {b}{a}{c}" for a in "abcdef" for b in "ghijkl" for c in "xyz"]
    sets, labels = [L.ngrams(t) for t in texts], [t[0] for t in texts]
    assert len(L.landmarks_of(sets, labels, 5)) == 30
    for most in (1, 400, 3000, 6000):
        monkeypatch.setattr(L, "LANDMARK_BYTES", most)
        model = L.solve(sets, labels, 5)
        n = model.landmarks.shape[1]
        assert model.langs == list("abcdef") and (model.landmarks.nbytes <= most or n == 1)
        bigger = L.landmarks_of(sets, labels, 5)
        assert len(bigger) == n
