import itertools
import unicodedata

import numpy as np
import pyarrow as pa

from massif.llm import language as L

EN = "the cat and the dog are in the house with the child who was reading this book"
DE = "der hund und die katze sind nicht mit dem kind das ein buch gelesen hat über straße"


def test_forward_backward_equals_enumeration():
    m = L.Model(["a", "b", "c"])
    r = np.random.default_rng(0)
    m.trans = r.normal(size=(3, 3)).astype(np.float32)
    n = np.array([3, 1, 5])
    s = r.normal(size=(9, 3)).astype(np.float32)
    got, at = m.marginals(s, n), 0
    for k in n:
        want = np.zeros((k, 3))
        for path in itertools.product(range(3), repeat=int(k)):
            x = np.exp(sum(s[at + t, y] for t, y in enumerate(path)) + sum(m.trans[a, b] for a, b in itertools.pairwise(path)))
            for t, y in enumerate(path):
                want[t, y] += x
        np.testing.assert_allclose(got[at : at + k], want / want.sum(axis=1, keepdims=True), atol=1e-4)
        at += k


def test_code_switched_words_and_edges(spark):
    m = L.fit([(EN, "en"), (DE, "de")] * 20)
    w, p = L.label_words(m, pa.array([EN + " " + DE]))
    best = p.argmax(axis=1)
    assert [m.langs[i] for i in best[:10]] == ["en"] * 10 and [m.langs[i] for i in best[-10:]] == ["de"] * 10
    rows = [(1, EN, "x"), (2, DE, "x"), (3, None, "x"), (4, "", None), (5, "12 345 -- ¿ …", "x"), (None, EN, "x"), (1, EN, "x"), (6, DE * 2000, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, score string")
    out = sorted(((x.doc_id, x.lang_pred) for x in L.identify(d, m).collect()), key=str)
    assert out == sorted([(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (None, "en"), (1, "en"), (6, "de")], key=str)
    assert L.identify(d.limit(0), m).count() == 0


def test_nothing_to_learn(spark):
    d = spark.createDataFrame([(1, EN, None)], "doc_id long, text string, lang string")
    out = L.identify(d, L.trained(d)).collect()
    assert [(x.lang_pred, x.score) for x in out] == [("und", 0.0)]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = L.identify(docs.where("length(text) > 100"), L.trained(docs), keep=["lang"]).where(L.fold() == 2).toPandas()
    assert len(out) > 100 and (out.lang == out.lang_pred).mean() > 0.97


def test_decomposed_text_is_read_as_composed():
    m = L.fit([(EN, "en"), (DE, "de")] * 20)
    text = "über die straße hört es jäh auf für könige"
    both = [L.label_words(m, pa.array([unicodedata.normalize(form, text)]))[1] for form in ("NFC", "NFD")]
    np.testing.assert_array_equal(*both)


def test_the_sample_is_bounded_whatever_the_ids(spark):
    rows = [(1, f"{EN} number {i}", "en") for i in range(300)] + [(1, DE, "de")] * 300 + [(None, EN, "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = L.sample(d, "text", "lang", d.doc_id, 20)
    assert sum(x == "en" for _, x in got) == 20 and sum(x == "de" for _, x in got) == 1


def test_rows_without_an_id_are_held_out(spark, tmp_path):
    rows = [(None, EN, "en"), (1, EN, "en"), (2, DE, "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {x.doc_id: x.held_out for x in L.op3_language(spark, str(tmp_path)).collect()}[None]


def test_chunks_change_nothing(monkeypatch):
    m = L.Model(["a", "b", "c"])
    r = np.random.default_rng(5)
    m.trans = r.normal(size=(3, 3)).astype(np.float32)
    n = np.array([0, 3, 700, 32, 33, 64, 1, 0, 2000])
    s = r.normal(size=(n.sum(), 3)).astype(np.float32)
    got = m.marginals(s, n)
    monkeypatch.setattr(L, "CHUNK", 10_000)
    np.testing.assert_allclose(got, m.marginals(s, n), atol=1e-4)
