import re

import numpy as np
import public_tokenizers as P
import tiktoken
from test_decontaminate import brute as leaks
from test_jaccard import brute as groups

import corpus_pipeline as C
from massif.llm import bpe, language, shared

DIR = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = shared.documents(spark, DIR)
    done = []
    for k, (_, stage) in enumerate(C.STAGES):
        docs = shared.stored(stage(spark, docs, DIR), f"test-{k}")
        done.append({r["doc_id"]: r for r in docs.collect()})
        if k < len(C.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    raw = {r["doc_id"]: r for r in shared.documents(spark, DIR).collect()}
    assert all(any(c.isalpha() for c in raw[i].text) for i in done[0]) and len(done[0]) > 0.95 * len(raw)
    least = {i: c for i, _, c in groups([(i, r.text) for i, r in done[0].items()])}
    assert set(done[1]) == set(least.values())
    items = [(r.item_id, r.text) for r in shared.table(spark, DIR, "benchmark").collect()]
    assert set(done[2]) == {i for i, r in done[1].items() if not leaks(r.text, items)[1]}
    assert set(done[3]) == set(done[2]) and not any(re.search(r"[\w.]+@[\w-]+\.\w", r.text) for r in done[3].values())
    same = [i for i in done[3] if done[3][i].text == done[2][i].text]
    assert len(same) > 0.5 * len(done[3])
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert {i: bytes(r.ids) for i, r in done[4].items()} == {i: np.array(enc.encode_ordinary(r.text), "<u4").tobytes() for i, r in done[3].items()}


def test_language_rejects_what_has_no_letter(spark):
    d = spark.createDataFrame([(1, "12 34 !!", None, "s", 8), (2, "the house and the tree", "en", "s", 22), (3, None, "en", "s", 0), (4, "le chat et la maison", "fr", "s", 20)], "doc_id long, text string, lang string, source string, n_chars long")
    assert language.UNKNOWN == "und"
    assert {r.doc_id for r in C.language_id(spark, d, DIR).collect()} <= {2, 4}


def test_rows_without_or_with_repeated_ids(spark):
    text = " ".join(f"word{i} of it" for i in range(30))
    other = " ".join(f"thing{i} of it" for i in range(30))
    item = shared.table(spark, DIR, "benchmark").where("length(text) > 200").first().text
    rows = [(None, text), (3, text), (2, text), (2, text), (2, other), (2, other), (None, item), (None, ""), (None, ""), (5, None), (6, "unlike all the others that there are here")]
    d = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _key string").drop("_key")
    got = C.near_duplicates(spark, d, DIR)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(2, text), (2, other), (None, item), (None, ""), (5, None), rows[-1]], key=str)
    assert got.columns == d.columns and C.near_duplicates(spark, d.limit(0), DIR).count() == 0
    clean = [(r.doc_id, r.text) for r in C.benchmark_free(spark, d, DIR).collect()]
    assert (None, item) not in clean and len(clean) == len(rows) - 1


def test_an_empty_table(spark):
    docs = shared.documents(spark, DIR).limit(0)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, DIR)
    assert docs.count() == 0 and "ids" in docs.columns
