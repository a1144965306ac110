import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken

from massif.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


def odd_texts(n, seed=0):
    r = random.Random(seed)
    parts = ["'s", "'", "'ll", "'re", "'t", "don't", " ", "  ", "\n", "\t", " ", " ", "é", "Ω", "٣", "½", "12", "a", "B!", "...", "''", "'sx", "🙂", "中文", "\x00", "\x1c", "\x85", "_", "'m ", " 'd"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(0, 40))) for _ in range(n)]


def test_pretokens_match_the_pattern():
    texts = odd_texts(3000) + ["", "   ", " x", "x  ", "'s", "it's", "\n\n a"]
    data, bounds, first = bpe.pretokens(pa.array(texts))
    got = [[data[bounds[i] : bounds[i + 1]].tobytes().decode() for i in range(a, b)] for a, b in zip(first[:-1], first[1:])]
    assert got == [regex.findall(P.PATTERN, t) for t in texts]


@pytest.mark.parametrize("head_words", [4_000_000, 40, 0])
def test_equals_tiktoken_and_round_trip(spark, head_words):
    texts = odd_texts(150, 1) + [None, "", "word " * 3000, "a" * 5000, "same text", "same text"]
    rows = [(i if i != 7 else None, t, "clash") for i, t in enumerate(texts)] + [(3, texts[3], "again")]
    d = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(d, PATH, head_words=head_words), PATH).collect()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks(PATH), special_tokens={})
    want = sorted(((i, np.array(enc.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, _ in rows), key=str)
    assert sorted(((x.doc_id, bytes(x.ids), bytes(x.decoded)) for x in out), key=str) == want


def test_empty_table(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(d, PATH), PATH).count() == 0
