import random

import numpy as np
import pyarrow as pa

from massif.llm import passages
from massif.llm import textkit as T


def brute_cut(text, radius):
    """(first word, number of words) of each paragraph, word by word."""
    w = T.Words(pa.array([text]), "nonspace")
    h = [int(x) for x in w.hash]
    value = [int(T.mix(np.array([(h[i] * 0x9FB21C651E98DF25 + (h[i + 1] if i + 1 < len(h) else 0)) % 2**64], np.uint64))[0]) for i in range(len(h))]
    first = [i for i in range(len(h)) if i == 0 or all(value[i] < v for v in value[max(0, i - radius) : i]) and all(value[i] <= v for v in value[i + 1 : i + radius + 1])]
    return [(a, z - a) for a, z in zip(first, [*first[1:], len(h)])]


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def brute(rows, radius, least):
    """The words (row, place) that the passages of rows hold, by comparing all paragraphs with each other."""
    paras = [(i, k, a, tuple(t.lower().split()[a : a + n])) for i, (_, t) in enumerate(rows) for k, (a, n) in enumerate(brute_cut(t or "", radius))]
    s = [shingles(p[3]) for p in paras]
    root = list(range(len(paras)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(paras)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 100 * both >= 75 * (len(s[i]) + len(s[j]) - both):
                root[find(i)] = find(j)
    held = {}
    for i, p in enumerate(paras):
        held.setdefault(find(i), set()).add(p[0])
    out, run = set(), []
    for i, p in [*enumerate(paras), (None, None)]:
        again = i is not None and len(held[find(i)]) > 1
        if run and (not again or p[0] != run[-1][0] or p[1] != run[-1][1] + 1):
            if sum(len(q[3]) for q in run) >= least:
                out |= {(q[0], q[2] + j) for q in run for j in range(len(q[3]))}
            run = []
        if again:
            run.append(p)
    return out


def words_of(rows, got):
    """The words (row, place) of the passages found; doc_ids must be unique."""
    at = {d: i for i, (d, _) in enumerate(rows)}
    out = set()
    for x in got:
        t = rows[at[x.doc_id]][1]
        a = len(t[: x.start].split())
        out |= {(at[x.doc_id], a + j) for j in range(len(t[x.start : x.end].split()))}
        assert len(t[x.start : x.end].split()) == x.words
    return out


def corpus():
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(3000)]
    make = lambda n: [r.choice(vocab) for _ in range(n)]
    shared = [make(r.randrange(40, 90)) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = [make(r.randrange(1, 80)) for _ in range(3)]
        for s in shared:
            if r.random() < 0.3:
                w = list(s)
                w[r.randrange(len(w))] = "Ünlike"
                parts.insert(r.randrange(3), w)
        rows.append((i, "".join(x + r.choice([" ", "\n", "  ", " "]) for p in parts for x in p)))
    return rows + [(100, None), (101, ""), (102, "short line\nshort line"), (103, " ".join(make(20000))), (104, "same " * 3000), (105, " ".join(shared[0]) + " é🙂"), (None, "é🙂 " + " ".join(shared[1]))]


def test_equals_brute_force(spark):
    rows = corpus()
    d = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, start int, row string")
    got = passages.repeated_passages(d).collect()
    want, found = brute(rows, passages.RADIUS, passages.LEAST_WORDS), words_of(rows, got)
    assert found <= want and len(found) >= 0.98 * len(want) > 1000
    for x in got:
        assert x.start < x.end and x.removed == ((x.cluster_doc, x.cluster_para) != (x.doc_id, x.para))
    assert passages.repeated_passages(d.limit(0)).count() == 0


def test_recall_of_passages_of_fifty_words(spark):
    """Of passages of 50 to 70 words in other texts at least 0.95 are found, and nothing else is."""
    r = random.Random(3)
    make = lambda n: [f"v{r.randrange(10**6)}" for _ in range(n)]
    rows, planted = [], {}
    for k in range(150):
        p = make(r.randrange(50, 71))
        for c in range(2):
            before = make(r.randrange(0, 200))
            words = [*before, *([x.upper() for x in p] if c else p), *make(r.randrange(0, 200))]
            planted[2 * k + c] = (len(before), len(before) + len(p))
            size = r.randrange(5, 400)
            rows.append((2 * k + c, "\n".join(" ".join(words[i : i + size]) for i in range(0, len(words), size))))
    rows += [(1000 + i, " ".join(make(300))) for i in range(100)]
    found = words_of(rows, passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    by = {}
    for i, place in found:
        # a similar paragraph may reach a few words into what is not shared
        assert planted[i][0] - 5 <= place < planted[i][1] + 5
        by[i] = by.get(i, 0) + 1
    assert len(by) >= 0.95 * len(planted)
    assert sum(by.values()) / sum(z - a for i, (a, z) in planted.items() if i in by) > 0.6


def test_a_passage_inside_single_line_documents(spark):
    r = random.Random(4)
    make = lambda n: [f"v{r.randrange(10**6)}" for _ in range(n)]
    p = make(60)
    rows = [(i, " ".join([*make(200), *p, *make(200)])) for i in range(3)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x.doc_id, x.cluster_doc, x.removed) for x in got} == {(0, 0, False), (1, 0, True), (2, 0, True)}


def test_rows_that_repeat_an_id_are_rows_of_their_own(spark):
    r = random.Random(6)
    t = " ".join(f"v{r.randrange(10**6)}" for _ in range(80))
    rows = [(2, t), (2, t), (None, t), (3, t + "\n" + t)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len([x for x in got if not x.removed]) == 1
    once = " ".join(f"u{r.randrange(10**6)}" for _ in range(80))
    assert passages.repeated_passages(spark.createDataFrame([(1, once + " " + once), (2, "other")], "doc_id long, text string")).count() == 0


def test_bands_are_tuned():
    bands, rows = passages.tuned(75)
    assert 1 - (1 - 0.75**rows) ** bands >= passages.RECALL and bands < 20
