import random
import re

from massif.llm.decontaminate import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(len(v), 10)
        for i in range(len(v) - n + 1) if n else []:
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[i : i + n]:
                    hit |= set(range(p, p + n))
                    found.add(item)
    return len(w), len(hit), sorted(found)


def test_equals_brute_force(spark):
    r = random.Random(3)
    vocab = ["a", "B", "c7", "é", "Öl", "x", "yy"]
    make = lambda n: " ".join(r.choice(vocab) + r.choice(["", ",", "\n"]) for _ in range(n))
    items = [(i, make(n)) for i, n in enumerate([0, *range(1, 12), 30])] + [(50, None), (None, "a b c")]
    docs = [(i, make(r.choice([0, 1, 5, 40, 300]))) for i in range(40)]
    docs += [(100, None), (101, ""), (None, items[3][1]), (102, "pre " + (items[5][1] or "") + " post"), (102, "pre " + (items[5][1] or "") + " post"), (103, " ".join(["a"] * 5000))]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, size string")
    b = spark.createDataFrame([(t, i) for i, t in items], "text string, item_id long")
    got = sorted(((x.doc_id, x.n_words, x.n_hit, x["items"]) for x in decontaminate(d, b).collect()), key=str)
    usable = [(i, t) for i, t in items if i is not None]
    assert got == sorted(((i, *brute(t, usable)) for i, t in docs), key=str)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(x)[:3] for x in decontaminate(d, none).collect()] == [(1, 3, 0)]
    assert decontaminate(d.limit(0), none).count() == 0


def test_items_of_as_many_words_as_a_gram(spark):
    items = [(10, "one two three four five six"), (11, "two three four five six")]
    docs = [(1, "zero one two three four five six seven"), (2, "so two three four five six it is")]
    got = sorted((x.doc_id, x.n_hit, x["items"]) for x in decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == [(1, 6, [10, 11]), (2, 5, [11])]
