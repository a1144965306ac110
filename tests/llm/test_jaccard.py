import random
import re

import numpy as np
import pytest

from massif.llm import jaccard, setjoin, sigtree

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    s = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] and s[j] and 100 * both >= 75 * (len(s[i]) + len(s[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s[i]), least.get(find(i)) if s[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, families=12, copies=9):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    rows = []
    for _ in range(families):
        base = [r.choice(vocab) for _ in range(r.choice([5, 8, 30, 80, 300]))]
        for _ in range(r.randrange(1, copies)):
            w = list(base)
            for _ in range(r.randrange(0, max(2, len(w) // 30))):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((len(rows), " ".join(w)))
    passage = " ".join(r.choice(vocab) for _ in range(50))
    rows += [(len(rows) + i, passage + " " + " ".join(r.choice(vocab) for _ in range(r.randrange(0, 60)))) for i in range(25)]
    return rows


@pytest.mark.parametrize("block", [512, 3])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(setjoin, "BLOCK", block)
    monkeypatch.setattr(setjoin, "FAMILY", 8 * block)
    rows = corpus(block) + [(900, None), (901, ""), (902, "one"), (903, "ONE"), (904, "a b c d"), (905, "a b  c\td"), (None, "a b c d"), (905, "a b  c\td"), (950, "lonely " * 4000), (906, " \n")]
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    got = sorted((tuple(x) for x in jaccard.jaccard_components(d).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tree_loses_no_pair():
    r = np.random.default_rng(4)
    sets, group, label = [], [], []
    for g in range(20):
        base = r.integers(0, 2**63, int(r.choice([3, 40, 200, 900])), dtype=np.uint64)
        for _ in range(int(r.integers(1, 40))):
            keep = r.random(len(base)) < r.choice([0.8, 0.9, 0.97])
            sets.append(np.unique(np.concatenate([base[keep], r.integers(0, 2**63, int((~keep).sum()), dtype=np.uint64), base[:1]])))
            group.append(g)
            label.append(int(r.integers(0, 3)))
    offs = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    n = np.diff(offs)
    a, b, _ = sigtree.candidates(np.array(group), n, np.array(label), sigtree.signatures(np.concatenate(sets), offs), 75)
    found = {(min(i, j), max(i, j)) for i, j in zip(a.tolist(), b.tolist())}
    assert len(found) == len(a)
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if group[i] == group[j] and label[i] != label[j] and 100 * both >= 75 * (n[i] + n[j] - both):
                assert (j, i) in found
