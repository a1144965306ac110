import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from massif.llm import secrets

PLAIN = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
TESTS = {"assign": lambda m: len(m.group(2)) >= 8, "access": lambda m: len(m.group()) >= 16, "hex": lambda m: len(m.group()) >= 32}


def brute(t):
    out = [(m.start(), i, k, m.end()) for i, k in enumerate(PLAIN) for m in re.finditer(PLAIN[k], t or "") if TESTS[k](m)]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def test_base_spans_equal_brute_force(spark):
    r = random.Random(6)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "APIkey", '"', "'", " ", ":", "=", "abcdefgh", "12345678", "x.y-z/", "AKIA", "ABCDEF012345", "deadbeef", "0123456789abcdef" * 2, "é", "🙂", "\n", "tokentoken", "aſk"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(0, 30))) for _ in range(1500)]
    texts += [None, "", "token" + " " * 60_000, "a" * 100_000, "token=" * 5000, "AKIA" * 5000, "f" * 31 + "g" + "f" * 32]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "token=abcdefgh1", "x"), (4, texts[4], "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    found = secrets.find(d).collect()
    assert sorted(((x.doc_id, [f"{s.kind}:{s.start}:{s.end}" for s in x.base]) for x in found), key=str) == sorted(((i, brute(t)) for i, t, _ in rows), key=str)
    for x in found:
        kept = [tuple(s) for s in x.base]
        assert [s for s in map(tuple, x.spans) if s[2] != "entropy"] == kept
    assert secrets.find(d.limit(0)).count() == 0


def entropy(s, w):
    best = 0.0
    for i in range(len(s) - w + 1):
        c = Counter(s[i : i + w]).values()
        best = max(best, -sum(x / w * math.log2(x / w) for x in c))
    return best


def test_incremental_entropy(spark):
    r = random.Random(8)
    texts = ["".join(r.choice("abcdef0123456789"[: r.randrange(1, 17)]) for _ in range(r.randrange(0, 60))) for _ in range(200)]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    got = d.select("t", secrets.window_entropy(F.col("t"), "0123456789abcdef", 24).alias("e")).collect()
    for x in got:
        assert abs(x.e - entropy(x.t, 24)) < 1e-9


def test_entropy_spans_and_allow_list(spark):
    key = "Zk3vQ9xTf7LmPw2RbY8sHd4NcJ6gUe1a"
    rows = [(1, f"use {key} here"), (2, "id 123e4567-e89b-12d3-a456-426614174000"), (3, "abcdefghijklmnopqrstuvwxyz0123456789"), (4, "thequickbrownfoxjumpsoverthelazydogs and words"), (5, f"token={key}"), (6, "EXAMPLE" + key), (7, "a1g1" * 15), (8, "some/long/path/to/the/file/name-2024")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: [(s.kind, s.start, s.end) for s in x.spans] for x in secrets.find(d).collect()}
    assert got[1] == [("entropy", 4, 36)] and got[5] == [("assign", 0, 38)]
    assert {i: got[i] for i in (2, 3, 4, 6, 7, 8)} == dict.fromkeys((2, 3, 4, 6, 7, 8), [])


CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


def brute_entropy(t):
    """Entropy spans, by the rules of the module, worked window by window."""
    base = [(m.start(), m.end()) for k in PLAIN for m in re.finditer(PLAIN[k], t) if TESTS[k](m)]
    out = []
    for m in CANDIDATE.finditer(t):
        v, hit = m.group(), False
        if re.search(secrets.ALLOWED[0], v) or re.search(secrets.ALLOWED[1], v):
            continue
        for x in re.sub(secrets.ALLOWED_PART, " ", v).split(" "):
            if len(x) >= 20 and re.search("[0-9]", x) and re.search("[A-Za-z]", x):
                name, _, _, bits = next(c for c in secrets.CLASSES if re.search(c[1], x))
                hit |= entropy(x.lower() if name == "hex" else x, 20) >= bits
        if hit and not any(a < m.end() and m.start() < b for a, b in base):
            out.append((m.start(), m.end()))
    return out


def test_entropy_spans_equal_brute_force(spark):
    r = random.Random(12)
    alphabets = ["0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJabcdefghij0123456789+/_=-", "ab1", "0123456789"]
    word = lambda: "".join(r.choice(a) for a in [r.choice(alphabets)] for _ in range(r.randrange(1, 70)))
    texts = ["".join(r.choice([word(), "sample", "-", "/", "XXXX", " ", "é ", "token=", "aaaaaaaaaa"]) for _ in range(r.randrange(1, 12))) for _ in range(500)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: [(s.start, s.end) for s in x.spans if s.kind == "entropy"] for x in secrets.find(d).collect()}
    want = {i: brute_entropy(t) for i, t in enumerate(texts)}
    assert got == want and sum(map(len, want.values())) > 40


def test_long_candidates_and_chance_placeholders(spark):
    r = random.Random(5)
    long = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(20_000))
    key = "Zk3vQ9xTf7LmPw2RbY8sHd4NcJ6gUe1a"
    rows = [(1, long[:9000] + "XxxX" + long[9000:]), (2, "/sample/" + key), (3, "deadbeef0123fedc9876"), (4, "a9c3e1f7b2d8046f5ce1"), (5, key * 5000)]
    got = {x.doc_id: [(s.kind, s.start, s.end) for s in x.spans] for x in secrets.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == [("entropy", 0, 20_004)] and got[2] == [("entropy", 0, 40)] and got[4] == [("entropy", 0, 20)] and got[5] == [("entropy", 0, 160_000)]
