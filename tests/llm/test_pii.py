import math
import random
import re

from massif.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in s if c.isdigit()]
    return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0


TESTS = {"email": lambda v: True, "ip": lambda v: all(int(p) <= 255 for p in v.split(".")), "card": luhn, "phone": lambda v: 9 <= sum(c.isdigit() for c in v) <= 15}


def brute(t):
    out = [(m.start(), i, k, m.end()) for i, k in enumerate(PLAIN) for m in re.finditer(PLAIN[k], t or "") if TESTS[k](m.group())]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def test_base_spans_equal_brute_force(spark):
    r = random.Random(5)
    parts = ["a", "@", "b.c", ".", "_", "x@y.z", "1", "12", "255", "256", "1.2.3.4", "4111 1111 1111 1111", "4111111111111111", "-", " ", "+", "+49 (30) 123-4567", "é", "🙂", "\n", "0004", "%", "٣", "79927398713", "00000000000"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(0, 30))) for _ in range(1500)]
    texts += [None, "", "a@b.c_d@e.f", "x" * 2000, "1" * 2000, "a@" + "b." * 3000 + "c", "+1" + " " * 50_000, "1 " * 50_000, "1.2.3.4 " * 300]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "me@x.org", "x"), (4, texts[4], "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(((x.doc_id, [f"{s.kind}:{s.start}:{s.end}" for s in x.base]) for x in pii.find(d).collect()), key=str)
    assert got == sorted(((i, brute(t)) for i, t, _ in rows), key=str)


def test_long_texts_take_linear_time(spark):
    texts = ["x" * 300_000, "1" * 300_000, "1." * 100_000, "+1" + " " * 100_000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: [s.kind for s in x.base] for x in pii.find(d).collect()}
    assert got[0] == got[1] == got[3] == [] and set(got[2]) == {"ip"} and len(got[2]) == 25_000


def names(i):
    return f"{chr(97 + i % 26)}{chr(97 + i // 26)}"


def test_terms_that_reveal(spark):
    r = random.Random(1)
    filler = lambda: " ".join(r.choice(["alpha", "bravo", "delta", "golf", "hotel"]) for _ in range(8))
    rows = [(i, f"{filler()} {names(i)} Hartwig wrote from boss@corp.example {filler()}", "x") for i in range(8)]
    rows += [(100 + i, f"{filler()} {names(i)} wrote nothing from {filler()}", "x") for i in range(200)]
    rows += [(400, "Ask HARTWIG about it", None), (401, None, "x"), (402, "", "x"), (403, "copy one@two.org Miller", "x")]
    rows += [(500 + i, "copy one@two.org Miller", "x") for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x.doc_id: [f"{s.kind}:{s.value}" for s in x.spans] for x in pii.find(d, support=5).collect()}
    assert got[400] == ["term:HARTWIG"] and got[3] == ["term:Hartwig", "email:boss@corp.example"]
    assert got[150] == [] and got[403] == ["email:one@two.org"] and got[401] == got[402] == []
    clean = {x.doc_id: x for x in pii.sanitise(d).collect()}
    assert clean[400].text == "Ask [TERM] about it" and clean[403].text == "copy [EMAIL] Miller"
    assert clean[401].text is None and clean[402].text == "" and "@" not in clean[0].text and clean[0].source == "x"
    assert len(clean) == len(rows)
    assert pii.find(d.limit(0)).count() == 0 and pii.sanitise(d.limit(0)).count() == 0


def test_copies_of_a_revealing_text_count_once(spark):
    texts = [f"{names(i)} Hartwig wrote from boss@corp.example {names(i + 40)}" for i in range(5)]
    rows = [*texts, *texts[:1] * 1000, *[f"{names(i)} wrote nothing from here" for i in range(200)]]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {x.doc_id: [f"{s.kind}:{s.value}" for s in x.spans] for x in pii.find(d).collect()}
    assert all(got[i] == ["term:Hartwig", "email:boss@corp.example"] for i in range(1005))
    assert not any(got[i] for i in range(1005, len(rows)))


def test_terms_far_from_an_entity_and_in_signature_blocks(spark):
    pad = "from here and there " * 20
    block = "Signed Zacharias <z@corp.example> of the northern office in the old town by the river, all rights reserved here"
    rows = [f"{names(i)} Hartwig wrote {pad} to boss@corp.example" for i in range(6)]
    rows += [f"{names(i)} number {i} {pad} {pad} {block} {block}" for i in range(6)]
    rows += [f"{names(i)} number wrote {pad} signed of the northern office in the old town by the river, all rights reserved" for i in range(200)]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {x.doc_id: [f"{s.kind}:{s.value}" for s in x.spans] for x in pii.find(d).collect()}
    assert all(got[i] == ["term:Hartwig", "email:boss@corp.example"] for i in range(6))
    assert all(got[i] == ["term:Zacharias", "email:z@corp.example"] * 2 for i in range(6, 12))
    assert not any(got[i] for i in range(12, len(rows)))


def test_overlapping_spans_are_cut_once(spark):
    text = "call +4111 1111 1111 1111 now 1.2.3.4, a@b.c_d@e.f"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.sanitise(d).first().text == "call +[CARD] now [IP], [EMAIL][EMAIL]" or pii.sanitise(d).first().text == "call [PHONE] now [IP], [EMAIL][EMAIL]"


def brute_terms(texts, support, disclosure, bits):
    """Revealing terms, text by text: every distinct text, its entities, and its terms outside each entity's own characters."""
    texts = set(texts)
    terms = lambda t: {x for x in re.split(r"[^\w]+|_", t.lower()) if len(x) >= 4 and re.search(r"[^\W\d]", x)}
    n_t, n_e, n_te = {}, {}, {}
    for t in texts:
        spans = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(PLAIN["email"], t)]
        for x in terms(t):
            n_t[x] = n_t.get(x, 0) + 1
        rest = terms(re.sub(PLAIN["email"], " ", t))
        for e in {s[2] for s in spans}:
            n_e[e] = n_e.get(e, 0) + 1
            for x in rest | terms(" ".join(s[2] for s in spans if s[2] != e)):
                n_te[e, x] = n_te.get((e, x), 0) + 1
    return {x for (e, x), n in n_te.items() if n >= support and n / n_t[x] >= disclosure and math.log2(len(texts) * n / (n_t[x] * n_e[e])) >= bits}


def test_terms_equal_brute_force(spark):
    r = random.Random(21)
    vocab = [f"term{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)]
    people = [f"{chr(97 + i)}{chr(97 + i)}@corp{chr(97 + i)}.example" for i in range(12)]
    texts = []
    for i in range(400):
        words = [r.choice(vocab) for _ in range(r.randrange(1, 12))]
        if r.random() < 0.4:
            k = r.randrange(12)
            words += [people[k], *(["secretname" + chr(97 + k)] if r.random() < 0.9 else []), *(["alsohere" + chr(97 + k)] if r.random() < 0.5 else [])]
            words += [people[r.randrange(12)]] if r.random() < 0.3 else []
        if r.random() < 0.05:
            words.append("alsohere" + chr(97 + r.randrange(12)))
        r.shuffle(words)
        texts += [" ".join(words)] * r.choice([1, 1, 1, 4])
    want = brute_terms(texts, 5, 0.8, 4.0)
    assert len(want) > 12
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in pii.find(d).collect():
        t = texts[x.doc_id]
        assert [(s.start, s.end) for s in x.spans if s.kind == "term"] == [m.span() for m in re.finditer(r"\w+", t) if m.group().lower() in want]


def test_one_document_is_no_evidence(spark):
    one = " ".join(f"context {i} filler platform today me@one.example" for i in range(7))
    rows = [one, *[f"{names(i)} filler platform today and more" for i in range(300)]]
    got = pii.find(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert all(s.kind == "email" for x in got for s in x.spans)


def test_copies_on_all_sides_change_nothing(spark):
    rows = [f"{names(i)} Hartwig wrote from boss@corp.example {names(i + 40)}" for i in range(8)] * 3 + [f"{names(i)} wrote nothing from here" for i in range(200)]
    got = {x.doc_id: [f"{s.kind}:{s.value}" for s in x.spans] for x in pii.find(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert all(got[i] == ["term:Hartwig", "email:boss@corp.example"] for i in range(24)) and not any(got[i] for i in range(24, 224))
