import json
import random

from massif.llm import chat


def test_layouts_and_edges(spark):
    rows = [
        (1, json.dumps({"messages": [{"role": "user", "content": "hi"}, {"content": None, "role": "assistant"}]})),
        (2, json.dumps({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]})),
        (3, json.dumps({"instruction": "do", "input": "", "output": "done"})),
        (4, json.dumps({"output": "done", "instruction": "do", "input": "this"})),
        (5, json.dumps({"prompt": "p", "response": "r"})),
        (6, json.dumps({"prompt": 5, "completion": "c"})),
        (7, json.dumps({"question": "p", "answer": None})),
        (8, json.dumps({"other": "p"})),
        (9, None),
        (10, "no json {"),
        (11, ""),
        (5, json.dumps({"prompt": "p", "response": "r"})),
        (12, json.dumps({"id": "x", "conversations": [{"value": "v", "from": "human"}]})),
    ]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "id long, record string, turns string")
    got = {}
    for x in chat.format_records(d).collect():
        got.setdefault(x.id, []).append((x.layout, None if x.turns is None else [tuple(t) for t in x.turns], x.formatted))
    u, a = "user", "assistant"
    assert got[1][0][:2] == ("messages", [(u, "hi"), (a, "")])
    assert got[2][0][:2] == ("shared_conversations", [(u, "q"), (a, "a")])
    assert got[3][0][1] == [(u, "do"), (a, "done")] and got[4][0][1] == [(u, "do\n\nthis"), (a, "done")]
    assert len(got[5]) == 2 and got[5][0][1] == [(u, "p"), (a, "r")]
    assert got[6][0][1] == [(u, "5"), (a, "c")] and got[7][0][1] == [(u, "p")]
    assert all(got[i][0] == (None, None, None) for i in (8, 9, 10, 11))
    assert got[12][0][1] == [(u, "v")]
    assert chat.format_records(d.limit(0)).count() == 0


def test_reversible(spark):
    r = random.Random(2)
    parts = ["\\", "###", "#", "</turn>", "\n", "### ", ": ", "<", "turn>", "é", "🙂", "s", "h", "t", "c", "x y"]
    make = lambda: "".join(r.choice(parts) for _ in range(r.randrange(0, 12)))
    turns = [[(r.choice(["user", "assistant", make()]), make()) for _ in range(r.randrange(1, 6))] for _ in range(300)]
    turns += [[("assistant", "a" * 200_000)], [("assistant", "x")] * 3000]
    rows = [(i, t, role, text) for i, c in enumerate(turns) for t, (role, text) in enumerate(c)] + [(9000, 0, None, None)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.format_records(chat.records_of(d), rename=False)
    for x in done.select("conv_id", "formatted", chat.read_back(done.formatted).alias("back"), chat.masked(done.formatted, done.mask).alias("loss")).collect():
        want = turns[x.conv_id] if x.conv_id < 9000 else [("", "")]
        assert [tuple(t) for t in x.back] == want
        assert x.loss == "".join(t for role, t in want if role == "assistant")
        assert x.formatted.count("</turn>\n") == len(want)
