from massif.llm.quality import quality_rules


def test_lines_rules_and_edges(spark):
    line = "Share this page 12 with your friends and follow us on every network today"
    unique = lambda i: " ".join(f"word{chr(97 + i % 26)}{chr(97 + j)}{chr(97 + i // 26)}" for j in range(20))
    rows = [(i, unique(i) + "\n" + line.replace("12", str(10 + i)), "hot", "n") for i in range(30)]
    rows += [(100, line.replace("12", "77"), "hot", "n"), (101, line, "other", "n"), (102, None, "hot", "n"), (103, "", None, None), (None, unique(40), None, "n")]
    rows += [(104, "a b c d e a b c d e a b c", "x", "n"), (105, unique(50), "x", "n"), (105, unique(50), "x", "n"), (106, "dup line é\ndup line é\n\n \ndup line é #$", "x", "n")]
    rows += [(107, " ".join(f"w{i}" for i in range(30000)), "x", "n")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lines string")
    got = {}
    for x in quality_rules(d).collect():
        got.setdefault(x.doc_id, []).append(x)
    assert sum(map(len, got.values())) == len(rows)
    assert all(got[i][0].kept and got[i][0].n_removed_words == 14 for i in range(30))
    assert not got[100][0].kept and not got[100][0].base_failed and got[100][0].n_removed_words == 14
    assert got[101][0].kept and got[None][0].kept
    assert got[102][0].n_words == 0 and got[102][0].base_failed and got[103][0].base_failed
    assert got[104][0].n_repeat_words == 13 and got[104][0].base_failed
    assert len(got[105]) == 2 and all(x.kept for x in got[105])
    x = got[106][0]
    assert (x.n_dup_lines, x.n_symbols, x.word_chars, x.n_words) == (1, 2, 26, 10)
    assert got[107][0].n_words == 30000 and got[107][0].kept
    assert quality_rules(d.limit(0)).count() == 0
