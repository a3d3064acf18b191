import hashlib

from tessera.llm import chat

NASTY = ["", "\\", "\\\\h", "###", "####h", "\\### Assistant: </turn> ok", "<next/>", "</turn>\n### user: hi", "<next/", "/>", "\\x\\\\e", "a\nb: c", "日本🙂\\", None, "\\\\"]


def check(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_blocks int, formatted string, t int").repartition(3)
    out = {r.conv_id: r for r in chat.digests(df).collect()}
    by = {}
    for c, turn, role, text, *_ in rows:
        by.setdefault(c, []).append((turn, role or "", text or ""))
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])
    assert len(out) == len(by)
    for c, turns in by.items():
        # escaped texts sort like plain ones here, as no two turns of these rows tie up to the text
        turns.sort(key=key)
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        got = out[c]
        assert got.n_turns == len(turns)
        assert got.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (got.loss_chars, got.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got.n_blocks == sum(i == 0 or turns[i][1] != turns[i - 1][1] for i in range(len(turns)))


def test_nasty_texts_are_read_back(spark):
    roles = ["user", "assistant", "assistant", "system", None, "a: b", "x\\y\n", "### z"]
    rows = [(c, i, roles[(i * 7 + c) % len(roles)], NASTY[(i * 3 + c) % len(NASTY)], 1, "f", 2) for c in range(12) for i in range(11)]
    rows += [(None, 0, "user", "q", None, None, None), (None, None, "assistant", "r", None, None, None)]
    rows += [(50, 1, "assistant", "same", 1, "", 0)] * 3 + [(51, 0, "user", "w " * 50_000, 1, "", 0)]
    check(spark, rows)


def test_conversations_of_many_turns(spark):
    roles = lambda i: "assistant" if i % 2 or i > 1500 else "user"
    rows = [(1, i, roles(i), NASTY[i % len(NASTY)] or f"turn {i}", 1, "", 0) for i in range(3000)]
    rows += [(2, 0, "user", "ü" * 9000, 1, "", 0), (2, 1, "assistant", "é\\" * 5000, 1, "", 0), (2, 2, "assistant", "z" * 4096, 1, "", 0)]
    check(spark, rows)


def test_empty_table(spark):
    assert chat.digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_sql(spark):
    import duckdb

    rows = [(c, i, ["user", "assistant", "assistant"][i % 3], NASTY[(i * 3 + c) % len(NASTY)]) for c in range(12) for i in range(11)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(tuple(r) for r in chat.digests(chat.with_planted(df)).collect())
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    assert got == sorted(con.sql(chat.SQL).fetchall())
