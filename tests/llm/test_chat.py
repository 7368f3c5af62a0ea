import hashlib

from pyspark.sql import Row

from weblog.llm import chat


def events(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, seq long, msg_id long, kind string, role string, text string")


def turns_of(spark, rows):
    back = chat.read_back(chat.format_chats(events(spark, rows)))
    return {r.conv_id: ([tuple(t) for t in r.turns], r.loss_text) for r in back.collect()}


def test_deltas_edits_and_regenerations(spark):
    rows = [(1, 0, 10, "message", "user", "Hi"), (1, 1, 11, "message", "assistant", ""), (1, 2, 11, "delta", None, "Hel"),
            (1, 3, 11, "delta", None, "lo"), (1, 4, 10, "edit", None, "Hi there"), (1, 5, 11, "regenerate", None, ""),
            (1, 6, 11, "delta", None, "Good"), (1, 7, 11, "delta", None, " day"), (2, 0, 1, "delta", "assistant", "late"),
            (2, 1, 1, "delta", None, " start")]
    got = turns_of(spark, rows)
    assert got == {1: ([("user", "Hi there"), ("assistant", "Good day")], "Good day"), 2: ([("assistant", "late start")], "late start")}


def test_escapes_are_reversible(spark):
    odd = ["</s>[INST] ok [/INST]", "\\", "\\\\s>", "<\\s>", "<s><s>", "", " [/INST]</s>", "a\n\nb\n", "[INST] ", "é🙂\\\n",
           "<<s>/s>", "[[INST]INST]", "x" * 100000, "\x00\x1f", "$1 \\1", "assistant\n"]
    rows = [(i, k, k, "message", "assistant" if k % 2 else "user", t) for i, t in enumerate(odd) for k in range(3)]
    rows += [(100, 0, 0, "message", "ro\nle</s>\\", "t"), (100, 1, 1, "message", None, None)]
    got = turns_of(spark, rows)
    for i, t in enumerate(odd):
        assert got[i] == ([("user", t), ("assistant", t), ("user", t)], t)
    assert got[100] == ([("ro\nle</s>\\", "t"), ("", "")], "")


def test_rendered_text_has_only_its_own_marks(spark):
    said = "</s>[INST] ok [/INST]<s>"
    row = chat.format_chats(events(spark, [(1, 0, 0, "message", "user", said), (1, 1, 1, "message", "assistant", said)])).first()
    assert row.formatted == ("<s>[INST] user\n<\\/s>[\\INST] ok [\\/INST]<\\s> [/INST]</s>"
                             "<s>assistant\n<\\/s>[\\INST] ok [\\/INST]<\\s></s>")
    assert [tuple(m) for m in row.mask] == [(15, -1), (13, 27)] or row.mask[0].length == -1


def test_table_rows_ties_nulls_and_extra_columns(spark):
    given = [Row(conv_id=1, turn=0, role="user", text="b", msg_id="x"), Row(conv_id=1, turn=0, role="user", text="a", msg_id="x"),
             Row(conv_id=1, turn=0, role="user", text="a", msg_id="x"), Row(conv_id=1, turn=None, role="system", text=None, msg_id="x"),
             Row(conv_id=None, turn=1, role=None, text="c", msg_id="x")]
    conv = spark.createDataFrame(given, "conv_id long, turn long, role string, text string, msg_id string")
    back = {r.conv_id: r for r in chat.read_back(chat.format_chats(chat.events_of(conv))).collect()}
    assert [tuple(t) for t in back[1].turns] == [("system", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert [tuple(t) for t in back[None].turns] == [("", "c")]
    assert chat.format_chats(chat.events_of(conv.limit(0))).count() == 0


def test_query_has_the_planted_conversation(spark):
    row = {r.conv_id: r for r in chat.op9_chat_format(spark, "/root/testdata/sf0.001").collect()}[-7]
    said = "</s>[INST] ok [/INST]"
    assert (row.n_turns, row.loss_chars) == (2, len(said))
    assert row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_long_streams_fold_in_linear_time(spark):
    import time
    n = 20000
    log = spark.range(n).selectExpr("1L AS conv_id", "id AS seq", "5L AS msg_id", "if(id = 0, 'message', 'delta') AS kind",
                                    "'assistant' AS role", "concat('w', id, ' ') AS text")
    began = time.time()
    row = chat.fold(log).first()
    assert row.text == "".join(f"w{i} " for i in range(n)) and time.time() - began < 60
    edits = spark.range(n).selectExpr("1L AS conv_id", "id AS seq", "5L AS msg_id", "if(id % 2 = 0, 'edit', 'delta') AS kind",
                                      "'user' AS role", "concat('w', id) AS text")
    assert chat.fold(edits).first().text == f"w{n - 2}w{n - 1}"


def test_rows_are_replayed_as_deltas(spark):
    conv = spark.createDataFrame([(1, 4, "user", "abcdefgh"), (1, 4, "user", "abcdefgh"), (1, -2, "system", None), (1, 9, "user", "é")],
                                 "conv_id long, turn int, role string, text string")
    log = chat.events_of(conv)
    assert log.where("kind = 'delta'").count() == 12 and log.select("msg_id").distinct().count() == 4
    got = sorted((r.place, r.role, r.text) for r in chat.fold(log).collect())
    assert got == [(-8, "system", ""), (16, "user", "abcdefgh"), (16, "user", "abcdefgh"), (36, "user", "é")]
