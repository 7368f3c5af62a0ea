"""Chat formatting: fold an event log into final messages, then render them.

An event log has the columns conv_id, seq, msg_id, kind, role, text. Kinds:
``message`` opens a message, ``delta`` appends to the newest message of that
msg_id, ``edit`` and ``regenerate`` replace its text. The log is partitioned by
conversation and each message's events are folded in sequence order.

Rendering. A turn is ``<s>role\\ntext</s>``, and for every role but the assistant
``<s>[INST] role\\ntext [/INST]</s>``. Inside roles and texts each backslash is
doubled and a backslash goes behind the first character of every control string,
so no control string is left; dropping one backslash before any character
gives the text back. The loss mask covers the text of each assistant turn: per
turn, the place and length of the masked part inside its piece.

Only DataFrame functions are used. Texts are escaped and rendered before the
shuffle to whole conversations; the one unbounded value is the finished
conversation itself, which is a single row of the result.

Defined cases: null roles and texts are empty; rows without conv_id form one
conversation; rows of equal place are ordered by role and text, and a repeated row
is a repeated turn; a delta or edit whose message was never opened opens it. An empty
log gives no conversations.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weblog.llm.common import pick, placed, table

#: The template's control strings (fixed values).
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]"]
OPEN, CLOSE, INST, END_INST = "<s>", "</s>", "[INST] ", " [/INST]"
ASSISTANT = "assistant"
#: Deltas that carry the text of a finished row when it is replayed as a stream.
DELTAS = 3


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    """As ``escape``, and a line feed gets a backslash: the first bare one ends the role."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def events_of(conversations: DataFrame, deltas: int = DELTAS) -> DataFrame:
    """Finished conversation rows as the log of a stream: each row opens an empty message, and ``deltas`` pieces of its text follow.

    A row is a message of its own (``msg_id`` is its place in the table), also where turns repeat.
    """
    rows = placed(pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text"))
    c = rows.toDF("conv_id", "turn", "role", "text", "file", "row").withColumn("msg_id", F.xxhash64("file", "row"))
    size = F.ceil(F.length("text") / F.lit(deltas)).cast("int")
    piece = F.transform(F.sequence(F.lit(0), F.lit(deltas)), lambda k: F.struct(
        (F.col("turn").cast("long") * (deltas + 1) + k).alias("seq"), F.when(k == 0, "message").otherwise("delta").alias("kind"),
        F.when(k == 0, "").otherwise(F.substring(F.col("text"), (k - 1) * size + 1, size)).alias("text")))
    return c.select("conv_id", "msg_id", "role", F.inline(piece)).select("conv_id", "seq", "msg_id", "kind", "role", "text")


def fold(events: DataFrame) -> DataFrame:
    """Final messages of a log: conv_id, place, role, text, one row per message.

    The events of a msg_id are put in order once. A ``message`` (or the first event) opens a message that reaches to the next
    opening; its text is that of the last event in there that sets it, with the deltas behind it. Each
    event is looked at a fixed number of times, and each text is copied once.
    """
    e = pick(events, conv_id="conv_id", seq="seq", msg_id="msg_id", kind="kind", role="role", text="text")
    e = e.select("conv_id", "msg_id", F.struct(
        F.col("seq").cast("long").alias("seq"), (F.col("kind") != "message").alias("later"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        "kind").alias("e")).repartition("conv_id")
    grouped = e.groupBy("conv_id", "msg_id").agg(F.sort_array(F.collect_list("e")).alias("es"))
    at = lambda i: F.element_at("es", i)
    places = F.sequence(F.lit(1), F.size("es"))
    grouped = grouped.withColumn("opened", F.filter(places, lambda i: (i == 1) | (at(i)["kind"] == "message")))
    grouped = grouped.withColumn("reach", F.transform("opened", lambda i, n: F.struct(
        i.alias("first"), (F.coalesce(F.try_element_at("opened", n + 2), F.size("es") + 1) - 1).alias("last"))))

    def message(m):
        sets = F.array_max(F.filter(F.sequence(m["first"], m["last"]), lambda i: (i == m["first"]) | (at(i)["kind"] != "delta")))
        text = F.array_join(F.transform(F.slice("es", sets, m["last"] - sets + 1), lambda x: x["text"]), "")
        return F.struct(at(m["first"])["seq"].alias("seq"), at(m["first"])["role"].alias("role"), text.alias("text"))

    return grouped.select("conv_id", F.explode(F.transform("reach", message)).alias("m")).select(
        "conv_id", F.col("m.seq").alias("place"), "m.role", "m.text")


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, and its loss mask.

    ``mask`` has an entry for each turn, in order: start (code points from the
    start of the turn's piece) and length of the masked part, or length -1.
    """
    m = pick(messages, conv_id="conv_id", place="place", role="role", text="text")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    own = role == ASSISTANT
    head = F.concat(F.when(own, F.lit(OPEN)).otherwise(F.lit(OPEN + INST)), escape_role(role), F.lit("\n"))
    tail = F.when(own, F.lit(CLOSE)).otherwise(F.lit(END_INST + CLOSE))
    body = escape(text)
    pieces = m.select("conv_id", F.struct(
        "place", role.alias("role"), text.alias("text"), F.concat(head, body, tail).alias("piece"),
        F.struct(F.length(head).alias("start"),
                 F.when(own, F.length(body)).otherwise(-1).alias("length")).alias("mask")).alias("p"))
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    return whole.select("conv_id", F.array_join(F.transform("ps", lambda p: p["piece"]), "").alias("formatted"),
                        F.transform("ps", lambda p: p["mask"]).alias("mask"))


def _split(formatted: Column) -> Column:
    return F.filter(F.split(formatted, r"(?<=</s>)"), lambda p: p != "")


def read_back(rendered: DataFrame) -> DataFrame:
    """Parse formatted conversations: conv_id, turns (role, text), loss_text."""
    pieces = _split(F.col("formatted"))

    def turn(p):
        inner = F.substring(p, F.lit(len(OPEN) + 1), F.length(p) - len(OPEN) - len(CLOSE))
        inst = F.startswith(inner, F.lit(INST))
        inner = F.when(inst, F.substring(inner, F.lit(len(INST) + 1), F.length(inner) - len(INST) - len(END_INST))
                       ).otherwise(inner)
        role = F.regexp_extract(inner, r"(?s)^((?:[^\\\n]|\\.)*+)\n", 1)
        text = F.substring(inner, F.length(role) + 2, F.length(inner))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    loss = F.zip_with(pieces, "mask", lambda p, k: F.when(
        k["length"] >= 0, unescape(F.substring(p, k["start"] + 1, k["length"]))).otherwise(""))
    return rendered.select("conv_id", "formatted", F.transform(pieces, turn).alias("turns"),
                           F.array_join(loss, "").alias("loss_text"))


def format_chats(events: DataFrame) -> DataFrame:
    return render(fold(events))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = pick(table(spark, sf_dir, "conversations"), conv_id="conv_id", turn="turn", role="role", text="text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"),
                                 F.lit(said).alias("text"))
    back = read_back(format_chats(events_of(given.unionByName(more))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(turns, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"),
                       F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def _sql_escape(x: str) -> str:
    x = f"replace({x}, '\\', '\\\\')"
    for c in CONTROL:
        x = f"replace({x}, '{c}', '{c[0]}\\{c[1:]}')"
    return x


ORACLE = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_sql_escape('role')}) + length({_sql_escape('text')}) + {len(OPEN) + len(CLOSE) + 1}
      + CASE WHEN role = 'assistant' THEN 0 ELSE {len(INST) + len(END_INST)} END)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
