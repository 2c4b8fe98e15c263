"""Chat formatting by event-sourced reconstruction, in DataFrame and SQL operations only.

A log is a table of events: conv_id, seq, piece, kind, message, writer, role, text. ``message`` is the number that orders a
message in its conversation, the seq of its opening as a rule; ``writer`` tells messages of one number apart. Kinds:

``open``        begins a message with its role and, if there is one, its text
``delta``       adds text to a message
``edit``        replaces the text that a message has so far
``regenerate``  empties a message, to be filled anew, and takes back every later message opened before this event

``folded`` deals the log by conversation, sorts by (seq, piece) and folds it into final messages; ``rendered`` writes them in
the template with the spans that a model learns from (the texts of one role); ``read_back`` gets turns and learnt text from
that output alone. The template is ``### role: text</turn>`` and a line feed. Inside texts the backslash becomes ``\\b``,
``###`` ``\\h`` and ``</turn>`` ``\\t``, in roles ``:`` also becomes ``\\c``, so control strings occur only as control
strings, and all is undone by plain replacements.

The log is shuffled once, by conversation. Conversations of more than ``LONG`` rows go another way: they are dealt by
(conversation, message div PART), so no task gets one whole, fold part by part, and come out in several parts; what earlier
parts take back reaches the later ones by a table with a row a part.

Defined results: null texts and roles are empty; rows with a null conv_id are a conversation; messages with a null number
come first, those of one number in order of role and text, and repeated ones stay, each with its own writer. Events of one (seq, piece) are
ordered by kind and text. A message without an opening has an empty role. An event for a message that was taken back counts as
if it were there. A message whose every event is gone has no turn. An empty log gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import staging

LONG, PART, PIECE = 64, 64, 512
END = "</turn>\n"
EVENT = ["conv_id", "seq", "piece", "kind", "message", "writer", "role", "text"]


def replaced(text, pairs):
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escaped(text):
    return replaced(text, [("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t")])


def unescaped(text):
    return replaced(text, [("\\t", "</turn>"), ("\\h", "###"), ("\\b", "\\")])


def escaped_role(role):
    return replaced(escaped(role), [(":", "\\c")])


def unescaped_role(role):
    return unescaped(replaced(role, [("\\c", ":")]))


def streamed(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """A log in which every row (conv_id, turn, role, text) is opened and then streamed in deltas of ``piece`` characters."""
    parts = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))
    nothing = F.lit(None).cast("string")
    opened = F.struct(F.lit(0).alias("piece"), F.lit("open").alias("kind"), F.col("role"), nothing.alias("text"))
    deltas = F.transform(parts, lambda p, i: F.struct((i + 1).alias("piece"), F.lit("delta").alias("kind"), nothing.alias("role"), p.alias("text")))
    told = rows.select("conv_id", "turn", F.monotonically_increasing_id().alias("writer"), F.concat(F.array(opened), deltas).alias("events"))
    log = told.select("conv_id", F.col("turn").alias("seq"), F.col("turn").alias("message"), "writer", F.explode("events").alias("e"))
    return log.select("conv_id", "seq", "e.piece", "e.kind", "message", "writer", "e.role", "e.text")


def long_conversations(rows: DataFrame, most: int = LONG) -> DataFrame:
    """conv_id of conversations with more than ``most`` rows; staged, and at most a row for ``most`` of the input."""
    ids = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    return staging.staged(ids.select(F.col("conv_id").alias("long_id")), "long")


def folded(events: DataFrame, by_part: bool = False, part: int = PART) -> DataFrame:
    """conv_id, part, message, writer, role, text: the messages left at the log's end. ``part`` is 0 without ``by_part``."""
    number = F.floor(F.col("message") / part) if by_part else F.lit(0).cast("long")
    key = ["conv_id", "part"]
    log = events.select(*EVENT, number.alias("part"))
    at = F.struct("seq", "piece")
    resets = F.col("kind").isin("open", "edit", "regenerate")
    messages = (
        (log.repartition(*key) if by_part else log.repartition("conv_id"))
        .groupBy(*key, "message", "writer")
        .agg(
            F.max_by("role", F.when(F.col("kind") == "open", F.struct("seq", "piece", "role"))).alias("role"),
            F.max(F.when(resets, at)).alias("reset"),
            F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"),
            F.array_sort(F.collect_list(F.struct("seq", "piece", "kind", "text"))).alias("events"),
        )
    )
    counts = F.filter("events", lambda e: F.col("reset").isNull() | (F.struct(e["seq"], e["piece"]) >= F.col("reset")))
    text = F.array_join(F.transform(counts, lambda e: e["text"]), "")
    back = F.max("again").over(Window.partitionBy(*key).orderBy("message").rangeBetween(Window.unboundedPreceding, -1))
    messages = messages.select(*key, "message", "writer", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), back.alias("back"))
    if by_part:
        parts = log.groupBy(*key).agg(F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"))
        before = F.max("again").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        earlier = parts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), before.alias("before")).where("before IS NOT NULL")
        met = messages["conv_id"].eqNullSafe(earlier["c"]) & messages["part"].eqNullSafe(earlier["p"])
        messages = messages.join(earlier, met, "left").withColumn("back", F.greatest("back", "before"))
    return messages.where(F.coalesce(F.col("back") < F.col("message"), F.lit(True))).select(*key, "message", "writer", "role", "text")


def rendered(messages: DataFrame, learnt: str = "assistant") -> DataFrame:
    """conv_id, part, formatted, loss: loss holds start and end, in characters of ``formatted``, of each learnt text."""
    head, body = F.concat(F.lit("### "), escaped_role(F.col("role")), F.lit(": ")), escaped(F.col("text"))
    turns = messages.select("*", F.concat(head, body, F.lit(END)).alias("turn"), F.char_length(head).alias("head"), F.char_length(body).alias("body"))
    order = Window.partitionBy("conv_id", "part").orderBy("message", "role", "text", "writer").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("turn")).over(order), F.lit(0))
    turns = turns.select("conv_id", "part", F.struct(start.alias("at"), "turn", "head", "body", (F.col("role") == learnt).alias("learnt")).alias("t"))
    whole = turns.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["learnt"]), lambda t: F.struct((t["at"] + t["head"]).alias("start"), (t["at"] + t["head"] + t["body"]).alias("end")))
    return whole.select("conv_id", "part", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), spans.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with turns (array of role, text) and loss_text, both got from its text and spans."""

    def turn(t):
        colon = F.instr(t, F.lit(":"))
        return F.struct(unescaped_role(F.substr(t, F.lit(5), colon - 5)).alias("role"), unescaped(F.substr(t, colon + 2)).alias("text"))

    pieces = F.split("formatted", END)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    learnt = F.transform("loss", lambda s: unescaped(F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.select("*", F.transform(pieces, turn).alias("turns"), F.array_join(learnt, "").alias("loss_text"))


def formatted(rows: DataFrame) -> DataFrame:
    """conv_id, part, formatted, loss of (conv_id, turn, role, text): one part, or more for long conversations."""
    whole, parted = _both_ways(rows)
    return whole.unionByName(parted)


def _both_ways(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    long = staging.broadcast_if_few(long_conversations(rows))
    rows = rows.select("conv_id", "turn", "role", "text")
    of_long = rows["conv_id"].eqNullSafe(long["long_id"])
    whole = rendered(folded(streamed(rows.join(long, of_long, "left_anti"))))
    return whole, rendered(folded(streamed(rows.join(long, of_long, "left_semi")), by_part=True))


def digests(parts: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, said (all turns as role, line feed, text, line feed), loss_text, formatted_chars of each part."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(parts).select("conv_id", "part", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), "loss_text", F.char_length("formatted").cast("long").alias("formatted_chars"))


CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staging.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    whole, parted = map(digests, _both_ways(rows.unionByName(added)))
    ordered = F.array_sort(F.collect_list(F.struct("part", "said", "loss_text")))
    join = lambda field: F.array_join(F.transform("ps", lambda p: p[field]), "").alias(field)
    parted = parted.groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), ordered.alias("ps"), F.sum("formatted_chars").alias("formatted_chars"))
    parted = parted.select("conv_id", "n_turns", join("said"), join("loss_text"), "formatted_chars")
    return whole.drop("part").unionByName(parted).select(
        "conv_id",
        "n_turns",
        F.sha2("said", 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) AS x(t)),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t') AS body,
         replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ':', '\c') AS head
  FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(head) + length(body) + 14)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
