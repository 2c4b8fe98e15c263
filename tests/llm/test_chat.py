import hashlib
import random

from pyspark.sql import functions as F

from quern.llm import chat

LOG = "conv_id long, seq long, piece int, kind string, message long, writer long, role string, text string, part string, turn int"


def fold(log):
    """The definitions, an event at a time: {conv: [(message, role, text, writer)]}."""
    out = {}
    for conv in {e[0] for e in log}:
        mine = [e for e in log if e[0] == conv]
        least = lambda x: (x is not None, x)  # noqa: E731  nulls first
        mine.sort(key=lambda e: (least(e[1]), least(e[2]), e[3], least(e[7])))
        messages, back = {}, []
        for _, seq, _, kind, number, writer, role, text in mine:
            m = messages.setdefault((number, writer), ["", ""])
            if kind == "open":
                m[0] = role or ""
            m[1] = text or "" if kind in ("open", "edit", "regenerate") else m[1] + (text or "")
            if kind == "regenerate":
                back.append((number, seq))
        left = [(n, *m, w) for (n, w), m in messages.items() if n is None or not any(x < n < r for x, r in back)]
        out[conv] = sorted(left, key=lambda t: (least(t[0]), t[1], t[2], t[3]))
    return out


def turns(df):
    """{conv: turns} and {conv: learnt text} as read back from the rendered log."""
    said, learnt = {}, {}
    for r in sorted(chat.read_back(chat.rendered(df)).collect(), key=lambda r: (r["conv_id"] or 0, r["part"] is not None, r["part"])):
        said.setdefault(r["conv_id"], []).extend(map(tuple, r["turns"]))
        learnt[r["conv_id"]] = learnt.get(r["conv_id"], "") + r["loss_text"]
        assert all(r["formatted"][s["end"] :].startswith(chat.END) for s in r["loss"])
    return said, learnt


def logs(seed, conversations=8):
    draw = random.Random(seed)
    words = ["", "a", "\\", "###", "</turn>", "\\h", "\\### x: </turn> ok", "é日👩\n", "####", "<</turn>/turn>", "\\\\b", None]
    log = []
    for conv in range(conversations):
        opened, seq = [], 0
        for _ in range(draw.randint(1, 120)):
            seq += draw.randint(1, 4)
            kind = draw.choice(["open", "open", "delta", "delta", "delta", "edit", "regenerate"]) if opened else "open"
            if kind == "open":
                opened.append(seq)
            message = seq if kind == "open" else draw.choice(opened[-4:] if draw.random() < 0.9 else opened)
            role = draw.choice(["user", "assistant", "assistant", "a:b\\c", None]) if kind == "open" else None
            for piece in range(draw.randint(1, 3) if kind == "delta" else 1):
                log.append((conv, seq, piece, kind, message, 0, role, draw.choice(words)))
    return log


def test_fold_against_an_event_at_a_time(spark):
    log = logs(1) + logs(2, 3)  # the second repeats numbers of the first
    log = list({e[:6]: e for e in log}.values())
    df = spark.createDataFrame([(*e, "x", 1) for e in log], LOG).repartition(5)
    want = fold(log)
    for by_part in (False, True):
        said, learnt = turns(chat.folded(df, by_part, part=7))
        assert said == {c: [(m[1], m[2]) for m in ms] for c, ms in want.items() if ms}
        assert learnt == {c: "".join(m[2] for m in ms if m[1] == "assistant") for c, ms in want.items() if ms}


def test_orphans_and_nulls(spark):
    log = [
        (1, 5, 1, "delta", 4, 0, None, "no opening"),
        (1, 6, 0, "open", 6, 0, "user", None),
        (1, 6, 0, "open", 6, 1, "user", "same number"),
        (None, None, None, "open", None, 0, None, "nothing known"),
        (None, 1, 0, "open", 1, 0, "assistant", ""),
        (2, 1, 0, "open", 1, 0, "assistant", "draft"),
        (2, 2, 0, "open", 2, 0, "user", "later"),
        (2, 3, 0, "regenerate", 1, 0, None, None),
        (2, 4, 0, "delta", 1, 0, None, "final"),
        (2, 5, 0, "open", 5, 0, "user", "stays"),
    ]
    df = spark.createDataFrame([(*e, "x", 1) for e in log], LOG)
    for by_part in (False, True):
        assert turns(chat.folded(df, by_part))[0] == {1: [("", "no opening"), ("user", ""), ("user", "same number")], None: [("", "nothing known"), ("assistant", "")], 2: [("assistant", "final"), ("user", "stays")]}


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv), key=lambda t: (t[0] is not None, *t))
        said = "".join(f"{role}\n{text}\n" for _, role, text in mine)
        learnt = "".join(text for _, role, text in mine if role == "assistant")
        out[conv] = (len(mine), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


def as_table(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, message int").repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.op13_chat_format(spark, str(tmp_path)).collect()}


ADDED = [(-7, 0, "user", chat.CONTROL_TEXT), (-7, 1, "assistant", chat.CONTROL_TEXT)]


def test_query_on_odd_rows(spark, tmp_path):
    rows = [(1, 0, "user", "hello"), (1, 0, "user", "hello"), (1, 0, "assistant", "tie"), (1, None, None, None), (None, 3, "assistant", "no id"), (2, 1, "assistant", None), (3, 9, "assistant", "é\n日👩 " * 40_000), (3, 2, "", "")]
    rows += [(4, i // 2, ("user", "assistant")[i % 2], f"</turn>\n### user: {i} \\") for i in range(700)] + [(5, 7, "assistant", "same")] * 300  # long ones
    assert as_table(spark, tmp_path, rows) == brute(rows + ADDED)


def test_query_on_an_empty_table(spark, tmp_path):
    assert as_table(spark, tmp_path, []) == brute(ADDED)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.op13_chat_format(spark, sf).collect()}
    assert got == brute(rows + ADDED)


def test_no_python_on_the_path(spark, sf):
    plan = chat.op13_chat_format(spark, sf)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_escapes(spark):
    texts = ["\\", "\\b", "\\\\h", "###", "#####", "</turn>", "<</turn>/turn>", "\\t</turn>", "", "a: b", "\\c:"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    row = df.select("t", chat.unescaped(chat.escaped(F.col("t"))).alias("u"), chat.unescaped_role(chat.escaped_role(F.col("t"))).alias("r"), chat.escaped_role(F.col("t")).alias("e")).collect()
    assert all(r["t"] == r["u"] == r["r"] and ":" not in r["e"] and "###" not in r["e"] and "</turn>" not in r["e"] for r in row)
