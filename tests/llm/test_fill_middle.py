import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import fill_middle as f

LINE = re.compile(r"[^\n]*\n|[^\n]+")


def brute(doc_id, text, seed="7", rate=100, spm=50):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    lines = LINE.findall(text)
    n = len(lines)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("a\n\r<PSM>é\u2028日👩 \x0b\x0c\x85")), st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), st.integers(0, 100), st.integers(0, 100))
def test_transform(text, doc_id, rate, spm):
    n, form, prefix, middle, output = f.transform(text.encode(), f.draws("7", doc_id), rate, spm)
    assert (n, form, prefix, middle, output.decode()) == brute(doc_id, text, "7", rate, spm)


@given(st.integers(0, 2**200), st.integers(0, 210))
def test_ranked(vector, k):
    places = [i for i in range(200) if vector >> i & 1]
    assert f.ranked(vector % 2**200, 200, k) == (places[k] if k < len(places) else 200)


def test_rows(spark, odd):
    extra = [(20, "one\ntwo\n\nthree" * 9), (21, "\n\n\n"), (22, "holds <P> a mark\n"), (23, "<"), (24, "S>\n<S\nM>\n<M\n>"), (25, "x\n" * 100_000), (26, "no line end" * 50_000), (26, "again\n")]
    docs = odd.select("doc_id", "text", "n", "rank").unionByName(spark.createDataFrame([(*r, 1, 2) for r in extra], "doc_id long, text string, n int, rank int"))
    rows = docs.collect()
    for settings_ in ({}, {"seed": "x", "rate": 40, "spm": 10}):
        got = [tuple(r) for r in f.transformed(docs, **settings_).collect()]
        assert sorted(got, key=repr) == sorted(((r["doc_id"], *brute(r["doc_id"], r["text"], **settings_)) for r in rows), key=repr)
        done = f.transformed(docs, **settings_).select("doc_id", f.restored(f.F.col("output"), f.F.col("form")).alias("text"))
        assert sorted(map(repr, map(tuple, done.collect()))) == sorted(repr((r["doc_id"], r["text"] or "")) for r in rows)


def test_query(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {tuple(r) for r in f.op12_fill_middle(spark, sf).collect()}
    assert got == {(i, n, form, a, b, sha(out), sha(t)) for i, t in docs.items() for n, form, a, b, out in [brute(i, t)]}


def test_empty(none):
    assert f.transformed(none).count() == 0
