import pytest
import tiktoken  # noqa: F401

from quern.llm import staging, token_counts as tc


@pytest.fixture(scope="module")
def ranks():
    return tc.Ranks(tc.default_path())


def brute(ranks, text, sections, rule):
    """Spans token by token from the decoded bytes, and every section tried for every token."""
    ids, spans, at = ranks.encoding.encode_ordinary(text), [], 0
    raw = text.encode()
    for i in ids:
        n = len(ranks.encoding.decode_single_token_bytes(i))
        inside = [k for k, c in enumerate(raw[: at + n]) if c & 0xC0 != 0x80]
        start = len([k for k in inside if k <= at]) - 1
        spans.append((start, len(inside)))
        at += n
    count = [0.0] * (len(sections) + 1)
    for a, b in spans:
        overlap = [max(0, min(b, y) - max(a, x)) for x, y in sections]
        if not any(overlap):
            count[-1] += 1
        elif rule == "largest":
            count[overlap.index(max(overlap))] += 1
        elif rule == "first":
            count[next(i for i, o in enumerate(overlap) if o)] += 1
        else:
            for i, o in enumerate(overlap):
                count[i] += o / (b - a)
            count[-1] += 1 - sum(overlap) / (b - a)
    return count, len(ids)


TEXT = "Héllo wörld! 日本語テキスト\n👩‍👩‍👧 and some more words, internationalization  x\n\nlast line"


@pytest.mark.parametrize("rule", tc.RULES)
@pytest.mark.parametrize("sections", [[(0, 3), (3, 20), (25, 60)], [(2, 4), (4, 5), (5, 6), (6, 7)], [], [(0, len(TEXT))], [(50, 50), (52, 52)]])
def test_attribution_matches_brute_force(spark, ranks, rule, sections):
    df = spark.createDataFrame([(1, TEXT, [{"start": a, "end": b} for a, b in sections])], "doc_id long, text string, parts array<struct<start:int,end:int>>")
    got = {r["section"]: r["n_tokens"] for r in tc.attributed(df, tc.default_path(), rule, "parts").collect()}
    want, n = brute(ranks, TEXT, sections, rule)
    assert {k: v for k, v in got.items() if k >= 0} == pytest.approx(dict(enumerate(want[:-1])))
    assert got.get(-1, 0) == pytest.approx(want[-1]) and sum(got.values()) == pytest.approx(n)


def test_overlapping_and_outside_sections(spark):
    df = spark.createDataFrame([(1, "one two three", [{"start": 4, "end": 99}, {"start": -3, "end": 6}, None])], "doc_id long, text string, parts array<struct<start:int,end:int>>")
    got = sorted((r["section"], r["start_char"], r["end_char"], r["n_tokens"]) for r in tc.attributed(df, tc.default_path(), sections="parts").collect())
    assert got == [(0, 0, 6, 2), (1, 6, 13, 1)]  # three of the four characters of ' two' are in the first


def test_odd_rows(odd, none, ranks):
    got = tc.attributed(odd, tc.default_path()).groupBy("doc_id").sum("n_tokens").collect()
    want = {}
    for r in odd.collect():
        if r["text"]:
            want[r["doc_id"]] = want.get(r["doc_id"], 0) + len(ranks.encoding.encode_ordinary(r["text"]))
    assert {r[0]: r[1] for r in got} == want
    assert tc.attributed(none, tc.default_path()).count() == 0
    with pytest.raises(ValueError):
        tc.attributed(odd, tc.default_path(), "last")


def test_query_sums_to_whole_encodings(spark, sf, ranks):
    got = {r[0]: r[1] for r in tc.op1_token_counts(spark, sf).groupBy("doc_id").sum("n_tokens").collect()}
    assert got == {r["doc_id"]: len(ranks.encoding.encode_ordinary(r["text"])) for r in staging.table(spark, sf, "documents").collect() if r["text"]}
