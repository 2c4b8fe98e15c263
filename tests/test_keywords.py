"""Keyword tables joined with texts against trying every keyword on every text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quern.operators import keywords

LETTERS = ["a", "b", "s", "e", " ", " ", "-", "é", "🍜", "\t"]


def tidy(x):
    return None if x is None else re.sub(r"[\t-\r ]+", " ", x.lower()).strip(" ")


@pytest.fixture(scope="module")
def made(spark):
    r = random.Random(5)
    word = lambda most: "".join(r.choice(LETTERS) for _ in range(r.randint(0, most)))
    rules = [(word(5), f"L{r.randint(0, 4)}", r.randint(1, 4) / 2, i) for i in range(60)]
    rules += [("Soup", "L1", 1.0, 60), ("soup", "L2", 3.0, 61), ("noodle soup", "L3", 2.0, 62), (None, "L1", 1.0, 63), ("  ", "L1", 1.0, 64), ("tomato", "L0", 1.0, 65), ("ab🍜", "L4", 1.0, 66)]
    texts = [(i, word(30), [word(6) for _ in range(r.randint(0, 4))]) for i in range(150)]
    texts += [(150, None, None), (151, "", []), (152, " \t ", [None]), (153, "Noodle  SOUPS", ["Tomatoes"]), (154, "soupy tomatoes", ["no\nodle soup", None]), (155, "x" * 30_000 + " soup", ["a" * 20_000])]
    docs = spark.createDataFrame([(*t, "own", 7.0, -1, "own") for t in texts], "id long, title string, terms array<string>, label string, weight double, place int, keyword string")
    table = spark.createDataFrame(rules, "keyword string, label string, weight double, place long")
    return texts, [(tidy(k), *v) for k, *v in rules if tidy(k)], docs, table


def one_each(rules, label=False):
    kept = {}
    for k, name, w, p in sorted(rules, key=lambda x: x[3]):
        kept.setdefault((k, name) if label else k, (k, name, w, p))
    return list(kept.values())


def is_word(k, title):
    return title is not None and re.search(rf"(?<![a-z]){re.escape(k)}(?:e?s)?(?![a-z])", tidy(title))


def longest_of(title, rules):
    return min([r for r in one_each(rules) if is_word(r[0], title)], key=lambda r: (-len(r[0]), r[3]), default=(None, None))[:2]


def best_of(texts, rules, least, default, weigh):
    rank, sums = {}, {}
    for k, label, w, p in one_each(rules, True):
        rank[label] = min(rank.get(label, p), p)
        if any(k in x for x in texts):
            sums[label] = sums.get(label, 0.0) + (w if weigh else 1.0)
    label, score = min(sums.items(), key=lambda s: (-s[1], rank[s[0]]), default=(default, 0.0))
    return label if score >= least else default, score


def rows(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_longest(made):
    texts, rules, docs, table = made
    want = {i: longest_of(t, rules) for i, t, _ in texts}
    assert rows(keywords.longest(docs, "id", F.col("title"), table)) == want
    known = {i: (k, label if label in ("L1", "L3") else None) for i, (k, label) in want.items()}
    assert rows(keywords.longest(docs, "id", F.col("title"), table, ["L1", "L3"])) == known
    assert want[153] == ("noodle soup", "L3") and want[155] == ("soup", "L1")
    assert want[154] == ("tomato", "L0")  # soupy is no soup


def test_first(made):
    texts, rules, docs, table = made
    find = lambda t: next((r[1] for r in one_each(rules) if t and r[0] in tidy(t)), "other")
    assert rows(keywords.first(docs, "id", F.col("title"), table)) == {i: (find(t),) for i, t, _ in texts}


def test_weighted_and_counted(made):
    texts, rules, docs, table = made
    want = {i: best_of([tidy(x) for x in terms or [] if x is not None], rules, 3.0, None, True) for i, _, terms in texts}
    assert rows(keywords.weighted(docs, "id", F.col("terms"), table)) == want
    assert len({label for label, _ in want.values()}) > 3
    both = {i: best_of([tidy(" ".join(x for x in [t, " ".join(x for x in terms or [] if x is not None) if terms is not None else None] if x is not None))], rules, 1, "Unknown", False) for i, t, terms in texts}
    assert rows(keywords.counted(docs, "id", F.col("title"), F.col("terms"), table)) == both


def test_title_or_terms(made):
    texts, rules, docs, table = made

    def find(title, terms):
        if not tidy(title or ""):
            return None
        keyword, label = longest_of(title, rules[::2])
        if keyword is not None:
            return label if label in ("L0", "L1", "L2") else None
        return best_of([tidy(x) for x in terms or [] if x is not None], rules, 3.0, None, True)[0]

    some = [r[3] for r in rules[::2]]
    got = keywords.title_or_terms(docs, "id", F.col("title"), F.col("terms"), table.where(F.col("place").isin(some)), table, ["L0", "L1", "L2"])
    assert rows(got) == {i: (find(t, terms),) for i, t, terms in texts}


def test_empty_tables(spark, made):
    texts, _, docs, table = made
    none = table.limit(0)
    assert set(rows(keywords.longest(docs, "id", F.col("title"), none)).values()) == {(None, None)}
    assert set(rows(keywords.first(docs, "id", F.col("title"), none)).values()) == {("other",)}
    assert set(rows(keywords.weighted(docs, "id", F.col("terms"), none)).values()) == {(None, 0.0)}
    assert keywords.longest(docs.limit(0), "id", F.col("title"), table).count() == 0


def test_tables_of_mappings(spark):
    assert [tuple(r) for r in keywords.table_of(spark, {"a": ["x", "y"], "b": {"z": 2}}).collect()] == [("x", "a", 1.0, 0), ("y", "a", 1.0, 1), ("z", "b", 2.0, 2)]
    assert [tuple(r) for r in keywords.table_of(spark, {"x": "a", "y": "b"}).collect()] == [("x", "a", 1.0, 0), ("y", "b", 1.0, 1)]


def test_large_tables_shuffle(spark, made, monkeypatch):
    texts, rules, docs, table = made
    monkeypatch.setattr(keywords, "BROADCAST_ROWS", 10)
    assert rows(keywords.longest(docs, "id", F.col("title"), table)) == {i: longest_of(t, rules) for i, t, _ in texts}
