import hashlib
import re
from collections import defaultdict

from quern.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "").encode()).hexdigest()].append(r["doc_id"])
    out = []
    for digest, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        out += [(i, least, len(ids), i == least, digest) for i in ids]
    return sorted(out, key=repr)


def test_groups_match_brute_force(odd):
    want = brute(odd.collect())
    assert sorted(map(tuple, exact_dedup.exact_groups(odd).collect()), key=repr) == want
    # the same where every group is a heavy hitter, and where the summary has too few counters to find any
    assert sorted(map(tuple, exact_dedup.exact_groups(odd, heavy_rows=1).collect()), key=repr) == want
    assert sorted(map(tuple, exact_dedup.exact_groups(odd, max_heavy=1, counters=8, heavy_rows=2).collect()), key=repr) == want


def test_a_hot_group_is_found_whole(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'same', concat('t', id div 2)) AS text")
    want = brute(docs.collect())
    assert sorted(map(tuple, exact_dedup.exact_groups(docs).collect()), key=repr) == want


def test_keep_first_keeps_columns(odd):
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 2 not in ids and 12 not in ids and 4 not in ids and {1, 3, 5, 13, 14} <= set(ids)


def test_empty(none):
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.keep_first(none).count() == 0


def test_one_row_of_a_group_stays_whatever_the_ids(spark):
    """Rows without doc_id, rows that share one, and copies that repeat the winner's."""
    rows = [(None, "a", "x"), (None, "a", "x"), (None, "b", "x"), (None, None, "x"), (1, "c g", "x"), (1, "c g", "x"), (1, "c  g", "y"), (1, "d", "x"), (2, "d", "x"), (2, "e", "x"), (3, "c g", "x"), (3, "f", "x"), (None, "f", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for heavy in ({}, {"heavy_rows": 1}):
        got = [(r["doc_id"], (r["text"] or "").replace("  ", " ")) for r in exact_dedup.keep_first(docs, **heavy).collect()]
        assert sorted(got, key=repr) == sorted([(None, "a"), (None, "b"), (None, ""), (1, "c g"), (1, "d"), (2, "e"), (3, "f")], key=repr)
