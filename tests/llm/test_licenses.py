import random

import numpy as np
import pytest

from quern.llm import licenses as li, staging


def test_templates_are_found_in_noise(spark):
    draw, rows = random.Random(1), []
    for i, (name, text) in enumerate(li.TEMPLATES.items()):
        around = [f"noise{draw.randrange(500)}" for _ in range(400)]
        at = draw.randrange(400)
        rows.append((i, " ".join(around[:at]) + " " + text + " " + " ".join(around[at:]), name))
    got = li.scanned(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()
    for i, text, name in rows:
        mine = [r for r in got if r["doc_id"] == i and r["license"] == name]
        assert len(mine) == 1 and mine[0]["coverage"] == 1.0
        assert text[mine[0]["start_char"] : mine[0]["end_char"]] == li.TEMPLATES[name]


def test_edited_copies_and_repeats(spark):
    words = li.TEMPLATES["mit"].split()
    del words[20]
    words[40:40] = ["truly", "yours"]
    words[60] = "SOMETHING"
    edited = " ".join(words).upper().replace(".", " .")
    df = spark.createDataFrame([(1, edited), (2, (li.TEMPLATES["cc-by-4.0"] + " zzz ") * 3), (3, " ".join(words[: len(words) // 3]))], "doc_id long, text string")
    got = li.scanned(df).collect()
    assert [r["license"] for r in got if r["doc_id"] == 1] == ["mit"] and not [r for r in got if r["doc_id"] == 3 and r["license"] == "mit"]
    assert len([r for r in got if r["doc_id"] == 2 and r["license"] == "cc-by-4.0"]) == 3


def whole_alignment(template, part):
    """The whole template with the run of ``part`` that scores best, by the full table with no band."""
    table = np.zeros((len(template) + 1, len(part) + 1), object)
    table[:] = [[(-i, 0, 0, 0)] * (len(part) + 1) for i in range(len(template) + 1)]
    less = lambda cell: (cell[0] - 1, *cell[1:])
    for i in range(1, len(template) + 1):
        for j in range(1, len(part) + 1):
            s, m, f, e = table[i - 1, j - 1]
            met = template[i - 1] == part[j - 1]
            table[i, j] = max((s + 1, m + 1, f if m else 1 - j, 1 - j) if met else less((s, m, f, e)), less(table[i - 1, j]), less(table[i, j - 1]))
    _, m, f, e = max(table[-1])
    return m, -f, -e


@pytest.mark.parametrize("seed", range(6))
def test_band_matches_the_full_table_near_its_diagonal(seed):
    draw = np.random.default_rng(seed)
    template = draw.integers(1, 30, 40)
    part = np.concatenate([draw.integers(31, 60, 12), np.delete(template, [5, 17]), draw.integers(31, 60, 9)])
    part[25] = 61
    m, a, b = li.align(template, part, 12 - li.BAND, 12 + li.BAND)
    assert (m, a, b) == whole_alignment(template.tolist(), part.tolist())


def test_odd_rows(odd, none, spark, sf):
    assert li.scanned(odd).count() == 0 and li.scanned(none).count() == 0
    docs = {r["doc_id"]: r["text"] or "" for r in staging.table(spark, sf, "documents").collect()}
    got = {(r["doc_id"], r["license"]) for r in li.op8_license_scan(spark, sf).collect()}
    for i, text in docs.items():  # verbatim templates by a plain search
        for name, template in li.TEMPLATES.items():
            if f" {template} " in f" {' '.join(text.split())} ":
                assert (i, name) in got


@pytest.fixture(scope="module")
def index():
    return li.Index(tuple(sorted(li.TEMPLATES.items())))


def test_templates_among_other_license_words(index):
    """Each template in 300 contexts of words that templates have too, so that fingerprints compete."""
    draw, vocabulary = random.Random(7), sorted(index.code)
    for t, name in enumerate(index.names):
        words = li.TEMPLATES[name].split()
        for _ in range(300 if len(words) < 30 else 20):
            before, after = (draw.choices(vocabulary, k=draw.randrange(12)) for _ in range(2))
            found = index.matches([*before, *words, *after], li.FLOOR)
            assert any(m[0] == t and m[1] == 1.0 for m in found), (name, before, after)


@pytest.mark.parametrize("times", [20, 100, 3000])
def test_repeats_have_a_row_each(index, times):
    for t, name in enumerate(index.names):
        words = li.TEMPLATES[name].split()
        if len(words) * times > 20_000:
            continue
        found = [m for m in index.matches(words * times, li.LEAST) if m[0] == t]
        assert len(found) == times and all(m[1] == 1.0 for m in found), name
        assert [m[3] for m in found] == [i * len(words) for i in range(times)], name


def test_against_the_alignment_of_every_template_with_every_text(index):
    """Edited copies of at most 40 words: whoever passes by the whole table is found, with no fewer matched words."""
    draw, small = random.Random(11), [(t, n) for t, n in enumerate(index.names) if len(index.templates[t]) <= 40]
    vocabulary = sorted(index.code)
    for _ in range(60):
        t, name = draw.choice(small)
        words = li.TEMPLATES[name].split()
        for _ in range(draw.randrange(1 + len(words) // 7)):
            at = draw.randrange(len(words))
            words[at : at + draw.randrange(2)] = [draw.choice(["foo", draw.choice(vocabulary)])]
        text = [*draw.choices(vocabulary, k=5), *words, *draw.choices(vocabulary, k=5)]
        code = index.numbers(text)
        found = index.matches(text, li.FLOOR)
        for u, _ in small:
            m, a, b = whole_alignment(index.templates[u].tolist(), code[code >= 0].tolist())
            if m >= li.LEAST * len(index.templates[u]):
                assert max((f[2] for f in found if f[0] == u), default=0) >= m


def test_parts_of_a_license_are_reported_below_the_threshold(spark):
    half = " ".join(li.TEMPLATES["mit"].split()[:110])
    templates = spark.createDataFrame([("mine", "one two three four five six seven eight nine ten"), ("none", None)], "name string, text string")
    docs = spark.createDataFrame([(1, half), (2, "zero one two three four five six eleven"), (3, "one two nothing")], "doc_id long, text string")
    got = {(r["license"], r["passes"]): r["coverage"] for r in li.scanned(docs).collect() if r["doc_id"] == 1}
    assert 0.6 < got["mit", False] < 0.85
    own = li.scanned(docs, templates).collect()
    assert [(r["doc_id"], r["license"], r["n_matched"], r["passes"]) for r in own] == [(2, "mine", 6, False)]
    with pytest.raises(ValueError):
        li.scanned(docs, templates.selectExpr("name", "repeat(coalesce(text, 'x'), 4000000) AS text"))


def test_one_word_exchanged_anywhere(index):
    """Each word of each template, the first and the last too, exchanged for another or left out: all others are matched."""
    for t, name in enumerate(index.names):
        words = li.TEMPLATES[name].split()
        places = range(len(words)) if len(words) <= 60 else [*range(4), len(words) // 2, *range(len(words) - 4, len(words))]
        for at in places:
            if len(words) - 1 < li.LEAST * len(words):
                continue
            for instead in (["nonesuch"], ["the"], []):
                text = ["zzz", *words[:at], *instead, *words[at + 1 :], "zzz"]
                best = max((m for m in index.matches(text, li.LEAST) if m[0] == t), key=lambda m: m[2], default=None)
                same = instead == ["the"] and words[at].lower() == "the"
                assert best is not None and best[2] == len(index.templates[t]) - (not same), (name, at, instead)
