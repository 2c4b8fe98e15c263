import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, digest string, n int, key string, rank int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns whose names operators use too."""
    words = " ".join(f"wort{i % 977}" for i in range(60_000))
    near = [f"alpha{i} beta{i * 7 % 50} gamma{i * 3 % 50}" for i in range(120)]
    rows = [
        (1, "The cat sat on the mat and looked at the dog for a while", "en", "a"),
        (2, "The cat sat on the mat and looked at the dog for a while", "en", "a"),
        (2, "The cat sat on the mat and looked at the dog for a while", "en", "a"),
        (3, None, "en", "a"),
        (4, "", None, None),
        (5, " \t\n ", "de", "b"),
        (6, "123 456 !!", "de", "b"),
        (None, "orphan text without an id", "en", None),
        (None, None, None, None),
        (7, words, "de", "b"),
        (8, words + " ende", "de", "b"),
        (9, " ".join(near), "en", "c"),
        (10, " ".join(near[:117]) + " and something else", "en", "c"),
        (11, "Straße Ünïcödé ﬁ İstanbul 日本語 テキスト 👩‍👩‍👧 é", None, "c"),
        (12, "The  cat sat\ton the mat and looked at the dog\nfor a while", "en", None),
        (13, "Only three words", "en", "a"),
        (14, "only three WORDS", "en", "a"),
        (15, "<|endoftext|> special <|startoftext|>\u0000 x  y ", "en", "a"),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), True, "x", 1, "k", 2) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
