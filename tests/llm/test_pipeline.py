import hashlib

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quern.llm import bpe, exact_dedup, language_id, mixing, near_dup, staging


def test_stages_against_each_operator(spark, sf):
    """Every stage keeps what its operator's own result says, and the tests of the operators check those by brute force."""
    docs = staging.table(spark, sf, "documents")
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    model = language_id.train(docs.where(~language_id.held_out()))
    kept = corpus_pipeline.identify_language(spark, docs, sf)
    assert ids(kept) == ids(language_id.predicted(docs, model).where("accepted"))
    first = staging.staged(kept, "t")
    kept = corpus_pipeline.drop_exact_copies(spark, first, sf)
    assert ids(kept) == ids(exact_dedup.exact_groups(first).where("kept"))
    second = staging.staged(kept, "t")
    kept = corpus_pipeline.drop_near_copies(spark, second, sf)
    assert ids(kept) == ids(near_dup.near_duplicates(second).where("kept"))
    third = staging.staged(kept, "t")
    kept = corpus_pipeline.mix_sources(spark, third, sf)
    assert ids(kept) == ids(mixing.mixed(third).where("selected"))
    fourth = staging.staged(kept, "t")
    last = {r["doc_id"]: r for r in corpus_pipeline.encode_tokens(spark, fourth, sf).collect()}
    assert all(x.columns == docs.columns for x in (first, second, third, fourth))
    assert sorted(last) == ids(fourth)
    library = Tokenizer.from_file(bpe.default_path())
    for r in fourth.collect():
        found = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert last[r["doc_id"]]["n_tokens"] == len(found)
        assert last[r["doc_id"]]["ids_sha256"] == hashlib.sha256(" ".join(map(str, found)).encode()).hexdigest()
    whole = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert whole == last


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_and_empty_tables(spark, odd, none, stage):
    name, step = corpus_pipeline.STAGES[stage]
    for docs in (odd, none):
        got = step(spark, docs, "")
        assert stage == 4 or got.columns == docs.columns
        assert got.count() <= docs.count(), name


def test_registered(spark):
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and {f"op{n}_" for n in range(1, 11)} <= {q.split("_")[0] + "_" for q in entry.queries()}
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_columns_with_the_names_that_helpers_use(spark):
    """Extra columns keep their values through every stage, whatever they are called."""
    docs = spark.range(60).selectExpr(
        "id AS doc_id", "concat('the cat and the dog number ', id % 50, ' went to the market and bought ', id % 50, ' apples') AS text", "'en' AS lang", "concat('s', id % 3) AS source", "60L AS n_chars",
        "id * 2 AS __id", "id * 3 AS __gone", "id * 5 AS h1", "id * 7 AS row", "id * 11 AS place", "id * 13 AS arrival", "id * 17 AS left",
    )
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        kept = staging.staged(stage(spark, kept, ""), "t")
        assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0
    assert 0 < kept.count() <= 50
