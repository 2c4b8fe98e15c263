import unicodedata
import zlib

import numpy as np

from quern.llm import language_id as li, staging


def test_held_out_accuracy_and_calibration(spark, sf):
    docs = staging.table(spark, sf, "documents")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = li.op5_language_id(spark, sf).collect()
    assert len(got) == len(lang)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)
    judged = [r for r in held if lang[r["doc_id"]] and r["lang_pred"] != "und"]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in judged]) >= 0.95


def test_predictions_ignore_labels(spark, odd):
    model = li.train(odd)
    got = sorted(map(repr, li.predicted(odd, model).collect()))
    assert got == sorted(map(repr, li.predicted(odd.selectExpr("doc_id", "text"), model).collect()))
    by_text = {}
    text = {r["doc_id"]: r["text"] for r in odd.where("doc_id IS NOT NULL").collect()}
    for r in li.predicted(odd.where("doc_id IS NOT NULL"), model).collect():
        by_text.setdefault(text[r["doc_id"]], set()).add((r["lang_pred"], round(r["score"], 9)))
    assert all(len(v) == 1 for v in by_text.values())
    assert by_text[None] == by_text[""] == by_text["123 456 !!"] == {("und", 0.0)}


def test_without_rows_or_labels(odd, none):
    model = li.train(none)
    assert {r["lang_pred"] for r in li.predicted(odd, model).collect()} == {"und"}
    assert li.train(odd.selectExpr("doc_id", "text", "CAST(null AS string) AS lang")).languages == ()
    assert li.predicted(none, li.train(odd)).count() == 0
    assert li.keep_identified(none).count() == 0


def test_rejection_threshold_bounds_the_error():
    draw = np.random.default_rng(1)
    logits = draw.normal(0, 2, (6000, 3))
    label = (draw.random((6000, 1)) > np.cumsum(li._softmax(logits), 1)).sum(1)
    scores = logits * 3  # three times too sure
    t, least = li.calibrated(scores, label, 0.02)
    assert abs(t - 3) < 0.4
    p = li._softmax(scores / t)
    kept = p.max(1) >= least
    surest = np.argsort(-p.max(1))[:3000]
    assert kept.mean() > 0.5 and (p.argmax(1) != label)[kept].mean() <= (p.argmax(1) != label)[surest].mean() + 0.021
    top = p.max(1)
    for low in np.arange(0.4, 1, 0.1):  # scores are probabilities
        at = (top >= low) & (top < low + 0.1)
        if at.sum() > 200:
            assert abs((p.argmax(1) == label)[at].mean() - top[at].mean()) < 0.08


def test_wrong_labels_do_not_reject_right_documents():
    """A twentieth of all labels are wrong at every score: no threshold mends that, so nothing sure is rejected."""
    draw = np.random.default_rng(2)
    label = draw.integers(0, 4, 5000)
    scores = np.eye(4)[label] * draw.uniform(6, 9, (5000, 1))
    wrong = draw.random(5000) < 0.05
    label[wrong] = (label[wrong] + 1) % 4
    t, least = li.calibrated(scores, label, 0.02)
    assert (li._softmax(scores / t).max(1) >= least).mean() > 0.99


def test_rows_stay_or_go_by_themselves(spark):
    """A text without a letter takes no other text of its doc_id, or without one, along."""
    rows = [(i, "the cat and the dog " * 5 if i % 2 else "der Hund und die Katze " * 5, "en" if i % 2 else "de") for i in range(80)]
    bad = [(None, "123", None), (3, "!!", None), (None, None, "en")]
    more = [(None, "the dog and the cat " * 5, None), (None, "the dog and the cat " * 5, None)]
    docs = spark.createDataFrame(rows + bad + more, "doc_id long, text string, lang string")
    assert sorted(map(tuple, li.keep_identified(docs).collect()), key=repr) == sorted(rows + more, key=repr)


def plainly(model, text):
    """A prediction without memo and arrays: every subword of every word, hashed one by one."""
    total, n = np.zeros(len(model.languages)), 0
    for word in (text or "").split():
        word = "".join(c for c in word if unicodedata.category(c)[0] in "LM").lower()
        points = [ord(c) for c in f"<{word}>"] if word else []
        for size in range(2, 5):
            for at in range(len(points) - size + 1):
                code = 0
                for k, p in enumerate(points[at : at + size], 1):
                    code = (code * 0x9E3779B97F4A7C15 + p + k ^ code >> 29) & (1 << 64) - 1
                total += model.table[(code * 0xD6E8FEB86659FD93 & (1 << 64) - 1) >> 48]
                n += 1
    z = (total / max(n, 1) + model.bias) / model.temperature
    p = np.exp(z - z.max())
    return model.languages[int(p.argmax())], float(p.max() / p.sum())


def test_predictions_against_a_plain_restatement(spark, sf, odd):
    docs = staging.table(spark, sf, "documents")
    model = li.train(docs.where(~li.held_out()))
    for df in (docs, odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])):
        text = {r["doc_id"]: r["text"] for r in df.collect()}
        for r in li.predicted(df, model).collect():
            t = text[r["doc_id"]]
            if t is None or not any(unicodedata.category(c)[0] == "L" for c in t):
                assert (r["lang_pred"], r["score"], r["accepted"]) == ("und", 0.0, False)
            else:
                lang, score = plainly(model, t)
                assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-5
                assert r["accepted"] == (r["score"] >= model.threshold)


def test_every_label_can_be_learned(spark):
    """More labels than a thousand, each with a word of its own."""
    docs = spark.range(3300).selectExpr("id AS doc_id", "repeat(concat('q', translate(cast(id % 1100 AS string), '0123456789', 'abcdefghij'), 'z '), 6) AS text", "concat('l', id % 1100) AS lang")
    model = li.train(docs)
    assert len(model.languages) == 1100
