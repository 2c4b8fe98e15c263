"""Language identification: averaged hashed subword embeddings under a linear softmax.

A word is lower-cased, stripped to its letters and bracketed by ``<`` and ``>``; its subwords are all runs of two to
four code points, hashed into ``BUCKETS`` rows. A text is the mean embedding of all its subwords, whatever its
length, and a linear softmax over that mean gives the language. Embeddings and weights are trained together by
stochastic gradient descent in numpy, on whole texts and, so that short texts work too, on short runs of their words.

The sample is bounded: about ``per_language`` labelled rows of each language, drawn by a hash of doc_id, each as the
counts of its buckets. A fourth of it is held back to calibrate: a temperature that makes scores probabilities, and
the rejection threshold, the lowest score above which the held-back error is at most ``target_error`` more than that of
the surest half, whose errors are the labels' own, and never less than one half, below which another answer is as likely.

At prediction the embeddings and the weights are multiplied into one small table of ``BUCKETS`` rows, and a worker
keeps the sum of each word it has seen, so a text costs one lookup a word.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected; rows with a null lang or
text teach nothing; without labelled rows everything is ``und``; other columns, extra ones too, are never read by a
prediction.
"""

from __future__ import annotations

import functools
import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import staging
from quern.llm.words import Memo, per_worker, text_slices

BUCKETS, WIDTH, SHORTEST, LONGEST = 1 << 16, 16, 2, 4
NOT_LETTER, LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")


def subword_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of ``words``, and of which word each is. A word without letters has none."""
    marked = ["<" + w + ">" if w else "" for w in (NOT_LETTER.sub("", w).lower() for w in words)]
    of = np.repeat(np.arange(len(marked)), [len(w) for w in marked])
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    buckets, owners = [], []
    code = np.zeros(len(points), np.uint64)
    for n in range(1, LONGEST + 1):
        if len(points) < n:
            break
        code = (code[: len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :] + np.uint64(n)) ^ (code[: len(points) - n + 1] >> np.uint64(29))
        if n >= SHORTEST:
            whole = of[: len(code)] == of[n - 1 :]
            mixed = code[whole] * np.uint64(0xD6E8FEB86659FD93)
            buckets.append((mixed >> np.uint64(64 - 16)).astype(np.int64))
            owners.append(of[: len(code)][whole])
    if not buckets:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # BUCKETS x languages: what a subword adds to each language's score before the mean
    bias: np.ndarray
    temperature: float
    threshold: float


def bag(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    buckets, _ = subword_buckets(words)
    return np.unique(buckets, return_counts=True)


def _training_bags(batches, short: int = 2, longest_run: int = 8):
    """A whole text's bag and, for each labelled row, bags of ``short`` short runs of its words."""
    for batch in text_slices(batches):
        rows = {"lang": [], "fold": [], "bucket": [], "n": []}
        for doc_id, text, lang in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "lang"))):
            words = text.split()
            draw = np.random.default_rng(zlib.crc32(str(doc_id).encode()))
            fold = int(draw.integers(4))
            runs = [words]
            for _ in range(short if len(words) > 3 else 0):
                n = int(draw.integers(2, longest_run + 1))
                at = int(draw.integers(max(1, len(words) - n + 1)))
                runs.append(words[at : at + n])
            for run in runs:
                bucket, n = bag(run)
                if len(bucket):
                    for k, v in zip(rows, (lang, fold, bucket.astype(np.int32), n.astype(np.int32))):
                        rows[k].append(v)
        yield pa.RecordBatch.from_pydict(rows, pa.schema([("lang", pa.string()), ("fold", pa.int32()), ("bucket", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))]))


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def mean_scores(table: np.ndarray, bias: np.ndarray, bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Scores of each language for bags: the mean of their subwords' rows of ``table``, plus ``bias``."""
    return np.array([(table[b] * n[:, None]).sum(0) / n.sum() + bias for b, n in bags]).reshape(len(bags), len(bias))


def log_loss(scores: np.ndarray, label: np.ndarray) -> float:
    return float(-np.log(np.maximum(_softmax(scores)[np.arange(len(label)), label], 1e-12)).mean())


def sgd(bags: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, languages: int, held: tuple = ((), ()), rate: float = 2.0, batch: int = 64, seed: int = 7, patience: int = 3):
    """Embeddings, weights and bias by stochastic gradient descent over minibatches of bags.

    Small samples are gone over more often, until the loss over the ``held`` bags and labels has not fallen by a
    thousandth for ``patience`` epochs.
    """
    draw = np.random.default_rng(seed)
    emb = draw.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = draw.normal(0, 0.3, (WIDTH, languages)).astype(np.float32), np.zeros(languages, np.float32)
    per_epoch = -(-len(bags) // batch)
    epochs = max(8, min(80, 1500 // per_epoch))
    steps, done, least, waited = epochs * per_epoch, 0, math.inf, 0
    for _ in range(epochs):
        order = draw.permutation(len(bags))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            lr, done = rate * (1 - done / steps), done + 1
            bucket = np.concatenate([bags[i][0] for i in rows])
            sizes = np.array([len(bags[i][0]) for i in rows])
            weight = np.concatenate([bags[i][1] / bags[i][1].sum() for i in rows]).astype(np.float32)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            mean = np.add.reduceat(emb[bucket] * weight[:, None], starts, axis=0)
            grad = _softmax(mean @ out + bias)
            grad[np.arange(len(rows)), label[rows]] -= 1
            back = (grad @ out.T) / len(rows)
            out -= lr * mean.T @ grad / len(rows)
            bias -= lr * grad.mean(0)
            step = np.repeat(back * np.float32(lr * len(rows) / 4), sizes, axis=0) * weight[:, None]
            by_bucket = np.argsort(bucket.astype(np.uint16), kind="stable")  # a bucket's steps are summed before it moves
            bucket = bucket[by_bucket]
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            emb[bucket[first]] -= np.add.reduceat(step[by_bucket], first, axis=0)
        if len(held[0]):
            loss = log_loss(mean_scores(emb @ out, bias, held[0]), held[1])
            waited = 0 if loss < least * 0.999 else waited + 1
            least = min(least, loss)
            if waited >= patience:
                break
    return emb, out, bias


def calibrated(scores: np.ndarray, label: np.ndarray, target_error: float) -> tuple[float, float]:
    """The temperature of least log loss on held-back rows, and the rejection threshold at that temperature."""
    if not len(label):
        return 1.0, 0.5
    loss = lambda t: -np.log(np.maximum(_softmax(scores / t)[np.arange(len(label)), label], 1e-12)).mean()
    temperature = min(np.geomspace(0.05, 20, 61), key=loss)
    p = _softmax(scores / temperature)
    top, right = p.max(1), p.argmax(1) == label
    order = np.argsort(-top, kind="stable")
    error = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    within = np.flatnonzero(error <= error[(len(order) - 1) // 2] + target_error)
    return float(temperature), max(0.5, float(top[order][within[-1]]) if len(within) else 1.0)


def train(docs: DataFrame, per_language: int = 800, target_error: float = 0.02) -> Model:
    """Fit on a bounded sample of ``docs``' labelled rows: about ``per_language`` rows of each language.

    Every label is learned, however many there are; a row goes to the driver as the counts of at most BUCKETS buckets.
    """
    spark = docs.sparkSession
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.5)
    at = (F.xxhash64(F.col("doc_id")).cast("double") / 2.0**64) + 0.5
    shares = spark.createDataFrame([(k, min(1.0, per_language / n)) for k, n in counts.items()], "lang string, share double")
    drawn = known.join(F.broadcast(shares), "lang").where(at < F.col("share")).select("doc_id", "text", "lang")
    sample = staging.small_batches(drawn).mapInArrow(_training_bags, "lang string, fold int, bucket array<int>, n array<int>").toArrow()
    languages = tuple(sorted(set(sample.column("lang").to_pylist())))
    if not languages:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.5)
    number = {k: i for i, k in enumerate(languages)}
    label = np.array([number[k] for k in sample.column("lang").to_pylist()])
    fold = np.asarray(sample.column("fold"))
    bags = [(np.asarray(b.values), np.asarray(n.values)) for b, n in zip(sample.column("bucket"), sample.column("n"))]
    fit, held = np.flatnonzero(fold != 0), np.flatnonzero(fold == 0)
    fit = fit if len(fit) else np.arange(len(bags))
    emb, out, bias = sgd([bags[i] for i in fit], label[fit], len(languages), ([bags[i] for i in held], label[held]))
    table = emb @ out
    scores = mean_scores(table, bias, [bags[i] for i in held])
    temperature, threshold = calibrated(scores, label[held], target_error)
    return Model(languages, table, bias, temperature, threshold)


class _Words:
    """Subword sums of the words that a worker has met."""

    def __init__(self, languages: int, model_key: str):
        self.memo, self.sums = Memo(), np.zeros((1024, languages + 1))

    def of(self, model: Model, texts: list[str | None]) -> np.ndarray:
        self.memo.tidy()
        words = [(t or "").split() for t in texts]
        at = [self.memo.numbers(w) for w in words]
        if new := self.memo.new:
            self.memo.new = []
            first, need = self.memo[new[0]], len(self.memo)
            if need > len(self.sums):
                self.sums = np.vstack([self.sums, np.zeros((max(need, 2 * len(self.sums)) - len(self.sums), self.sums.shape[1]))])
            bucket, owner = subword_buckets(new)
            for k in range(len(model.languages)):
                self.sums[first:need, k] = np.bincount(owner, model.table[bucket, k], len(new))
            self.sums[first:need, -1] = np.bincount(owner, minlength=len(new))
        return np.array([self.sums[i].sum(0) for i in at])


def _predict(batches, shared, key: str):
    model: Model = shared.value
    words = per_worker(_Words, len(model.languages), key)
    for batch in text_slices(batches, 1 << 20):
        texts = batch.column("text").to_pylist()
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        if model.languages:
            sums = words.of(model, texts)
            n = sums[:, -1:]
            p = _softmax((sums[:, :-1] / np.maximum(n, 1) + model.bias) / model.temperature)
            for i, (t, best) in enumerate(zip(texts, p.argmax(1))):
                if t and LETTER.search(t):
                    lang[i], score[i] = model.languages[best], float(p[i, best])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, accepted. Only doc_id and text are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of a float a language
    key = f"{zlib.crc32(model.table.tobytes()):08x}-{len(model.languages)}"
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = staging.small_batches(docs.select("doc_id", "text")).mapInArrow(functools.partial(_predict, shared=shared, key=key), f"doc_id {kind}, lang_pred string, score double")
    return found.withColumn("accepted", (F.col("lang_pred") != "und") & (F.col("score") >= model.threshold))


def held_out():
    """True for the documents whose label may not be learned from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is accepted, with all their columns; a model of ``docs``' own labels decides."""
    model = train(docs.where(~held_out()))
    rows = staging.keyed(docs).select(F.struct(staging.H1, staging.H2).alias("doc_id"), "row.text")
    return staging.keep_rows(docs, predicted(rows, model).select("doc_id.*", F.col("accepted").alias("keep")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = staging.table(spark, sf_dir, "documents")
    found = predicted(docs, train(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")
