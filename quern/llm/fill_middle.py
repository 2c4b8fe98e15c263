"""Fill-in-middle transformation of documents, with big integers as bit vectors.

A text's UTF-8 bytes become two big integers with a bit a byte: ``bytes.translate`` maps each byte to the digit of its class
(line feed; first byte of a code point), and ``int`` reads the digits. Shifting the line feeds by one marks where lines
begin, ``bit_count`` counts the lines, and halving the vector by counts finds the k-th line's first byte, in time linear in
the text. Cuts fall between lines. Prefix, middle and suffix are then put in the order of the form:

``psm``    <P>prefix<S>suffix<M>middle
``spm``    <S>suffix<P>prefix<M>middle
``plain``  the text; empty ones, those that hold a mark, and those that ``rate`` leaves out

All draws come from the SHA-256 of ``seed:doc_id``, so they repeat on every run, partitioning and retry. Texts go to workers
in batches bounded by bytes, and the masks are a bit a byte.

Defined results: a null text is an empty one; a null doc_id draws as an empty one; repeated rows give repeated rows (equal
doc_ids draw alike); an empty table gives an empty result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import staging
from quern.llm.words import text_slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
LINE_FEED = bytes(ord("1") if b == 10 else ord("0") for b in range(256))
CODE_POINT = bytes(ord("0") if 0x80 <= b < 0xC0 else ord("1") for b in range(256))


def bits(data: bytes, digits: bytes) -> int:
    """Bit i tells whether byte i is of the class that ``digits`` maps to 1."""
    return int(data[::-1].translate(digits), 2) if data else 0


def line_starts(data: bytes) -> int:
    """Bit i tells whether a line (``[^\\n]*\\n`` or ``[^\\n]+`` at the end) begins at byte i."""
    return ((bits(data, LINE_FEED) << 1) | 1) & ((1 << len(data)) - 1)


def ranked(vector: int, width: int, k: int) -> int:
    """The place of the k-th set bit, from 0, of ``width`` bits; ``width`` if there are not so many."""
    if k >= vector.bit_count():
        return width
    at = 0
    while width > 1:
        half = width >> 1
        low = vector & ((1 << half) - 1)
        before = low.bit_count()
        if k < before:
            vector, width = low, half
        else:
            vector, width, k, at = vector >> half, width - half, k - before, at + half
    return at


def draws(seed: str, doc_id: int | None) -> list[int]:
    """Four numbers below 2^32."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def transform(data: bytes, drawn: list[int], rate: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, prefix_chars, middle_chars, output."""
    starts = line_starts(data)
    n = starts.bit_count()
    if not data or any(mark in data for mark in (PREFIX, SUFFIX, MIDDLE)) or drawn[2] % 100 >= rate:
        return n, "plain", None, None, data
    a, b = (ranked(starts, len(data), k) for k in sorted((drawn[0] % (n + 1), drawn[1] % (n + 1))))
    points = bits(data, CODE_POINT)
    to_a, to_b = ((points & ((1 << at) - 1)).bit_count() for at in (a, b))
    if drawn[3] % 100 < spm:
        return n, "spm", to_a, to_b - to_a, b"".join((SUFFIX, data[b:], PREFIX, data[:a], MIDDLE, data[a:b]))
    return n, "psm", to_a, to_b - to_a, b"".join((PREFIX, data[:a], SUFFIX, data[b:], MIDDLE, data[a:b]))


def _transformed(batches, seed: str, rate: int, spm: int):
    for batch in text_slices(batches):
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        rows = [transform(t or b"", draws(seed, i), rate, spm) for i, t in zip(batch.column("doc_id").to_pylist(), texts)]
        n, form, prefix, middle, output = zip(*rows)
        columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).view(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def transformed(docs: DataFrame, seed: str = "7", rate: int = 100, spm: int = 50) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, output.

    ``rate`` percent of the texts are rearranged, ``spm`` percent of those with the suffix first.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return staging.small_batches(docs.select("doc_id", "text")).mapInArrow(functools.partial(_transformed, seed=seed, rate=rate, spm=spm), schema)


def restored(output, form):
    """The text that ``output`` of ``form`` was made from. No mark occurs in the parts, so the marks split it."""
    part = F.split(output, "<[PSM]>", -1)
    first, second, middle = part[1], part[2], part[3]
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = transformed(staging.table(spark, sf_dir, "documents"))
    text = restored(F.col("output"), F.col("form"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines,
         ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM d),
k AS (
  SELECT *, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM u),
p AS (
  SELECT *, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle, array_to_string(lines[b + 1:n], '') AS suffix FROM k)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
