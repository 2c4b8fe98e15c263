"""Token counts by section: offset-mapped attribution.

A document is encoded once and whole. The tokens' byte lengths give their byte spans, a running count of leading
bytes turns those into character spans, and an interval join (binary search of token ends in the sections' sorted
starts) finds the sections that a token reaches. Rules for a token that crosses a boundary:

``largest``  all of it goes to the section it overlaps most, the earlier one of equals (the default);
``first``    all of it goes to the first section it overlaps;
``split``    each section gets the share of its characters, so counts are fractions.

A token that overlaps no section is counted under section -1, which is listed only where it has tokens; so a document's
counts always sum to its tokens. A letter that several tokens encode belongs to the span of each.

Sections are (start, end) in characters, end exclusive; they are sorted, cut to the text, and one that overlaps its
predecessor begins where that ends. Defined results: a null or empty text has no tokens and its sections, if any, count
0; a null list of sections is an empty one; repeated rows give repeated rows; columns besides doc_id, text and the
sections are not read.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quern.llm import staging
from quern.llm.words import per_worker, text_slices

RULES = ("largest", "first", "split")


class Ranks:
    """A byte-level BPE vocabulary in tiktoken's format, with the byte length of each id."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.length[i] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every token, in characters."""
        ids = np.asarray(self.encoding.encode_ordinary(text), np.int64)
        end = np.cumsum(self.length[ids])
        start = end - self.length[ids]
        if text.isascii():
            return start, end
        leads = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)  # characters begun up to each byte
        return leads[start] - 1, leads[end - 1]


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every line with its line end; an empty text has none."""
    lines = text.split("\n")
    end = np.cumsum([len(x) + 1 for x in lines])
    start = np.concatenate([[0], end[:-1]])
    end[-1] -= 1
    return (start, end) if end[-1] > start[-1] else (start[:-1], end[:-1])


def tidy(sections: list[dict] | None, length: int) -> tuple[np.ndarray, np.ndarray]:
    pairs = sorted((min(max(s["start"], 0), length), min(max(s["end"], 0), length)) for s in sections or () if s and s["start"] is not None and s["end"] is not None)
    start = np.array([p[0] for p in pairs], np.int64)
    end = np.array([p[1] for p in pairs], np.int64)
    if len(start) > 1:
        start[1:] = np.maximum(start[1:], np.maximum.accumulate(end)[:-1])
    return start, np.maximum(start, end)


def attribute(start: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts and boundary-crossing tokens of each section, that of no section last. ``first``, ``last``: the sections."""
    sections = len(first)
    count, crossing = np.zeros(sections + 1), np.zeros(sections + 1, np.int64)
    if not sections or not len(start):
        count[-1] = len(start)
        return count, crossing
    a = np.searchsorted(last, start, "right")  # the first section that ends after the token's start
    b = np.searchsorted(first, end, "left")  # one past the last section that starts before the token's end
    inside = (b == a + 1) & (first[np.minimum(a, sections - 1)] <= start) & (last[np.minimum(a, sections - 1)] >= end)
    count += np.bincount(a[inside], minlength=sections + 1)
    for t in np.flatnonzero(~inside):
        reached = np.arange(a[t], b[t])
        overlap = np.minimum(last[reached], end[t]) - np.maximum(first[reached], start[t])
        reached, overlap = reached[overlap > 0], overlap[overlap > 0]
        if not len(reached):
            count[-1] += 1
            continue
        crossing[reached] += 1
        if rule == "largest":
            count[reached[overlap.argmax()]] += 1
        elif rule == "first":
            count[reached[0]] += 1
        else:
            count[reached] += overlap / (end[t] - start[t])
            count[-1] += 1 - overlap.sum() / (end[t] - start[t])
    return count, crossing


def _attributed(batches, path: str, rule: str, by: str | None):
    ranks = per_worker(Ranks, path)
    names = ["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing"]
    for batch in text_slices(batches, 1 << 20):
        given = batch.column(by).to_pylist() if by else None
        rows, parts = [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            text = text or ""
            first, last = tidy(given[i], len(text)) if by else line_sections(text)
            count, crossing = attribute(*ranks.spans(text), first, last, rule)
            n = len(first) + (count[-1] > 0)
            rows.append(np.full(n, i))
            number = np.arange(n)
            number[len(first) :] = -1
            parts.append((number, np.append(first, 0)[:n], np.append(last, len(text))[:n], count[:n], crossing[:n]))
        number, first, last, count, crossing = (np.concatenate(x) for x in zip(*parts))
        ids = batch.column("doc_id").take(pa.array(np.concatenate(rows)))
        counts = pa.array(count) if rule == "split" else pa.array(count.astype(np.int64))
        yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), pa.array(first.astype(np.int64)), pa.array(last.astype(np.int64)), counts, pa.array(crossing)], names)


def attributed(docs: DataFrame, path: str, rule: str = "largest", sections: str | None = None) -> DataFrame:
    """One row per document and section: doc_id, section, start_char, end_char, n_tokens, n_crossing.

    ``sections`` names a column of array<struct<start,end>>; without it a document's lines are its sections.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind = docs.schema["doc_id"].dataType.simpleString()
    count = "double" if rule == "split" else "long"
    schema = f"doc_id {kind}, section int, start_char long, end_char long, n_tokens {count}, n_crossing long"
    return staging.small_batches(docs.select("doc_id", "text", *[sections] * bool(sections))).mapInArrow(functools.partial(_attributed, path=path, rule=rule, by=sections), schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributed(staging.table(spark, sf_dir, "documents"), default_path())
