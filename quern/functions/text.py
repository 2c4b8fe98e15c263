"""Text expressions: all are built-in column functions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPECIAL = re.compile(r"([\\.^$|()\[\]{}*+?\-])")


def escaped(words: Sequence[str]) -> str:
    """One alternation of literal words."""
    return "|".join(SPECIAL.sub(r"\\\1", w) for w in words)


def title_normalized(title: Column) -> Column:
    """Lower case, only ASCII letters, digits and spaces, trimmed; inner runs of spaces stay."""
    return F.lower(F.trim(F.regexp_replace(title, "[^a-zA-Z0-9 ]", "")))


def dedup_key(title: Column) -> Column:
    return F.lower(F.trim(title))


def one_space(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def join_non_empty(separator: str, *parts: Column) -> Column:
    """Join those parts that are neither null nor empty."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), separator)


def ensure_list(value: Column, default: Column | None = None) -> Column:
    """A comma-separated string as a list of trimmed, non-blank items; null or blank gives ``default`` (an empty list)."""
    items = F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(items) > 0, items).otherwise(F.array().cast("array<string>") if default is None else default)


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Whether any of ``words`` is a plain substring."""
    return text.rlike(escaped(words)) if words else F.lit(False)


def word_any(text: Column, words: Sequence[str]) -> Column:
    """Whether any of ``words`` stands between word boundaries, letters of any script being word characters."""
    return text.rlike(rf"(?U)\b(?:{escaped(words)})\b") if words else F.lit(False)


def phrase_any(text: Column, words: Sequence[str]) -> Column:
    """Single words by word boundary, phrases as substrings."""
    single, phrases = [w for w in words if " " not in w], [w for w in words if " " in w]
    return word_any(text, single) | contains_any(text, phrases)


def plural_word(text: Column, word: str) -> Column:
    """``word`` or its plural in s or es, with no a-z letter on either side."""
    return text.rlike(rf"(?<![a-z]){SPECIAL.sub(r'\\\1', word)}(?:e?s)?(?![a-z])")


def deterministic_uuid(source: Column, title: Column) -> Column:
    """The MD5 of ``source::title`` in the form of a UUID."""
    return F.regexp_replace(F.md5(F.concat_ws("::", source, title)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def list_literal(cell: Column) -> Column:
    """A list literal with either quotes, else a split at line ends, semicolons or bars, else one item."""
    parsed = F.from_json(cell, "array<string>", {"allowSingleQuotes": "true"})
    parts = F.filter(F.transform(F.split(cell, r"[\n;|]"), lambda x: F.trim(x)), lambda x: x != "")
    literal = F.trim(cell).startswith("[") & parsed.isNotNull()
    return F.when(cell.isNull() | (F.trim(cell) == ""), F.array().cast("array<string>")).when(literal, parsed).otherwise(parts)
