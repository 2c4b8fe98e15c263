"""Keyword classification. Rule tables are data: (keyword, label) pairs or label -> keywords."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import text


def first_rule(title: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str = "other") -> Column:
    """The label of the first rule with a keyword that is a plain substring of the lower-cased title."""
    t = F.lower(F.coalesce(title, F.lit("")))
    found = F
    for label, words in rules:
        found = found.when(text.contains_any(t, words), F.lit(label))
    return found.otherwise(F.lit(default))


def longest_keyword(title: Column, rules: Sequence[tuple[str, str]], vocabulary: Sequence[str] | None = None) -> Column:
    """The label of the longest keyword that the title has as a word or its plural; of equally long ones the first listed.

    A label outside the vocabulary gives null: compounds are listed to shadow their parts. Null and blank titles give null.
    """
    t = text.one_space(title)
    found = F.when(F.coalesce(t, F.lit("")) == "", F.lit(None).cast("string"))
    for word, label in sorted(rules, key=lambda r: -len(r[0])):
        known = vocabulary is None or label in vocabulary
        found = found.when(text.plural_word(t, word.lower()), F.lit(label if known else None).cast("string"))
    return found


def has_keyword(title: Column, words: Sequence[str]) -> Column:
    """Whether the title has any of the keywords as a word or its plural."""
    t = text.one_space(F.coalesce(title, F.lit("")))
    return t.rlike(rf"(?<![a-z])(?:{text.escaped([w.lower() for w in words])})(?:e?s)?(?![a-z])")


def best(scores: Sequence[tuple[str, Column]], least: float, default: str | None = None) -> Column:
    """The label of the highest score, the first listed of equals; ``default`` where that is below ``least``."""
    top = F.greatest(*[s for _, s in scores]) if len(scores) > 1 else scores[0][1]
    found = F.when(top < least, F.lit(default).cast("string"))
    for label, s in scores:
        found = found.when(s == top, F.lit(label))
    return found


def weighted_terms(terms: Column, table: Mapping[str, Mapping[str, float]], least: float = 3.0) -> Column:
    """The label with the highest sum of weights of its terms in ``terms``; each term counts once."""
    lower = F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    score = lambda words: sum((F.when(F.array_contains(lower, w.lower()), F.lit(float(k))).otherwise(0.0) for w, k in words.items()), F.lit(0.0))
    return best([(label, score(words)) for label, words in table.items()], least)


def title_and_terms(title: Column, terms: Column, title_words: Mapping[str, Sequence[str]], term_words: Mapping[str, Sequence[str]], least: int = 2) -> Column:
    """+3 for a title keyword, +1 for a keyword in title or terms; below ``least`` Other. Labels of the title table win ties."""
    t = F.lower(F.coalesce(title, F.lit("")))
    both = F.concat_ws(" ", t, F.lower(F.array_join(terms, " ")))
    labels = [*title_words, *[k for k in term_words if k not in title_words]]
    hits = lambda where, words, k: sum((F.when(where.contains(w), F.lit(k)).otherwise(0) for w in words), F.lit(0))
    scores = {k: hits(t, title_words.get(k, ()), 3) + hits(both, term_words.get(k, ()), 1) for k in labels}
    titled = [(k, F.when(hits(t, title_words.get(k, ()), 1) > 0, s).otherwise(-1)) for k, s in scores.items()]
    top = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    found = F.when(top < least, F.lit("Other"))
    for k, s in titled:
        found = found.when(s == top, F.lit(k))
    for k, s in scores.items():
        found = found.when(s == top, F.lit(k))
    return found


def keyword_count(title: Column, terms: Column, table: Mapping[str, Sequence[str]]) -> Column:
    """The label with most keywords in title and terms, the first listed of equals; Unknown without any."""
    both = F.lower(F.concat_ws(" ", title, F.array_join(terms, " ")))
    scores = [(k, sum((both.contains(w).cast("int") for w in words), F.lit(0))) for k, words in table.items()]
    return best(scores, 1, "Unknown")


def normalised_label(label: Column, valid: Sequence[str], aliases: Mapping[str, str]) -> Column:
    """A label of the vocabulary, by alias where needed, else Other."""
    t = F.lower(F.trim(label))
    table = {v.lower(): v for v in valid} | {k.lower(): v for k, v in aliases.items()}
    from quern.functions.numeric import lookup

    return lookup(table, t, F.lit("Other"))
