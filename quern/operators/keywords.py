"""Classification by keyword tables of any size, which are joined with the texts instead of being tried one by one.

A table is a DataFrame of keyword, label and place (its order; smaller ones were listed first), and weight where rules
weigh. Texts are cut into what a keyword could be, and one equi-join with the table finds those that are one, so the work
grows with the texts and not with the keywords:

``as words``       every run of words that a form (keyword, its plural in s or es) may be, from every word on
``as substrings``  the text from every character on; joined by the first KEY characters, then compared in full

The rows of a text meet again in one aggregation by its key, to which every task sends one row a text (and label), so frequent
keywords cost nothing more. Tables of up to BROADCAST_ROWS rows are broadcast; larger ones are shuffled by keyword.

Defined results: texts and keywords are compared in lower case, each run of white space as one space, trimmed. Null and blank
keywords match nothing. Of a keyword listed twice the first place counts, with the label of that place. ``key`` must be
unique. Columns of the documents besides the key and the texts are not read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY, BROADCAST_ROWS = 4, 200_000
PART = "[a-z]++|[^a-z]"  # a word, or a character that is of none
WHOLE = r"(?![\uDC00-\uDFFF])"  # not inside a character
BETWEEN = "\u0001"  # stands between the texts of a list; no keyword holds it


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def table_of(spark: SparkSession, rules: Mapping[str, str] | Mapping[str, Sequence[str]] | Mapping[str, Mapping[str, float]]) -> DataFrame:
    """A table of {keyword: label}, {label: keywords} or {label: {keyword: weight}}, in the order given."""
    rows: list[tuple] = []
    for a, b in rules.items():
        pairs = [(a, b, 1.0)] if isinstance(b, str) else [(k, a, float(b[k]) if isinstance(b, Mapping) else 1.0) for k in b]
        rows += [(*p, len(rows) + i) for i, p in enumerate(pairs)]
    return spark.createDataFrame(rows, "keyword string, label string, weight double, place long")


def tidy(table: DataFrame, per_label: bool = False) -> DataFrame:
    """keyword, label, weight, place: keywords normalised, of repeated ones (of a label, with ``per_label``) the first."""
    weight = F.col("weight") if "weight" in table.columns else F.lit(1.0)
    rows = table.select(normalised(F.col("keyword")).alias("keyword"), "label", weight.cast("double").alias("weight"), F.col("place").cast("long").alias("place")).where("keyword <> ''")
    first = F.min(F.struct("place", "label", "weight")).alias("first")
    return rows.groupBy("keyword", *["label"] * per_label).agg(first).select("keyword", "first.label", "first.weight", "first.place")


def _small(table: DataFrame) -> DataFrame:
    """``table``, broadcast if it has BROADCAST_ROWS rows at most."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def by_words(docs: DataFrame, key: str, text: Column, table: DataFrame) -> DataFrame:
    """``key``, keyword, label, weight, place: a row a keyword that the text has as a word or its plural, with no a-z letter on either
    side."""
    forms = tidy(table).withColumn("form", F.explode(F.array("keyword", F.concat("keyword", F.lit("s")), F.concat("keyword", F.lit("es")))))
    lengths = [r[0] for r in forms.select(F.size(F.regexp_extract_all("form", F.lit(f"(?s){PART}"), F.lit(0))).alias("n")).distinct().collect()]  # as many as the longest keyword has words at most
    t = normalised(text)
    runs = [F.regexp_extract_all(t, F.lit(f"(?s)(?<![a-z]){WHOLE}(?=((?:{PART}){{{n}}})(?![a-z]))"), F.lit(1)) for n in sorted(lengths)]
    grams = docs.select(F.col(key), F.explode(F.array_distinct(F.concat(*runs)) if runs else F.array().cast("array<string>")).alias("gram"))
    return grams.join(_small(forms), F.col("gram") == F.col("form")).drop("gram", "form")


def by_substring(docs: DataFrame, key: str, texts: Column, table: DataFrame, per_label: bool = False) -> DataFrame:
    """The same for keywords that are a plain substring of one of ``texts``, an array; with repeated rows for one found again."""
    rows = tidy(table, per_label).withColumn("head", F.substring("keyword", 1, KEY))
    longest, heads = rows.agg(F.max(F.char_length("keyword")), F.collect_set(F.char_length("head"))).first()
    joined = F.array_join(F.transform(texts, normalised), BETWEEN)
    ahead = F.array_distinct(F.regexp_extract_all(joined, F.lit(f"(?s){WHOLE}(?=(.{{1,{longest or 1}}}))"), F.lit(1)))
    places = docs.select(F.col(key), F.explode(ahead).alias("ahead"))
    begins = F.array_distinct(F.array(*[F.substring("ahead", 1, n) for n in sorted(heads)]).cast("array<string>"))
    places = places.select(key, "ahead", F.explode(begins).alias("begins"))
    return places.join(_small(rows), (F.col("begins") == F.col("head")) & F.startswith("ahead", "keyword")).drop("ahead", "begins", "head")


def _picked(docs: DataFrame, key: str, hits: DataFrame, pick: Column, names: Sequence[str]) -> DataFrame:
    """The fields ``names`` of ``pick``, an aggregate of structs, for every key; null for those without hits."""
    found = hits.groupBy(key).agg(pick.alias("p")).select(key, *[F.col(f"p.{n}").alias(n) for n in names])
    return docs.select(key).join(found, key, "left")


def longest(docs: DataFrame, key: str, title: Column, table: DataFrame, vocabulary: Sequence[str] | None = None) -> DataFrame:
    """``key``, keyword, label: the longest keyword that the title has as a word or its plural, of equally long ones the first listed.

    A label outside the vocabulary is null though its keyword is found: compounds are listed to shadow their parts.
    """
    hits = by_words(docs, key, title, table)
    order = F.struct((-F.char_length("keyword")).alias("n"), "place", "keyword", "label")
    got = _picked(docs, key, hits, F.min(order), ["keyword", "label"])
    return got if vocabulary is None else got.withColumn("label", F.when(F.col("label").isin(list(vocabulary)), F.col("label")))


def first(docs: DataFrame, key: str, title: Column, table: DataFrame, default: str = "other") -> DataFrame:
    """``key``, label: that of the first keyword listed that is a substring of the title, else ``default``."""
    hits = by_substring(docs, key, F.array(title), table)
    got = _picked(docs, key, hits, F.min(F.struct("place", "label")), ["label"])
    return got.withColumn("label", F.coalesce("label", F.lit(default)))


def _best(docs: DataFrame, key: str, hits: DataFrame, least: float, default: str | None) -> DataFrame:
    """``key``, label, score: the label with the highest sum of its keywords' weights, each keyword once; of equals the one whose first
    keyword in the table stands first. ``default`` where no sum reaches ``least``."""
    scores = hits.groupBy(key, "label", "keyword").agg(F.max("weight").alias("weight"), F.min("rank").alias("rank")).groupBy(key, "label").agg(F.sum("weight").alias("score"), F.min("rank").alias("rank"))
    got = _picked(docs, key, scores, F.min(F.struct((-F.col("score")).alias("less"), "rank", "label", "score")), ["label", "score"])
    enough = F.coalesce(F.col("score") >= least, F.lit(False))
    return got.select(key, F.when(enough, F.col("label")).otherwise(F.lit(default)).alias("label"), F.coalesce("score", F.lit(0.0)).alias("score"))


def _hits_by_label(docs: DataFrame, key: str, texts: Column, table: DataFrame) -> DataFrame:
    """The hits, each with the ``rank`` of its label: the place of the label's first keyword."""
    ranks = tidy(table, per_label=True).groupBy("label").agg(F.min("place").alias("rank"))
    return by_substring(docs, key, texts, table, per_label=True).join(_small(ranks), "label")


def weighted(docs: DataFrame, key: str, terms: Column, table: DataFrame, least: float = 3.0) -> DataFrame:
    """``key``, label, score: the label with the highest sum of weights of keywords that are part of one of the terms, each once;
    null below ``least``."""
    return _best(docs, key, _hits_by_label(docs, key, terms, table), least, None)


def counted(docs: DataFrame, key: str, title: Column, terms: Column, table: DataFrame, default: str = "Unknown") -> DataFrame:
    """``key``, label, score: the label with most keywords in title and terms written one after the other."""
    both = F.concat_ws(" ", title, F.array_join(terms, " "))
    plain = table.select("keyword", "label", "place", F.lit(1.0).alias("weight"))
    return _best(docs, key, _hits_by_label(docs, key, F.array(both), plain), 1, default)


def title_or_terms(docs: DataFrame, key: str, title: Column, terms: Column, titles: DataFrame, ingredients: DataFrame, vocabulary: Sequence[str], least: float = 3.0) -> DataFrame:
    """``key``, label: by the longest keyword of the title; titles without one by the weights of their terms; null for blank titles,
    and for keywords whose label is not of the vocabulary, which do not fall through to the terms."""
    by_title = longest(docs, key, title, titles).withColumnRenamed("label", "titled")
    by_terms = weighted(docs, key, terms, ingredients, least).select(key, F.col("label").alias("termed"))
    named = F.when(F.col("titled").isin(list(vocabulary)), F.col("titled"))
    blank = docs.select(key, (F.coalesce(normalised(title), F.lit("")) == "").alias("blank"))
    label = F.when(F.col("blank"), F.lit(None)).when(F.col("keyword").isNotNull(), named).otherwise(F.col("termed"))
    return by_title.join(by_terms, key).join(blank, key).select(key, label.alias("label"))
