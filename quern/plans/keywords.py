"""Classes by keyword tables of thousands of rows: titles and terms of documents against the words and pairs of ``benchmark``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import keywords
from quern.plans.catalogue import CATALOGUE, catalogue
from quern.sources.tables import table

# A keyword is a word of an item of four letters or more, or a pair of words that follow each other. Its place is where it
# stands, its label is dealt by item, so many keywords are listed twice under different labels; four labels only shadow.
LABELS, KNOWN = 17, [f"class {i}" for i in range(13)]


def keyword_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    items = table(spark, sf_dir, "benchmark").select("item_id", words.alias("words"))
    pairs = F.transform("words", lambda w, i: F.array(w, F.concat_ws(" ", w, F.get("words", i + 1))))
    rows = items.select("item_id", F.posexplode(pairs).alias("at", "pair")).select("item_id", "at", F.posexplode("pair").alias("two", "keyword")).where("length(keyword) >= 4").distinct()
    place = F.col("item_id") * 100_000 + F.col("at") * 2 + F.col("two")
    return rows.select("keyword", F.concat(F.lit("class "), F.col("item_id") % LABELS).alias("label"), (1 + F.length("keyword") % 3 * 0.5).alias("weight"), place.alias("place"))


TABLE = f"""{CATALOGUE},
i AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS words FROM benchmark),
k1 AS (SELECT item_id, unnest(words) AS w, unnest(list_concat(words[2:], [NULL])) AS follows, unnest(range(len(words))) AS pos FROM i),
k2 AS (SELECT item_id, pos, 0 AS two, w AS keyword FROM k1 UNION ALL SELECT item_id, pos, 1, CASE WHEN follows IS NULL THEN w ELSE w || ' ' || follows END FROM k1),
k AS (SELECT keyword, 'class ' || item_id % {LABELS} AS label, 1 + length(keyword) % 3 * 0.5 AS weight, item_id * 100000 + pos * 2 + two AS place FROM k2 WHERE length(keyword) >= 4),
once AS (SELECT keyword, arg_min(label, place) AS label, min(place) AS place FROM k GROUP BY keyword),
each AS (SELECT keyword, label, arg_min(weight, place) AS weight, min(place) AS place FROM k GROUP BY keyword, label),
ranks AS (SELECT label, min(place) AS rank FROM k GROUP BY label),
t AS (SELECT doc_id, trim(regexp_replace(lower(title), '[\\t-\\r ]+', ' ', 'g'), ' ') AS title, array_to_string(terms, chr(1)) AS terms,
  trim(regexp_replace(lower(title || ' ' || array_to_string(terms, ' ')), '[\\t-\\r ]+', ' ', 'g'), ' ') AS title_and_terms FROM d)"""
LONGEST = """,
parts AS (SELECT doc_id, regexp_extract_all(title, '[a-z]+|[^a-z]') AS p FROM t),
runs AS (SELECT DISTINCT doc_id, unnest(list_concat(p, list_transform(range(1, len(p) - 1), lambda x: p[x] || p[x + 1] || p[x + 2]))) AS run FROM parts),
forms AS (SELECT *, unnest([keyword, keyword || 's', keyword || 'es']) AS form FROM once),
longest AS (SELECT doc_id, arg_min(keyword, (-length(keyword), place)) AS keyword, arg_min(label, (-length(keyword), place)) AS label FROM runs JOIN forms ON run = form GROUP BY doc_id)"""


def _found_sql(name: str, text: str, rows: str) -> str:
    """The keywords of ``rows`` that are a substring of ``text``, each once a document and label."""
    return f""",
{name}_at AS (SELECT doc_id, {text} AS x, unnest(range(1, length({text}) - 2)) AS i FROM t),
{name} AS (SELECT DISTINCT doc_id, keyword, label, weight, place FROM {name}_at JOIN (SELECT *, keyword[1:4] AS head{", 1 AS weight" if rows == "once" else ""} FROM {rows}) AS r
  ON substr(x, i, 4) = head AND substr(x, i, length(keyword)) = keyword)"""


def _best_sql(name: str, hits: str, weight: str) -> str:
    return f""",
{name}_sums AS (SELECT doc_id, label, rank, CAST(sum({weight}) AS DOUBLE) AS score FROM {hits} JOIN ranks USING (label) GROUP BY ALL),
{name} AS (SELECT doc_id, arg_min(label, (-score, rank)) AS label, max(score) AS score FROM {name}_sums GROUP BY doc_id)"""


def keyword_longest(spark, sf_dir):
    return keywords.longest(catalogue(spark, sf_dir), "doc_id", F.col("title"), keyword_table(spark, sf_dir), KNOWN)


_KNOWN = f"({', '.join(repr(v) for v in KNOWN)})"
KEYWORD_LONGEST = f"WITH {TABLE}{LONGEST} SELECT doc_id, keyword, CASE WHEN label IN {_KNOWN} THEN label END AS label FROM d LEFT JOIN longest USING (doc_id)"


def keyword_first(spark, sf_dir):
    return keywords.first(catalogue(spark, sf_dir), "doc_id", F.col("title"), keyword_table(spark, sf_dir))


KEYWORD_FIRST = f"""WITH {TABLE}{_found_sql("hits", "title", "once")}, f AS (SELECT doc_id, arg_min(label, place) AS label FROM hits GROUP BY doc_id)
SELECT doc_id, coalesce(label, 'other') AS label FROM d LEFT JOIN f USING (doc_id)"""


def keyword_weighted(spark, sf_dir):
    return keywords.weighted(catalogue(spark, sf_dir), "doc_id", F.col("terms"), keyword_table(spark, sf_dir))


WEIGHTED = f"""{_found_sql("whits", "terms", "each")}{_best_sql("b", "whits", "weight")}"""
KEYWORD_WEIGHTED = f"WITH {TABLE}{WEIGHTED} SELECT doc_id, CASE WHEN score >= 3 THEN label END AS label, coalesce(score, 0) AS score FROM d LEFT JOIN b USING (doc_id)"


def keyword_counted(spark, sf_dir):
    return keywords.counted(catalogue(spark, sf_dir), "doc_id", F.col("title"), F.col("terms"), keyword_table(spark, sf_dir))


KEYWORD_COUNTED = f"""WITH {TABLE}{_found_sql("hits", "title_and_terms", "each")}{_best_sql("b", "hits", "1")}
SELECT doc_id, coalesce(label, 'Unknown') AS label, coalesce(score, 0) AS score FROM d LEFT JOIN b USING (doc_id)"""


def keyword_title_or_terms(spark, sf_dir):
    rows = keyword_table(spark, sf_dir)
    pairs = rows.where("keyword LIKE '% %'")  # few titles hold one, so the others fall through to their terms
    return keywords.title_or_terms(catalogue(spark, sf_dir), "doc_id", F.col("title"), F.col("terms"), pairs, rows, KNOWN, 6.0)


KEYWORD_TITLE_OR_TERMS = f"""WITH {TABLE.replace("FROM k GROUP BY keyword),", "FROM k WHERE contains(keyword, ' ') GROUP BY keyword),", 1)}{LONGEST}{WEIGHTED}
SELECT doc_id, CASE WHEN coalesce(t.title, '') = '' THEN NULL WHEN keyword IS NOT NULL THEN CASE WHEN longest.label IN {_KNOWN} THEN longest.label END
  WHEN score >= 6 THEN b.label END AS label FROM t LEFT JOIN longest USING (doc_id) LEFT JOIN b USING (doc_id)"""

QUERIES = {
    "keyword_longest": (keyword_longest, KEYWORD_LONGEST),
    "keyword_first": (keyword_first, KEYWORD_FIRST),
    "keyword_weighted": (keyword_weighted, KEYWORD_WEIGHTED),
    "keyword_counted": (keyword_counted, KEYWORD_COUNTED),
    "keyword_title_or_terms": (keyword_title_or_terms, KEYWORD_TITLE_OR_TERMS),
}
