"""Queries: names looked up in tiers of reference tables, and nutrients by serving."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import lookup
from quern.sources.tables import table

_ENTRY = "concat(p_name, element_at(array('', ', raw', ' (average)', ', sliced thin', ' set, cooked', ' raw'), CAST(p_partkey % 6 + 1 AS INT)))"
_TIERS = {"a": "p_partkey % 3 = 0 AND p_size < 5", "b": "p_partkey % 3 = 1 AND p_size BETWEEN 5 AND 8", "c": "p_partkey % 3 = 2 AND p_size = 9"}


def _found(spark, sf_dir, like: bool):
    part = table(spark, sf_dir, "part")
    tiers = {k: part.where(where).selectExpr(f"{_ENTRY} AS entry") for k, where in _TIERS.items()}
    return lookup.tiered(part.select(F.col("p_name").alias("name")), tiers, like)


def tiered_lookup(spark, sf_dir):
    """Each distinct part name in the first tier with an entry that is it, a usual phrase with it, or begins with it."""
    return _found(spark, sf_dir, like=False)


def tiered_lookup_alike(spark, sf_dir):
    """The same with likeness as the last rule, which SQL cannot say; tested against trying every entry."""
    return _found(spark, sf_dir, like=True)


TIERED_LOOKUP = f"""WITH n AS (SELECT DISTINCT lower(trim(p_name, ' ')) AS name FROM part),
e AS (SELECT DISTINCT tier, lower(p_name || ['', ', raw', ' (average)', ', sliced thin', ' set, cooked', ' raw'][p_partkey % 6 + 1]) AS entry
  FROM (SELECT *, CASE {' '.join(f"WHEN {where} THEN '{k}'" for k, where in _TIERS.items())} END AS tier FROM part) WHERE tier IS NOT NULL),
m AS (SELECT name, tier, entry, list_position([{', '.join("'" + p + "'" for p in lookup.PHRASES)}], entry[length(name) + 1:]) AS pos FROM n JOIN e ON starts_with(entry, name)),
r AS (SELECT *, CASE WHEN entry = name THEN 1 WHEN pos > 0 THEN 2 WHEN entry[length(name) + 1] IN (',', ' ') THEN 3 END AS rule,
  CASE WHEN contains(entry, 'raw') THEN 0 WHEN contains(entry, 'cooked') OR contains(entry, 'steamed') THEN 1 ELSE 2 END AS kind FROM m)
SELECT name, tier, entry, rule FROM r WHERE rule IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY name ORDER BY tier, rule, CASE WHEN rule = 2 THEN pos END, CASE WHEN rule = 3 THEN kind END, length(entry), entry) = 1"""


def nutrition_per_serving(spark, sf_dir):
    """Orders as documents: nutrients of the parts of their lines that have an entry, by serving."""
    part, lines, orders = (table(spark, sf_dir, t) for t in ("part", "lineitem", "orders"))
    values = part.where("p_size < 25").groupBy(F.lower("p_name").alias("name")).agg(*[F.floor(F.max("p_retailprice") / (i + 1)).cast("double").alias(n) for i, n in enumerate(lookup.NUTRIENTS)])
    names = lines.join(part, lines["l_partkey"] == part["p_partkey"]).groupBy("l_orderkey").agg(F.collect_list("p_name").alias("names"))  # at most the lines of an order
    docs = orders.join(names, orders["o_orderkey"] == names["l_orderkey"], "left").withColumn("serves", (F.col("o_custkey") % 5).cast("int"))
    got = lookup.nutrition_per_serving(docs, "o_orderkey", F.col("names"), F.col("serves"), values)
    return got.select("o_orderkey", "kcal", *[F.round(n, 1).alias(n) for n in ("protein_g", "salt_g")])


NUTRITION_PER_SERVING = """WITH v AS (SELECT lower(p_name) AS name, max(p_retailprice) AS x FROM part WHERE p_size < 25 GROUP BY 1),
t AS (SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 4 ELSE o_custkey % 5 END AS serves, sum(floor(x)) AS x, sum(floor(x / 2)) AS y, sum(floor(x / 8)) AS z
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN v ON v.name = lower(p_name) GROUP BY 1, 2)
SELECT o_orderkey, CASE WHEN x IS NOT NULL THEN CAST(greatest(1, trunc(x / serves)) AS INT) END AS kcal, round(y / serves, 1) AS protein_g, round(round(z / serves, 2), 1) AS salt_g FROM t"""

QUERIES = {
    "tiered_lookup": (tiered_lookup, TIERED_LOOKUP),
    "tiered_lookup_alike": (tiered_lookup_alike, None),
    "nutrition_per_serving": (nutrition_per_serving, NUTRITION_PER_SERVING),
}
