"""Query: profiles and queries made from customers, fused."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern import schemas
from quern.operators import fusion
from quern.sources.tables import table

_PROFILES = """c_custkey AS user_id, array(named_struct('label', 'Building', 'is_hard_stop', c_custkey % 4 = 0)) AS hard_stops,
array(named_struct('label', 'onion', 'is_hard_stop', false)) AS soft_stops, element_at(array(null, 'vegan', 'lacto-vegetarian', 'flexitarian vegan', 'omnivore'), CAST(c_custkey % 5 + 1 AS INT)) AS spectrum,
map('cuisine', element_at(array('core', 'important', 'optional', 'contextual', 'none'), CAST(c_custkey % 5 + 1 AS INT))) AS weights,
element_at(array('beginner', 'home_cook', 'confident', 'advanced', 'professional'), CAST(c_custkey % 5 + 1 AS INT)) AS skill, 30 AS weeknight_minutes, 90 AS weekend_minutes,
array(named_struct('cuisine', 'Thai', 'level', 'love'), named_struct('cuisine', 'Korean', 'level', 'never'), named_struct('cuisine', 'French', 'level', 'dislike')) AS affinities,
map('spicy', CAST(c_custkey % 11 AS DOUBLE)) AS flavors"""
_QUERIES = """c_custkey AS user_id, concat('something with ', c_mktsegment) AS query_text, c_custkey % 10 / 10 AS complexity, c_custkey % 7 <> 0 AS eat_in,
element_at(array(null, 'Korean', 'Thai', 'French'), CAST(c_custkey div 2 % 4 + 1 AS INT)) AS desired_cuisine, if(c_custkey % 2 = 0, array('rice'), null) AS desired_ingredients,
if(c_custkey % 3 = 0, array('egg'), null) AS excluded_ingredients, if(c_custkey % 6 = 0, CAST(20 + c_custkey % 50 AS INT), null) AS minutes, element_at(array(null, 'easy', 'challenging'), CAST(c_custkey % 3 + 1 AS INT)) AS difficulty,
if(c_custkey % 2 = 1, array(named_struct('kind', 'amplifies', 'source', 'x', 'target', 'cuisine', 'confidence', CAST(0.5 AS DOUBLE))), null) AS relationships,
element_at(array('morning', 'dinner', 'noon'), CAST(c_custkey % 3 + 1 AS INT)) AS time_of_day, if(c_custkey % 5 = 0, 'tired', null) AS energy, if(c_custkey % 9 = 0, 'weekend', 'weekday') AS day_of_week"""


def _full(df, ddl: str):
    """``df`` with all columns of a schema, null where it has none."""
    target = df.sparkSession.createDataFrame([], ddl).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target])


def fusion_filters(spark, sf_dir):
    """What each customer's query must and should hold, its weights, and how many warnings it gives."""
    customers = table(spark, sf_dir, "customer")
    profiles = _full(customers.selectExpr(*_columns(_PROFILES)), schemas.PROFILE)
    queries = _full(customers.selectExpr(*_columns(_QUERIES)), schemas.QUERY)
    joined = lambda name: F.array_join(F.transform(name, lambda f: F.concat(f["type"], F.lit("="), f["value"])), ";")
    weight = lambda k: F.round(F.try_element_at("scoring", F.lit(k)), 4)
    return fusion.fused(queries, profiles).select(
        "user_id", joined("hard_filters").alias("hard"), joined("soft_filters").alias("soft"), weight("cuisine").alias("cuisine_weight"), weight("ingredients").alias("ingredients_weight"),
        F.size("warnings").alias("n_warnings"), "n_blocking", "inferred_urgency",
    )


def _columns(sql: str) -> list[str]:
    """The top-level expressions of a select list."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(sql):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(sql[start:i])
            start = i + 1
    return [*out, sql[start:]]


FUSION_FILTERS = """WITH k AS (SELECT c_custkey AS user_id, c_mktsegment = 'BUILDING' AS building, c_custkey % 7 <> 0 AS eat, [NULL, 'Korean', 'Thai', 'French'][c_custkey // 2 % 4 + 1] AS cuisine,
  CASE WHEN c_custkey % 6 = 0 THEN CAST(20 + c_custkey % 50 AS INT) END AS minutes, c_custkey % 3 AS m3, c_custkey % 4 AS m4, c_custkey % 5 AS m5, c_custkey % 2 AS m2, c_custkey % 11 <= 2 AS mild,
  1 + 0.3::DOUBLE * (c_custkey % 10) / 10 AS boost, [1.0::DOUBLE, 0.7, 0.3, 0.15, 0.3][c_custkey % 5 + 1] AS base, c_custkey % 9 = 0 AS weekend FROM customer),
w AS (SELECT *, CASE WHEN eat AND cuisine IS NOT NULL THEN least(2, base * boost * 1.5) ELSE base END AS w0, m4 = 0 AND building AS blocked FROM k)
SELECT user_id,
  array_to_string(list_filter([CASE WHEN m4 = 0 THEN 'exclude_ingredient=Building' END, CASE m5 WHEN 1 THEN 'dietary_flag=is_vegan' WHEN 2 THEN 'dietary_flag=is_vegetarian' END,
    CASE WHEN eat AND m3 = 0 THEN 'exclude_ingredient=egg' END, CASE WHEN eat AND minutes IS NOT NULL THEN 'max_time_min=' || minutes END,
    CASE WHEN NOT (eat AND coalesce(cuisine = 'Korean', false)) THEN 'exclude_cuisine=Korean' END], lambda x: x IS NOT NULL), ';') AS hard,
  array_to_string(list_filter(['prefer_exclude_ingredient=onion', CASE WHEN eat AND minutes IS NULL THEN 'prefer_max_time_min=' || CASE WHEN weekend THEN 90 ELSE 30 END END,
    CASE WHEN eat AND m3 = 0 THEN 'prefer_max_difficulty=' || (m5 + 1) END, CASE WHEN eat AND cuisine = 'Korean' THEN 'prefer_exclude_cuisine=Korean' END,
    CASE WHEN NOT (eat AND coalesce(cuisine = 'French', false)) THEN 'prefer_exclude_cuisine=French' END, CASE m3 WHEN 0 THEN 'prefer_occasion_tag=breakfast' WHEN 1 THEN 'prefer_occasion_tag=dinner' END,
    CASE WHEN m5 = 0 AND NOT (eat AND minutes IS NOT NULL) THEN 'prefer_max_time_min=30' END], lambda x: x IS NOT NULL), ';') AS soft,
  round(CASE WHEN m2 = 1 THEN least(2, w0 * 1.15::DOUBLE) ELSE w0 END, 4) AS cuisine_weight, round(CASE WHEN eat AND m2 = 0 THEN 1.2::DOUBLE * boost END, 4) AS ingredients_weight,
  CAST(coalesce(eat AND cuisine = 'Korean', false) AS INT) + CAST(blocked AS INT) + CAST(coalesce(eat AND cuisine IN ('Korean', 'Thai') AND mild, false) AS INT) + CAST(eat AND m3 = 2 AND m5 < 2 AS INT)
    + CAST(coalesce(eat AND minutes > 45, false) AS INT) + CAST(m5 = 1 AS INT) + CAST(mild AS INT) AS n_warnings,
  CAST(blocked AS INT) AS n_blocking, CASE WHEN eat AND minutes <= 30 THEN 'quick' END AS inferred_urgency FROM w"""

QUERIES = {"fusion_filters": (fusion_filters, FUSION_FILTERS)}
