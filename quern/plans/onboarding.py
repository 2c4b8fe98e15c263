"""Queries: profiles from answers, and their merge with what activity says. The answers are drawn from events: each names an
item by its properties and answers it with its value."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import onboarding as o
from quern.sources.tables import table

_MORE = (("q3", "Thai"), ("q3", "Greek"), ("q3", "Italian"), ("q13", "Meal prep"), ("q13", "Batch cooking"), ("q13", "Quick & easy"), ("q15", "Sour Dough"), ("q1", "Fruit Only"), ("q2", "No Quinoa"), ("q16", "text"))
ITEMS = list(dict.fromkeys((r[0], r[1]) for r in o.rules())) + list(_MORE)
FINE = ("q4", "q11", "q14")
LEVELS = ("Love", "Like", "Meh", "Skip")


def _answers(spark, sf_dir):
    items = spark.createDataFrame([(i, q, item) for i, (q, item) in enumerate(ITEMS)], "place int, question string, item string")
    place = F.pmod(F.get_json_object("props", "$.k").cast("int") + 100 * F.pmod("event_id", F.lit(2)), F.lit(len(ITEMS))).cast("int")
    drawn = table(spark, sf_dir, "events").withColumn("place", place).join(F.broadcast(items), "place")
    number = F.pmod(F.floor("value"), F.when(F.col("question").isin(*FINE), 100).otherwise(10)).cast("double")
    level = F.element_at(F.array(*[F.lit(w) for w in LEVELS]), (F.pmod("event_id", F.lit(4)) + 1).cast("int"))
    word = F.when(F.col("question") == "q3", level).when(F.col("question") == "q16", F.concat_ws(", ", "event_type", F.concat(F.lit("NL"), F.col("user_id"))))
    return drawn.select("user_id", "question", "item", number.alias("number"), word.alias("word"), F.col("event_id").alias("position"))


def _profiles(spark, sf_dir):
    return o.profile(o.facts(_answers(spark, sf_dir)))


_NUMBERS = {"flavor": ("spicy", "sweet", "sour", "umami", "fatty", "salty"), "texture": ("creamy", "crispy", "soft"), "vibes": ("cozy", "lively", "hidden_gem", "romantic", "business")}


def onboarding_profile(spark, sf_dir):
    labels = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["label"], x["reason"])), "|")
    joined = lambda c: F.array_join(c, "|")
    cuisines = F.array_join(F.transform("cuisines", lambda x: F.concat_ws(":", x["cuisine"], x["level"])), "|")
    return _profiles(spark, sf_dir).select(
        "user_id", "dietary.spectrum", labels(F.col("dietary.hard_stops")).alias("hard_stops"), labels(F.col("dietary.soft_stops")).alias("soft_stops"), cuisines.alias("cuisines"),
        *[F.col(f"{s}.{p}") for s, ps in _NUMBERS.items() for p in ps],
        "cooking.skill", "cooking.setup", joined("cooking.equipment").alias("equipment"), "cooking.weeknight", "budget.home", "budget.out",
        F.col("adventurousness.cooking").alias("bold_cooking"), F.col("adventurousness.dining").alias("bold_dining"), F.col("nutrition.level").alias("nutrition"), joined("nutrition.tracked").alias("tracked"),
        "social.context", "social.meals_out", "social.home_cooked", "lifestyle.seasonal", "lifestyle.sustainability", "lifestyle.style",
        joined(F.array_sort("lifestyle.interests")).alias("interests"), joined("lifestyle.priorities").alias("priorities"), joined("lifestyle.favourites").alias("favourites"), "location.city", "location.country",
    )


def _said(spark, sf_dir):
    """What purchases and errors say about a user, by section."""
    e = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'error')").groupBy("user_id")
    e = e.agg(F.max(F.floor("value") % 11).cast("double").alias("m"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.concat(F.lit("bought_"), F.floor("value") % 4))).alias("kinds"), F.min("event_type").alias("t"))
    odd = lambda c: F.when(F.col("n") % 2 == 1, c)
    return e.select(
        "user_id", F.struct(odd(F.lit("omnivore")).alias("spectrum")).alias("dietary"), F.struct(odd(F.col("m")).alias("spicy")).alias("flavor"),
        F.struct(F.col("m").alias("cooking"), F.col("m").alias("dining")).alias("adventurousness"), F.struct(F.col("kinds").alias("interests"), F.lit("never").alias("style")).alias("lifestyle"),
        F.struct(F.col("t").alias("city"), odd(F.col("t")).alias("country")).alias("location"),
    )


def profile_merge(spark, sf_dir):
    both = o.merged(_profiles(spark, sf_dir), _said(spark, sf_dir))
    return both.select(
        "user_id", "dietary.spectrum", "flavor.spicy", "flavor.sweet", F.col("adventurousness.cooking").alias("bold_cooking"), F.col("adventurousness.dining").alias("bold_dining"),
        F.array_join(F.array_sort("lifestyle.interests"), "|").alias("interests"), "lifestyle.style", "location.city", "location.country",
    )


def _value(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


_row = lambda r: f"({', '.join(_value(x) for x in r)})"
_case = lambda c, d: f"CASE {c} {' '.join(f"WHEN {_value(k)} THEN {_value(v)}::DOUBLE" for k, v in d.items())} END"
_held = lambda p: f"coalesce(max(number) FILTER (path = '{p}'), {_value(o.START.get(p))})"
_list = lambda p, what="words": f"coalesce(any_value({what}) FILTER (path = '{p}'), [])"
_tenth = lambda x: f"floor(({x}) * 10 + 0.5) / 10"
_TEXTURES = {p: f"texture_{p}" for p in _NUMBERS["texture"]}
_CTES = f"""WITH items(place, question, item) AS (VALUES {', '.join(_row((i, *x)) for i, x in enumerate(ITEMS))}),
rules(question, item, step, path, op, a, b, under, word) AS (VALUES {', '.join(_row(r) for r in o.rules())}),
drawn AS (SELECT user_id, question, item, CAST(CAST(floor(value) AS BIGINT) % CASE WHEN question IN ('q4', 'q11', 'q14') THEN 100 ELSE 10 END AS DOUBLE) AS number, event_id AS position,
  CASE question WHEN 'q3' THEN ['Love', 'Like', 'Meh', 'Skip'][event_id % 4 + 1] WHEN 'q16' THEN event_type || ', NL' || user_id END AS word
  FROM events JOIN items ON (CAST(props ->> '$.k' AS INT) + 100 * (event_id % 2)) % {len(ITEMS)} = place),
answers AS (SELECT * FROM drawn QUALIFY row_number() OVER (PARTITION BY user_id, question, item ORDER BY position DESC) = 1),
acts AS (SELECT user_id, item, position, number, step, path, op, a::DOUBLE AS a, b::DOUBLE AS b, under::DOUBLE AS under, r.word FROM answers JOIN rules r USING (question, item)
  UNION ALL SELECT user_id, item, position, NULL, CAST(question[2:] AS INT), {"CASE question " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in o.PASSED.items()) + " END"}, 'word', NULL, NULL, NULL,
    CASE question WHEN 'q1' THEN lower(item) WHEN 'q2' THEN 'preference' WHEN 'q13' THEN trim(regexp_replace(lower(item), '[^a-z0-9]+', '_', 'g'), '_') WHEN 'q15' THEN replace(lower(item), ' ', '_') ELSE word END
  FROM answers WHERE question IN ({', '.join(f"'{q}'" for q in o.PASSED)}) AND (question, item) NOT IN (SELECT (question, item) FROM rules WHERE op = 'word')),
steps AS (SELECT user_id, path, list({{'op': op, 'a': a, 'b': b, 'under': under, 'number': number}} ORDER BY step, position) AS xs,
  list(word ORDER BY step, position) FILTER (op = 'word') AS words, list(item ORDER BY step, position) FILTER (op = 'word') AS items FROM acts GROUP BY user_id, path),
paths AS (SELECT user_id, path, words, items, list_reduce(list_prepend({{'op': '', 'a': 0::DOUBLE, 'b': 0::DOUBLE, 'under': 0::DOUBLE, 'number': {_case("path", o.START)}}}, xs), lambda s, x: {{'op': '', 'a': 0::DOUBLE, 'b': 0::DOUBLE, 'under': 0::DOUBLE, 'number':
  CASE x.op WHEN 'boost' THEN CASE WHEN x.under IS NULL OR s.number IS NULL OR s.number < x.under THEN greatest(0, least(10, coalesce(s.number, x.b) + x.a)) ELSE s.number END
  WHEN 'first' THEN coalesce(s.number, x.a) WHEN 'least' THEN greatest(s.number, x.a) WHEN 'tenth' THEN coalesce(floor(x.a * x.number + x.b + 0.5) / 10, s.number)
  WHEN 'raw' THEN coalesce(x.number, s.number) ELSE s.number END}}).number AS number FROM steps),
u AS (SELECT user_id, {_list('spectrum')} AS spectra, {_list('stops')} AS reasons, {_list('stops', 'items')} AS stops, {_list('cuisines')} AS levels, {_list('cuisines', 'items')} AS cuisines, {_list('favourites', 'items')} AS favourites,
  list_sort(list_distinct({_list('equipment')})) AS equipment, {_list('skill')} AS skills, {_list('context')} AS contexts, {_list('context', 'items')}[1] AS chip, {_list('style')} AS styles, {_list('style', 'items')}[1] AS who,
  {_list('priorities')} AS priorities, {_list('priorities', 'items')} AS wishes, {_list('interests')} AS interests, {_list('place')} AS places,
  {', '.join(f"{_tenth(_held('flavor.' + p))} AS {p}" for p in _NUMBERS['flavor'])}, {', '.join(f"{_held('texture.' + p)} AS {q}" for p, q in _TEXTURES.items())}, {', '.join(f"{_held('vibe.' + p)} AS {p}" for p in _NUMBERS['vibes'])},
  {', '.join(f"{_held(p)} AS {p.replace('.', '_')}" for p in ('cooking.weeknight', 'servings', 'meals', 'groceries', 'budget.out', 'adventure.cooking', 'adventure.dining', 'calories', 'protein', 'sugar', 'fibre', 'meals_out', 'organic', 'local'))}
  FROM paths GROUP BY user_id),
prof AS (SELECT *, CASE WHEN len(spectra) > 0 THEN array_to_string(spectra, '-') END AS spectrum,
  {_tenth("CASE WHEN who IN ('Curious food explorer', 'Aspiring chef') THEN greatest(adventure_cooking, 8.0::DOUBLE) ELSE adventure_cooking END")} AS bold_cooking,
  {_tenth("CASE WHEN who IN ('Curious food explorer', 'Aspiring chef') THEN greatest(adventure_dining, 8.0::DOUBLE) ELSE adventure_dining END")} AS bold_dining,
  list_concat(CASE WHEN list_has_any(wishes, ['Meal prep', 'Batch cooking']) THEN ['meal_prep'] ELSE [] END, interests) AS liked, trim(split_part(places[1], ',', 1)) AS city, trim(split_part(places[1], ',', 2)) AS country, coalesce(styles[1], 'short_list') AS style FROM u)"""
_stops = lambda soft: f"""array_to_string(list_filter(list_transform(list_zip(stops, reasons), lambda x: CASE WHEN (x[2] = 'dislike') = {soft} THEN lower(regexp_replace(regexp_replace(x[1], '^No ', ''), ' \\(.*\\)', '')) || ':' || x[2] END), lambda y: y IS NOT NULL), '|')"""
PROFILE_SQL = f"""{_CTES} SELECT user_id, spectrum, {_stops('false')} AS hard_stops, {_stops('true')} AS soft_stops,
  array_to_string(list_transform(list_zip(cuisines, levels), lambda x: x[1] || ':' || CASE x[2] WHEN 'Love' THEN 'love' WHEN 'Like' THEN 'like' WHEN 'Meh' THEN 'neutral' ELSE 'dislike' END), '|') AS cuisines,
  {', '.join((*_NUMBERS['flavor'], *_NUMBERS['vibes']))}, texture_crispy AS crispy, texture_soft AS soft,
  CASE WHEN list_has_any(favourites, [{', '.join(f"'{w}'" for w in o.FATTY)}]) THEN least(10, coalesce(texture_creamy, 5) + 1.5) ELSE texture_creamy END AS creamy,
  coalesce(skills[1], 'home_cook') AS skill, CASE WHEN len(equipment) >= 3 THEN 'fully_equipped' WHEN len(equipment) >= 1 THEN 'well_equipped' ELSE 'basic' END AS setup, array_to_string(equipment, '|') AS equipment,
  CAST(floor(cooking_weeknight + 0.5) AS BIGINT) AS weeknight, coalesce(CASE WHEN meals > 0 AND servings > 0 THEN floor(groceries / meals / servings * 100 + 0.5) / 100 END, CASE WHEN who = 'Budget-savvy eater' THEN 3.5 END) AS home, budget_out AS out,
  bold_cooking, bold_dining, CASE WHEN calories > 75 THEN 'strict' WHEN calories > 50 THEN 'moderate' WHEN calories > 25 THEN 'light' WHEN who = 'Health-conscious eater' THEN 'moderate' ELSE 'none' END AS nutrition,
  concat_ws('|', CASE WHEN calories > 50 THEN 'calories' END, CASE WHEN protein > 50 THEN 'protein' END, CASE WHEN sugar > 50 THEN 'sugar' END, CASE WHEN fibre > 50 THEN 'fibre' END) AS tracked,
  CASE WHEN who = 'Love feeding people' THEN 'group' ELSE coalesce(contexts[1], CASE WHEN servings <= 1 THEN 'solo' WHEN servings <= 2 THEN 'couple' WHEN servings <= 4 THEN 'family' ELSE 'group' END) END AS context,
  coalesce(meals_out, {_case('chip', o.MEALS_OUT)}, 2) AS meals_out, least(meals, 14.0::DOUBLE) AS home_cooked, {_tenth('local / 10')} AS seasonal, {_tenth('(organic + local) / 20')} AS sustainability, style,
  array_to_string(list_sort(list_distinct(liked)), '|') AS interests, array_to_string(priorities, '|') AS priorities, array_to_string(favourites, '|') AS favourites, city, country FROM prof"""
MERGE_SQL = f"""{_CTES}, said AS (SELECT user_id, max(CAST(floor(value) AS BIGINT) % 11)::DOUBLE AS m, count(*) AS n, list(DISTINCT 'bought_' || CAST(floor(value) AS BIGINT) % 4) AS kinds, min(event_type) AS t FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id)
SELECT user_id, CASE WHEN n % 2 = 1 THEN 'omnivore' ELSE spectrum END AS spectrum, CASE WHEN n % 2 = 1 THEN m ELSE spicy END AS spicy, sweet, greatest(bold_cooking, m) AS bold_cooking, greatest(bold_dining, m) AS bold_dining,
  array_to_string(list_sort(list_distinct(list_concat(liked, coalesce(kinds, [])))), '|') AS interests, style, coalesce(city, t) AS city, coalesce(country, CASE WHEN n % 2 = 1 THEN t END) AS country FROM prof LEFT JOIN said USING (user_id)"""

QUERIES = {"onboarding_profile": (onboarding_profile, PROFILE_SQL), "profile_merge": (profile_merge, MERGE_SQL)}
