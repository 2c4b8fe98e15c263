"""Fusion of profiles with queries: what must and should hold, weights of the factors, targets and warnings.

One row per query, joined with its profile; all rules are column expressions over ``schemas.PROFILE`` and
``schemas.QUERY``. What a rule adds comes after what the earlier ones added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base weights, levels, ceilings, and the penalties and boosts of the rules.
BASE = {"core": 1.0, "important": 0.7, "optional": 0.3, "contextual": 0.15}
DIMENSIONS = ("dietary", "cuisine", "flavor", "texture", "cooking_skill", "nutrition", "adventurousness")
LEVELS = {"love": 1.0, "like": 0.7, "neutral": 0.5, "dislike": 0.1, "never": 0.0}
CEILINGS = {"beginner": 1, "home_cook": 2, "confident": 3, "advanced": 4, "professional": 5}
DIFFICULTY = {"easy": 2, "medium": 3, "challenging": 5}
HIGH_SPICE = ("Thai", "Sichuan", "Korean", "Indian", "Ethiopian", "Mexican")
WITH_ANIMAL_PRODUCTS = ("Japanese", "Korean", "Thai", "Vietnamese", "French", "Spanish", "Italian", "Greek", "Turkish", "Peruvian")
ANIMAL_STOPS = ("meat", "fish", "seafood", "eggs", "dairy")

HARD = "struct<type:string,value:string,required:boolean,reason:string>"
SOFT = "struct<type:string,value:string,penalty:double,boost:double,reason:string>"
CONFLICT = "struct<kind:string,strategy:string,description:string,warning:string,query_value:string>"
TENSION = "struct<dimensions:string,description:string,resolved:boolean>"
RELATION = "struct<kind:string,source:string,target:string,confidence:double>"

c = F.col


def _text(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("string")


def hard(kind: str, value, reason: str | None = None, required: bool | None = None) -> Column:
    return F.struct(_text(kind).alias("type"), _text(value).alias("value"), F.lit(required).cast("boolean").alias("required"), _text(reason).alias("reason"))


def soft(kind: str, value, penalty: float | None = None, boost: float | None = None, reason: str | None = None) -> Column:
    number = lambda x: F.lit(x).cast("double")
    return F.struct(_text(kind).alias("type"), _text(value).alias("value"), number(penalty).alias("penalty"), number(boost).alias("boost"), _text(reason).alias("reason"))


def _list(x: Column, kind: str) -> Column:
    return F.coalesce(x, F.array()).cast(f"array<{kind}>")


def _if(condition: Column, item: Column, kind: str) -> Column:
    """An array with the item where the condition holds, else an empty one."""
    return F.when(F.coalesce(condition, F.lit(False)), F.array(item).cast(f"array<{kind}>")).otherwise(F.array().cast(f"array<{kind}>"))


def _lookup(table: dict, key: Column, default) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def _filled(x: Column) -> Column:
    return F.coalesce(x, F.lit("")) != ""


def required_diet(spectrum: Column) -> Column:
    """The flag that a diet requires: vegan but for flexitarian ones, else vegetarian; or null."""
    s = F.lower(F.coalesce(spectrum, F.lit("")))
    return F.when(s.contains("vegan") & ~s.contains("flexitarian"), "is_vegan").when(s.contains("vegetarian"), "is_vegetarian")


def stops() -> Column:
    """Labels of the hard stops that are ones."""
    return F.transform(F.filter(_list(c("hard_stops"), "struct<label:string,is_hard_stop:boolean>"), lambda r: F.coalesce(r["is_hard_stop"], F.lit(False))), lambda r: r["label"])


def _affinities(*levels: str) -> Column:
    all_ = _list(c("affinities"), "struct<cuisine:string,level:string>")
    return F.filter(all_, lambda a: a["level"].isin(*levels)) if levels else all_


def tensions() -> Column:
    """The profile's tensions with those that its own answers give, once for each pair of dimensions."""
    made = lambda dims, says: F.struct(dims.alias("dimensions"), says.alias("description"), F.lit(False).alias("resolved"))
    cuisine = lambda a: F.concat(F.lit("cuisine "), a["cuisine"])
    strict = F.coalesce(required_diet(c("spectrum")) == "is_vegan", F.lit(False)) | F.exists(
        F.transform(_list(c("hard_stops"), "struct<label:string,is_hard_stop:boolean>"), lambda r: F.lower(r["label"])), lambda x: x.isin(*ANIMAL_STOPS)
    )
    liked = F.filter(_affinities("love", "like"), lambda a: strict & a["cuisine"].isin(*WITH_ANIMAL_PRODUCTS))
    mild = F.coalesce(F.try_element_at("flavors", F.lit("spicy")) <= 2.0, F.lit(False))
    spicy = F.filter(_affinities("love"), lambda a: mild & a["cuisine"].isin(*HIGH_SPICE))
    dear = F.coalesce((c("eating_out_budget") < 15.0) & (c("sustainability") >= 8.0), F.lit(False))
    new = F.concat(
        F.transform(liked, lambda a: made(F.concat(F.lit("diet | "), cuisine(a)), F.concat(a["cuisine"], F.lit(" is liked, but often uses what the diet leaves out")))),
        F.transform(spicy, lambda a: made(F.concat(F.lit("spicy | "), cuisine(a)), F.concat(a["cuisine"], F.lit(" is loved, but often hotter than what is liked")))),
        _if(dear, made(F.lit("budget | sustainability"), F.lit("a high sustainability priority with a low budget leaves few results")), TENSION),
    )
    old = _list(c("tensions"), TENSION)
    resolved = lambda t: F.coalesce(t["resolved"], F.lit(False))
    unresolved = F.filter(old, lambda t: ~resolved(t))
    keys = F.transform(unresolved, lambda t: t["dimensions"])
    return F.concat(F.filter(old, resolved), unresolved, F.filter(new, lambda t: ~F.array_contains(keys, t["dimensions"])))


def _word_in(label: Column, words: Column) -> Column:
    return F.regexp_like(words, F.concat(F.lit("\\b\\Q"), F.lower(label), F.lit("\\E\\b")))


def conflicts() -> Column:
    """The query's conflicts, those with hard stops made strict, and those that rules find."""
    made = lambda kind, strategy, says, warning, value: F.struct(*[_text(x).alias(k) for k, x in (("kind", kind), ("strategy", strategy), ("description", says), ("warning", warning), ("query_value", value))])
    labels = stops()
    given = F.transform(
        _list(c("conflicts"), CONFLICT),
        lambda x: F.when(
            F.exists(labels, lambda s: F.coalesce(F.lower(x["query_value"]).contains(F.lower(s)), F.lit(False))), made("dietary_violation", "honor_profile", x["description"], x["warning"], x["query_value"])
        ).otherwise(x),
    )
    asked = F.lower(F.concat_ws(" ", F.array_join(_list(c("desired_ingredients"), "string"), " "), F.coalesce("desired_cuisine", F.lit("")), c("query_text")))
    known = lambda s: F.exists(given, lambda x: (x["kind"] == "dietary_violation") & _word_in(s, F.lower(F.coalesce(x["query_value"], F.lit("")))))
    found = F.transform(
        F.filter(labels, lambda s: _word_in(s, asked) & ~known(s)),
        lambda s: made("dietary_violation", "honor_profile", F.concat(F.lit("the query asks for "), s, F.lit(", a hard stop")), F.concat(F.lit("left out what contains "), s), s),
    )
    so_far = F.concat(given, found)
    flagged = lambda kind: F.exists(so_far, lambda x: x["kind"] == kind)
    rule = lambda when, kind, says, warning: _if(c("eat_in") & when & ~flagged(kind), made(kind, "show_warning", says, warning, None), CONFLICT)
    spicy = F.lower("desired_cuisine").isin(*[x.lower() for x in HIGH_SPICE]) & (F.try_element_at("flavors", F.lit("spicy")) <= 2.0)
    return F.concat(
        so_far,
        rule(spicy, "flavor_mismatch", F.concat(c("desired_cuisine"), F.lit(" is typically spicy")), "this cuisine is typically spicy; milder variants are preferred"),
        rule((c("difficulty") == "challenging") & c("skill").isin("beginner", "home_cook"), "skill_mismatch", "challenging difficulty beyond the skill level", "this may be harder than usual"),
        rule(c("minutes") > c("weeknight_minutes") * 1.5, "time_exceeded", "much more time than the weeknight budget", "this takes longer than the usual budget"),
    )


def relationships() -> Column:
    made = lambda kind, source, target, x: F.struct(F.lit(kind).alias("kind"), F.lit(source).alias("source"), F.lit(target).alias("target"), F.lit(x).alias("confidence"))
    return F.concat(
        _list(c("relationships"), RELATION),
        _if(c("eat_in") & F.lower("occasion").contains("date"), made("implies", "occasion", "mood", 0.85), RELATION),
        _if(c("eat_in") & (c("difficulty") == "easy"), made("attenuates", "difficulty_constraint", "time_constraint_minutes", 0.7), RELATION),
    )


def with_rules(queries: DataFrame, profiles: DataFrame) -> DataFrame:
    """Queries with their profile, after the deterministic rules over both."""
    rows = queries.withColumn("eat_in", F.coalesce("eat_in", F.lit(False))).join(profiles, "user_id")
    quick = F.when(c("eat_in") & (c("minutes") <= 30), "quick")
    romantic = c("eat_in") & F.coalesce(F.lower("occasion").contains("date"), F.lit(False)) & ~_filled(c("inferred_mood"))
    return rows.withColumns(
        {"tensions": tensions(), "conflicts": conflicts(), "relationships": relationships(), "inferred_urgency": quick, "inferred_mood": F.when(romantic, "romantic").otherwise(c("inferred_mood"))}
    )


def has_hard_stop_conflict(conflicts_: Column) -> Column:
    return F.exists(conflicts_, lambda x: x["kind"] == "dietary_violation")


def blocking(conflicts_: Column) -> Column:
    """The conflicts that are resolved as the profile says."""
    return F.filter(conflicts_, lambda x: x["strategy"] == "honor_profile")


def _weights() -> dict[str, Column]:
    """Weight of each dimension, null where it has none."""
    base = {d: _lookup(BASE, F.coalesce(F.try_element_at("weights", F.lit(d)), F.lit("")), 0.3) for d in DIMENSIONS}
    boost = 1.0 + F.coalesce("complexity", F.lit(0.0)) * 0.3
    on = lambda x: c("eat_in") & x
    w = base | {
        "cuisine": F.when(on(_filled(c("desired_cuisine"))), F.least(F.lit(2.0), base["cuisine"] * boost * 1.5)).otherwise(base["cuisine"]),
        "nutrition": F.when(on(_filled(c("goal"))), F.least(F.lit(2.0), base["nutrition"] * 2.0)).otherwise(base["nutrition"]),
        "ingredients": F.when(on(F.size(_list(c("desired_ingredients"), "string")) > 0), 1.2 * boost),
        "occasion": F.when(on(_filled(c("mood"))), F.lit(0.8)),
    }

    def related(name: str, start: Column) -> Column:
        mine = F.filter(c("relationships"), lambda r: r["target"] == name)
        up, down = lambda a, r: F.least(F.lit(2.0), a * (1.0 + 0.3 * r["confidence"])), lambda a, r: F.greatest(F.lit(0.0), a * (1.0 - 0.2 * r["confidence"]))
        return F.when(start.isNotNull(), F.aggregate(mine, start.cast("double"), lambda a, r: F.when(r["kind"] == "amplifies", up(a, r)).when(r["kind"] == "attenuates", down(a, r)).otherwise(a)))

    return {name: related(name, x) for name, x in w.items()}


def _hour_and_weekend() -> tuple[Column, Column]:
    """Of the time of asking, in UTC."""
    seconds = F.unix_timestamp("asked_at")
    return F.pmod(F.floor(seconds / 3600), F.lit(24)), F.pmod(F.floor(seconds / 86400) + 3, F.lit(7)) >= 5  # 1 January 1970 was a Thursday


def fused(queries: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row per query: user_id, hard_filters, soft_filters, scoring, targets, warnings, requires_clarification, clarification."""
    rows = with_rules(queries, profiles)
    eat, wanted = c("eat_in"), F.lower(F.coalesce("desired_cuisine", F.lit("")))
    explicit = F.concat(F.when(eat & (wanted != ""), F.array(wanted)).otherwise(F.array().cast("array<string>")), F.transform(_list(c("cuisine_tags"), "string"), F.lower))
    never = F.transform(_affinities("never"), lambda a: a["cuisine"])
    asked_for = lambda x: F.array_contains(explicit, F.lower(x))
    diet = required_diet(c("spectrum"))
    hard_filters = F.concat(
        F.transform(stops(), lambda x: hard("exclude_ingredient", x, "dietary_hard_stop")),
        _if(diet.isNotNull(), hard("dietary_flag", diet, None, True), HARD),
        F.when(eat, F.transform(_list(c("excluded_ingredients"), "string"), lambda x: hard("exclude_ingredient", x, "query_exclusion"))).otherwise(F.array().cast(f"array<{HARD}>")),
        _if(eat & c("minutes").isNotNull(), hard("max_time_min", c("minutes")), HARD),
        F.transform(F.filter(never, lambda x: ~asked_for(x)), lambda x: hard("exclude_cuisine", x, "cuisine_never")),
    )
    session = c("time_of_day").isNotNull() | c("day_of_week").isNotNull() | c("energy").isNotNull()
    hour, at_weekend = _hour_and_weekend()
    weekend = F.when(session, F.coalesce(c("day_of_week") == "weekend", F.lit(False))).otherwise(at_weekend)
    budget = F.when(weekend, c("weekend_minutes")).otherwise(c("weeknight_minutes"))
    soft_stops = F.filter(_list(c("soft_stops"), "struct<label:string,is_hard_stop:boolean>"), lambda r: ~F.coalesce(r["is_hard_stop"], F.lit(False)))
    ceiling = _lookup(CEILINGS, F.coalesce("skill", F.lit("")), 3)
    disliked = F.filter(F.transform(_affinities("dislike"), lambda a: a["cuisine"]), lambda x: F.lower(x) != F.when(eat, wanted).otherwise(""))
    meal = lambda name, boost: soft("prefer_occasion_tag", name, None, boost)
    soft_filters = F.concat(
        F.transform(soft_stops, lambda r: soft("prefer_exclude_ingredient", r["label"], 0.4)),
        _if(eat & c("minutes").isNull(), soft("prefer_max_time_min", budget, 0.2), SOFT),
        _if(eat & ~_filled(c("difficulty")), soft("prefer_max_difficulty", ceiling, 0.3), SOFT),
        F.transform(F.filter(never, asked_for), lambda x: soft("prefer_exclude_cuisine", x, 0.2, None, "cuisine_never_overridden_by_query")),
        F.transform(disliked, lambda x: soft("prefer_exclude_cuisine", x, 0.3)),
        _if(session & c("time_of_day").isin("morning", "breakfast"), meal("breakfast", 0.3), SOFT),
        _if(session & (c("time_of_day") == "dinner"), meal("dinner", 0.2), SOFT),
        _if(session & (c("energy") == "tired") & ~(eat & c("minutes").isNotNull()), soft("prefer_max_time_min", 30, 0.3), SOFT),
        _if(~session & hour.between(5, 9), meal("breakfast", 0.2), SOFT),
        _if(~session & hour.between(11, 13), meal("lunch", 0.2), SOFT),
        _if(~session & hour.between(17, 21), meal("dinner", 0.2), SOFT),
    )
    weights = _weights()
    scoring = F.map_filter(F.create_map(*[x for name, w in weights.items() for x in (F.lit(name), w)]), lambda k, v: v.isNotNull())
    own = {
        "cuisine": F.when(eat & _filled(c("desired_cuisine")), c("desired_cuisine")),
        "desired_ingredients": F.when(eat & (F.size(_list(c("desired_ingredients"), "string")) > 0), F.to_json("desired_ingredients")),
        "mood": F.when(eat & _filled(c("mood")), c("mood")),
        "max_time_min": F.when(eat, c("minutes").cast("string")),
        "difficulty_constraint": F.when(eat & _filled(c("difficulty")), c("difficulty")),
        "max_difficulty": F.when(eat & _filled(c("difficulty")), _lookup(DIFFICULTY, c("difficulty"), 3).cast("string")),
        "profile_max_difficulty": F.when(eat & ~_filled(c("difficulty")), ceiling.cast("string")),
        "occasion": F.when(eat & _filled(c("occasion")), c("occasion")),
        "nutritional_goal": F.when(eat & _filled(c("goal")), c("goal")),
    }
    named = F.map_filter(F.create_map(*[x for k, v in own.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    central = F.filter(_list(c("attributes"), "struct<attribute:string,value:string,centrality:double>"), lambda a: (a["centrality"] >= 0.7) & ~F.array_contains(F.map_keys(named), a["attribute"]))
    last_of = lambda items, key, value: F.map_from_entries(F.transform(F.array_distinct(F.transform(items, key)), lambda k: F.struct(k, F.element_at(F.filter(items, lambda x: key(x) == k), -1)[value])))
    levels = F.transform_values(last_of(_affinities(), lambda a: F.lower(a["cuisine"]), "level"), lambda k, v: _lookup(LEVELS, F.coalesce(v, F.lit("")), 0.5))
    tastes = F.transform_values(F.map_filter(F.coalesce("flavors", F.create_map().cast("map<string,double>")), lambda k, v: v.isNotNull()), lambda k, v: v / 10.0)
    tastes = F.map_from_entries(F.array_sort(F.map_entries(tastes)))
    more = {"cuisine_affinities": F.when(F.size(levels) > 0, F.to_json(levels)), "flavor_preferences": F.when(F.size(tastes) > 0, F.to_json(tastes))}
    targets = F.map_concat(
        named,
        last_of(central, lambda a: F.concat(F.lit("query_"), a["attribute"]), "value"),
        F.map_filter(F.create_map(*[x for k, v in more.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull()),
    )
    warned = lambda x: F.when((x["strategy"] == "honor_profile") & (x["kind"] == "dietary_violation"), F.concat(F.lit("dietary restriction applied: "), x["description"])).when((x["strategy"] == "show_warning") & _filled(x["warning"]), x["warning"])
    warnings = F.concat(
        F.transform(F.filter(never, asked_for), lambda x: F.concat(x, F.lit(" is never wanted, but was asked for"))),
        F.array_compact(F.transform("conflicts", warned)),
        F.transform(F.filter("tensions", lambda t: ~F.coalesce(t["resolved"], F.lit(False))), lambda t: F.concat(F.lit("profile note: "), t["description"])),
    )
    unclear = F.filter("conflicts", lambda x: x["strategy"] == "ask_user")
    question = F.concat(F.lit("how should this be handled: "), F.try_element_at(unclear, F.lit(-1))["description"], F.lit("?"))
    return rows.select(
        "user_id", hard_filters.alias("hard_filters"), soft_filters.alias("soft_filters"), scoring.alias("scoring"), targets.alias("targets"), warnings.alias("warnings"),
        (F.size(unclear) > 0).alias("requires_clarification"), question.alias("clarification"), F.size(blocking(c("conflicts"))).alias("n_blocking"), "inferred_urgency", "inferred_mood",
    )
