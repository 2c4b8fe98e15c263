"""Multi-factor ranking of documents against a profile and a query, all in column expressions.

``names``, ``tags``, ``flavors`` are arrays of lower-case strings. What is unknown about a document scores a neutral half.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import numeric

# Factor weights, levels, tiers and ceilings.
WEIGHTS = {
    "ingredient_overlap": 0.30,
    "dietary_compliance": 0.25,
    "cuisine_affinity": 0.15,
    "difficulty_match": 0.10,
    "time_fit": 0.10,
    "flavor_affinity": 0.05,
    "novelty_bonus": 0.05,
}
LEVELS = {"love": 1.0, "like": 0.75, "neutral": 0.5, "dislike": 0.15, "never": 0.0}
CEILINGS = {"beginner": 1, "home_cook": 2, "confident": 3, "advanced": 4, "professional": 5}
BANDS = {"easy": (1, 2), "medium": (2, 3), "challenging": (4, 5)}
CLIENT_LEVELS = {"love": 1.0, "like": 0.7, "neutral": 0.4, "dislike": 0.1}
CLIENT_DEFAULT = 0.35


def _touch(names: Column, word: str) -> Column:
    return F.exists(names, lambda n: n.contains(word) | F.lit(word).contains(n))


def ingredient_overlap(names: Column, desired: Sequence[str], excluded: Sequence[str] = ()) -> Column:
    """The share of desired names that the document has, by substring either way; an excluded one costs a half."""
    some = F.array_distinct(F.filter(F.transform(names, numeric.synonym), lambda n: n != ""))
    wanted = list(dict.fromkeys(numeric.SYNONYMS.get(d.strip().lower(), d.strip().lower()) for d in desired))
    if not wanted:
        return F.lit(0.5)
    hits = sum((_touch(some, d).cast("int") for d in wanted), F.lit(0)) / F.lit(float(len(wanted)))
    bad = F.lit(False)
    for e in excluded:
        bad = bad | _touch(some, e.strip().lower())
    return F.when(F.size(some) == 0, 0.3).when(bad, F.greatest(F.lit(0.0), hits - 0.5)).otherwise(hits)


def _british(word: str) -> str:
    return numeric.SYNONYMS.get(word.strip().lower(), word.strip().lower())


def dietary_compliance(names: Column, flags: Mapping[str, Column], hard: Sequence[str], soft: Sequence[str], spectrum: str | None = None) -> Column:
    """0 where a hard stop is in a name or its ``contains_`` flag is set, or the diet's flag is missing.

    Each soft stop found in a name costs 0.3. Labels and names are compared in British names; the diet is looked for in
    ``spectrum`` as a substring, vegan first but not in flexitarian.
    """
    some = F.transform(names, numeric.synonym)
    found = lambda label: F.exists(some, lambda n: n.contains(_british(label)))
    stop = F.lit(False)
    for label in hard:
        stop = stop | found(label) | F.coalesce(flags.get(f"contains_{label.lower()}", F.lit(False)), F.lit(False))
    diet = (spectrum or "").lower()
    if "vegan" in diet and "flexitarian" not in diet:
        stop = stop | ~F.coalesce(flags["is_vegan"], F.lit(False))
    elif "vegetarian" in diet:
        stop = stop | ~F.coalesce(flags["is_vegetarian"], F.lit(False))
    penalty = sum((F.when(found(label), 0.3).otherwise(0.0) for label in soft), F.lit(0.0))
    return F.when(stop, 0.0).otherwise(numeric.clamp(F.lit(1.0) - penalty))


def cuisine_affinity(tags: Column, affinities: Sequence[tuple[str, str]], wanted: str | None = None) -> Column:
    """1 or 0.2 by the query's cuisine; else the mean level of the tags, the first affinity in order that matches a tag.

    Names match where one holds the other.
    """
    either = lambda t, c: t.contains(c.lower()) | F.lit(c.lower()).contains(t)
    if wanted:
        score = F.when(F.exists(tags, lambda t: either(t, wanted)), 1.0).otherwise(0.2)
    else:
        level = lambda t: F.coalesce(*[F.when(either(t, c), LEVELS.get(v, 0.5)) for c, v in affinities], F.lit(None).cast("double"))
        score = F.coalesce(numeric.mean_of(F.filter(F.transform(tags, level), lambda x: x.isNotNull())), F.lit(0.5))
    return F.when(F.size(tags) == 0, 0.5).otherwise(score)


def difficulty_match(difficulty: Column, skill: str, constraint: str | None = None) -> Column:
    if constraint:
        low, high = BANDS.get(constraint, (1, 5))
        off = F.least(F.abs(difficulty - low), F.abs(difficulty - high))
        score = F.when(difficulty.between(low, high), 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - off * 0.25))
    else:
        top = CEILINGS.get(skill, 3)
        score = F.when(difficulty <= top, 1.0 - (top - difficulty) * 0.1).otherwise(F.greatest(F.lit(0.0), 1.0 - (difficulty - top) * 0.35))
    return F.when(difficulty.isNull(), 0.5).otherwise(score)


def time_fit(minutes: Column, limit: int) -> Column:
    ratio = minutes / limit if limit > 0 else F.lit(1.0)
    over = (minutes - limit) / limit if limit > 0 else F.lit(1.0)
    return F.when(minutes.isNull(), 0.5).when(minutes <= limit, 0.7 + 0.3 * ratio).otherwise(F.greatest(F.lit(0.0), 1.0 - over * 0.8))


# Tags that stand for a flavour.
FLAVOR_OF_TAG = {
    "acidic": "sour",
    "rich": "fatty",
    "hot": "spicy",
    "peppery": "spicy",
    "briny": "salty",
    "caramelized": "sweet",
    "charred": "smoky",
    "grilled": "smoky",
    "pickled": "fermented",
    "fermented": "fermented",
    "savory": "umami",
    "meaty": "umami",
}
#: Tags that are named among the flavours but have no preference, whatever they stand for.
NO_FLAVOR = ("acidic", "rich")


def flavor_affinity(flavors: Column, preferences: Mapping[str, float]) -> Column:
    """The mean of the preferences (0 to 1) of the flavours; 0.7 and more count 1, 0.2 and less 0.

    A tag that is no flavour itself counts as the one it stands for.
    """
    value = {k: 1.0 if v >= 0.7 else 0.0 if v <= 0.2 else float(v) for k, v in preferences.items()}
    value |= {tag: value[f] for tag, f in FLAVOR_OF_TAG.items() if f in value and tag not in value and tag not in NO_FLAVOR}
    found = F.filter(F.transform(flavors, lambda t: numeric.lookup(value, t)), lambda x: x.isNotNull())
    return F.coalesce(numeric.mean_of(found), F.lit(0.5))


def novelty_bonus(tags: Column, common: Sequence[str], adventurousness: float) -> Column:
    a = adventurousness / 10.0
    known = F.arrays_overlap(tags, F.array(*[F.lit(c) for c in common]))
    return F.when(F.size(tags) == 0, 0.5).when(known, 0.5 + 0.25 * (1.0 - a)).otherwise(0.5 + 0.5 * a)


def composite(factors: Mapping[str, Column]) -> Column:
    """The weighted sum in the order of WEIGHTS; 0.1 where a factor is unknown."""
    total = None
    for name, weight in WEIGHTS.items():
        part = F.lit(weight) * factors[name]
        total = part if total is None else total + part
    return F.coalesce(total, F.lit(0.1))


def match_tier(score: Column) -> Column:
    return F.when(score >= 0.8, "full_match").when(score >= 0.5, "close_match").otherwise("stretch_pick")


def client_score(tags: Column, flags: Mapping[str, Column], flavors: Column, difficulty: Column, seasons: Column, profile: Mapping, season: str) -> Column:
    """0 to 100: cuisine 35, diet 25 less 15 for each restriction broken, flavour 20, skill 10, season 10; parts rounded half up."""
    default = F.lit(CLIENT_DEFAULT)
    best = default
    for cuisine, level in profile["affinities"]:
        hit = _touch(tags, cuisine.lower())
        best = F.greatest(best, F.when(hit, CLIENT_LEVELS.get(level, CLIENT_DEFAULT)).otherwise(default))
    cuisine = F.when(F.size(tags) == 0, F.lit(CLIENT_DEFAULT * 35)).otherwise(numeric.half_up(best * 35).cast("double"))
    on = lambda k: F.coalesce(flags.get(k, F.lit(False)), F.lit(False))
    off = lambda k: F.coalesce(~flags[k], F.lit(False)) if k in flags else F.lit(False)  # noqa: E731  said to be false
    almost = lambda c: F.when(c, 25).when(on("vegan_if_substituted"), 12).otherwise(0)
    diet = {
        "vegan": almost(on("is_vegan")),
        "vegetarian": almost(on("is_vegetarian") | on("is_vegan")),
        "pescatarian": F.when(on("is_pescatarian_ok") | on("is_vegan") | on("is_vegetarian"), 25).otherwise(0),
    }.get(profile["spectrum"], F.lit(25))
    broken = [
        (("nut",), off("is_nut_free")),
        (("no pork", "pork-free", "halal"), on("contains_pork")),
        (("shellfish",), on("contains_shellfish")),
        (("dairy",), off("is_dairy_free")),
        (("gluten",), off("is_gluten_free")),
    ]
    penalty = sum((F.when(c, 15).otherwise(0) for r in profile["restrictions"] for words, c in broken if any(w in r.lower() for w in words)), F.lit(0))
    flavor = F.aggregate(F.transform(flavors, lambda t: numeric.lookup(profile["flavors"], t, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x) / F.when(F.size(flavors) > 0, F.size(flavors))
    gap = F.coalesce(difficulty, F.lit(1)) - profile["skill"]
    skill = F.when(gap <= 0, 10).when(gap == 1, 6).otherwise(2)
    timely = F.when(F.size(seasons) == 0, 5).when(F.exists(seasons, lambda s: s.contains(season)), 10).otherwise(2)
    total = cuisine + F.greatest(F.lit(0), diet - penalty) + F.coalesce(numeric.half_up(flavor * 20), F.lit(0)) + skill + timely
    return numeric.clamp(numeric.half_up(total), 0, 100).cast("int")
