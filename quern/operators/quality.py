"""Quality scores, tiers, enrichment flags and provenance of documents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.numeric import lookup
from quern.operators import filters


def _size(a: Column) -> Column:
    return F.coalesce(F.size(a), F.lit(0))


def _length(t: Column) -> Column:
    return F.length(F.coalesce(t, F.lit("")))


def score_100(title: Column, ingredients: Column, steps: Column, label: Column, terms: Column) -> Column:
    """0 to 100: ingredients 25/15/5, steps 25/15/5, title 20/10, label 20 (5 if generic), terms 10."""
    n, s, t = _size(ingredients), _size(steps), F.length(F.trim(F.coalesce(title, F.lit(""))))
    generic = label.isin("Other", "Unknown", "other", "")
    return F.least(
        F.lit(100),
        F.when(n.between(5, 15), 25).when(n.between(3, 20), 15).when(n >= 2, 5).otherwise(0)
        + F.when(s.between(4, 12), 25).when(s.between(2, 15), 15).when(s >= 1, 5).otherwise(0)
        + F.when(t.between(10, 60), 20).when(t.between(5, 80), 10).otherwise(0)
        + F.when(label.isNull(), 0).when(generic, 5).otherwise(20)
        + F.when(_size(terms) > 0, 10).otherwise(0),
    )


def score_unit(title: Column, terms: Column, steps: Column) -> Column:
    """0 to 1: terms .3/.2/.1, steps .2/.15, title .2/.1, distinct terms .15/.1, mean step length .15/.1."""
    n, s, t = _size(terms), _size(steps), _length(title)
    distinct = _size(F.array_distinct(F.transform(terms, lambda x: F.trim(F.lower(x)))))
    mean = F.aggregate(steps, F.lit(0), lambda a, x: a + F.length(x)) / F.when(s > 0, s)
    return F.least(
        F.lit(1.0),
        F.when(n.between(7, 15), 0.3).when(n.between(5, 20), 0.2).otherwise(0.1)
        + F.when(s.between(4, 10), 0.2).when(s.between(3, 15), 0.15).otherwise(0.0)
        + F.when(t.between(10, 60), 0.2).when(t > 5, 0.1).otherwise(0.0)
        + F.when(distinct >= 6, 0.15).when(distinct >= 4, 0.1).otherwise(0.0)
        + F.when(mean > 50, 0.15).when(mean > 30, 0.1).otherwise(0.0),
    )


def score_deductions(title: Column, terms: Column, steps: Column) -> Column:
    """1 minus deductions for few terms, few steps, short titles and digits in them; 0 at least."""
    n, s = _size(terms), _size(steps)
    off = lambda c, x: F.when(c, F.lit(x)).otherwise(0.0)
    score = F.lit(1.0) - off(n < 5, 0.1) - off(n < 3, 0.2) - off(s < 3, 0.15) - off(s < 2, 0.2)
    score = score - off(_length(title) < 5, 0.1) - off(F.coalesce(title, F.lit("")).rlike("[0-9]"), 0.05)
    return F.greatest(F.lit(0.0), score)


#: What each enrichment is worth for promotion.
PROMOTION = {
    "has_real_description": 30,
    "has_cuisine_tag": 20,
    "has_course_tag": 20,
    "has_dietary_flags": 15,
    "has_llm_flavor_tags": 10,
    "has_nutrition": 5,
}


def promotion_score(flags: Mapping[str, Column]) -> Column:
    """Sum of the points of the flags that are true; null counts 0."""
    return sum((F.when(flags[k], F.lit(v)).otherwise(0) for k, v in PROMOTION.items()), F.lit(0))


READY = ("deterministic_enriched", "llm_enriched", "validated")


def tier(title: Column, n_ingredients: Column, n_steps: Column, flags: Mapping[str, Column], status: Column) -> Column:
    """0 rejected or empty, 1 complete, 2 usable, 3 with a title."""
    t, n, s = F.length(F.trim(F.coalesce(title, F.lit("")))), F.coalesce(n_ingredients, F.lit(0)), F.coalesce(n_steps, F.lit(0))
    on = lambda k: F.coalesce(flags[k], F.lit(False))
    complete = (t >= 5) & (n >= 2) & (s >= 2) & on("has_real_description") & on("has_cuisine_tag") & on("has_course_tag") & on("has_dietary_flags") & status.isin(*READY)
    return F.when(status == "rejected", 0).when(complete, 1).when((t >= 3) & (n >= 2) & (s >= 1), 2).when(t >= 1, 3).otherwise(0)


def tier1_failures(title: Column, description: Column, n_ingredients: Column, n_steps: Column, flags: Mapping[str, Column], status: Column, confidence: Column) -> Column:
    """What keeps a document from tier 1, in order. ``flags``: has_cuisine_tag, has_course_tag, has_dietary_flags."""
    checks = [
        (F.length(F.trim(title)) >= 3, "title"),
        (n_ingredients >= 2, "ingredients"),
        (n_steps >= 2, "steps"),
        (F.length(description) >= 50, "description"),
        (flags["has_cuisine_tag"], "cuisine_tags"),
        (flags["has_course_tag"], "course_tags"),
        (flags["has_dietary_flags"], "dietary_flags"),
        (status != "raw", "enrichment_status"),
        (description.isNull() | (confidence >= 0.6), "description.confidence"),
    ]
    return filters.failures(checks)


def next_status(tier_: Column, status: Column) -> Column:
    """Complete documents become validated."""
    return F.when(tier_ == 1, F.lit("validated")).otherwise(status)


def tier_quality(tier_: Column) -> Column:
    return lookup({1: 0.95, 2: 0.65, 3: 0.35, 0: 0.1}, tier_)


def completeness(deductions: Mapping[str, tuple[Column, float]]) -> Column:
    """1 minus the given deductions whose condition holds, clamped, to two places."""
    score = F.lit(1.0)
    for condition, off in deductions.values():
        score = score - F.when(condition, F.lit(off)).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2)


#: Groups of fields whose provenance is seeded.
SEEDED = ("title", "description", "cuisine_tags", "course_tags", "dietary_flags", "flavor_tags", "nutrition_per_serving")


def seeded_provenance(provenance: Column, has_label: Column, source: str = "recipenlg_raw") -> Column:
    """A map of group -> struct(source, confidence) where provenance is empty; what exists is kept."""
    entry = lambda s, c: F.struct(s.alias("source"), c.alias("confidence"))
    values = []
    for group in SEEDED:
        if group == "title":
            values.append(entry(F.lit(source), F.lit(0.5)))
        elif group == "cuisine_tags":
            values.append(entry(F.when(has_label, F.lit(source)).otherwise("unknown"), F.when(has_label, F.lit(0.3)).otherwise(0.0)))
        else:
            values.append(entry(F.lit("unknown"), F.lit(0.0)))
    seed = F.map_from_arrays(F.array(*[F.lit(g) for g in SEEDED]), F.array(*values))
    return F.when(F.coalesce(F.size(provenance), F.lit(0)) == 0, seed).otherwise(provenance)


def changed(df: DataFrame, pairs: Mapping[str, str]) -> DataFrame:
    """Rows in which any column differs from its new value, null-safe."""
    same = F.lit(True)
    for old, new in pairs.items():
        same = same & F.col(old).eqNullSafe(F.col(new))
    return df.where(~same)
