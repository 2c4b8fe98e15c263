"""Row predicates with explicit null policies.

``lenient`` passes rows whose time is unknown and reads a missing flag as false; ``strict`` is plain three-valued logic
in a ``where``: what is unknown goes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text

POLICIES = ("lenient", "strict")


def bare_label(label: str) -> str:
    """A restriction without a leading ``no-`` or ``no ``, in lower case: what must not be in the dish."""
    label = label.strip().lower()
    return label[3:] if label.startswith(("no-", "no ")) else label


def exclude_ingredient(names: Column, tags: Column, label: str, raw_label: bool = False) -> Column:
    """No ingredient name, nor the joined tags, holds ``label`` as a substring. A blank label excludes nothing."""
    label = label.strip().lower() if raw_label else bare_label(label)
    if not label:
        return F.lit(True)
    in_names = F.exists(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.coalesce(F.lower(n).contains(label), F.lit(False)))
    return ~in_names & ~F.lower(F.coalesce(F.array_join(tags, " "), F.lit(""))).contains(label)


def dietary_flag(flag: Column, required: bool = True, nulls: str = "lenient") -> Column:
    return (F.coalesce(flag, F.lit(False)) if nulls == "lenient" else flag) == F.lit(required)


def max_time(minutes: Column, most: int, nulls: str = "lenient") -> Column:
    within = minutes <= most
    return minutes.isNull() | within if nulls == "lenient" else within


def exclude_cuisine(tags: Column, cuisine: str) -> Column:
    return ~F.exists(F.coalesce(tags, F.array().cast("array<string>")), lambda c: F.lower(c).contains(cuisine.lower()))


def first_failure(checks: Sequence[tuple[Column, str]]) -> Column:
    """The reason of the first check that does not hold, or null. Unknown counts as not holding."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for ok, reason in checks])


def raw_quality(title: Column, terms: Column, steps: Column) -> Column:
    """Title of 1 to 200 characters, two terms and two steps at least, no step over 2000 characters."""
    return (
        F.length(title).between(1, 200)
        & (F.size(terms) >= 2)
        & (F.size(steps) >= 2)
        & ~F.exists(steps, lambda s: F.length(s) > 2000)
    )


#: How descriptions begin that say nothing.
STUBS = ("a recipe for", "this is a recipe", "delicious recipe", "simple recipe")


def is_stub(description: Column, openings: Sequence[str] = STUBS, least: int = 80) -> Column:
    """Null, blank, shorter than ``least`` or with one of the stock openings."""
    t = F.lower(F.trim(F.coalesce(description, F.lit(""))))
    return (F.length(t) < least) | t.rlike(f"^(?:{text.escaped(openings)})")


def non_empty(values: Column) -> Column:
    return F.coalesce(F.size(values) > 0, F.lit(False))


def non_empty_json(values: Column) -> Column:
    """The same of an array in JSON."""
    return non_empty(F.from_json(values, "array<string>"))


METRIC_UNITS = ("g", "ml", "dl", "cl", "kg", "l", "tbsp", "tsp", "piece", "pinch", "bunch", "to-taste")


def has_metric_unit(units: Column) -> Column:
    return F.coalesce(F.exists(units, lambda u: F.coalesce(F.lower(u).isin(*METRIC_UNITS), F.lit(False))), F.lit(False))


def any_flag(flags: Column) -> Column:
    """Whether any value of a map or array of booleans is true."""
    return F.coalesce(F.exists(flags, lambda x: F.coalesce(x, F.lit(False))), F.lit(False))


def failures(checks: Sequence[tuple[Column, str]]) -> Column:
    """All reasons whose check does not hold, in order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(why)) for ok, why in checks]))


def baseline_failures(title: Column, names: Column, steps: Column) -> Column:
    """What a document lacks: a title, ingredients, their names, the texts of its steps."""
    filled = lambda a: F.forall(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))
    return failures([(F.trim(title) != "", "title"), (non_empty(names), "ingredients"), (filled(names), "ingredient name"), (filled(steps), "step text")])


def missing_fields(fields: dict[str, Column]) -> Column:
    """Names of the fields that are null."""
    return failures([(c.isNotNull(), name) for name, c in fields.items()])


def off_topic(complexity: Column, signal: Column) -> Column:
    return (complexity <= 0.15) & ~F.coalesce(signal, F.lit(False))


def limit_then_filter(df: DataFrame, order: Sequence[Column], first: int, predicate: Column, most: int) -> DataFrame:
    """The first rows, then those of them that match: the order of the two matters."""
    return df.orderBy(*order).limit(first).where(predicate).orderBy(*order).limit(most)
