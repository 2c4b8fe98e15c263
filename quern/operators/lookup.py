"""Names looked up in tiers of reference tables: exactly, by usual phrases, by beginning, and by likeness.

The first tier with a match decides. Each rule is an equi-join: names of a table that begin with the name are found by
joining it with all their beginnings at a comma or space, and likeness is computed only for pairs that a lossless filter leaves.

The filter: let two names, words sorted, have a and b letters, and common letters in order c. At LIKE of 100, 200 c / (a + b) >= LIKE
gives a least c. Of the c - 1 neighbours among them, at most (a - c) / 2 stand more than two places apart in the first name and
(b - c) / 2 in the second, so the names share at least ``least_shared`` pairs of letters one or two places apart, counted as often as
both have them. A name's most frequent pairs, as long as they are fewer than that, may be left out of the join; what is left
must still share the rest. Lengths differ by less than a factor of two, so classes of length are part of the key.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# How reference tables go on after an ingredient's name, in order of preference.
PHRASES = (
    ", raw", ", raw (average)", ", all types, raw", ", flesh and skin, raw", ", flesh without skin, raw", ", flesh without skin, without seeds, raw", " (average)", ", cooked (average)", ", cooked",
    ", white, cooked, no added salt", ", white", ", extra virgin", ", whole (average)", ", whole, raw", ", breast, raw", ", breast, cooked", ", leg, roasted/baked", ", shoulder, cooked", ", chop, grilled/pan-fried",
    ", steamed", ", boiled/cooked in water", ", peeled, raw", ", peeled, boiled/cooked in water",
)
LIKE, SURE, TOP, CLOSE = 70.0, 85.0, 10, 10.0
SPACES = r"[\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"  # what Python's split takes for space
WHOLE = r"(?![\uDC00-\uDFFF])"  # not inside a character


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a word of bits for each row of its table."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def likeness(a: str, b: str) -> float:
    """0 to 100 by insertions and deletions between the two, their words sorted."""
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


@F.pandas_udf(DoubleType())
def likeness_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([likeness(x, y) for x, y in zip(a, b)], dtype="float64")


def _first(df: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def _sorted_words(names: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(names, SPACES), lambda w: w != "")), " ")


def least_common(a: Column, b: Column) -> Column:
    """The fewest common letters in order that names of ``a`` and ``b`` letters have if they are LIKE alike."""
    return F.ceil((a + b) * int(LIKE) / 200).cast("int")


def least_shared(a: Column, b: Column) -> Column:
    """How many pairs of letters, one or two places apart, such names share at least."""
    c = least_common(a, b)
    return (c - 1 - F.floor((a - c) / 2) - F.floor((b - c) / 2)).cast("int")


def _pairs_of(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with size (letters of the sorted words), pair and n: how often the pair stands there. One letter has no pairs."""
    runs = lambda k: F.regexp_extract_all("words", F.lit(f"(?s){WHOLE}(?=({'.' * k}))"), F.lit(1))
    apart = F.transform(runs(3), lambda x: F.concat(F.substring(x, 1, 1), F.substring(x, 3, 1)))
    each = rows.withColumn("words", _sorted_words(F.col(text))).withColumn("size", F.char_length("words"))
    each = each.select(*rows.columns, "size", F.explode(F.concat(runs(2), apart)).alias("pair"))
    return each.groupBy(*rows.columns, "size", "pair").agg(F.count(F.lit(1)).alias("n"))


def alike_pairs(names: DataFrame, entries: DataFrame) -> DataFrame:
    """name, tier, entry: every pair of a name (name, tries) and an entry (tier, entry) of its first ``tries`` tiers that can be LIKE
    alike, but for equal ones of one letter or none."""
    met = _pairs_of(entries, "entry").select("tier", "entry", F.col("size").alias("long"), F.length(F.bin("size")).alias("class"), "pair", F.col("n").alias("m"))
    often = met.groupBy("pair").agg(F.sum("m").alias("often"))
    asked = _pairs_of(names.where("tries > 0").select("name", "tries"), "name")
    sizes = F.filter(F.sequence(F.lit(1), F.col("size") * 2), lambda b: least_common(F.col("size"), b) <= F.least("size", b))
    fewest = F.array_min(F.transform(sizes, lambda b: least_shared(F.col("size"), b)))
    seen = F.sum("n").over(Window.partitionBy("name").orderBy(F.col("often").desc(), "pair"))  # a name's own pairs
    kept = asked.join(often, "pair", "left").withColumn("often", F.coalesce("often", F.lit(0))).withColumn("seen", seen).withColumn("fewest", fewest)
    kept = kept.withColumn("out", F.coalesce(F.max(F.when(F.col("seen") < F.col("fewest"), F.col("seen"))).over(Window.partitionBy("name")), F.lit(0))).where("seen >= fewest AND often > 0")
    near = F.array(*[F.length(F.bin("size")) + i for i in (-1, 0, 1)])
    kept = kept.select("name", "size", "pair", "n", "out", F.explode(F.sequence(F.lit(0), F.col("tries") - 1)).alias("tier"), near.alias("near"))
    kept = kept.withColumn("class", F.explode("near")).drop("near")
    a, b = F.col("size"), F.col("long")
    both = kept.join(met, ["tier", "class", "pair"]).where(least_common(a, b) <= F.least(a, b))
    shared = both.groupBy("name", "tier", "entry", "size", "long", "out").agg(F.sum(F.least("n", "m")).alias("shared"))
    return shared.where(F.col("shared") + F.col("out") >= least_shared(a, b)).select("name", "tier", "entry")


def _plainly(names: DataFrame, entries: DataFrame) -> DataFrame:
    """name, tier, entry, rule of each name in the first tier that has it exactly (1), in a phrase (2) or at its beginning (3)."""
    row = lambda rule, place: ("name", "tier", "entry", F.lit(rule).alias("rule"), place.cast("int").alias("place"))
    exact = entries.join(names, entries["entry"] == names["name"]).select(*row(1, F.lit(0)))
    phrases = names.select("name", F.posexplode(F.array(*[F.lit(p) for p in PHRASES])).alias("at", "phrase")).select("name", "at", F.concat("name", "phrase").alias("entry"))
    by_phrase = phrases.join(entries, "entry").select(*row(2, F.col("at")))
    ends = F.filter(F.sequence(F.lit(1), F.length("entry")), lambda i: F.substring("entry", i, F.lit(1)).isin(",", " "))
    beginnings = entries.select("tier", "entry", F.explode(F.array_distinct(F.transform(ends, lambda i: F.substring("entry", F.lit(1), i - 1)))).alias("name"))
    kind = F.when(F.col("entry").contains("raw"), 0).when(F.col("entry").contains("cooked") | F.col("entry").contains("steamed"), 1).otherwise(2)
    by_start = beginnings.join(names, "name").select(*row(3, kind))
    return _first(exact.unionByName(by_phrase).unionByName(by_start), ["name"], ["tier", "rule", "place", F.length("entry"), "entry"]).drop("place")


def _alike(names: DataFrame, entries: DataFrame) -> DataFrame:
    """The same by likeness (4), in each of the ``tries`` first tiers of a name."""
    scored = alike_pairs(names, entries).withColumn("score", likeness_of("name", "entry")).where(F.col("score") >= LIKE)
    of_name = Window.partitionBy("name", "tier")
    best = scored.withColumn("place", F.row_number().over(of_name.orderBy(F.col("score").desc(), F.length("entry"), "entry"))).where(F.col("place") <= TOP)
    head = F.split("entry", ",")[0]
    plain = (F.size(F.split("entry", ",")) <= 4) & (head.contains(F.col("name")) | (F.col("score") >= SURE))
    kept = best.withColumn("plain", plain).withColumn("some", F.bool_or("plain").over(of_name)).where("plain OR NOT some AND place <= 3")
    near = kept.withColumn("top", F.max("score").over(of_name)).where(F.col("score") >= F.col("top") - CLOSE)
    return _first(near, ["name"], ["tier", F.length("entry"), F.col("score").desc(), "entry"]).select("name", "tier", "entry", F.lit(4).alias("rule"))


def tiered(names: DataFrame, tiers: Mapping[str, DataFrame], like: bool = True) -> DataFrame:
    """name, tier, entry, rule: each distinct name (column ``name``) in the first tier that has it; others have no row.

    Tiers are tables with a column ``entry``; names and entries are compared trimmed and in lower case. Likeness is tried
    in the tiers before the one that has the name plainly, with every entry in effect. Null and blank names and entries match nothing.
    """
    clean = lambda c: F.lower(F.trim(F.col(c)))
    wanted = names.select(clean("name").alias("name")).where("name <> ''").distinct()
    tables = [t.select(F.lit(i).alias("tier"), clean("entry").alias("entry")) for i, t in enumerate(tiers.values())]
    entries = functools.reduce(DataFrame.unionByName, tables).where("entry <> ''").distinct()
    found = _plainly(wanted, entries)
    if like:
        open_ = wanted.join(found.select("name", "tier"), "name", "left").select("name", F.coalesce("tier", F.lit(len(tables))).alias("tries"))
        found = _first(found.unionByName(_alike(open_, entries)), ["name"], ["tier"])
    label = F.element_at(F.array(*[F.lit(t) for t in tiers]), F.col("tier") + 1)
    return found.select("name", label.alias("tier"), "entry", "rule")


# Nutrients and their decimal places in a document; kcal is a whole number.
NUTRIENTS = {"kcal": 0, "protein_g": 1, "fat_g": 1, "saturated_fat_g": 1, "carbs_g": 1, "fiber_g": 1, "sugar_g": 1, "salt_g": 2}


def nutrition_per_serving(docs: DataFrame, key: str, names: Column, serves: Column, nutrition: DataFrame) -> DataFrame:
    """``key`` and the nutrients summed over the names found, by serving: kcal one at least; documents without any are null.

    ``nutrition``: name and the NUTRIENTS. A name counts as often as the document has it; no servings count as four.
    """
    rows = docs.select(F.col(key), F.when(F.coalesce(serves, F.lit(0)) == 0, 4).otherwise(serves).alias("serves"), F.explode_outer(F.transform(names, lambda n: F.lower(F.trim(n)))).alias("name"))
    total = rows.join(nutrition, "name", "left").groupBy(key, "serves").agg(*[F.sum(n).alias(n) for n in NUTRIENTS])
    share = lambda n, places: F.greatest(F.lit(1), (F.col(n) / F.col("serves")).cast("int")) if n == "kcal" else F.round(F.col(n) / F.col("serves"), places)
    return total.select(key, *[F.when(F.col(n).isNotNull(), share(n, places)).alias(n) for n, places in NUTRIENTS.items()])
