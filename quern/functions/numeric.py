"""Vector, geographic and quantity expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either norm is 0. The longer vector is cut to the shorter one's length."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, n), F.slice(b, 1, n)
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


def is_zero(vector: Column) -> Column:
    """Whether all components are 0; true for an empty vector."""
    return F.forall(vector, lambda x: x == 0)


def parse_vector(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in metres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dp, dl = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    a = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return F.lit(EARTH_M * 2) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def half_up(x: Column) -> Column:
    """Round half towards positive infinity."""
    return F.floor(x + 0.5)


def mean_of(values: Column) -> Column:
    """Mean of an array of doubles; null where it is empty."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values))


def lookup(table: Mapping, key: Column, default: Column | None = None) -> Column:
    """A literal map's value."""
    if not table:
        return default if default is not None else F.lit(None)
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.element_at(pairs, key)
    return found if default is None else F.coalesce(found, default)


def parse_measure(text: Column) -> Column:
    """struct(amount, unit) of such as ``1/2 cup``: a leading number and all that follows it as the unit, in lower case.

    Without a number all of it is the unit of 1; a number that is none counts as 1 and keeps its unit; nothing is one piece.
    """
    t = F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))
    pattern = r"^([0-9./]+)\s*(.*)"
    number, unit = F.regexp_extract(t, pattern, 1), F.regexp_replace(F.regexp_extract(t, pattern, 2), r"^\s+|\s+$", "")
    parts = F.split(number, "/")
    ratio = F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double"))
    value = F.when(F.size(parts) > 1, ratio).otherwise(number.try_cast("double"))
    given = F.when(number != "", unit).otherwise(t)
    return F.struct(
        F.coalesce(value, F.lit(1.0)).alias("amount"),
        F.when(F.coalesce(given, F.lit("")) == "", F.lit("piece")).otherwise(given).alias("unit"),
    )


#: Grams of a unit; any other unit counts as 100.
UNIT_GRAMS = {
    "g": 1.0,
    "kg": 1000.0,
    "ml": 1.0,
    "dl": 100.0,
    "cl": 10.0,
    "l": 1000.0,
    "tbsp": 15.0,
    "tsp": 5.0,
    "piece": 100.0,
    "bunch": 50.0,
    "pinch": 1.0,
}

#: British names and their American equivalents.
BRITISH_TO_AMERICAN = {
    "aubergine": "eggplant",
    "courgette": "zucchini",
    "coriander": "cilantro",
    "spring onion": "scallion",
    "rocket": "arugula",
    "chips": "fries",
    "crisps": "chips",
    "mince": "ground meat",
    "minced beef": "ground beef",
    "minced pork": "ground pork",
    "minced lamb": "ground lamb",
    "double cream": "heavy cream",
    "single cream": "light cream",
    "caster sugar": "superfine sugar",
    "icing sugar": "powdered sugar",
    "plain flour": "all-purpose flour",
    "strong flour": "bread flour",
    "wholemeal flour": "whole wheat flour",
    "bicarbonate of soda": "baking soda",
    "biscuit": "cookie",
    "broad beans": "fava beans",
    "swede": "rutabaga",
    "mange tout": "snow peas",
    "king prawn": "jumbo shrimp",
    "prawn": "shrimp",
    "streaky bacon": "bacon",
    "back bacon": "canadian bacon",
    "gammon": "ham steak",
    "rapeseed oil": "canola oil",
    "natural yoghurt": "plain yogurt",
    "full-fat milk": "whole milk",
    "semi-skimmed milk": "2% milk",
    "skimmed milk": "skim milk",
    "pepper (capsicum)": "bell pepper",
    "capsicum": "bell pepper",
    "chilli": "chili",
    "beetroot": "beet",
    "sweetcorn": "corn",
    "tin": "can",
    "tinned tomatoes": "canned tomatoes",
    "stock cube": "bouillon cube",
    "cling film": "plastic wrap",
    "greaseproof paper": "parchment paper",
    "grill": "broil",
    "liquidiser": "blender",
    "measure": "measuring cup",
}
#: The last British name of an American one stands for it.
SYNONYMS = {us: eu for eu, us in BRITISH_TO_AMERICAN.items()}


def unit_to_grams(unit: Column) -> Column:
    return lookup(UNIT_GRAMS, F.lower(F.trim(unit)), F.lit(100.0))


def synonym(name: Column) -> Column:
    """The British name, lower-cased and trimmed."""
    n = F.lower(F.trim(name))
    return lookup(SYNONYMS, n, n)


def american(name: Column) -> Column:
    """The American name, lower-cased and trimmed."""
    n = F.lower(F.trim(name))
    return lookup(BRITISH_TO_AMERICAN, n, n)


def season(month: Column) -> Column:
    return F.when(month.between(3, 5), "spring").when(month.between(6, 8), "summer").when(month.between(9, 11), "autumn").otherwise("winter")


def daypart(hour: Column) -> Column:
    """The meal that an hour of the day suggests, or null."""
    return F.when(hour.between(5, 9), "breakfast").when(hour.between(11, 13), "lunch").when(hour.between(17, 21), "dinner")
