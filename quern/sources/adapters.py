"""Adapters: one feed each, from its own shape (``schemas.FEEDS``) to documents or places, in column expressions.

A field that is null counts as missing and gets the feed's default.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern import schemas
from quern.functions import numeric, text
from quern.operators import classify

def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _or(c: Column, default) -> Column:
    return F.coalesce(c, F.lit(default))


def _strings(c: Column, default: Sequence[str] = ()) -> Column:
    fill = F.array(*[F.lit(x) for x in default]).cast("array<string>") if default else F.array().cast("array<string>")
    return F.coalesce(c, fill)


def _ingredient(name: Column, amount: Column, unit: Column, notes: Column) -> Column:
    return F.struct(name.alias("name"), amount.cast("double").alias("amount"), unit.alias("unit"), notes.alias("notes"), F.lit(False).alias("is_optional"))


def numbered_steps(lines: Column) -> Column:
    """Steps of the lines that are not blank, numbered by their place among all lines."""
    all_ = F.transform(lines, lambda x, i: F.struct((i + 1).alias("step_number"), strip(x).alias("instruction"), F.lit(None).cast("int").alias("duration_min"), F.array().cast("array<string>").alias("technique_tags")))
    return F.filter(all_, lambda s: F.coalesce(s["instruction"], F.lit("")) != "")


def parse_quantity(line: Column) -> Column:
    """struct(amount, unit) of such as ``1/2 cup flour``: a number, a word and more after it; else one piece."""
    pattern = r"^([0-9./ ]+)\s+(\w+)\s+"
    number, unit = F.trim(F.regexp_extract(strip(line), pattern, 1)), F.regexp_extract(strip(line), pattern, 2)
    parts = F.split(number, "/")
    value = F.when(F.size(parts) > 1, F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double"))).otherwise(number.try_cast("double"))
    return F.struct(F.coalesce(value, F.lit(1.0)).alias("amount"), F.when(value.isNull(), F.lit("piece")).otherwise(unit).alias("unit"))


def paired_ingredients(names: Column, lines: Column, synonyms: bool = False) -> Column:
    """Ingredients of ``names``, each with the line at its place: what the line says of amount and unit, or one piece."""

    def one(name, i):
        line = F.get(F.coalesce(lines, F.array().cast("array<string>")), i)
        read = parse_quantity(line)
        clean = numeric.synonym(strip(name)) if synonyms else strip(name)
        return _ingredient(clean, F.coalesce(read["amount"], F.lit(1.0)), F.coalesce(read["unit"], F.lit("piece")), F.when(line != "", line))

    return F.transform(_strings(names), one)


#: Units of the client's parser.
CLIENT_UNITS = (
    "g", "kg", "ml", "l", "tsp", "tbsp", "cup", "cups", "oz", "lb", "lbs", "clove", "cloves", "slice", "slices", "handful", "handfuls", "pinch", "pinches", "bunch", "bunches",
    "sprig", "sprigs", "piece", "pieces", "sheet", "sheets", "can", "cans", "jar", "jars", "pack", "packs", "stalk", "stalks",
)


def parse_ingredient(line: Column) -> Column:
    """struct(name, amount, unit) of a line: amount, known unit and name; or a bare number and name; or a name."""
    t = strip(line)
    full, bare = rf"(?i)^([0-9][0-9\s./]*)?\s*({'|'.join(CLIENT_UNITS)})\.?\s+(.+)$", r"^([0-9][0-9./]*)\s+(.+)$"
    part = lambda name, amount, unit: F.struct(name.alias("name"), amount.alias("amount"), unit.alias("unit"))
    return (
        F.when(t.rlike(full), part(strip(F.regexp_extract(t, full, 3)), strip(F.regexp_extract(t, full, 1)), F.lower(F.regexp_extract(t, full, 2))))
        .when(t.rlike(bare), part(strip(F.regexp_extract(t, bare, 2)), F.regexp_extract(t, bare, 1), F.lit("")))
        .otherwise(part(t, F.lit(""), F.lit("")))
    )


def document(df: DataFrame, **fields: Column) -> DataFrame:
    """Documents with the given fields; all others are null or empty, by ``schemas.DOCUMENT``."""
    target = df.sparkSession.createDataFrame([], schemas.DOCUMENT).schema
    out = []
    for f in target:
        kind = f.dataType.simpleString()
        c = fields.get(f.name, F.lit(None))
        out.append((F.coalesce(c.cast(kind), F.array().cast(kind)) if kind.startswith("array") else c.cast(kind)).alias(f.name))
    return df.select(*out)


def _names(ingredients: Column) -> Column:
    return F.array_join(F.transform(ingredients, lambda i: i["name"]), " ")


def from_flat(raw: DataFrame) -> DataFrame:
    """Meals with ingredient and measure in twenty numbered fields each."""
    pairs = F.array(*[F.struct(strip(_or(F.col(f"strIngredient{i}"), "")).alias("name"), strip(_or(F.col(f"strMeasure{i}"), "")).alias("measure")) for i in range(1, 21)])
    read = F.transform(F.filter(pairs, lambda p: p["name"] != ""), lambda p: _ingredient(p["name"], numeric.parse_measure(p["measure"])["amount"], numeric.parse_measure(p["measure"])["unit"], F.when(p["measure"] != "", p["measure"])))
    raw = raw.withColumns({"read": read, "lines": F.split(_or(F.col("strInstructions"), ""), "\r\n")})
    category = _or(F.col("strCategory"), "")
    tag = F.when(category != "", F.array(F.lower(category)))
    title, area = _or(F.col("strMeal"), "Unknown Recipe"), _or(F.col("strArea"), "Unknown")
    return document(
        raw, title=title, title_en=title, cuisine_tags=F.array(area), ingredients=F.col("read"), steps=numbered_steps(F.col("lines")), dietary_tags=tag, course_tags=tag,
        season_tags=F.array(F.lit("year-round")), source_type=F.lit("themealdb"), embedding_text=F.concat_ws(" ", title, area, category, _names(F.col("read"))), data_quality_score=F.lit(0.3),
    )


def from_plain(raw: DataFrame) -> DataFrame:
    """Titles, names, lines and directions without any times: the feed's constants stand in."""
    title = _or(F.col("title"), "Untitled Recipe")
    raw = raw.withColumn("read", paired_ingredients(F.col("NER"), F.col("ingredients")))
    return document(
        raw, title=title, title_en=title, description=F.concat(F.lit("Recipe: "), title), ingredients=F.col("read"), steps=numbered_steps(_strings(F.col("directions"))),
        time_prep_min=F.lit(15), time_cook_min=F.lit(30), time_total_min=F.lit(45), serves=F.lit(4), difficulty=F.lit(2), season_tags=F.array(F.lit("year-round")),
        source_type=F.lit("recipenlg"), embedding_text=F.concat_ws(" ", title, _names(F.col("read"))), data_quality_score=F.lit(0.5),
    )


# The vocabulary of cuisines, and names that stand for one of it.
CUISINES = (
    "Italian", "French", "Spanish", "Greek", "Moroccan", "Lebanese", "Turkish", "Indian", "Chinese", "Japanese", "Korean", "Thai", "Vietnamese", "Mexican", "Peruvian",
    "American", "British", "German", "Dutch", "Scandinavian", "Middle Eastern", "African", "Caribbean", "Fusion", "Other",
)
CUISINE_ALIASES = {
    "swedish": "Scandinavian",
    "norwegian": "Scandinavian",
    "danish": "Scandinavian",
    "finnish": "Scandinavian",
    "mediterranean": "Fusion",
    "cajun": "American",
    "cuban": "Caribbean",
    "creole": "American",
    "irish": "British",
    "scottish": "British",
    "welsh": "British",
    "austrian": "German",
    "swiss": "German",
    "hungarian": "Fusion",
    "polish": "Fusion",
    "serbian": "Fusion",
    "croatian": "Fusion",
    "malaysian": "Fusion",
    "indonesian": "Fusion",
    "pakistani": "Indian",
    "sri lankan": "Indian",
    "ethiopian": "African",
    "nigerian": "African",
    "south african": "African",
    "west african": "African",
}


def clamped(c: Column, low: int, high: int | None = None) -> Column:
    c = F.greatest(F.lit(low), c)
    return c if high is None else F.least(F.lit(high), c)


def rounded_nutrition(n: Column) -> Column:
    """Whole kcal, one at least; salt to two places and all else to one."""
    get = lambda k, places=1: F.round(_or(n[k], 0.0), places).alias(k)
    kcal = clamped(_or(n["kcal"], 0.0).cast("int"), 1).alias("kcal")
    return F.when(n.isNotNull(), F.struct(kcal, *[get(k) for k in ("protein_g", "fat_g", "saturated_fat_g", "carbs_g", "fiber_g", "sugar_g")], get("salt_g", 2)))


def record_completeness(d: Mapping[str, Column]) -> Column:
    """1 less what each gap costs, to two places."""
    gaps = [
        (F.length(d["description"]) < 30, 0.1),
        (F.size(d["ingredients"]) < 3, 0.15),
        (F.size(d["steps"]) < 2, 0.1),
        (F.size(d["flavor_tags"]) == 0, 0.05),
        (F.size(d["texture_tags"]) == 0, 0.05),
        (d["nutrition"].isNull(), 0.1),
        (d["cuisine"] == "Other", 0.05),
        ((d["prep"] == 0) & (d["cook"] == 0), 0.1),
    ]
    score = sum((-F.when(gap, F.lit(off)).otherwise(0.0) for gap, off in gaps), F.lit(1.0))
    return numeric.clamp(F.round(score, 2))


def from_enriched(raw: DataFrame) -> DataFrame:
    """Records with enrichment, nutrition and flags beside them; tags come as lists or comma-separated text."""
    e, title = F.col("_enrichment"), _or(F.col("title"), "Untitled Recipe")
    tags = lambda c, *default: F.when(c.isNull(), _strings(F.lit(None).cast("array<string>"), default)).otherwise(F.coalesce(F.from_json(c, "array<string>"), text.ensure_list(c)))
    described = F.coalesce(e["description"], F.concat(F.lit("A recipe for "), title, F.lit(".")))
    described = F.when(F.length(described) < 30, F.concat(F.lit("A delicious recipe for "), title, F.lit(". "), described)).otherwise(described)
    cuisine = classify.normalised_label(_or(e["cuisine"], "Other"), CUISINES, CUISINE_ALIASES)
    prep, cook = _or(e["time_prep_min"], 15), _or(e["time_cook_min"], 30)
    raw = raw.select(
        "*", title.alias("_title"), described.alias("_description"), cuisine.alias("_cuisine"), prep.alias("_prep"), cook.alias("_cook"),
        paired_ingredients(F.col("NER"), F.col("ingredients"), synonyms=True).alias("_ingredients"), numbered_steps(_strings(F.col("directions"))).alias("_steps"),
        rounded_nutrition(F.col("_nutrition")).alias("_per_serving"), tags(e["flavor_tags"]).alias("_flavor"), tags(e["texture_tags"]).alias("_texture"),
        tags(e["season_tags"], "year-round").alias("_season"), tags(e["occasion_tags"], "weeknight").alias("_occasion"), tags(e["course_tags"], "main").alias("_course"), tags(F.col("_dietary_tags")).alias("_dietary"),
    )
    c = F.col
    join = lambda k: F.array_join(c(k), " ")
    parts = {"description": c("_description"), "ingredients": c("_ingredients"), "steps": c("_steps"), "flavor_tags": c("_flavor"), "texture_tags": c("_texture")}
    score = record_completeness(parts | {"nutrition": c("_per_serving"), "cuisine": c("_cuisine"), "prep": c("_prep"), "cook": c("_cook")})
    embedded = text.join_non_empty(" ", c("_title"), c("_description"), _names(c("_ingredients")), join("_flavor"), join("_texture"), join("_dietary"), join("_occasion"), join("_season"), c("_cuisine"))
    return document(
        raw, title=c("_title"), title_en=c("_title"), cuisine_tags=F.array(c("_cuisine")), description=c("_description"), ingredients=c("_ingredients"), steps=c("_steps"),
        time_prep_min=c("_prep"), time_cook_min=c("_cook"), time_total_min=c("_prep") + c("_cook"), serves=clamped(_or(c("_enrichment.serves"), 4), 1), difficulty=clamped(_or(c("_enrichment.difficulty"), 2), 1, 5),
        flavor_tags=c("_flavor"), texture_tags=c("_texture"), dietary_tags=c("_dietary"), dietary_flags=c("_dietary_flags"), nutrition_per_serving=c("_per_serving"), season_tags=c("_season"),
        occasion_tags=c("_occasion"), course_tags=c("_course"), source_type=F.lit("recipenlg_enriched"), embedding_text=embedded, data_quality_score=score,
    )


def from_nutrients(raw: DataFrame) -> DataFrame:
    """Recipes with health labels and total nutrients; those are divided by the yield, and sodium gives salt."""
    r = F.col("recipe")
    labels = F.transform(_strings(r["healthLabels"]), F.lower)
    on = lambda *names: F.reduce(F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.array_contains(labels, n)), F.lit(True), lambda a, x: a & x)
    serves = F.when(_or(r["yield"], 0.0) == 0, 4.0).otherwise(r["yield"])
    share = lambda k: _or(F.try_element_at(r["totalNutrients"], F.lit(k))["quantity"], 0.0) / serves
    nutrition = F.struct(
        share("ENERC_KCAL").cast("int").alias("kcal"), F.round(share("PROCNT"), 1).alias("protein_g"), F.round(share("FAT"), 1).alias("fat_g"), F.round(share("FASAT"), 1).alias("saturated_fat_g"),
        F.round(share("CHOCDF"), 1).alias("carbs_g"), F.round(share("FIBTG"), 1).alias("fiber_g"), F.round(share("SUGAR"), 1).alias("sugar_g"), F.round(share("NA") / 400, 2).alias("salt_g"),
    )
    flags = F.struct(
        on("vegan").alias("is_vegan"), on("vegetarian").alias("is_vegetarian"), on("pescatarian").alias("is_pescatarian_ok"), on("dairy-free").alias("is_dairy_free"), on("gluten-free").alias("is_gluten_free"),
        on("tree-nut-free", "peanut-free").alias("is_nut_free"), F.lit(False).alias("is_halal_ok"), (~on("pork-free")).alias("contains_pork"), (~on("crustacean-free")).alias("contains_shellfish"),
        (~on("alcohol-free")).alias("contains_alcohol"), F.lit(False).alias("vegan_if_substituted"), F.lit(False).alias("gluten_free_if_substituted"),
    )
    read = F.transform(r["ingredients"], lambda i: _ingredient(_or(i["food"], "unknown"), _or(i["quantity"], 1.0), _or(i["measure"], "piece"), i["text"]))
    step = lambda x, i: F.struct((i + 1).alias("step_number"), x.alias("instruction"), F.lit(None).cast("int").alias("duration_min"), F.array().cast("array<string>").alias("technique_tags"))
    title, minutes, kinds = _or(r["label"], "Unknown"), _or(r["totalTime"], 30), _strings(r["cuisineType"])
    return document(
        raw, title=title, title_en=title, cuisine_tags=kinds, description=F.concat(F.lit("Recipe from Edamam: "), title), ingredients=read, steps=F.transform(_strings(r["instructionLines"]), step),
        time_prep_min=F.floor(minutes / 3), time_cook_min=F.floor(minutes * 2 / 3), time_total_min=minutes, serves=serves.cast("int"), difficulty=F.lit(2), dietary_tags=F.slice(F.array_sort(F.array_distinct(labels)), 1, 5),
        dietary_flags=flags, nutrition_per_serving=nutrition, season_tags=F.array(F.lit("year-round")), source_type=F.lit("edamam"),
        embedding_text=F.concat_ws(" ", title, _names(F.coalesce(read, F.array().cast(f"array<{schemas.INGREDIENT}>"))), F.array_join(kinds, " ")), data_quality_score=F.lit(1.0),
    )


# The nutrients of a product per 100 g, and their names and decimal places here.
PER_100G = {
    "proteins_100g": ("protein_g", 1),
    "fat_100g": ("fat_g", 1),
    "saturated-fat_100g": ("saturated_fat_g", 1),
    "carbohydrates_100g": ("carbs_g", 1),
    "fiber_100g": ("fiber_g", 1),
    "sugars_100g": ("sugar_g", 1),
    "salt_100g": ("salt_g", 2),
}


def from_product(raw: DataFrame) -> DataFrame:
    """product_name, nutrition_per_100g, allergens, labels."""
    value = lambda k: _or(F.try_element_at("nutriments", F.lit(k)), 0.0)
    nutrition = F.struct(value("energy-kcal_100g").cast("int").alias("kcal"), *[F.round(value(k), places).alias(name) for k, (name, places) in PER_100G.items()])
    return raw.select(_or(F.col("product_name"), "").alias("product_name"), nutrition.alias("nutrition_per_100g"), _strings(F.col("allergens_tags")).alias("allergens"), _strings(F.col("labels_tags")).alias("labels"))


def from_place(raw: DataFrame) -> DataFrame:
    """Places with nested or flat coordinates and addresses; a price from 1 to 4 becomes as many signs, any other two."""
    c, nested = F.col, F.col("location").isNotNull()
    price = F.when(c("price_range").isNotNull(), F.when(c("price_range") == "", "€€").otherwise(c("price_range"))).when(c("price").between(1, 4), F.repeat(F.lit("€"), c("price"))).otherwise("€€")
    where = lambda inner, flat, default: F.when(nested, _or(c(f"location.{inner}"), default)).otherwise(_or(c(flat), default))
    blank = lambda *names: F.coalesce(*[F.when(c(n) != "", c(n)) for n in names])  # noqa: E731  the first that is not empty
    out = {
        "id": F.coalesce("id", F.uuid()), "name": _or(c("name"), "Unknown"), "address": where("formatted_address", "address", ""), "neighborhood": _or(c("neighborhood"), "Unknown"),
        "city": where("locality", "city", "Amsterdam"), "country": where("country", "country", "NL"), "cuisine_primary": _or(c("cuisine_tags.primary"), "Unknown"),
        "cuisine_secondary": _strings(c("cuisine_tags.secondary")), "vibe_tags": _strings(c("vibe_tags")), "price_range": price, "lat": F.coalesce("geocodes.main.latitude", "coordinates.lat"),
        "lng": F.coalesce("geocodes.main.longitude", "coordinates.lng"), "phone": blank("phone", "tel"), "website_url": blank("website_url", "website"), "opening_hours": c("opening_hours"),
        "menu_summary": c("menu_summary"), "specialties": _strings(c("specialties")), "is_open": _or(c("is_open"), True), "data_quality_score": _or(c("data_quality_score"), 0.5),
    }
    return raw.select(*[v.alias(k) for k, v in out.items()])


DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def parse_hours(hours: Column) -> Column:
    """A struct of days from such as ``Mo-Fr 12:00-22:00; Sa,Su 11:00-23:00; Mo closed``; later parts win.

    An unknown first day of a range is Monday, an unknown last one Sunday; a range that wraps around the week is empty,
    and one of three days or more ends the reading, as do no further parts after it.
    """
    number = F.create_map(*[x for i, d in enumerate(DAYS) for x in (F.lit(d[:2]), F.lit(i))])
    parts = F.transform(F.split(hours, ";"), lambda p: F.split(F.lower(strip(p)), r"\s+"))
    whole = F.filter(parts, lambda p: F.size(p) >= 2)
    broken = F.transform(whole, lambda p: F.size(F.split(p[0], "-")) > 2)
    whole = F.when(F.array_contains(broken, True), F.slice(whole, 1, F.array_position(broken, True).cast("int") - 1)).otherwise(whole)

    def day(i: int) -> Column:
        def says(p):
            spec, ends = p[0], F.split(p[0], "-")
            in_range = F.coalesce(F.try_element_at(number, F.get(ends, F.lit(0))), F.lit(0)) <= i
            in_range = in_range & (F.coalesce(F.try_element_at(number, F.get(ends, F.lit(1))), F.lit(6)) >= i)
            return F.when(spec.contains("-"), in_range).otherwise(F.array_contains(F.split(spec, ","), DAYS[i][:2]))

        return F.array_join(F.slice(F.try_element_at(F.filter(whole, says), F.lit(-1)), 2, 1000), " ")

    return F.struct(*[day(i).alias(d) for i, d in enumerate(DAYS)])


def _title(c: Column) -> Column:
    """Each run of letters with a capital."""
    return F.array_join(F.transform(F.split(c, r"(?<=[^\p{L}])"), F.initcap), "")


def from_map_tags(raw: DataFrame) -> DataFrame:
    """What tags of a map say about a place; null where they say nothing."""
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    yes = lambda k, *more: F.when(_or(tag(k), "").isin("yes", *more), True)
    kinds = F.transform(F.split(tag("cuisine"), ";"), lambda x: _title(strip(x)))
    vibes = F.array_compact(F.array(F.when(yes("outdoor_seating"), "outdoor-seating"), F.when(yes("internet_access", "wlan"), "wifi"), F.when(yes("wheelchair"), "wheelchair-accessible")))
    address = strip(F.concat(tag("addr:street"), F.lit(" "), _or(tag("addr:housenumber"), ""), F.lit(", "), _or(tag("addr:postcode"), ""), F.lit(" "), _or(tag("addr:city"), "Amsterdam")))
    return raw.select(
        tag("name").alias("name"), address.alias("address"), F.when(F.col("lon").isNotNull(), F.col("lat")).alias("lat"), F.when(F.col("lat").isNotNull(), F.col("lon")).alias("lng"),
        F.get(kinds, F.lit(0)).alias("cuisine_primary"), F.slice(kinds, 2, 1000).alias("cuisine_secondary"), F.when(tag("opening_hours").isNotNull(), parse_hours(tag("opening_hours"))).alias("opening_hours"),
        *[yes(f"diet:{d}", *(() if d == "gluten_free" else ("only",))).alias(f"{d}_ok") for d in ("vegan", "vegetarian", "halal", "gluten_free", "kosher")], F.when(F.size(vibes) > 0, vibes).alias("vibe_tag_additions"),
    )


# Courses of the categories of meals; any other category is a main dish.
COURSES = {
    "Starter": "starter",
    "Side": "side",
    "Dessert": "dessert",
    "Breakfast": "breakfast",
    "Beef": "main",
    "Chicken": "main",
    "Lamb": "main",
    "Pork": "main",
    "Seafood": "main",
    "Pasta": "main",
    "Vegetarian": "main",
    "Vegan": "main",
    "Miscellaneous": "",
    "Goat": "main",
}

#: Quality and tier of a source where a record says nothing of its own.
SOURCE_QUALITY = {"recipenlg_enriched": 0.5, "themealdb": 0.6, "ai_generated": 0.85, "curated_verified": 0.95}


def meals_to_open(raw: DataFrame) -> DataFrame:
    """Meals (title, cuisine, category, instructions, tags, ingredients: name and measure) as open documents."""
    c, category, cuisine = F.col, _or(F.col("category"), ""), _or(F.col("cuisine"), "Unknown")
    lines = F.transform(F.split(_or(c("instructions"), ""), "\n"), lambda x, i: F.struct((i + 1).alias("step_number"), strip(x).alias("instruction"), F.lit(None).cast("int").alias("duration_min"), F.array().cast("array<string>").alias("technique_tags")))
    course = numeric.lookup(COURSES, category, F.lit("main"))
    diet = F.when(category == "Vegetarian", F.array(F.lit("vegetarian"))).when(category == "Vegan", F.array(F.lit("vegan"), F.lit("vegetarian")))
    read = F.transform(c("ingredients"), lambda i: _ingredient(_or(i["name"], ""), F.lit(None), _or(i["measure"], ""), F.lit(None).cast("string")))
    title = _or(c("title"), "Untitled")
    return document(
        raw, title=title, title_en=_or(c("title"), ""), cuisine_tags=F.when(cuisine != "", F.array(cuisine)), ingredients=read, steps=F.filter(lines, lambda s: F.length(s["instruction"]) > 5),
        description=F.when(cuisine != "", F.concat(category, F.lit(" dish from "), cuisine, F.lit(" cuisine."))).otherwise(""), dietary_tags=diet, course_tags=F.when(course != "", F.array(course)),
        source_type=F.lit("themealdb"), data_quality_score=F.lit(SOURCE_QUALITY["themealdb"]),
    )


def in_open_form(docs: DataFrame, source_type: str) -> DataFrame:
    """Documents that have the open form already: source and quality are filled in where they say nothing."""
    return docs.withColumns({"source_type": _or(F.col("source_type"), source_type), "data_quality_score": _or(F.col("data_quality_score"), SOURCE_QUALITY[source_type])})


def tiered_sources(docs: DataFrame) -> DataFrame:
    """With source_tier: 0 for curated documents, 1 for the meal database, 2 for all else."""
    tier = F.when(F.col("source_type") == "curated_verified", 0).when(F.col("source_type") == "themealdb", 1).otherwise(2)
    return docs.withColumn("source_tier", tier)
