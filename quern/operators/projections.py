"""Documents, places, profiles and answers in the shapes that their readers want."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text
from quern.sources.adapters import parse_ingredient

c = F.col


def _strings(x: Column) -> Column:
    return F.coalesce(x, F.array().cast("array<string>"))


def _filled(x: Column) -> Column:
    """``x`` where it is neither null nor empty."""
    return F.when(x != "", x)


def place_text(name: Column, neighborhood: Column, cuisines: Column, vibes: Column, menu: Column, reviews: Column, specialties: Column) -> Column:
    """The text that a place is embedded by."""
    words = lambda x: F.array_join(_strings(x), " ")
    return text.join_non_empty(" ", name, neighborhood, words(cuisines), words(vibes), menu, reviews, words(specialties))


def place_text_short(name: Column, neighborhood: Column, cuisines: Column, vibes: Column, price: Column, menu: Column, specialties: Column) -> Column:
    """The same with its price, without reviews, and with 80 characters of the menu."""
    parts = F.concat(F.array(name, neighborhood), _strings(cuisines), _strings(vibes), F.array(price, F.substring(menu, 1, 80)), _strings(specialties))
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " ")


def query_text(raw: Column, cuisine: Column, ingredients: Column, mood: Column, occasion: Column, inferred_mood: Column) -> Column:
    """The text that a query is embedded by: itself, cuisine, its first five ingredients, mood, occasion and inferred mood."""
    return F.array_join(F.array_compact(F.concat(F.array(raw, _filled(cuisine)), F.slice(_strings(ingredients), 1, 5), F.array(_filled(mood), _filled(occasion), _filled(inferred_mood)))), " ")


def total_time(total: Column, prep: Column, cook: Column) -> Column:
    """The total, or the sum of the two parts where both are known."""
    return F.coalesce(total, prep + cook)


def structured_ingredients(lines: Column) -> Column:
    """Ingredients read from lines."""
    return F.transform(_strings(lines), parse_ingredient)


def structured_steps(lines: Column) -> Column:
    return F.transform(_strings(lines), lambda x, i: F.struct((i + 1).alias("step_number"), x.alias("instruction"), F.array().cast("array<string>").alias("technique_tags")))


def numbered(steps: Column) -> Column:
    """Steps that have their place as number where they have none, or 0."""
    return F.transform(steps, lambda s, i: s.withField("step_number", F.when(F.coalesce(s["step_number"], F.lit(0)) == 0, i + 1).otherwise(s["step_number"])))


def normalised_row(row: DataFrame) -> DataFrame:
    """Rows of documents with the defaults of the client: a title, empty lists, numbered steps."""
    lists = [f.name for f in row.schema if f.dataType.typeName() == "array" and f.name not in ("ingredients", "steps")]
    kinds = {f.name: f.dataType.simpleString() for f in row.schema}
    filled = {k: F.coalesce(c(k), F.array().cast(kinds[k])) for k in (*lists, "ingredients")}
    title = F.coalesce(_filled(c("title_en")), _filled(c("title")), F.lit("Untitled"))
    return row.withColumns(filled | {"title": title, "description": F.coalesce("description", F.lit("")), "steps": numbered(F.coalesce("steps", F.array().cast(kinds["steps"])))})


# A document's nutrients and the client's names of them.
UI_NUTRITION = {
    "kcal": "calories",
    "protein_g": "protein",
    "carbs_g": "carbs",
    "fat_g": "fat",
    "fiber_g": "fibre",
    "saturated_fat_g": "saturatedFat",
    "sugar_g": "sugar",
    "salt_g": "salt",
}


def ui_row(docs: DataFrame, key: str, score: Column) -> DataFrame:
    """Documents as the client shows them. A nutrient that is missing stays null, one of 0 stays 0."""
    or_ = lambda name, default: F.when(F.coalesce(c(name), F.lit(0)) == 0, default).otherwise(c(name))
    return docs.select(
        c(key).alias("id"), "title", c("cuisine_tags").alias("cuisine"), c("dietary_tags").alias("dietary"), F.coalesce("time_total_min", F.lit(0)).alias("time"), or_("difficulty", 1).alias("difficulty"),
        score.alias("matchScore"), "description", or_("serves", 2).alias("servings"),
        F.transform("ingredients", lambda i: F.struct(i["name"].alias("name"), F.coalesce(i["amount"].cast("string"), F.lit("")).alias("amount"), F.coalesce(i["unit"], F.lit("")).alias("unit"))).alias("ingredients"),
        F.transform("steps", lambda s: F.struct(s["step_number"].alias("number"), s["instruction"].alias("instruction"), _strings(s["technique_tags"]).alias("techniqueTags"))).alias("steps"),
        F.struct(*[c("nutrition_per_serving")[k].alias(name) for k, name in UI_NUTRITION.items()]).alias("nutrition"), c("flavor_tags").alias("flavourTags"), c("texture_tags").alias("textureTags"),
        c("dietary_flags").alias("dietaryFlags"), c("region_tag").alias("regionTag"), c("season_tags").alias("seasonTags"), c("occasion_tags").alias("occasionTags"), c("course_tags").alias("courseTags"), c("source_type").alias("sourceType"),
    )


def filled_generated(docs: DataFrame, cuisine: str) -> DataFrame:
    """Generated documents with the defaults of their kind."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    no_flags = F.struct(*[F.lit(f.name in ("is_nut_free", "is_halal_ok")).alias(f.name) for f in docs.schema["dietary_flags"].dataType])
    no_nutrition = F.struct(*[F.lit(0).cast(f.dataType).alias(f.name) for f in docs.schema["nutrition_per_serving"].dataType])
    keep = lambda name, value: F.coalesce(c(name), value.cast(kinds[name]))
    substituted = lambda name: F.coalesce(c(f"dietary_flags.{name}"), F.lit(False))
    flags = c("dietary_flags").withField("vegan_if_substituted", substituted("vegan_if_substituted")).withField("gluten_free_if_substituted", substituted("gluten_free_if_substituted"))
    nutrition = c("nutrition_per_serving").withField("saturated_fat_g", F.coalesce(c("nutrition_per_serving.saturated_fat_g"), F.lit(0.0)))
    return docs.withColumns({
        "title_en": F.coalesce("title", F.lit("")), "cuisine_tags": F.when(F.coalesce(F.size("cuisine_tags"), F.lit(0)) == 0, F.array(F.lit(cuisine))).otherwise(c("cuisine_tags")),
        "dietary_flags": F.when(c("dietary_flags").isNull(), no_flags).otherwise(flags), "nutrition_per_serving": F.when(c("nutrition_per_serving").isNull(), no_nutrition).otherwise(nutrition),
        "season_tags": keep("season_tags", F.array(F.lit("year-round"))), "occasion_tags": keep("occasion_tags", F.array()), "course_tags": keep("course_tags", F.array()),
        "source_type": F.lit("mock_tier0"), "data_quality_score": F.lit(0.9),
    })


def filled_place(places: DataFrame, neighborhood: str) -> DataFrame:
    """Generated places: the two names of phone and site agree, prices are the number of signs, hours are shown."""
    days = [F.when((c(f"opening_hours.{d}") != "") & (c(f"opening_hours.{d}") != "closed"), F.concat(F.lit(d[:3].capitalize() + ": "), c(f"opening_hours.{d}"))) for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")]
    shown = F.array_join(F.array_compact(F.array(*days)), "; ")
    phone, site = F.coalesce(_filled(c("phone")), c("tel")), F.coalesce(_filled(c("website")), c("website_url"))
    price = F.when(F.coalesce("price", F.lit(0)) != 0, c("price")).when(F.coalesce("price_range", F.lit("")) != "", F.length("price_range")).otherwise(2)
    return places.withColumns({
        "id": F.coalesce(_filled(c("id")), F.uuid()), "city": F.coalesce("city", F.lit("Amsterdam")), "country": F.coalesce("country", F.lit("NL")), "neighborhood": F.coalesce("neighborhood", F.lit(neighborhood)),
        "is_open": F.coalesce("is_open", F.lit(True)), "phone": phone, "tel": phone, "website": site, "website_url": site, "price": price, "hours_display": F.when(shown != "", shown).otherwise("See website for hours"),
    })


def client_profile(profiles: DataFrame, summary: Column) -> DataFrame:
    """Profiles (``schemas.PROFILE``) flattened for the client; the first word of the summary is the name."""
    labels = lambda name: F.transform(F.coalesce(name, F.array().cast("array<struct<label:string,is_hard_stop:boolean>>")), lambda r: r["label"])
    first = F.regexp_extract(summary, r"^(\w+)", 1)
    return profiles.select(
        "user_id", F.when(F.coalesce(first, F.lit("")) != "", first).otherwise("User").alias("display_name"), F.coalesce("spectrum", F.lit("")).alias("dietary_spectrum"), F.coalesce(summary, F.lit("")).alias("summary"),
        "affinities", F.concat(labels(c("hard_stops")), labels(c("soft_stops"))).alias("restrictions"), c("flavors").alias("flavor_prefs"), F.coalesce("skill", F.lit("")).alias("cooking_skill"),
    )


# Short keys of generated records, the full ones, and the defaults.
SHORT_KEYS = {
    "description": ("desc", ""),
    "difficulty": ("diff", 2),
    "cuisine": ("cuis", "Other"),
    "flavor_tags": ("flav", []),
    "texture_tags": ("text", []),
    "season_tags": ("seas", []),
    "occasion_tags": ("occ", []),
    "course_tags": ("cour", []),
    "time_prep_min": ("prep", 15),
    "time_cook_min": ("cook", 30),
    "serves": ("serv", 4),
}


def expanded(record: Column) -> Column:
    """A JSON record with short or full keys as a struct with full ones; the short key wins."""
    kind = lambda default: "array<string>" if isinstance(default, list) else "int" if isinstance(default, int) else "string"
    ddl = ", ".join(f"{short} {kind(default)}, {full} {kind(default)}" for full, (short, default) in SHORT_KEYS.items())
    read = F.from_json(record, ddl)
    default = lambda x: F.array().cast("array<string>") if isinstance(x, list) else F.lit(x)
    return F.struct(*[F.coalesce(read[short], read[full], default(x)).alias(full) for full, (short, x) in SHORT_KEYS.items()])


TIERS = ("generated", "adapted", "full_match", "close_match", "stretch_pick")


def answer_items(items: DataFrame, ranked: DataFrame) -> DataFrame:
    """Items of an answer (recipe_id, position, title, match_score, match_tier, minutes, difficulty, serves, warnings).

    What an item lacks comes from the ranked document of its id (recipe_id, title, match_score, match_tier, minutes,
    difficulty, serves); 0 counts as lacking. An unknown tier is a stretch; scores have four places.
    """
    meta = ranked.select("recipe_id", *[c(k).alias(f"_{k}") for k in ("title", "match_score", "match_tier", "minutes", "difficulty", "serves")])
    number = lambda k: F.when(F.coalesce(c(k), F.lit(0)) == 0, c(f"_{k}")).otherwise(c(k)).cast("int").alias(k)
    tier = F.coalesce(_filled(c("match_tier")), _filled(c("_match_tier")), F.lit("stretch_pick"))
    said = lambda x: F.regexp_replace(x, r"!(?=\s|$)", ".")
    return items.join(meta, "recipe_id", "left").select(
        "recipe_id", F.coalesce(_filled(c("title")), _filled(c("_title")), F.concat(F.lit("Recipe "), (c("position") + 1).cast("string"))).alias("title"),
        F.round(F.coalesce("match_score", "_match_score", F.lit(0.0)), 4).alias("match_score"), F.when(tier.isin(*TIERS), tier).otherwise("stretch_pick").alias("match_tier"),
        number("minutes"), number("difficulty"), number("serves"), F.transform(_strings(c("warnings")), said).alias("warnings"),
    )


def by_client_score(docs: DataFrame, score: Column | None, position: str) -> DataFrame:
    """Best score first, equal ones in their former order; without a profile the former order and a score of 0."""
    if score is None:
        return docs.withColumn("match_score", F.lit(0)).orderBy(position)
    return docs.withColumn("match_score", score).orderBy(F.col("match_score").desc(), position)


def seasonal_first(docs: DataFrame, order: Sequence[Column], first: int, season: Column, shuffle: Column, most: int) -> DataFrame:
    """Of the first documents those of the season, shuffled; others fill up what is missing."""
    within = F.exists(_strings(c("season_tags")), lambda t: F.lower(t).contains(season))
    return docs.orderBy(*order).limit(first).withColumn("in_season", within).orderBy(F.col("in_season").desc(), shuffle).limit(most)


def unprocessed(status: Column, skipped: Sequence[str]) -> Column:
    return ~status.isin(*skipped)


def without_tags(tags: Column) -> Column:
    """Null or an empty list: one predicate and one scan."""
    return F.coalesce(F.size(tags), F.lit(0)) <= 0


def merged_lists(a: Column, b: Column) -> Column:
    """All items once, in the order of their first place."""
    return F.array_distinct(F.concat(_strings(a), _strings(b)))


def cut(t: Column, most: int, mark: str = "...") -> Column:
    """The text, or its first characters and a mark."""
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit(mark))).otherwise(t)


def edge_cases(docs: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The documents and damaged copies of the first thirty: no nutrition, few ingredients, no steps, a wrong flag, too long.

    Copies are rows of their own, so the originals stay as they are.
    """
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(*order)) - 1
    first = docs.orderBy(*order).limit(30).withColumn("_i", place)  # thirty rows
    zero = F.struct(*[F.lit(0).cast(f.dataType).alias(f.name) for f in docs.schema["nutrition_per_serving"].dataType])
    i = c("_i")
    kind = F.floor(i / 5)
    copies = first.withColumns({
        "title": F.concat(F.lit("[EDGE] "), c("title")), "nutrition_per_serving": F.when(i < 10, zero).otherwise(c("nutrition_per_serving")),
        "ingredients": F.when(kind == 2, F.slice("ingredients", 1, 2)).otherwise(c("ingredients")), "steps": F.when(kind == 3, F.slice("steps", 1, 0)).otherwise(c("steps")),
        "dietary_flags": F.when(kind == 4, c("dietary_flags").withField("is_vegan", F.lit(True))).otherwise(c("dietary_flags")),
        "time_total_min": F.when(kind == 5, 360).otherwise(c("time_total_min")), "time_cook_min": F.when(kind == 5, 300).otherwise(c("time_cook_min")),
        "data_quality_score": F.element_at(F.array(*[F.lit(x) for x in (0.3, 0.3, 0.2, 0.15, 0.25, 0.4)]), kind.cast("int") + 1),
    })
    return docs.unionByName(copies.drop("_i"))


def eligible(docs: DataFrame, title: Column, score: Column, least: int) -> DataFrame:
    """Documents with a title of five characters and the score at least."""
    return docs.where((F.length(F.trim(title)) >= 5) & (score >= least))


def pass_counts(docs: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """One row: how many documents fail each check, any of them, and whether none does."""
    any_ = F.lit(False)
    for ok in checks.values():
        any_ = any_ | ~F.coalesce(ok, F.lit(False))
    counts = [F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in checks.items()]
    failed = F.count_if(any_)
    return docs.agg(*counts, failed.alias("failed"), (F.count(F.lit(1)) - failed).alias("passed"), (failed == 0).alias("clean"))


def vegan_and_vegetarian(terms: Column, words: Mapping[str, Sequence[str]]) -> Column:
    """struct(is_vegan, is_vegetarian) by plain substrings of all terms joined: meat, fish, dairy, egg."""
    joined = F.array_join(F.array_distinct(F.transform(_strings(terms), lambda x: F.lower(F.trim(x)))), " ")
    has = {k: text.contains_any(joined, words[k]) for k in ("meat", "fish", "dairy", "egg")}
    vegetarian = ~has["meat"] & ~has["fish"]
    return F.struct((vegetarian & ~has["dairy"] & ~has["egg"]).alias("is_vegan"), vegetarian.alias("is_vegetarian"))
