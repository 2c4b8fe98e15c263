"""Answers of an onboarding as profiles: rules are rows, joined with the answers and folded in order for each user."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import numeric, text

ANSWERS = "user_id long, question string, item string, number double, word string, position long"

# Sliders as (question, item, path, rule, factor, shift); tenth: round(factor * x + shift) / 10.
SLIDERS = (
    ("q4", "Spice level", "flavor.spicy", "tenth", 1.0, 0.0),
    ("q4", "Sweet vs savoury", "flavor.sweet", "tenth", -1.0, 100.0),
    ("q4", "Sweet vs savoury", "flavor.salty", "tenth", 1.0, 0.0),
    ("q4", "Light vs rich", "flavor.fatty", "tenth", 1.0, 0.0),
    ("q4", "Simple vs complex", "flavor.umami", "tenth", 1.0, 0.0),
    ("q6", "Time on a weeknight", "cooking.weeknight", "raw", 1.0, 0.0),
    ("q6", "Time on a weekend", "cooking.weekend", "raw", 1.0, 0.0),
    ("q8", "Typical servings", "servings", "raw", 1.0, 0.0),
    ("q8", "Meals you cook per week", "meals", "raw", 1.0, 0.0),
    ("q8", "Grocery budget per week", "groceries", "raw", 1.0, 0.0),
    ("q8", "Dining out per person", "budget.out", "raw", 1.0, 0.0),
    ("q10", "Cooking adventure", "adventure.cooking", "raw", 1.0, 0.0),
    ("q10", "Dining adventure", "adventure.dining", "raw", 1.0, 0.0),
    ("q11", "Calorie tracking", "calories", "raw", 1.0, 0.0),
    ("q11", "Protein focus", "protein", "raw", 1.0, 0.0),
    ("q11", "Sugar awareness", "sugar", "raw", 1.0, 0.0),
    ("q11", "Fibre & wholefoods", "fibre", "raw", 1.0, 0.0),
    ("q12", "Meals out per week", "meals_out", "raw", 1.0, 0.0),
    ("q14", "Organic preference", "organic", "raw", 1.0, 0.0),
    ("q14", "Local & seasonal", "local", "raw", 1.0, 0.0),
)
# What a path holds before any answer; paths that are not named hold nothing.
START = {
    "cooking.weeknight": 30.0, "cooking.weekend": 60.0, "servings": 2.0, "meals": 5.0, "groceries": 65.0, "budget.out": 25.0,
    "adventure.cooking": 5.0, "adventure.dining": 5.0, "calories": 30.0, "protein": 40.0, "sugar": 30.0, "fibre": 35.0, "organic": 30.0, "local": 40.0,
    "vibe.cozy": 5.0, "vibe.lively": 5.0, "vibe.trendy": 5.0, "vibe.classic": 5.0, "vibe.hidden_gem": 5.0, "vibe.romantic": 5.0, "vibe.business": 5.0, "vibe.efficient": 5.0,
}
VIBES = tuple(p.removeprefix("vibe.") for p in START if p.startswith("vibe."))
# Chips as (question, path, what is added, base where nothing is held, only below, items).
BOOSTS = (
    ("q5", "flavor.umami", 1.5, 5.0, 7.0, ("Garlic", "Miso", "Mushrooms", "Tahini")),
    ("q5", "flavor.fatty", 1.0, 5.0, 7.0, ("Butter", "Cheese", "Avocado", "Olive oil", "Coconut", "Tahini")),
    ("q5", "flavor.spicy", 1.0, 5.0, 7.0, ("Chilli", "Ginger")),
    ("q5", "texture.crunchy", 2.5, 5.0, None, ("Crunchy",)),
    ("q5", "texture.creamy", 2.5, 5.0, None, ("Creamy",)),
    ("q5", "texture.crispy", 2.5, 5.0, None, ("Crispy", "Flaky")),
    ("q5", "texture.silky", 2.5, 5.0, None, ("Silky smooth",)),
    ("q5", "texture.chunky", 2.5, 5.0, None, ("Chunky",)),
    ("q5", "texture.chewy", 2.5, 5.0, None, ("Chewy",)),
    ("q5", "texture.soft", 2.5, 5.0, None, ("Tender",)),
    ("q9", "vibe.cozy", 2.0, 5.0, None, ("Cosy & intimate", "Outdoor / terrace")),
    ("q9", "vibe.lively", 2.0, 5.0, None, ("Buzzy & lively", "Outdoor / terrace", "Late night")),
    ("q9", "vibe.trendy", 2.0, 5.0, None, ("Trendy & modern",)),
    ("q9", "vibe.classic", 2.0, 5.0, None, ("Classic & traditional",)),
    ("q9", "vibe.hidden_gem", 2.0, 5.0, None, ("Hidden gem", "Late night")),
    ("q9", "vibe.romantic", 2.0, 5.0, None, ("Romantic",)),
    ("q9", "vibe.efficient", 2.0, 5.0, None, ("Quick & efficient",)),
    ("q10", "adventure.cooking", -1.0, 5.0, None, ("I love my rotation of favourites",)),
    ("q10", "adventure.dining", -1.0, 5.0, None, ("I love my rotation of favourites",)),
    ("q10", "adventure.cooking", 1.5, 5.0, None, ("I try a new recipe every week or two",)),
    ("q10", "adventure.cooking", 1.0, 5.0, None, ("I follow food trends",)),
    ("q10", "adventure.dining", 1.0, 5.0, None, ("I follow food trends",)),
    ("q10", "adventure.dining", 2.0, 5.0, None, ("I actively seek out unfamiliar cuisines", "I'll order the thing I can't pronounce")),
    ("q10", "adventure.dining", 1.5, 5.0, None, ("Street food markets are my happy place",)),
    ("q12", "vibe.romantic", 1.5, 5.0, None, ("Fine dining",)),
    ("q12", "vibe.classic", 1.5, 5.0, None, ("Casual bistro", "Pub grub")),
    ("q12", "vibe.trendy", 1.5, 5.0, None, ("Street food", "Food trucks", "Pop-ups")),
    ("q12", "vibe.efficient", 1.5, 5.0, None, ("Fast casual",)),
    ("q12", "vibe.cozy", 1.5, 5.0, None, ("Cafés",)),
    ("q12", "vibe.lively", 1.5, 5.0, None, ("Brunch spots",)),
    ("q12", "vibe.hidden_gem", 1.5, 5.0, None, ("Late night spots",)),
)
# Chips that name something, by question and path.
WORDS = {
    ("q1", "spectrum"): {
        "I eat everything": "omnivore", "Pescatarian — fish but no meat": "pescatarian", "Vegetarian": "vegetarian", "Vegan": "vegan",
        "Flexitarian — mostly plants, sometimes meat": "flexitarian", "Low carb / keto": "low_carb", "Paleo / whole foods": "paleo",
        "Gluten-free lifestyle": "gluten_free", "Halal": "halal", "Kosher": "kosher", "Raw food": "raw_food",
    },
    ("q2", "stops"): {
        "No pork": "ethical", "No beef": "ethical", "No red meat": "preference", "No lamb": "preference", "No nuts": "allergy", "No peanuts": "allergy",
        "No shellfish": "allergy", "No eggs": "allergy", "No soy": "allergy", "No fish": "allergy", "No sesame": "allergy", "No celery": "allergy",
        "No mustard": "allergy", "No lupin": "allergy", "No gluten (coeliac)": "intolerance", "No dairy (lactose)": "intolerance",
        "No fructose": "intolerance", "No histamine": "intolerance", "No coriander": "dislike", "No olives": "dislike", "No mushrooms": "dislike", "No blue cheese": "dislike",
    },
    ("q5", "favourites"): {w: w for w in (
        "Garlic", "Lemon", "Chilli", "Ginger", "Coriander", "Basil", "Miso", "Cheese", "Butter", "Olive oil", "Tahini", "Coconut",
        "Avocado", "Mushrooms", "Aubergine", "Sweet potato", "Chickpeas", "Tofu",
    )},
    ("q6", "skill"): {
        "Just starting out": "beginner", "I can follow a recipe": "home_cook", "Pretty confident": "confident", "I know my way around": "advanced", "Semi-pro level": "professional",
    },
    ("q7", "equipment"): {
        "Air fryer": "air_fryer", "Instant Pot / pressure cooker": "pressure_cooker", "Slow cooker": "pressure_cooker", "Wok": "wok", "Grill / BBQ": "outdoor_grill", "Sous vide": "sous_vide",
        "Stand mixer": "stand_mixer", "Blender": "stand_mixer", "Food processor": "food_processor", "Dutch oven": "cast_iron", "Cast iron skillet": "cast_iron",
    },
    ("q12", "context"): {"Mostly solo": "solo", "With my partner": "couple", "Small group": "group", "Family": "family", "Varies a lot": "couple"},
    ("q15", "interests"): {
        "Fermentation & pickling": "fermentation", "Baking & pastry": "baking", "BBQ & grilling": "bbq", "Food science": "food_science", "Food photography": "food_photography",
        "Foraging": "foraging", "Wine & pairing": "wine_pairing", "Coffee & tea": "coffee_tea", "Cocktails & spirits": "cocktails", "Meal planning": "meal_prep",
        "Zero waste cooking": "zero_waste", "Cultural food history": "food_history", "Cheese & charcuterie": "cheese_charcuterie", "Spice blending": "spice_blending",
    },
    ("q17", "style"): {
        "Confident home cook": "short_list", "Curious food explorer": "wide_selection", "Health-conscious eater": "short_list", "Busy but into good food": "short_list",
        "Budget-savvy eater": "short_list", "Aspiring chef": "wide_selection", "I know exactly what I like": "one_best", "Love feeding people": "wide_selection",
    },
}
MEALS_OUT = {"Mostly solo": 0.5, "With my partner": 1.5, "Small group": 2.5, "Family": 1.0, "Varies a lot": 2.0}
LEVELS = {"love": "love", "like": "like", "meh": "neutral", "skip": "dislike", "neutral": "neutral", "dislike": "dislike"}
SURE = {"love": 0.9, "like": 0.8, "neutral": 0.7, "dislike": 0.7}
FATTY = BOOSTS[1][5]
#: Questions whose unknown items pass under a path, their word made from the item.
PASSED = {"q1": "spectrum", "q2": "stops", "q3": "cuisines", "q13": "priorities", "q15": "interests", "q16": "place"}
RULE = "question string, item string, step int, path string, op string, a double, b double, under double, word string"


def rules() -> list[tuple]:
    """The rules as rows of RULE. ``step`` is the question's number: a path is folded in order of questions, then of answers."""
    step = lambda q: int(q[1:])
    found = [(q, item, step(q), path, op, a, b, None, None) for q, item, path, op, a, b in SLIDERS]
    found += [(q, item, step(q), path, "boost", a, b, under, None) for q, path, a, b, under, items in BOOSTS for item in items]
    found += [("q5", "Lemon", 5, "flavor.sour", "first", 6.5, None, None, None), ("q13", "Weekend feasts", 13, "adventure.cooking", "least", 6.0, None, None, None)]
    return found + [(q, item, step(q), path, "word", None, None, None, word) for (q, path), names in WORDS.items() for item, word in names.items()]


def _passing() -> Column:
    q, item = F.col("question"), F.col("item")
    word = F.when(q == "q1", F.lower(item)).when(q == "q2", F.lit("preference")).when(q == "q13", text.slug(item)).when(q == "q15", F.replace(F.lower(item), F.lit(" "), F.lit("_"))).otherwise(F.col("word"))
    nothing = F.lit(None).cast("double")
    act = F.struct(F.expr("cast(substr(question, 2) as int)").alias("step"), numeric.lookup(PASSED, q).alias("path"), F.lit("word").alias("op"), nothing.alias("a"), nothing.alias("b"), nothing.alias("under"), word.alias("word"))
    known = F.exists(F.coalesce("acts", F.array()), lambda x: x["op"] == "word")
    return F.when(q.isin(*PASSED) & ~known & word.isNotNull(), F.array(act))


def _folded(path: Column, facts: Column) -> Column:
    """The number of a path: its facts applied in order to what it starts with. Sums stay within 0 and 10."""
    start = numeric.lookup(START, path).cast("double")

    def apply(held, x):
        number, below = x["number"], x["under"].isNull() | held.isNull() | (held < x["under"])
        boosted = numeric.clamp(F.coalesce(held, x["b"]) + x["a"], 0, 10)
        value = F.when(x["op"] == "tenth", numeric.half_up(x["a"] * number + x["b"]) / 10).when(x["op"] == "raw", number)
        value = F.coalesce(value, held)
        return F.when(x["op"] == "boost", F.when(below, boosted).otherwise(held)).when(x["op"] == "first", F.coalesce(held, x["a"])).when(x["op"] == "least", F.greatest(held, x["a"])).otherwise(value)

    return F.aggregate(facts, start, apply)


def facts(answers: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """user_id, numbers (path -> number), words (path -> [(word, item)] in order of answers). ``answers`` has the columns of ANSWERS.

    Of repeated answers to an item the last by position counts, so a user has at most as many as there are items; this is
    aggregated before the shuffle. ``table`` has the columns of RULE, by default ``rules()``. Rows with a null user, question or item,
    and numbers that are null, change nothing; chips without a rule pass where the question allows it.
    """
    spark = answers.sparkSession
    table = spark.createDataFrame(rules(), RULE) if table is None else table
    acts = table.groupBy("question", "item").agg(F.sort_array(F.collect_list(F.struct("step", "path", "op", "a", "b", "under", "word"))).alias("acts"))
    last = answers.where("user_id IS NOT NULL AND question IS NOT NULL AND item IS NOT NULL").groupBy("user_id", "question", "item")
    last = last.agg(F.max(F.struct("position", "number", "word")).alias("last")).select("user_id", "question", "item", "last.*")
    joined = last.join(F.broadcast(acts), ["question", "item"], "left")
    each = joined.select("user_id", "item", "position", "number", F.explode(F.concat(F.coalesce("acts", F.array()), F.coalesce(_passing(), F.array()))).alias("act"))
    one = F.struct("act.step", "position", "item", "act.op", "act.a", "act.b", "act.under", "number", "act.word")
    paths = each.groupBy("user_id", F.col("act.path").alias("path")).agg(F.sort_array(F.collect_list(one)).alias("facts"))
    words = F.transform(F.filter("facts", lambda x: x["op"] == "word"), lambda x: F.struct(x["word"].alias("word"), x["item"].alias("item")))
    value = paths.select("user_id", "path", _folded(F.col("path"), F.col("facts")).alias("number"), words.alias("words"))
    entries = lambda c: F.map_from_entries(F.collect_list(F.struct("path", c)))
    return value.groupBy("user_id").agg(entries("number").alias("numbers"), entries("words").alias("words"))


def profile(found: DataFrame) -> DataFrame:
    """One row a user from ``facts``: the sections of a profile as structs."""
    number = lambda p: F.coalesce(F.try_element_at("numbers", F.lit(p)), F.lit(START.get(p)).cast("double"))
    entries = lambda p: F.coalesce(F.try_element_at("words", F.lit(p)), F.array().cast("array<struct<word:string,item:string>>"))
    words = lambda p: F.transform(entries(p), lambda x: x["word"])
    items = lambda p: F.transform(entries(p), lambda x: x["item"])
    tenth = lambda c: numeric.half_up(c * 10) / 10
    first = lambda c: F.get(c, F.lit(0))
    struct = lambda **fields: F.struct(*[c.alias(k) for k, c in fields.items()])

    soft = lambda x: x["word"] == "dislike"
    label = lambda x: F.lower(F.regexp_replace(F.regexp_replace(x["item"], "^No ", ""), r" \(.*\)", ""))
    stops = lambda keep, sure: F.transform(F.filter(entries("stops"), keep), lambda x: struct(label=label(x), reason=x["word"], confidence=F.lit(sure)))
    spectrum = F.when(F.size(words("spectrum")) > 0, F.array_join(words("spectrum"), "-"))
    level = lambda x: F.coalesce(numeric.lookup(LEVELS, F.lower(x["word"])), F.lit("neutral"))
    cuisines = F.transform(entries("cuisines"), lambda x: struct(cuisine=x["item"], level=level(x), confidence=numeric.lookup(SURE, level(x))))
    creamy = number("texture.creamy")
    creamy = F.when(F.arrays_overlap(items("favourites"), F.array(*[F.lit(w) for w in FATTY])), F.least(F.lit(10.0), F.coalesce(creamy, F.lit(5.0)) + 1.5)).otherwise(creamy)
    equipment = F.array_sort(F.array_distinct(words("equipment")))
    setup = F.when(F.size(equipment) >= 3, "fully_equipped").when(F.size(equipment) >= 1, "well_equipped").otherwise("basic")
    servings, meals, identity, chip = number("servings"), number("meals"), first(items("style")), first(items("context"))
    home = F.when((meals > 0) & (servings > 0), numeric.half_up(F.try_divide(F.try_divide(number("groceries"), meals), servings) * 100) / 100)
    context = F.when(servings <= 1, "solo").when(servings <= 2, "couple").when(servings <= 4, "family").otherwise("group")
    context = F.when(identity == "Love feeding people", "group").otherwise(F.coalesce(first(words("context")), context))
    bold = lambda p: tenth(F.when(identity.isin("Curious food explorer", "Aspiring chef"), F.greatest(number(p), F.lit(8.0))).otherwise(number(p)))
    calories = number("calories")
    level_of = F.when(calories > 75, "strict").when(calories > 50, "moderate").when(calories > 25, "light").when(identity == "Health-conscious eater", "moderate").otherwise("none")
    tracked = F.array_compact(F.array(*[F.when(number(p) > 50, F.lit(p)) for p in ("calories", "protein", "sugar", "fibre")]))
    prepared = F.when(F.arrays_overlap(items("priorities"), F.array(F.lit("Meal prep"), F.lit("Batch cooking"))), F.array(F.lit("meal_prep"))).otherwise(F.array().cast("array<string>"))
    places = F.filter(F.transform(F.split(F.coalesce(first(words("place")), F.lit("")), "[,\\-—]+"), lambda x: F.trim(x)), lambda x: x != "")
    return found.select(
        "user_id",
        struct(spectrum=spectrum, hard_stops=stops(lambda x: ~soft(x), 1.0), soft_stops=stops(soft, 0.8)).alias("dietary"),
        cuisines.alias("cuisines"),
        struct(**{p: tenth(number(f"flavor.{p}")) for p in ("spicy", "sweet", "sour", "umami", "fatty", "salty")}).alias("flavor"),
        struct(**{p: creamy if p == "creamy" else number(f"texture.{p}") for p in ("crunchy", "creamy", "soft", "chewy", "crispy", "silky", "chunky")}).alias("texture"),
        struct(skill=F.coalesce(first(words("skill")), F.lit("home_cook")), setup=setup, equipment=equipment, weeknight=numeric.half_up(number("cooking.weeknight")), weekend=numeric.half_up(number("cooking.weekend"))).alias("cooking"),
        struct(home=F.coalesce(home, F.when(identity == "Budget-savvy eater", 3.5)), out=number("budget.out")).alias("budget"),
        struct(**{v: number(f"vibe.{v}") for v in VIBES}).alias("vibes"),
        struct(cooking=bold("adventure.cooking"), dining=bold("adventure.dining")).alias("adventurousness"),
        struct(level=level_of, tracked=tracked).alias("nutrition"),
        struct(context=context, meals_out=F.coalesce(number("meals_out"), numeric.lookup(MEALS_OUT, chip), F.lit(2.0)), home_cooked=F.least(meals, F.lit(14.0))).alias("social"),
        struct(
            seasonal=tenth(number("local") / 10), sustainability=tenth((number("organic") + number("local")) / 20), style=F.coalesce(first(words("style")), F.lit("short_list")),
            interests=F.array_distinct(F.concat(prepared, words("interests"))), priorities=words("priorities"), favourites=items("favourites"),
        ).alias("lifestyle"),
        struct(city=first(places), country=F.when(F.size(places) > 1, F.element_at(places, -1))).alias("location"),
    )


#: How fields of a profile take what an enrichment says; fields without a policy stay.
POLICIES: Mapping[str, str] = {
    "dietary.spectrum": "overlay", "dietary.soft_stops": "append",
    **{f"flavor.{p}": "overlay" for p in ("spicy", "sweet", "sour", "umami", "fatty", "salty")},
    **{f"texture.{p}": "overlay" for p in ("crunchy", "creamy", "soft", "chewy", "crispy", "silky", "chunky")},
    "cooking.weeknight": "overlay", "cooking.weekend": "overlay", "budget.home": "overlay", "budget.out": "overlay",
    "adventurousness.cooking": "greatest", "adventurousness.dining": "greatest", "nutrition.tracked": "union", "social.meals_out": "overlay",
    "lifestyle.interests": "union", "lifestyle.favourites": "union", "location.city": "fill", "location.country": "fill",
}


def _by_policy(policy: str | None, old: Column, new: Column) -> Column:
    return {
        "overlay": lambda: F.coalesce(new, old),
        "greatest": lambda: F.greatest(old, new),
        "union": lambda: F.coalesce(F.array_union(old, new), old, new),
        "append": lambda: F.coalesce(F.concat(old, new), old, new),
        "fill": lambda: F.when(old.isNull() | (old == ""), F.coalesce(F.nullif(new, F.lit("")), old)).otherwise(old),
    }.get(policy, lambda: old)()


def merged(base: DataFrame, enrichments: DataFrame, key: str = "user_id", policies: Mapping[str, str] = POLICIES) -> DataFrame:
    """``base`` with what ``enrichments`` (one row a key, any of the sections and fields of ``base``) adds, field by field.

    The schemas drive it: fields that both sides have and that have a policy are merged, all others stay. A null says
    nothing. Keys without an enrichment stay as they are; those only in ``enrichments`` are left out.
    """
    both = base.alias("b").join(enrichments.alias("e"), key, "left")
    said = {f.name: {g.name for g in f.dataType.fields} for f in enrichments.schema if f.name != key and hasattr(f.dataType, "fields")}
    columns = []
    for f in base.schema:
        old = F.col(f"b.{f.name}") if f.name != key else F.col(key)
        if f.name in said:
            fields = [(g.name, policies.get(f"{f.name}.{g.name}") if g.name in said[f.name] else None) for g in f.dataType.fields]
            old = F.struct(*[_by_policy(p, old[g], F.col(f"e.{f.name}")[g] if p else None).alias(g) for g, p in fields])
        columns.append(old.alias(f.name))
    return both.select(*columns)


