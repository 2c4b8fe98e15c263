import pytest
from pyspark.sql import functions as F

from quern import schemas
from quern.operators import projections as p
from quern.sources import adapters


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def words(*items):
    return F.array(*[F.lit(i) for i in items]).cast("array<string>")


def documents(spark, n=3, **fields):
    base = dict(title=F.concat(F.lit("Dish "), F.col("id").cast("string")), ingredients=F.array(*[F.struct(F.lit(x).alias("name"), F.lit(1.0).alias("amount"), F.lit("g").alias("unit"), F.lit(None).alias("notes"), F.lit(False).alias("is_optional")) for x in "abc"]))
    return adapters.document(spark.range(n), **(base | fields))


def test_texts(spark):
    none = F.lit(None).cast("string")
    r = one(
        spark,
        p.place_text(F.lit("Bar"), F.lit(""), words("Thai"), words("cosy", "loud"), none, F.lit("good"), words()),
        p.place_text_short(F.lit("Bar"), none, words("Thai", ""), words(), F.lit("€€"), F.lit("m" * 100), words("pie")),
        p.query_text(F.lit("raw"), F.lit("Thai"), words(*"abcdef"), F.lit(""), none, F.lit("cosy")),
        p.total_time(F.lit(None).cast("int"), F.lit(1), F.lit(2)), p.total_time(F.lit(9), F.lit(1), F.lit(2)), p.total_time(F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(2)),
        p.cut(F.lit("abcdef"), 3), p.cut(F.lit("abc"), 3), p.merged_lists(words("b", "a"), words("a", "c", "b")), p.without_tags(F.lit(None).cast("array<string>")), p.without_tags(words()), p.without_tags(words("x")),
    )
    assert list(r) == ["Bar Thai cosy loud good", "Bar Thai €€ " + "m" * 80 + " pie", "raw Thai a b c d e cosy", 3, 9, None, "abc...", "abc", ["b", "a", "c"], True, True, False]


def test_rows_of_the_client(spark):
    steps = F.array(*[F.struct(F.lit(n).cast("int").alias("step_number"), F.lit("do").alias("instruction"), F.lit(None).cast("int").alias("duration_min"), F.lit(None).cast("array<string>").alias("technique_tags")) for n in (0, 7, None)])
    docs = documents(spark, 1, title=F.lit(""), steps=steps, nutrition_per_serving=F.from_json(F.lit('{"sugar_g": 0}'), schemas.NUTRITION))
    row = p.normalised_row(docs).first()
    assert (row.title, row.description, [s.step_number for s in row.steps]) == ("Untitled", "", [1, 7, 3])
    ui = p.ui_row(p.normalised_row(docs).withColumn("key", F.lit(5)), "key", F.lit(80)).first()
    assert (ui.id, ui.matchScore, ui.difficulty, ui.servings, ui.time, ui.nutrition.calories, ui.nutrition.sugar, ui.steps[0].techniqueTags) == (5, 80, 1, 2, 0, None, 0, [])
    assert [s.instruction for s in one(spark, p.structured_steps(words("a", "b")))[0]] == ["a", "b"] and one(spark, p.structured_ingredients(words("3 eggs")))[0][0].name == "eggs"


def test_defaults_of_generated_rows(spark):
    row = p.filled_generated(documents(spark, 1), "Thai").first()
    assert row.cuisine_tags == ["Thai"] and row.dietary_flags.is_nut_free and not row.dietary_flags.is_vegan and row.nutrition_per_serving.kcal == 0 and row.season_tags == []
    ddl = f"id string, city string, country string, neighborhood string, is_open boolean, phone string, tel string, website string, website_url string, price int, price_range string, opening_hours {schemas.HOURS}"
    raw = [("", None, None, None, None, "", "5", None, "u", None, "€€€", ("9-5", "closed", None, None, None, None, "1-2")), ("7", "Delft", "NL", "x", False, "1", "2", "w", None, 4, "", None)]
    a, b = sorted(p.filled_place(spark.createDataFrame(raw, ddl), "Centrum").collect(), key=lambda r: r.city)
    assert (a.phone, a.tel, a.website, a.price, a.hours_display, a.neighborhood, a.is_open) == ("5", "5", "u", 3, "Mon: 9-5; Sun: 1-2", "Centrum", True) and len(a.id) == 36
    assert (b.phone, b.website_url, b.price, b.hours_display, b.is_open) == ("1", "w", 4, "See website for hours", False)


def test_profiles_and_records(spark):
    names = spark.createDataFrame([], schemas.PROFILE).columns
    profile = spark.createDataFrame([tuple({"user_id": 1, "hard_stops": [("nut", True)], "soft_stops": [("egg", False)]}.get(n) for n in names)], schemas.PROFILE)
    r = p.client_profile(profile, F.lit("Ana likes soup")).first()
    assert (r.display_name, r.restrictions, r.dietary_spectrum) == ("Ana", ["nut", "egg"], "") and p.client_profile(profile, F.lit(None).cast("string")).first().display_name == "User"
    e = one(spark, p.expanded(F.lit('{"desc": "d", "description": "e", "diff": 4, "flavor_tags": ["x"]}')))[0]
    assert (e.description, e.difficulty, e.flavor_tags, e.serves, e.cuisine, e.season_tags) == ("d", 4, ["x"], 4, "Other", [])


def test_answers(spark):
    items = spark.createDataFrame([("a", 0, "", None, "odd", 0, None, 2, ["Hot!!", "a!b c! d"]), ("generated", 1, None, 0.123456, "adapted", 5, 1, None, None)], "recipe_id string, position int, title string, match_score double, match_tier string, minutes int, difficulty int, serves int, warnings array<string>")
    ranked = spark.createDataFrame([("a", "Soup", 0.98765, "full_match", 30, 2, 9)], "recipe_id string, title string, match_score double, match_tier string, minutes int, difficulty int, serves int")
    a, b = p.answer_items(items, ranked).orderBy("recipe_id").collect()
    assert tuple(a) == ("a", "Soup", 0.9877, "stretch_pick", 30, 2, 2, ["Hot!.", "a!b c. d"])
    assert tuple(b) == ("generated", "Recipe 2", 0.1235, "adapted", 5, 1, None, [])


def test_orders(spark):
    docs = spark.createDataFrame([(1, 5, ["Early Spring"]), (2, 9, None), (3, 9, ["winter"]), (4, 1, ["spring"]), (5, 7, ["spring"])], "n int, s int, season_tags array<string>")
    assert [r.n for r in p.by_client_score(docs, F.col("s"), "n").collect()] == [2, 3, 5, 1, 4]
    assert [(r.n, r.match_score) for r in p.by_client_score(docs, None, "n").collect()][:2] == [(1, 0), (2, 0)]
    assert [r.n for r in p.seasonal_first(docs, [F.col("n")], 4, F.lit("spring"), F.col("n").desc(), 3).collect()] == [4, 1, 3]
    assert [r.n for r in docs.where(p.unprocessed(F.col("s").cast("string"), ["9", "1"])).orderBy("n").collect()] == [1, 5]
    assert [r.n for r in p.eligible(docs, F.lit(" four5 "), F.col("s"), 7).orderBy("n").collect()] == [2, 3, 5] and p.eligible(docs, F.lit(" four "), F.col("s"), 0).count() == 0


def test_edge_cases(spark):
    docs = documents(spark, 40, dietary_flags=F.expr(f"cast(null as {schemas.FLAGS})"), steps=F.expr(f"array(cast(null as {schemas.STEP}))"))
    got = p.edge_cases(docs, [F.length("title"), F.col("title")])
    edge = got.where("title LIKE '[EDGE]%'")
    assert got.count() == 70 and edge.where("time_total_min = 360").count() == 5 and edge.where("size(steps) = 0").count() == 5 and edge.where("size(ingredients) = 2").count() == 5
    assert edge.where("nutrition_per_serving.kcal = 0").count() == 10 and docs.exceptAll(got.where("title NOT LIKE '[EDGE]%'")).count() == 0


def test_counts_and_quick_flags(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "b")], "x int, y string")
    assert tuple(p.pass_counts(df, {"x": F.col("x") > 1, "y": F.col("y").isNotNull()}).first()) == (2, 1, 3, 0, False)
    lists = {"meat": ["ham"], "fish": ["cod"], "dairy": ["milk"], "egg": ["egg"]}
    r = one(spark, p.vegan_and_vegetarian(words(" Rice"), lists), p.vegan_and_vegetarian(words("Shamrock"), lists), p.vegan_and_vegetarian(words("Milk "), lists))
    assert [tuple(x) for x in r] == [(True, True), (False, False), (False, True)]
