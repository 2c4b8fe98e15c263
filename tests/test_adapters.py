import json

import pytest
from pyspark.sql import functions as F

from quern import schemas
from quern.sources import adapters


def feed(spark, name, *records):
    """Records through the reader that a feed has."""
    return spark.read.schema(schemas.FEEDS[name]).json(spark.sparkContext.parallelize([json.dumps(r) for r in records], 1))


def test_flat_meals(spark):
    raw = {"strMeal": "Pie", "strArea": "British", "strCategory": "Dessert", "strInstructions": "Mix.\r\n\r\n Bake. ", "strIngredient1": " Flour ", "strMeasure1": "1/2 Cup", "strIngredient2": "", "strIngredient3": "Salt", "strMeasure3": "to taste"}
    a, b = adapters.from_flat(feed(spark, "flat", raw, {"strInstructions": "  One step only "})).collect()
    assert [(i.name, i.amount, i.unit, i.notes) for i in a.ingredients] == [("Flour", 0.5, "cup", "1/2 Cup"), ("Salt", 1.0, "to taste", "to taste")]
    assert [(s.step_number, s.instruction) for s in a.steps] == [(1, "Mix."), (3, "Bake.")]
    assert (a.title, a.cuisine_tags, a.course_tags, a.data_quality_score, a.embedding_text) == ("Pie", ["British"], ["dessert"], 0.3, "Pie British Dessert Flour Salt")
    assert (b.title, b.ingredients, b.course_tags, [s.instruction for s in b.steps]) == ("Unknown Recipe", [], [], ["One step only"])


def test_plain_records(spark):
    raw = {"title": "Soup", "NER": ["carrot ", "salt"], "ingredients": ["1 1/2 cups carrots"], "directions": ["Chop. ", " ", "Boil."]}
    (a,) = adapters.from_plain(feed(spark, "plain", raw)).collect()
    assert [(i.name, i.amount, i.unit, i.notes) for i in a.ingredients] == [("carrot", 1.0, "piece", "1 1/2 cups carrots"), ("salt", 1.0, "piece", None)]
    assert [(s.step_number, s.instruction) for s in a.steps] == [(1, "Chop."), (3, "Boil.")]
    assert (a.time_total_min, a.serves, a.difficulty, a.description) == (45, 4, 2, "Recipe: Soup")


def test_enriched_records(spark):
    e = {"description": "Short.", "cuisine": "danish", "difficulty": 9, "serves": 0, "time_prep_min": 0, "time_cook_min": 0, "flavor_tags": "sweet, ,salty"}
    raw = {"title": "Roll", "NER": ["eggplant", "milk", "flour"], "ingredients": ["2 cups eggplant diced"], "directions": ["Do it."], "_enrichment": e, "_nutrition": {"kcal": 0.4, "salt_g": 1.236}, "_dietary_tags": "vegan"}
    a, b = adapters.from_enriched(feed(spark, "enriched", raw, {"title": "Bare"})).collect()
    assert a.cuisine_tags == ["Scandinavian"] and a.description == "A delicious recipe for Roll. Short." and (a.difficulty, a.serves, a.time_total_min) == (5, 1, 0)
    assert a.ingredients[0].name == "aubergine" and (a.ingredients[0].amount, a.ingredients[0].unit) == (2.0, "cups")
    assert a.flavor_tags == ["sweet", "salty"] and a.season_tags == ["year-round"] and (a.nutrition_per_serving.kcal, a.nutrition_per_serving.salt_g) == (1, 1.24)
    assert a.data_quality_score == pytest.approx(0.75)  # one step, no texture, no time
    assert b.cuisine_tags == ["Other"] and b.nutrition_per_serving is None and b.description == "A delicious recipe for Bare. A recipe for Bare."
    assert b.data_quality_score == pytest.approx(0.5)  # ingredients, steps, flavour, texture, nutrition, cuisine


def test_nutrients_and_products(spark):
    recipe = {"label": "Stew", "healthLabels": ["Vegan", "Tree-Nut-Free", "Pork-Free"], "totalNutrients": {"ENERC_KCAL": {"quantity": 999.0}, "NA": {"quantity": 1600.0}}, "yield": 2.0, "totalTime": 50, "instructionLines": ["a"], "ingredients": [{"food": "bean", "quantity": 2.0}]}
    (a,) = adapters.from_nutrients(feed(spark, "nutrients", {"recipe": recipe})).collect()
    assert (a.nutrition_per_serving.kcal, a.nutrition_per_serving.salt_g, a.serves, a.time_prep_min, a.time_cook_min) == (499, 2.0, 2, 16, 33)
    f = a.dietary_flags
    assert (f.is_vegan, f.is_nut_free, f.contains_pork, f.contains_shellfish, f.is_halal_ok) == (True, False, False, True, False)
    assert [(i.name, i.amount, i.unit) for i in a.ingredients] == [("bean", 2.0, "piece")]
    (p,) = adapters.from_product(feed(spark, "product", {"product_name": "Oat", "nutriments": {"energy-kcal_100g": 371.9, "sugars_100g": 0.99, "salt_100g": 0.016}})).collect()
    assert (p.nutrition_per_100g.kcal, p.nutrition_per_100g.sugar_g, p.nutrition_per_100g.salt_g, p.allergens) == (371, 1.0, 0.02, [])


def test_places(spark):
    nested = {"id": "1", "geocodes": {"main": {"latitude": 1.0, "longitude": 2.0}}, "location": {"locality": "Utrecht"}, "price": 3, "phone": "", "tel": "5"}
    flat = {"id": "2", "coordinates": {"lat": 3.0, "lng": 4.0}, "city": "Delft", "price": 9, "cuisine_tags": {"primary": "Thai"}, "is_open": False}
    a, b = adapters.from_place(feed(spark, "place", nested, flat)).orderBy("id").collect()
    assert (a.lat, a.lng, a.city, a.country, a.price_range, a.phone, a.is_open, a.name) == (1.0, 2.0, "Utrecht", "NL", "€€€", "5", True, "Unknown")
    assert (b.lat, b.lng, b.city, b.price_range, b.cuisine_primary, b.is_open) == (3.0, 4.0, "Delft", "€€", "Thai", False)


@pytest.mark.parametrize(
    "hours,days",
    [
        ("Mo-Fr 12:00-22:00; Sa-Su 11:00-23:00", ["12:00-22:00"] * 5 + ["11:00-23:00"] * 2),
        ("Tu-Su 17:00-23:00; Mo closed", ["closed"] + ["17:00-23:00"] * 6),
        ("Mo-Su 10:00-20:00; We off; Fr,Sa 10:00-12:00,13:00-22:00 approx", ["10:00-20:00"] * 2 + ["off", "10:00-20:00"] + ["10:00-12:00,13:00-22:00 approx"] * 2 + ["10:00-20:00"]),
        ("Fr-Mo 9:00-10:00; Xx-Tu 1:00", ["1:00", "1:00"] + [None] * 5),
        ("Mo 8:00; Mo-Tu-We 9:00; Tu 7:00", ["8:00"] + [None] * 6),
        ("24/7; ; Mo", [None] * 7),
    ],
)
def test_hours(spark, hours, days):
    assert list(spark.range(1).select(adapters.parse_hours(F.lit(hours)).alias("h")).first().h) == days


def test_map_tags(spark):
    tags = {"name": "Bar", "cuisine": "ice_cream; asian fusion", "diet:vegan": "only", "diet:gluten_free": "only", "internet_access": "wlan", "addr:street": "Kade", "addr:postcode": "1000"}
    a, b = adapters.from_map_tags(feed(spark, "map_tags", {"lat": 1.0, "lon": 2.0, "tags": tags}, {"lat": 1.0, "tags": {}})).collect()
    assert (a.cuisine_primary, a.cuisine_secondary, a.vegan_ok, a.gluten_free_ok, a.vibe_tag_additions, a.address) == ("Ice_Cream", ["Asian Fusion"], True, None, ["wifi"], "Kade , 1000 Amsterdam")
    assert (b.lat, b.lng, b.opening_hours, b.address, b.vibe_tag_additions) == (None, None, None, None, None)


@pytest.mark.parametrize(
    "line,parsed",
    [
        ("200 g flour", ("flour", "200", "g")), ("1 1/2 Cups sugar, sifted", ("sugar, sifted", "1 1/2", "cups")), ("pinch of salt", ("of salt", "", "pinch")), ("2 tbsp. oil", ("oil", "2", "tbsp")),
        ("3 eggs", ("eggs", "3", "")), ("fresh herbs", ("fresh herbs", "", "")), ("  ", ("", "", "")), ("glass noodles", ("glass noodles", "", "")),
    ],
)
def test_client_ingredients(spark, line, parsed):
    assert tuple(spark.range(1).select(adapters.parse_ingredient(F.lit(line)).alias("i")).first().i) == parsed


def test_meals_in_the_open_form(spark):
    df = spark.createDataFrame([("T", "Thai", "Vegan", "Chop it all\nBoil\nServe it hot", None)], "title string, cuisine string, category string, instructions string, ingredients array<struct<name:string,measure:string>>")
    (a,) = adapters.meals_to_open(df).collect()
    assert (a.course_tags, a.dietary_tags, a.description) == (["main"], ["vegan", "vegetarian"], "Vegan dish from Thai cuisine.")
    assert [(s.step_number, s.instruction) for s in a.steps] == [(1, "Chop it all"), (3, "Serve it hot")]
    tiers = adapters.tiered_sources(adapters.in_open_form(adapters.meals_to_open(df).unionByName(adapters.document(df)), "curated_verified"))
    assert sorted((r.source_type, r.data_quality_score, r.source_tier) for r in tiers.collect()) == [("curated_verified", 0.95, 0), ("themealdb", 0.6, 1)]


def test_tables(spark):
    names = schemas.create_tables(spark, "made")
    assert schemas.create_tables(spark, "made") == names
    adapters.document(spark.range(1), title=F.lit("x")).withColumns({"doc_id": F.lit("1"), "source_tier": F.lit(2), "enrichment_status": F.lit("raw")}).write.mode("append").saveAsTable("made.documents_open")
    assert spark.table("made.documents_open").count() == 1
