"""Declared schemas of feeds, documents, places, profiles and queries, and the tables made from them."""

from __future__ import annotations

from pyspark.sql import SparkSession

INGREDIENT = "struct<name:string, amount:double, unit:string, notes:string, is_optional:boolean>"
STEP = "struct<step_number:int, instruction:string, duration_min:int, technique_tags:array<string>>"
FLAGS = (
    "struct<is_vegan:boolean, is_vegetarian:boolean, is_pescatarian_ok:boolean, is_dairy_free:boolean, is_gluten_free:boolean, is_nut_free:boolean, "
    "is_halal_ok:boolean, contains_pork:boolean, contains_shellfish:boolean, contains_alcohol:boolean, vegan_if_substituted:boolean, gluten_free_if_substituted:boolean>"
)
NUTRITION = "struct<kcal:int, protein_g:double, fat_g:double, saturated_fat_g:double, carbs_g:double, fiber_g:double, sugar_g:double, salt_g:double>"

DOCUMENT = (
    f"title string, title_en string, cuisine_tags array<string>, region_tag string, description string, ingredients array<{INGREDIENT}>, steps array<{STEP}>, "
    f"time_prep_min int, time_cook_min int, time_total_min int, serves int, difficulty int, flavor_tags array<string>, texture_tags array<string>, dietary_tags array<string>, "
    f"dietary_flags {FLAGS}, nutrition_per_serving {NUTRITION}, season_tags array<string>, occasion_tags array<string>, course_tags array<string>, source_type string, "
    "embedding_text string, data_quality_score double"
)

HOURS = "struct<monday:string, tuesday:string, wednesday:string, thursday:string, friday:string, saturday:string, sunday:string>"
PLACE = (
    "id string, name string, address string, neighborhood string, city string, country string, cuisine_primary string, cuisine_secondary array<string>, vibe_tags array<string>, "
    f"price_range string, lat double, lng double, phone string, website_url string, opening_hours {HOURS}, menu_summary string, specialties array<string>, is_open boolean, data_quality_score double"
)

#: Feeds as they arrive, by name.
FEEDS = {
    "flat": "strMeal string, strArea string, strCategory string, strInstructions string, " + ", ".join(f"strIngredient{i} string, strMeasure{i} string" for i in range(1, 21)),
    "plain": "title string, NER array<string>, ingredients array<string>, directions array<string>",
    "enriched": (
        "title string, NER array<string>, ingredients array<string>, directions array<string>, "
        "_enrichment struct<description:string, cuisine:string, difficulty:int, serves:int, time_prep_min:int, time_cook_min:int, flavor_tags:string, texture_tags:string, season_tags:string, occasion_tags:string, course_tags:string>, "
        f"_nutrition struct<kcal:double, protein_g:double, fat_g:double, saturated_fat_g:double, carbs_g:double, fiber_g:double, sugar_g:double, salt_g:double>, _dietary_flags {FLAGS}, _dietary_tags string"
    ),
    "nutrients": (
        "recipe struct<label:string, cuisineType:array<string>, ingredients:array<struct<food:string, quantity:double, measure:string, text:string>>, instructionLines:array<string>, "
        "healthLabels:array<string>, totalNutrients:map<string,struct<quantity:double>>, yield:double, totalTime:int>"
    ),
    "product": "product_name string, nutriments map<string,double>, allergens_tags array<string>, labels_tags array<string>",
    "place": (
        "id string, name string, geocodes struct<main:struct<latitude:double, longitude:double>>, coordinates struct<lat:double, lng:double>, "
        "location struct<formatted_address:string, locality:string, country:string>, address string, city string, country string, neighborhood string, "
        "cuisine_tags struct<primary:string, secondary:array<string>>, vibe_tags array<string>, price int, price_range string, phone string, tel string, website_url string, website string, "
        f"opening_hours {HOURS}, menu_summary string, specialties array<string>, is_open boolean, data_quality_score double"
    ),
    "map_tags": "lat double, lon double, tags map<string,string>",
}

PROFILE = (
    "user_id long, hard_stops array<struct<label:string, is_hard_stop:boolean>>, soft_stops array<struct<label:string, is_hard_stop:boolean>>, spectrum string, "
    "weights map<string,string>, skill string, weeknight_minutes int, weekend_minutes int, affinities array<struct<cuisine:string, level:string>>, flavors map<string,double>, "
    "tensions array<struct<dimensions:string, description:string, resolved:boolean>>, adventurousness double, eating_out_budget double, sustainability double"
)
QUERY = (
    "user_id long, query_text string, complexity double, eat_in boolean, desired_cuisine string, desired_ingredients array<string>, excluded_ingredients array<string>, mood string, "
    "minutes int, difficulty string, occasion string, goal string, cuisine_tags array<string>, attributes array<struct<attribute:string, value:string, centrality:double>>, "
    "relationships array<struct<kind:string, source:string, target:string, confidence:double>>, conflicts array<struct<kind:string, strategy:string, description:string, warning:string, query_value:string>>, inferred_mood string, "
    "time_of_day string, day_of_week string, energy string, asked_at timestamp"
)

TABLES = {"documents_open": f"doc_id string, {DOCUMENT}, source_tier int, enrichment_status string", "places_open": PLACE, "profiles": PROFILE, "queries": QUERY}


def create_tables(spark: SparkSession, database: str) -> list[str]:
    """Create the tables that do not exist yet; their full names."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
    return [f"{database}.{name}" for name in TABLES]
