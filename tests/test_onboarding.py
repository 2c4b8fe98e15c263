"""Answers to profiles and their merge, by literal rows."""

from quern.operators import onboarding as o

U = 1


def chips(question, *items, at=0):
    return [(U, question, x, None, None, at + i) for i, x in enumerate(items)]


def sliders(question, **numbers):
    return [(U, question, k.replace("_", " "), float(v), None, 50 + i) for i, (k, v) in enumerate(numbers.items())]


def made(spark, rows):
    return o.profile(o.facts(spark.createDataFrame(rows, o.ANSWERS))).collect()


def test_whole_profile(spark):
    rows = chips("q1", "Flexitarian — mostly plants, sometimes meat", "Halal", "Fruit Only") + chips("q2", "No gluten (coeliac)", "No olives", "No Quinoa")
    rows += [(U, "q3", "Thai", None, "Love", 0), (U, "q3", "Greek", None, "Meh", 1), (U, "q3", "Odd", None, "??", 2), (U, "q16", "text", None, "Gent — East Flanders, Belgium ", 0)]
    rows += [(U, "q4", "Spice level", 64.5, None, 0), (U, "q4", "Sweet vs savoury", 38.0, None, 1)]
    rows += chips("q5", "Tahini", "Miso", "Garlic", "Lemon", "Chilli", "Ginger", "Creamy", "Flaky", "Crispy", "Crispy") + chips("q6", "Semi-pro level")
    rows += chips("q7", "Slow cooker", "Instant Pot / pressure cooker", "Wok", "Toaster") + chips("q9", "Late night", "Outdoor / terrace", "Buzzy & lively", "Odd")
    rows += [(U, "q8", "Typical servings", 3.0, None, 0), (U, "q8", "Meals you cook per week", 20.0, None, 1), (U, "q8", "Grocery budget per week", 100.0, None, 2)]
    rows += [(U, "q10", "Cooking adventure", 9.5, None, 0)] + chips("q10", "I try a new recipe every week or two", "I love my rotation of favourites", at=1)
    rows += [(U, "q11", "Calorie tracking", 51.0, None, 0), (U, "q11", "Fibre & wholefoods", 90.0, None, 0)] + chips("q12", "Family", "Fine dining", "Small group")
    rows += chips("q13", "Batch cooking", "Quick & easy!") + [(U, "q14", "Local & seasonal", 85.0, None, 0)] + chips("q15", "Meal planning", "Foraging", "Sour Dough")
    rows += chips("q17", "Aspiring chef")
    [p] = made(spark, rows + [(U, "q4", "Spice level", 12.0, None, -1), (None, "q1", "Vegan", None, None, 1), (U, None, "Vegan", None, None, 1), (U, "q1", None, None, None, 1)])
    assert p.dietary.spectrum == "flexitarian-halal-fruit only"
    assert [(*x,) for x in p.dietary.hard_stops] == [("gluten", "intolerance", 1.0), ("quinoa", "preference", 1.0)] and [(*x,) for x in p.dietary.soft_stops] == [("olives", "dislike", 0.8)]
    assert [(*x,) for x in p.cuisines] == [("Thai", "love", 0.9), ("Greek", "neutral", 0.7), ("Odd", "neutral", 0.7)]
    # spicy 6.5 + 1 is past 7, so ginger adds nothing; umami 5 + 1.5, then + 1.5, and garlic adds nothing
    assert p.flavor.asDict() == {"spicy": 7.5, "sweet": 6.2, "sour": 6.5, "umami": 8.0, "fatty": 6.0, "salty": 3.8}
    assert p.texture.asDict() == {"crunchy": None, "creamy": 9.0, "soft": None, "chewy": None, "crispy": 10.0, "silky": None, "chunky": None}
    assert p.cooking.asDict() == {"skill": "professional", "setup": "well_equipped", "equipment": ["pressure_cooker", "wok"], "weeknight": 30, "weekend": 60}
    assert (p.budget.home, p.budget.out) == (1.67, 25.0)
    assert p.vibes.asDict() == {"cozy": 7.0, "lively": 10.0, "trendy": 5.0, "classic": 5.0, "hidden_gem": 7.0, "romantic": 6.5, "business": 5.0, "efficient": 5.0}
    assert (p.adventurousness.cooking, p.adventurousness.dining) == (9.0, 8.0)  # 9.5 + 1.5 is cut to 10 before 1 goes
    assert (p.nutrition.level, p.nutrition.tracked) == ("moderate", ["calories", "fibre"])
    assert (*p.social,) == ("family", 1.0, 14.0)
    assert (*p.lifestyle,) == (8.5, 5.8, "wide_selection", ["meal_prep", "foraging", "sour_dough"], ["batch_cooking", "quick_easy"], ["Tahini", "Miso", "Garlic", "Lemon", "Chilli", "Ginger"])
    assert (p.location.city, p.location.country) == ("Gent", "Belgium")


def test_defaults_and_no_rows(spark):
    assert made(spark, []) == []
    [p] = made(spark, chips("q17", "Budget-savvy eater") + [(U, "q8", "Meals you cook per week", 0.0, None, 0), (U, "q8", "Typical servings", 6.0, None, 0), (U, "q11", "Calorie tracking", None, None, 0)])
    assert p.budget.home == 3.5 and p.social.context == "group" and p.social.meals_out == 2.0 and p.nutrition.level == "light" and p.dietary.spectrum is None
    assert p.cooking.skill == "home_cook" and p.cooking.setup == "basic" and (p.adventurousness.cooking, p.lifestyle.sustainability) == (5.0, 3.5)


def test_merge(spark):
    base = spark.sql("""SELECT 1L AS user_id, named_struct('spectrum', 'vegan', 'soft_stops', array('a')) AS dietary, named_struct('cooking', 6.0D, 'dining', 7.0D) AS adventurousness,
      named_struct('interests', array('x', 'y'), 'style', 's') AS lifestyle, named_struct('city', '', 'country', 'NL') AS location
      UNION ALL SELECT 2L, named_struct('spectrum', NULL, 'soft_stops', NULL), named_struct('cooking', 1.0D, 'dining', NULL), NULL, named_struct('city', NULL, 'country', NULL)""")
    more = spark.sql("""SELECT 1L AS user_id, named_struct('spectrum', NULL, 'soft_stops', array('a', 'b')) AS dietary, named_struct('dining', 6.5D, 'cooking', 8.0D, 'odd', 1) AS adventurousness,
      named_struct('interests', array('y', 'z'), 'style', 't') AS lifestyle, named_struct('city', 'Delft', 'country', 'BE') AS location, 'v' AS extra
      UNION ALL SELECT 3L, NULL, NULL, NULL, NULL, NULL""")
    a, b = o.merged(base, more).orderBy("user_id").collect()
    assert (*a.dietary,) == ("vegan", ["a", "a", "b"]) and (*a.adventurousness,) == (8.0, 7.0) and (*a.lifestyle,) == (["x", "y", "z"], "s") and (*a.location,) == ("Delft", "NL")
    assert b.user_id == 2 and (*b.adventurousness,) == (1.0, None) and b.location.city is None and o.merged(base, more).columns == base.columns
    assert b.lifestyle is None or (*b.lifestyle,) == (None, None)
