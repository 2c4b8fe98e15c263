import datetime

import pytest

from quern import schemas
from quern.operators import fusion

PROFILE = dict(
    user_id=1, hard_stops=[("peanut", True), ("celery", False)], soft_stops=[("onion", False)], spectrum="vegetarian", weights={"cuisine": "core", "dietary": "important", "texture": "contextual"}, skill="home_cook",
    weeknight_minutes=30, weekend_minutes=90, affinities=[("Thai", "love"), ("Korean", "never"), ("French", "dislike"), ("thai", "like")], flavors={"spicy": 2.0, "sweet": 8.0}, tensions=[], adventurousness=5.0,
    eating_out_budget=None, sustainability=None,
)
QUERY = dict(
    user_id=1, query_text="dinner", complexity=1.0, eat_in=True, desired_cuisine=None, desired_ingredients=[], excluded_ingredients=[], mood=None, minutes=None, difficulty=None, occasion=None, goal=None, cuisine_tags=[],
    attributes=[], relationships=[], conflicts=[], inferred_mood=None, time_of_day="noon", day_of_week=None, energy=None, asked_at=None,
)


def fuse(spark, profile=None, **query):
    names = lambda ddl: spark.createDataFrame([], ddl).columns
    p, q = PROFILE | (profile or {}), QUERY | query
    profiles = spark.createDataFrame([tuple(p[n] for n in names(schemas.PROFILE))], schemas.PROFILE)
    queries = spark.createDataFrame([tuple(q[n] for n in names(schemas.QUERY))], schemas.QUERY)
    return fusion.fused(queries, profiles).first()


def hard(row):
    return [(f.type, f.value) for f in row.hard_filters]


def soft(row):
    return [(f.type, f.value, f.penalty if f.penalty is not None else f.boost) for f in row.soft_filters]


def test_profile_alone(spark):
    r = fuse(spark)
    assert hard(r) == [("exclude_ingredient", "peanut"), ("dietary_flag", "is_vegetarian"), ("exclude_cuisine", "Korean")]
    assert soft(r) == [("prefer_exclude_ingredient", "onion", 0.4), ("prefer_max_time_min", "30", 0.2), ("prefer_max_difficulty", "2", 0.3), ("prefer_exclude_cuisine", "French", 0.3)]
    assert r.scoring == {"dietary": 0.7, "cuisine": 1.0, "flavor": 0.3, "texture": 0.15, "cooking_skill": 0.3, "nutrition": 0.3, "adventurousness": 0.3}
    assert r.targets["profile_max_difficulty"] == "2" and r.targets["cuisine_affinities"] == '{"thai":0.7,"korean":0.0,"french":0.1}' and r.targets["flavor_preferences"] == '{"spicy":0.2,"sweet":0.8}'
    assert [w.split(":")[0] for w in r.warnings] == ["profile note"] and "Thai" in r.warnings[0]  # loved, and spicy is not


def test_query_weights_and_targets(spark):
    r = fuse(spark, desired_cuisine="Korean", desired_ingredients=["tofu"], excluded_ingredients=["egg"], mood="cosy", minutes=20, difficulty="easy", goal="light", attributes=[("mood", "x", 0.9), ("speed", "fast", 0.7), ("late", "y", 0.6)])
    assert hard(r)[2:] == [("exclude_ingredient", "egg"), ("max_time_min", "20")]
    assert ("prefer_exclude_cuisine", "Korean", 0.2) in soft(r) and not any(f.type.startswith("prefer_max") for f in r.soft_filters)
    assert r.scoring["cuisine"] == pytest.approx(1.95) and r.scoring["ingredients"] == pytest.approx(1.56) and r.scoring["occasion"] == 0.8 and r.scoring["nutrition"] == 0.6
    assert {k: r.targets[k] for k in ("cuisine", "max_time_min", "max_difficulty", "query_speed", "desired_ingredients")} == {"cuisine": "Korean", "max_time_min": "20", "max_difficulty": "2", "query_speed": "fast", "desired_ingredients": '["tofu"]'}
    assert "query_mood" not in r.targets and "query_late" not in r.targets and r.inferred_urgency == "quick"
    assert any("Korean" in w and "never" in w for w in r.warnings) and any("spicy" in w for w in r.warnings)


def test_relationships_change_weights_in_order(spark):
    r = fuse(spark, relationships=[("amplifies", "a", "cuisine", 1.0), ("attenuates", "a", "cuisine", 0.5), ("amplifies", "a", "occasion", 1.0), ("requires", "a", "dietary", 1.0), ("amplifies", "a", "flavor", 100.0)])
    assert r.scoring["cuisine"] == pytest.approx(1.3 * 0.9) and "occasion" not in r.scoring and r.scoring["dietary"] == 0.7 and r.scoring["flavor"] == 2.0


@pytest.mark.parametrize(
    "context,filters",
    [
        ({"time_of_day": "morning", "day_of_week": "weekend"}, [("prefer_max_time_min", "90", 0.2), ("prefer_occasion_tag", "breakfast", 0.3)]),
        ({"time_of_day": "dinner", "energy": "tired"}, [("prefer_max_time_min", "30", 0.2), ("prefer_occasion_tag", "dinner", 0.2), ("prefer_max_time_min", "30", 0.3)]),
        ({"time_of_day": None, "asked_at": datetime.datetime(2024, 1, 6, 12, tzinfo=datetime.UTC)}, [("prefer_max_time_min", "90", 0.2), ("prefer_occasion_tag", "lunch", 0.2)]),
        ({"time_of_day": None, "asked_at": datetime.datetime(2024, 1, 8, 22, tzinfo=datetime.UTC)}, [("prefer_max_time_min", "30", 0.2)]),
        ({"time_of_day": "noon", "eat_in": False}, []),
    ],
)
def test_context(spark, context, filters):
    got = [f for f in soft(fuse(spark, **context)) if f[0] in ("prefer_max_time_min", "prefer_occasion_tag")]
    assert got == filters


def test_conflicts(spark):
    given = [("taste", "show_warning", "d1", "w1", "PEANUT sauce"), ("taste", "ask_user", "d2", None, None), ("taste", "honor_query", "d3", "w3", None)]
    r = fuse(spark, conflicts=given, desired_ingredients=["peanut"])
    assert r.warnings[0] == "dietary restriction applied: d1" and r.requires_clarification and "d2" in r.clarification and r.n_blocking == 1
    assert fuse(spark, query_text="Peanuts please").n_blocking == 0  # another word
    assert fuse(spark, query_text="with peanut, please").n_blocking == 1
    r = fuse(spark, minutes=46, difficulty="challenging", occasion="Date night")
    assert len(r.warnings) == 3 and r.inferred_mood == "romantic" and not r.requires_clarification and r.clarification is None


def test_tensions(spark):
    many = {"spectrum": "Vegan", "affinities": [("Thai", "love"), ("French", "like"), ("Dutch", "love")], "eating_out_budget": 10.0, "sustainability": 8.0}
    assert len(fuse(spark, many).warnings) == 4
    assert len(fuse(spark, many | {"tensions": [("diet | cuisine Thai", "old", True), ("diet | cuisine French", "said before", False)]}).warnings) == 4
    assert len(fuse(spark, many | {"spectrum": "flexitarian vegan", "hard_stops": []}).warnings) == 2
