import pytest
from pyspark.sql import functions as F

from quern.functions import numeric, text
from quern.operators import classify, filters, flags, quality, ranking, retrieval, sampling
from quern.sources import tables


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def words(*items):
    return F.array(*[F.lit(i) for i in items]) if items else F.array().cast("array<string>")


@pytest.mark.parametrize(
    "measure,amount,unit",
    [("1/2 cup", 0.5, "cup"), ("3", 3.0, "piece"), ("200g", 200.0, "g"), (" To taste ", 1.0, "to taste"), ("1/0 cup", 1.0, "cup"), ("2.5 TBSP", 2.5, "tbsp")]
    + [("", 1.0, "piece"), (None, 1.0, "piece"), ("1/2/4 big cups, sifted", 0.5, "big cups, sifted"), ("1.2.3 l", 1.0, "l"), ("/ x", 1.0, "x"), (".5kg", 0.5, "kg")],
)
def test_measures(spark, measure, amount, unit):
    assert tuple(one(spark, numeric.parse_measure(F.lit(measure).cast("string")))[0]) == (amount, unit)


def test_vectors(spark):
    a, zero = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(0.0), F.lit(0.0))
    r = one(spark, numeric.cosine(a, a), numeric.cosine(a, zero), numeric.is_zero(zero), numeric.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)))
    assert r[0] == pytest.approx(1) and r[1] == 0 and r[2] and r[3] == pytest.approx(3.14159265 * 6_371_000, rel=1e-6)


def test_titles_and_lists(spark):
    r = one(spark, text.title_normalized(F.lit(" A-b  c! ")), text.list_literal(F.lit("['x', 'y;z']")), text.list_literal(F.lit("x; y|z")), text.list_literal(F.lit(None).cast("string")), text.slug(F.lit("Été à Paris!")))
    assert r[0] == "ab  c" and r[1] == ["x", "y;z"] and r[2] == ["x", "y", "z"] and r[3] == [] and r[4] == "t_paris"


@pytest.mark.parametrize("nulls,kept", [("lenient", [1, 3]), ("strict", [1])])
def test_null_policies(spark, nulls, kept):
    df = spark.createDataFrame([(1, 10, True), (2, 99, True), (3, None, True), (4, 10, None)], "id int, t int, flag boolean")
    assert [r.id for r in df.where(filters.max_time(F.col("t"), 20, nulls) & filters.dietary_flag(F.col("flag"), True, nulls)).collect()] == kept


def test_exclusions_and_reasons(spark):
    ham = words("smoked ham", "rice")
    r = one(spark, filters.exclude_ingredient(ham, words(), "no-ham"), filters.exclude_ingredient(ham, words(), "no-ham", raw_label=True), filters.exclude_ingredient(ham, words(), " "), filters.first_failure([(F.lit(True), "a"), (F.lit(None).cast("boolean"), "b"), (F.lit(False), "c")]))
    assert tuple(r) == (False, True, True, "b")


def test_longest_keyword_wins(spark):
    rules = [("fried rice", "Chinese"), ("kimchi fried rice", "Korean"), ("thai", "Thai"), ("nasi goreng", "Indonesian")]
    cases = {"Kimchi Fried Rice": "Korean", "Fried Rices": "Chinese", "Thai Curry": "Thai", "Nasi Goreng": None, "": None, "thaiX": None}
    df = spark.createDataFrame([*cases.items()], "t string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", classify.longest_keyword(F.col("t"), rules, ["Korean", "Chinese", "Thai"])).collect())


def test_flag_rule_sets_differ(spark):
    terms = words("nutmeg", "graham cracker")
    r = one(spark, flags.by_word(terms).contains_pork, flags.by_substring(terms).contains_pork, flags.by_word(words()).is_vegan, flags.mixed(words(), F.lit("")).is_vegan)
    assert tuple(r) == (False, True, True, False)


def test_seven_and_ten_flags_have_words_of_their_own(spark):
    seven = lambda title, *t: {k for k, v in one(spark, flags.seven(words(*t), F.lit(title)))[0].asDict().items() if v}
    ten = lambda *t: {k for k, v in one(spark, flags.ten(words(*t)))[0].asDict().items() if v}
    assert seven("", "rice", "eggnog") == {"is_vegetarian", "is_vegan", "is_gluten_free", "is_dairy_free", "is_nut_free"}
    assert seven("Nut Cake", "Greek Yogurt") == {"is_vegetarian", "contains_nuts"} and seven("Clam bake") == {"contains_shellfish"}
    assert seven("", "baking powder", "ghee") == {"is_vegetarian", "is_nut_free"} and "is_nut_free" in seven("", "nutmeg") and "is_vegetarian" not in seven("", "ox", "bone broths")
    assert "is_nut_free" not in ten("Nutmeg") and "contains_pork" in ten("Graham cracker") and "is_vegetarian" in ten("prawn") and "contains_shellfish" in ten("king prawns")
    assert "is_halal_ok" not in ten("Wine vinegar") and ten() == {"is_vegan", "is_vegetarian", "is_pescatarian_ok", "is_dairy_free", "is_gluten_free", "is_nut_free", "is_halal_ok"}
    assert "is_pescatarian_ok" in ten("cod") and "is_vegetarian" not in ten("cod")


def test_ranking_factors(spark):
    names = words("aubergine", "rice")
    r = one(
        spark,
        ranking.ingredient_overlap(names, ["eggplant", "beef"]), ranking.ingredient_overlap(words(), ["x"]), ranking.ingredient_overlap(names, []), ranking.ingredient_overlap(names, ["rice"], ["rice"]),
        ranking.time_fit(F.lit(30), 60), ranking.time_fit(F.lit(90), 60), ranking.time_fit(F.lit(None).cast("int"), 60),
        ranking.difficulty_match(F.lit(5), "beginner"), ranking.difficulty_match(F.lit(1), "x", "challenging"), ranking.cuisine_affinity(words("north italian"), [("italian", "love")]),
    )
    assert [round(x, 6) for x in r] == [0.5, 0.3, 0.5, 0.5, 0.85, 0.6, 0.5, 0.0, 0.25, 1.0]


def test_seats_sum_to_the_target(spark):
    rows = [(f"s{i}", n, i) for i, n in enumerate((3, 5, 100, 250, 251, 4000))]
    seats = {r.stratum: r.seats for r in sampling.allocate_seats(spark.createDataFrame(rows, "stratum string, rows long, first_seen long"), 600, 10).collect()}
    assert sum(seats.values()) == 600 and seats["s0"] == 3 and seats["s1"] == 5 and seats["s5"] > seats["s4"] >= seats["s3"]


def test_pages_and_ties(spark):
    df = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(10)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in retrieval.vector_top_k(df, [1.0, 0.0], 3).orderBy("retrieval_rank").collect()] == [0, 2, 4]
    assert [r.vec_id for r in retrieval.keyset_page(df, "vec_id", 3, 2).collect()] == [4, 5]


def test_readers(spark, tmp_path):
    (tmp_path / "a_1.jsonl").write_text('{"id": 1, "t": "x"}\n\n{bad\n', encoding="utf-8")
    (tmp_path / "a_2.jsonl").write_text('{"id": 2, "t": "é"}\n', encoding="utf-8")
    rows, bad = tables.json_lines(spark, f"{tmp_path}/a_*.jsonl", "id int, t string")
    assert sorted(map(tuple, rows.collect())) == [(1, "x"), (2, "é")] and [r.line for r in bad.collect()] == ["{bad"]
    (tmp_path / "c.csv").write_text('Name,link\n"a ""q""",u\n', encoding="utf-8")
    assert [tuple(r) for r in tables.csv_table(spark, f"{tmp_path}/c.csv", {"title": ["name"], "url": ["link"], "none": []}).collect()] == [('a "q"', "u", None)]
    (tmp_path / "e.json").write_text('{"results": [{"id": 1}, {"id": 2}]}', encoding="utf-8")
    assert tables.json_envelope(spark, f"{tmp_path}/e.json", "results", "id int").count() == 2
    assert tables.json_envelope(spark, f"{tmp_path}/none.json", "results", "id int").count() == 0
    tables.write_json(rows.withColumn("_internal", F.lit(1)), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").columns == ["id", "t"]


def test_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, tables.upsert(old, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert [r.k for r in tables.delete(old, F.col("v") == "a").collect()] == [2]
    assert tables.select(old, ["v"], {"k": 2}).first().v == "b"
    assert tables.combined({"x": old, "y": old}, "combined").count() == 4 and tables.combined({"x": old, "y": old}, "?").count() == 2


def test_ranking_rules_by_literal_cases(spark):
    """Cases worked out by hand from the rules of each factor."""
    names = words("aubergine", "streaky bacon", "rice")
    none = F.lit(None).cast("boolean")
    compliance = lambda flags_, hard, soft, diet: ranking.dietary_compliance(names, flags_, hard, soft, diet)
    r = one(
        spark,
        compliance({}, ["eggplant"], [], None),  # the American name of what is there
        compliance({"contains_pork": F.lit(True)}, ["pork"], [], None),
        compliance({"contains_pork": F.lit(True)}, [], ["pork"], None),  # soft stops look at names only
        compliance({}, [], ["rice", "milk"], None),
        compliance({"is_vegan": F.lit(False)}, [], [], "Mostly vegan"),
        compliance({"is_vegan": F.lit(False)}, [], [], "flexitarian, some vegan days"),
        compliance({"is_vegetarian": F.lit(True)}, [], [], "lacto-vegetarian"),
        ranking.cuisine_affinity(words("thai"), [], "northern thai"),
        ranking.cuisine_affinity(words("northern thai"), [], "Thai"),
        ranking.cuisine_affinity(words("greek"), [], "Thai"),
        ranking.flavor_affinity(words("hot", "charred"), {"spicy": 0.9, "smoky": 0.4}),
        ranking.flavor_affinity(words("acidic", "rich"), {"sour": 0.9, "fatty": 0.9}),
    )
    assert list(r) == [0.0, 0.0, 1.0, pytest.approx(0.7), 0.0, 1.0, 1.0, 1.0, 1.0, 0.2, pytest.approx(0.7), 0.5]
    profile = {"affinities": [], "spectrum": "pescatarian", "restrictions": [], "flavors": {}, "skill": 5}
    client = lambda flags_, **more: ranking.client_score(words(), flags_, words(), F.lit(1), words(), profile | more, "summer")
    r = one(
        spark,
        client({}),  # 12 of the cuisine, 10 of the skill, 5 of the season
        client({"is_pescatarian_ok": F.lit(True)}),
        client({"vegan_if_substituted": F.lit(True)}, spectrum="vegan"),
        client({"vegan_if_substituted": F.lit(True)}, spectrum="vegetarian"),
        client({"is_nut_free": none}, spectrum="omnivore", restrictions=["nut allergy"]),
        client({"is_nut_free": F.lit(False)}, spectrum="omnivore", restrictions=["nut allergy"]),
        client({"contains_pork": F.lit(True)}, spectrum="omnivore", restrictions=["loves pork belly"]),
        client({"contains_pork": F.lit(True)}, spectrum="omnivore", restrictions=["no pork", "Halal"]),
    )
    assert list(r) == [27, 52, 39, 39, 52, 37, 52, 27]


@pytest.mark.parametrize("opening,stub", [("A recipe for", True), ("This is a recipe", True), ("Delicious recipe", True), ("Simple recipe", True), ("A dish of", False), ("Recipe for", False)])
def test_stub_openings(spark, opening, stub):
    assert one(spark, filters.is_stub(F.lit(opening + " x" * 60)))[0] is stub


def test_what_keeps_a_document_from_tier_1(spark):
    on = {"has_cuisine_tag": F.lit(True), "has_course_tag": F.lit(True), "has_dietary_flags": F.lit(True)}
    lacks = lambda title, text_, n, k, flags_, status, c: quality.tier1_failures(F.lit(title), F.lit(text_), F.lit(n), F.lit(k), flags_, F.lit(status), F.lit(c))
    r = one(spark, lacks("Soup", "x" * 50, 2, 2, on, "validated", 0.6), lacks("  So ", "x" * 49, 1, 1, dict.fromkeys(on, F.lit(False)), "raw", 0.59))
    assert r[0] == [] and r[1] == ["title", "ingredients", "steps", "description", "cuisine_tags", "course_tags", "dietary_flags", "enrichment_status", "description.confidence"]


def test_an_id_with_two_vectors_is_found_once(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0])], "vec_id int, embedding array<double>")
    assert [(r.vec_id, r.similarity) for r in retrieval.vector_top_k(vectors, [1.0, 0.0], 2).collect()] == [(1, 1.0), (2, 0.0)]
