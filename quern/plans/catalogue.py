"""Queries over documents as a catalogue: titles, filters, scores, tiers, classes and flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import numeric, text
from quern.operators import classify, dedup, filters, flags, quality
from quern.sources.tables import table

# A document's first non-blank line is its title, the lines after it are its steps, the title's words its terms.


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    title = F.coalesce(F.get("lines", F.lit(0)), F.lit(""))
    return docs.withColumn("lines", lines).select(
        "doc_id", "text", "lang", "source", "n_chars",
        title.alias("title"),
        F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(1))).alias("steps"),
        F.filter(F.split(F.lower(title), " "), lambda x: x != "").alias("terms"),
    )


CATALOGUE = """
l AS (SELECT *, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ') <> '') AS lines FROM documents),
d AS (SELECT doc_id, text, lang, source, n_chars, coalesce(lines[1], '') AS title, lines[2:] AS steps,
      list_filter(string_split(lower(coalesce(lines[1], '')), ' '), lambda x: x <> '') AS terms FROM l)"""


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue with the flags and status that labels give."""
    labels = table(spark, sf_dir, "labels")
    docs = catalogue(spark, sf_dir).join(labels, "doc_id", "left")
    status = F.when(F.col("quality") == 1, "deterministic_enriched").when(F.col("quality") == 0, "rejected").otherwise("raw")
    return docs.select(
        "*",
        status.alias("status"),
        (~filters.is_stub(F.col("text"))).alias("has_real_description"),
        F.col("lang").isNotNull().alias("has_cuisine_tag"),
        F.col("source").isNotNull().alias("has_course_tag"),
        (F.col("quality") == 1).alias("has_dietary_flags"),
        (F.col("toxic") == 1).alias("has_llm_flavor_tags"),
        (F.col("n_chars") > 1000).alias("has_nutrition"),
    )


STUB = """(length(trim(lower(coalesce(text, '')), ' ')) < 80
  OR regexp_matches(trim(lower(coalesce(text, '')), ' '), '^(a recipe for|this is a recipe|delicious recipe|simple recipe)'))"""
GRADED = f"""{CATALOGUE},
g AS (SELECT d.*, quality, toxic,
      CASE WHEN quality = 1 THEN 'deterministic_enriched' WHEN quality = 0 THEN 'rejected' ELSE 'raw' END AS status,
      NOT {STUB} AS has_real_description, lang IS NOT NULL AS has_cuisine_tag, source IS NOT NULL AS has_course_tag,
      quality = 1 AS has_dietary_flags, toxic = 1 AS has_llm_flavor_tags, n_chars > 1000 AS has_nutrition
      FROM d LEFT JOIN labels USING (doc_id))"""
FLAG_NAMES = [*quality.PROMOTION]


def title_normalized(spark, sf_dir):
    title = F.col("title")
    return catalogue(spark, sf_dir).select(
        "doc_id", text.title_normalized(title).alias("title_normalized"), text.one_space(title).alias("one_space"), text.slug(title).alias("slug"),
        text.deterministic_uuid(F.coalesce("source", F.lit("none")), title).alias("uuid"), F.size("terms").alias("ingredient_count"), F.size("steps").alias("step_count"),
    )


TITLE_NORMALIZED = f"""WITH {CATALOGUE}, m AS (SELECT *, md5(coalesce(source, 'none') || '::' || title) AS h FROM d)
SELECT doc_id, lower(trim(regexp_replace(title, '[^a-zA-Z0-9 ]', '', 'g'), ' ')) AS title_normalized,
  regexp_replace(lower(trim(title, ' ')), '[\\t\\n\\f\\r\\x0B ]+', ' ', 'g') AS one_space,
  regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
  h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS uuid,
  CAST(len(terms) AS INT) AS ingredient_count, CAST(len(steps) AS INT) AS step_count FROM m"""


def dedup_keep_first(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return dedup.keep_first(docs, text.dedup_key(F.col("text")), "doc_id").select("doc_id", "lang", "source")


DEDUP_KEEP_FIRST = """SELECT doc_id, lang, source FROM documents WHERE text IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY lower(trim(text, ' ')) ORDER BY doc_id) = 1"""


def raw_quality_filter(spark, sf_dir):
    docs = catalogue(spark, sf_dir)
    keep = filters.raw_quality(F.col("title"), F.col("terms"), F.col("steps")) & ~F.col("title").startswith("[EDGE")
    return docs.where(keep).select("doc_id", F.size("terms").alias("n_terms"), F.size("steps").alias("n_steps"))


RAW_QUALITY_FILTER = f"""WITH {CATALOGUE} SELECT doc_id, CAST(len(terms) AS INT) AS n_terms, CAST(len(steps) AS INT) AS n_steps FROM d
WHERE length(title) BETWEEN 1 AND 200 AND len(terms) >= 2 AND len(steps) >= 2
  AND len(list_filter(steps, lambda s: length(s) > 2000)) = 0 AND NOT starts_with(title, '[EDGE')"""


def first_failing_filter(spark, sf_dir):
    """Hard filters in order, with the reason of the first that fails, and all that the document lacks."""
    docs = graded(spark, sf_dir)
    checks = [
        (filters.exclude_ingredient(F.col("terms"), F.array("lang"), "no-ham"), "exclude_ingredient"),
        (filters.dietary_flag(F.col("quality") == 1), "dietary_flag"),
        (filters.max_time(F.col("n_chars"), 3000), "max_time_min"),
        (filters.exclude_cuisine(F.array(F.coalesce("lang", F.lit(""))), "FR"), "exclude_cuisine"),
    ]
    lacks = filters.baseline_failures(F.col("title"), F.col("terms"), F.col("steps"))
    missing = filters.missing_fields({"lang": F.col("lang"), "source": F.col("source"), "quality": F.col("quality"), "toxic": F.col("toxic")})
    return docs.select("doc_id", filters.first_failure(checks).alias("reason"), F.array_join(lacks, ",").alias("baseline"), F.array_join(missing, ",").alias("missing"))


FIRST_FAILING_FILTER = f"""WITH {GRADED} SELECT doc_id,
  CASE WHEN len(list_filter(terms, lambda n: contains(lower(n), 'ham'))) > 0 OR contains(lower(coalesce(lang, '')), 'ham') THEN 'exclude_ingredient'
       WHEN NOT coalesce(quality = 1, false) THEN 'dietary_flag' WHEN n_chars > 3000 THEN 'max_time_min'
       WHEN contains(coalesce(lang, ''), 'fr') THEN 'exclude_cuisine' END AS reason,
  array_to_string(list_filter([CASE WHEN trim(title, ' ') = '' THEN 'title' END, CASE WHEN len(terms) = 0 THEN 'ingredients' END,
    CASE WHEN len(list_filter(terms, lambda x: trim(x, ' ') = '')) > 0 THEN 'ingredient name' END,
    CASE WHEN len(list_filter(steps, lambda x: trim(x, ' ') = '')) > 0 THEN 'step text' END], lambda x: x IS NOT NULL), ',') AS baseline,
  array_to_string(list_filter([CASE WHEN lang IS NULL THEN 'lang' END, CASE WHEN source IS NULL THEN 'source' END,
    CASE WHEN quality IS NULL THEN 'quality' END, CASE WHEN toxic IS NULL THEN 'toxic' END], lambda x: x IS NOT NULL), ',') AS missing FROM g"""


def quality_score(spark, sf_dir):
    d = catalogue(spark, sf_dir)
    t, terms, steps = F.col("title"), F.col("terms"), F.col("steps")
    gaps = {"short": (F.length("title") < 20, 0.15), "steps": (F.size("steps") == 0, 0.2), "lang": (F.col("lang").isNull(), 0.1)}
    return d.select(
        "doc_id",
        quality.score_100(t, terms, steps, F.col("lang"), terms).alias("score_100"),
        F.round(quality.score_unit(t, terms, steps), 4).alias("score_unit"),
        F.round(quality.score_deductions(t, terms, steps), 4).alias("score_deductions"),
        quality.completeness(gaps).alias("completeness"),
    )


QUALITY_SCORE = f"""WITH {CATALOGUE}, s AS (SELECT *, len(terms) AS n, len(steps) AS k, length(title) AS t, length(trim(title, ' ')) AS tt,
  len(list_distinct(list_transform(terms, lambda x: trim(lower(x), ' ')))) AS u,
  CASE WHEN len(steps) > 0 THEN list_sum(list_transform(steps, lambda x: length(x))) / len(steps) END AS mean FROM d)
SELECT doc_id, CAST(least(100, CASE WHEN n BETWEEN 5 AND 15 THEN 25 WHEN n BETWEEN 3 AND 20 THEN 15 WHEN n >= 2 THEN 5 ELSE 0 END
  + CASE WHEN k BETWEEN 4 AND 12 THEN 25 WHEN k BETWEEN 2 AND 15 THEN 15 WHEN k >= 1 THEN 5 ELSE 0 END
  + CASE WHEN tt BETWEEN 10 AND 60 THEN 20 WHEN tt BETWEEN 5 AND 80 THEN 10 ELSE 0 END
  + CASE WHEN lang IS NULL THEN 0 WHEN lang IN ('Other', 'Unknown', 'other', '') THEN 5 ELSE 20 END + CASE WHEN n > 0 THEN 10 ELSE 0 END) AS INT) AS score_100,
  round(least(1.0::DOUBLE, CASE WHEN n BETWEEN 7 AND 15 THEN 0.3::DOUBLE WHEN n BETWEEN 5 AND 20 THEN 0.2 ELSE 0.1 END
  + CASE WHEN k BETWEEN 4 AND 10 THEN 0.2::DOUBLE WHEN k BETWEEN 3 AND 15 THEN 0.15 ELSE 0 END + CASE WHEN t BETWEEN 10 AND 60 THEN 0.2::DOUBLE WHEN t > 5 THEN 0.1 ELSE 0 END
  + CASE WHEN u >= 6 THEN 0.15::DOUBLE WHEN u >= 4 THEN 0.1 ELSE 0 END + CASE WHEN mean > 50 THEN 0.15::DOUBLE WHEN mean > 30 THEN 0.1 ELSE 0 END), 4) AS score_unit,
  round(greatest(0::DOUBLE, 1::DOUBLE - CASE WHEN n < 5 THEN 0.1 ELSE 0 END - CASE WHEN n < 3 THEN 0.2 ELSE 0 END - CASE WHEN k < 3 THEN 0.15 ELSE 0 END
  - CASE WHEN k < 2 THEN 0.2 ELSE 0 END - CASE WHEN t < 5 THEN 0.1 ELSE 0 END - CASE WHEN regexp_matches(title, '[0-9]') THEN 0.05 ELSE 0 END), 4) AS score_deductions,
  round(1::DOUBLE - CASE WHEN t < 20 THEN 0.15 ELSE 0 END - CASE WHEN k = 0 THEN 0.2 ELSE 0 END - CASE WHEN lang IS NULL THEN 0.1 ELSE 0 END, 2) AS completeness FROM s"""


def tiered(spark, sf_dir):
    g = graded(spark, sf_dir)
    on = {k: F.col(k) for k in FLAG_NAMES}
    level = quality.tier(F.col("title"), F.size("terms"), F.size("steps"), on, F.col("status"))
    return g.withColumn("tier", level).withColumn("promotion_score", quality.promotion_score(on))


TIERED = f"""{GRADED},
p AS (SELECT *, length(trim(title, ' ')) AS t, len(terms) AS n, len(steps) AS k,
  {' + '.join(f'CASE WHEN {k} THEN {v} ELSE 0 END' for k, v in quality.PROMOTION.items())} AS promotion_score FROM g),
r AS (SELECT *, CASE WHEN status = 'rejected' THEN 0
  WHEN t >= 5 AND n >= 2 AND k >= 2 AND has_real_description AND has_cuisine_tag AND has_course_tag AND coalesce(has_dietary_flags, false)
    AND status IN ('deterministic_enriched', 'llm_enriched', 'validated') THEN 1
  WHEN t >= 3 AND n >= 2 AND k >= 1 THEN 2 WHEN t >= 1 THEN 3 ELSE 0 END AS tier FROM p)"""


def tier_assign(spark, sf_dir):
    d = tiered(spark, sf_dir).withColumn("confidence", F.when(F.col("toxic") == 1, 0.4).otherwise(0.6 + F.col("doc_id") % 5 * 0.05))
    on = {k: F.col(k) for k in FLAG_NAMES}
    lacks = quality.tier1_failures(F.col("title"), F.col("text"), F.size("terms"), F.size("steps"), on, F.col("status"), F.col("confidence"))
    kind = F.when(F.col("status") == "raw", "open").otherwise("curated")
    return d.select(
        "doc_id", "tier", F.col("promotion_score").cast("int").alias("promotion_score"), quality.next_status(F.col("tier"), F.col("status")).alias("status"),
        quality.tier_quality(F.col("tier")).alias("tier_quality"), F.array_join(lacks, ",").alias("tier1_failures"), kind.alias("source_type"),
    )


TIER_ASSIGN = f"""WITH {TIERED} SELECT doc_id, CAST(tier AS INT) AS tier, CAST(promotion_score AS INT) AS promotion_score,
  CASE WHEN tier = 1 THEN 'validated' ELSE status END AS status, CASE tier WHEN 1 THEN 0.95::DOUBLE WHEN 2 THEN 0.65 WHEN 3 THEN 0.35 ELSE 0.1 END AS tier_quality,
  array_to_string(list_filter([CASE WHEN NOT length(trim(title, ' ')) >= 3 THEN 'title' END, CASE WHEN n < 2 THEN 'ingredients' END,
    CASE WHEN k < 2 THEN 'steps' END, CASE WHEN NOT coalesce(length(text) >= 50, false) THEN 'description' END,
    CASE WHEN lang IS NULL THEN 'cuisine_tags' END, CASE WHEN source IS NULL THEN 'course_tags' END,
    CASE WHEN NOT coalesce(quality = 1, false) THEN 'dietary_flags' END, CASE WHEN quality IS NULL THEN 'enrichment_status' END,
    CASE WHEN text IS NOT NULL AND toxic = 1 THEN 'description.confidence' END], lambda x: x IS NOT NULL), ',') AS tier1_failures,
  CASE WHEN status = 'raw' THEN 'open' ELSE 'curated' END AS source_type FROM r"""


def change_detect(spark, sf_dir):
    """Documents whose tier differs from what their label alone says."""
    old = F.when(F.col("quality") == 1, 1).when(F.col("quality") == 0, 0)
    d = tiered(spark, sf_dir).withColumn("old_tier", old)
    return quality.changed(d, {"old_tier": "tier"}).select("doc_id", "old_tier", "tier")


CHANGE_DETECT = f"""WITH {TIERED}, o AS (SELECT *, CASE WHEN quality = 1 THEN 1 WHEN quality = 0 THEN 0 END AS old_tier FROM r)
SELECT doc_id, CAST(old_tier AS INT) AS old_tier, CAST(tier AS INT) AS tier FROM o WHERE old_tier IS DISTINCT FROM tier"""


def provenance_seed(spark, sf_dir):
    d = catalogue(spark, sf_dir)
    empty = F.create_map().cast("map<string,struct<source:string,confidence:double>>")
    seeded = quality.seeded_provenance(empty, F.col("lang").isNotNull(), "documents")
    return d.select("doc_id", F.explode(seeded).alias("field", "v")).select("doc_id", "field", "v.source", "v.confidence")


PROVENANCE_SEED = f"""SELECT doc_id, field, CASE WHEN field = 'title' OR field = 'cuisine_tags' AND lang IS NOT NULL THEN 'documents' ELSE 'unknown' END AS source,
  CASE WHEN field = 'title' THEN 0.5::DOUBLE WHEN field = 'cuisine_tags' AND lang IS NOT NULL THEN 0.3 ELSE 0 END AS confidence
FROM documents, (SELECT unnest([{', '.join(f"'{x}'" for x in quality.SEEDED)}]) AS field)"""


def tier_distribution(spark, sf_dir):
    n = tiered(spark, sf_dir).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    return n.select("tier", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2).alias("percent"))  # a row a tier


TIER_DISTRIBUTION = f"WITH {TIERED} SELECT CAST(tier AS INT) AS tier, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM r GROUP BY tier"


def flag_coverage(spark, sf_dir):
    return tiered(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.coalesce(F.col(k), F.lit(False))).alias(k) for k in FLAG_NAMES])


FLAG_COVERAGE = f"WITH {TIERED} SELECT source, count(*) AS n, {', '.join(f'count(*) FILTER ({k}) AS {k}' for k in FLAG_NAMES)} FROM r GROUP BY source"


def blocker_top20(spark, sf_dir):
    keys = FLAG_NAMES[:2] + FLAG_NAMES[3:4]
    n = tiered(spark, sf_dir).where("tier = 2").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.col("n").desc(), *keys).limit(20)


BLOCKER_TOP20 = f"WITH {TIERED} SELECT has_real_description, has_cuisine_tag, has_dietary_flags, count(*) AS n FROM r WHERE tier = 2 GROUP BY ALL ORDER BY n DESC, 1 NULLS FIRST, 2, 3 NULLS FIRST LIMIT 20"


def work_queues(spark, sf_dir):
    """How many documents wait in each queue, and the head of the enrichment queue by promotion score."""
    d = tiered(spark, sf_dir)
    head = d.where((F.col("tier") > 0) & ~F.coalesce("has_llm_flavor_tags", F.lit(False)))
    return head.orderBy(F.col("promotion_score").desc(), F.size("terms").desc(), "doc_id").limit(100).select("doc_id", F.col("promotion_score").cast("int").alias("promotion_score"))


WORK_QUEUES = f"WITH {TIERED} SELECT doc_id, CAST(promotion_score AS INT) AS promotion_score FROM r WHERE tier > 0 AND NOT coalesce(has_llm_flavor_tags, false) ORDER BY promotion_score DESC, n DESC, doc_id LIMIT 100"

FIRST_RULES = [("jewelry", ["ring", "chain"]), ("tool", ["bolt", "gear", "nut"]), ("part", ["widget", "gadget", "valve", "pipe"])]
LONGEST_RULES = [("small", "Size"), ("red", "Colour"), ("small ring", "Band"), ("ring", "Jewel"), ("blue", "Colour"), ("widget", "Device"), ("large bolt", "Shadow"), ("bolt", "Fastener")]
VOCABULARY = ("Size", "Colour", "Jewel", "Device", "Fastener", "Band")
WEIGHTED = {"Shape": {"ring": 2.0, "small": 1.5, "large": 1.5, "bolt": 2.0}, "Colour": {"red": 3.0, "blue": 3.0, "green": 3.0}, "Device": {"widget": 2.5, "gadget": 2.5, "small": 0.5}}
TITLE_WORDS = {"Jewel": ["ring"], "Device": ["widget", "gadget"]}
TERM_WORDS = {"Colour": ["red", "blue"], "Device": ["small"], "Jewel": ["large"]}
COUNTED = {"Warm": ["red", "orange", "small"], "Cold": ["blue", "green", "ring"]}


def _case(conditions: list[tuple[str, str]], default: str = "NULL") -> str:
    return f"CASE {' '.join(f'WHEN {c} THEN {v}' for c, v in conditions)} ELSE {default} END"


def _has(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def keyword_class(spark, sf_dir):
    """One class for each way of matching keywords in part names."""
    p = table(spark, sf_dir, "part")
    name, terms = F.col("p_name"), F.split("p_name", " ")
    return p.select(
        "p_partkey",
        classify.first_rule(name, FIRST_RULES).alias("first_match"),
        classify.longest_keyword(name, LONGEST_RULES, VOCABULARY).alias("longest_match"),
        classify.weighted_terms(terms, WEIGHTED).alias("weighted"),
        classify.title_and_terms(name, terms, TITLE_WORDS, TERM_WORDS).alias("title_and_terms"),
        classify.keyword_count(name, terms, COUNTED).alias("keyword_count"),
        classify.has_keyword(name, ["small", "large"]).alias("sized"),
        classify.normalised_label(F.col("p_type"), ["Economy", "Standard"], {"promo": "Promotion", "large": "Standard"}).alias("label"),
    )


def _weighted_sql() -> str:
    scores = {k: " + ".join(f"CASE WHEN list_contains(terms, '{w}') THEN {x} ELSE 0 END" for w, x in v.items()) for k, v in WEIGHTED.items()}
    top = f"greatest({', '.join(scores.values())})"
    return _case([(f"{top} < 3", "NULL"), *[(f"{s} = {top}", f"'{k}'") for k, s in scores.items()]])


def _title_terms_sql() -> str:
    labels = [*TITLE_WORDS, *[k for k in TERM_WORDS if k not in TITLE_WORDS]]
    part = lambda words, k: " + ".join(f"CASE WHEN contains(name, '{w}') THEN {k} ELSE 0 END" for w in words) or "0"
    scores = {k: f"({part(TITLE_WORDS.get(k, []), 3)} + {part(TERM_WORDS.get(k, []), 1)})" for k in labels}
    top = f"greatest({', '.join(scores.values())})"
    titled = [(f"{_has('name', TITLE_WORDS[k])} AND {scores[k]} = {top}", f"'{k}'") for k in TITLE_WORDS]
    return _case([(f"{top} < 2", "'Other'"), *titled, *[(f"{s} = {top}", f"'{k}'") for k, s in scores.items()]])


def _count_sql() -> str:
    scores = {k: " + ".join(f"CAST(contains(name, '{w}') AS INT)" for w in v) for k, v in COUNTED.items()}
    top = f"greatest({', '.join(scores.values())})"
    return _case([(f"{top} < 1", "'Unknown'"), *[(f"{s} = {top}", f"'{k}'") for k, s in scores.items()]])


_WORD = "(^|[^a-z]){}(e?s)?($|[^a-z])"
KEYWORD_CLASS = f"""WITH q AS (SELECT *, lower(p_name) AS name, string_split(lower(p_name), ' ') AS terms FROM part)
SELECT p_partkey, {_case([(_has('name', w), f"'{k}'") for k, w in FIRST_RULES], "'other'")} AS first_match,
  {_case([(f"regexp_matches(name, '{_WORD.format(w)}')", f"'{k}'" if k in VOCABULARY else 'NULL') for w, k in sorted(LONGEST_RULES, key=lambda r: -len(r[0]))])} AS longest_match,
  {_weighted_sql()} AS weighted, {_title_terms_sql()} AS title_and_terms, {_count_sql()} AS keyword_count,
  regexp_matches(name, '{_WORD.format('(small|large)')}') AS sized,
  CASE lower(trim(p_type, ' ')) WHEN 'economy' THEN 'Economy' WHEN 'standard' THEN 'Standard' WHEN 'promo' THEN 'Promotion' WHEN 'large' THEN 'Standard' ELSE 'Other' END AS label FROM q"""

TAGS = {"is_vegan": "vegan", "is_vegetarian": "vegetarian", "is_dairy_free": "dairy-free", "is_nut_free": "nut-free"}


# Terms that reach every category: words of the lists, some with more letters around them, and words of none.
FLAG_WORDS = [*dict.fromkeys(w for words in flags.CATEGORIES.values() for w in words), "rice", "carrot", "nutmeg", "hamlet", "ginger", "portobello", "eggplant", "butternut"]


def _flag_query(make):
    def query(spark, sf_dir):
        words = F.array(*[F.lit(w) for w in FLAG_WORDS])
        word = lambda by, off=0: F.element_at(words, ((F.col("doc_id") * by + off) % len(FLAG_WORDS) + 1).cast("int"))
        none = F.array().cast("array<string>")
        terms = F.when(F.col("doc_id") % 10 == 0, none).when(F.col("doc_id") % 3 == 0, F.array(word(1), F.lit("rice"))).otherwise(F.array(word(1), F.concat(F.lit("fresh "), word(7, 3)), F.concat(F.lit("xx"), word(13, 5))))
        d = table(spark, sf_dir, "documents").select("doc_id", terms.alias("terms"), F.concat(word(5, 1), F.lit(" Bowl")).alias("title"))
        d = d.withColumn("f", make(F.col("terms"), F.col("title")))
        return d.select("doc_id", "f.*", F.array_join(flags.tags(F.col("f"), TAGS), ",").alias("tags"))

    return query


def _flag_sql(hit, positive: str = "true", swappable: str | None = None) -> str:
    h = {k: f"({hit(v)})" for k, v in flags.CATEGORIES.items()}
    flesh = f"({h['meat']} OR {h['poultry']})"
    vegetarian = f"NOT ({flesh} OR {h['fish']} OR {h['shellfish']})"
    vegan = f"({vegetarian} AND NOT {h['dairy']} AND NOT {h['egg']} AND NOT {h['honey']})"
    out = {
        "is_vegetarian": vegetarian, "is_vegan": vegan, "is_pescatarian_ok": f"NOT {flesh}", "is_dairy_free": f"NOT {h['dairy']}", "is_gluten_free": f"NOT {h['gluten']}", "is_nut_free": f"NOT {h['nut']}",
        "is_halal_ok": f"NOT {h['pork']} AND NOT {h['alcohol']}", "vegan_if_substituted": f"{vegetarian} AND NOT {vegan}", "gluten_free_if_substituted": f"{h['gluten']} AND {swappable or h['swappable']}",
    }
    out = {k: f"({positive} AND {v})" for k, v in out.items()} | {"contains_pork": h["pork"], "contains_shellfish": h["shellfish"], "contains_alcohol": h["alcohol"]}
    words = "[" + ", ".join(f"'{w}'" for w in FLAG_WORDS) + "]"
    word = lambda by, off=0: f"w[(doc_id * {by} + {off}) % {len(FLAG_WORDS)} + 1]"
    return f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN [] WHEN doc_id % 3 = 0 THEN [{word(1)}, 'rice'] ELSE [{word(1)}, 'fresh ' || {word(7, 3)}, 'xx' || {word(13, 5)}] END AS terms,
  {word(5, 1)} || ' Bowl' AS title FROM documents, (SELECT {words} AS w)),
b AS (SELECT *, lower(array_to_string(terms, ' ') || ' ' || title) AS all_text FROM d),
f AS (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in out.items())} FROM b)
SELECT *, array_to_string(list_filter([{', '.join(f"CASE WHEN {k} THEN '{t}' END" for k, t in TAGS.items())}], lambda x: x IS NOT NULL), ',') AS tags FROM f"""


_EDGE = "[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}]"


def _word_sql(x: str, words: list[str]) -> str:
    return f"regexp_matches({x}, '(^|{_EDGE})(?:{text.escaped(words)})($|{_EDGE})')"


def _terms_sql(has) -> str:
    c = flags.CATEGORIES
    every = f"len(list_filter(terms, lambda x: {has('x', c['gluten'])} AND NOT {has('x', c['swappable'])})) = 0"
    return _flag_sql(lambda w: f"len(list_filter(terms, lambda x: {has('x', w)})) > 0", swappable=every)


FLAGS_WORD = _terms_sql(_word_sql)
FLAGS_SUBSTRING = _terms_sql(_has)
FLAGS_MIXED = _flag_sql(lambda w: " OR ".join([f"{_word_sql('all_text', [x for x in w if ' ' not in x])}", *[f"contains(all_text, '{x}')" for x in w if " " in x]]), "len(terms) > 0")


def _own_flags(words: dict, make):
    """Terms and titles drawn from the words of a rule set; the flags that it makes of them."""
    known = [*dict.fromkeys(w for ws in words.values() for w in ws), "rice", "graham", "coconut", "eggnog", "hamlet", "prawn toast", "pale ale"]

    def query(spark, sf_dir):
        drawn = F.array(*[F.lit(w) for w in known])
        word = lambda by, off=0: F.element_at(drawn, ((F.col("n_chars") * by + F.col("doc_id") + off) % len(known) + 1).cast("int"))
        terms = F.when(F.col("doc_id") % 10 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 3 == 0, F.array(word(1), F.lit("Rice"))).otherwise(F.array(word(1), F.concat(F.lit("fresh "), word(7, 3)), F.concat(F.lit("xx"), word(13, 5))))
        d = table(spark, sf_dir, "documents").where("n_chars IS NOT NULL").select("doc_id", terms.alias("terms"), F.concat(word(5, 1), F.lit(" Bowl")).alias("title"))
        return d.select("doc_id", make(F.col("terms"), F.col("title")).alias("f")).select("doc_id", "f.*")

    word = lambda by, off=0: f"w[(n_chars * {by} + doc_id + {off}) % {len(known)} + 1]"
    sql = f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN [] WHEN doc_id % 3 = 0 THEN [{word(1)}, 'Rice'] ELSE [{word(1)}, 'fresh ' || {word(7, 3)}, 'xx' || {word(13, 5)}] END AS terms,
  {word(5, 1)} || ' Bowl' AS title FROM documents, (SELECT [{", ".join(f"'{w}'" for w in known)}] AS w) WHERE n_chars IS NOT NULL),
b AS (SELECT *, lower(array_to_string(terms, ' ') || ' ' || title) AS all_text FROM d)"""
    return query, sql


flag_inference_seven, _SEVEN = _own_flags(flags.SEVEN, flags.seven)
flag_inference_ten, _TEN = _own_flags(flags.TEN, lambda terms, title: flags.ten(terms))
_s = {k: f"({' OR '.join([_word_sql('all_text', [x for x in w if ' ' not in x]), *[f"contains(all_text, '{x}')" for x in w if ' ' in x]])})" for k, w in flags.SEVEN.items()}
_t = {k: f"len(list_filter(terms, lambda x: {' OR '.join(f"contains(lower(x), '{x}')" for x in w)})) > 0" for k, w in flags.TEN.items()}
FLAGS_SEVEN = f"""{_SEVEN}, f AS (SELECT doc_id, len(terms) > 0 AS named, {', '.join(f'{v} AS {k}' for k, v in _s.items())} FROM b)
SELECT doc_id, named AND NOT meat AND NOT seafood AS is_vegetarian, named AND NOT meat AND NOT seafood AND NOT dairy AND NOT egg AS is_vegan, named AND NOT gluten AS is_gluten_free, named AND NOT dairy AS is_dairy_free,
  named AND NOT nut AS is_nut_free, shellfish AS contains_shellfish, nut AS contains_nuts FROM f"""
FLAGS_TEN = f"""{_TEN}, f AS (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _t.items())} FROM b)
SELECT doc_id, NOT meat AND NOT fish AND NOT dairy AND NOT egg AS is_vegan, NOT meat AND NOT fish AS is_vegetarian, NOT meat AS is_pescatarian_ok, NOT dairy AS is_dairy_free, NOT gluten AS is_gluten_free,
  NOT nut AS is_nut_free, NOT pork AND NOT alcohol AS is_halal_ok, pork AS contains_pork, shellfish AS contains_shellfish, alcohol AS contains_alcohol FROM f"""


def parse_quantity(spark, sf_dir):
    """Measures such as ``3/4 kg`` made from parts, read back as amounts and grams, and names by synonym."""
    p = table(spark, sf_dir, "part")
    units = F.array(*[F.lit(u) for u in [*numeric.UNIT_GRAMS, "sack", ""]])
    size = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws("/", F.col("p_size").cast("string"), (F.col("p_partkey") % 4).cast("string"))).otherwise(F.col("p_size").cast("string"))
    unit = F.get(units, (F.col("p_partkey") % 13).cast("int"))
    measure = F.when(F.col("p_partkey") % 11 == 0, F.lit("to taste")).otherwise(F.concat_ws(" ", size, unit))
    names = F.array(*[F.lit(n) for n in numeric.BRITISH_TO_AMERICAN.values()])
    d = p.select("p_partkey", measure.alias("measure"), F.get(names, (F.col("p_partkey") % len(numeric.BRITISH_TO_AMERICAN)).cast("int")).alias("name"))
    d = d.withColumn("m", numeric.parse_measure(F.col("measure")))
    grams = F.round(F.col("m.amount") * numeric.unit_to_grams(F.col("m.unit")), 4)
    return d.select("p_partkey", "measure", F.round("m.amount", 6).alias("amount"), "m.unit", grams.alias("grams"), numeric.synonym(F.col("name")).alias("synonym"))


_UNITS = [*numeric.UNIT_GRAMS, "sack", ""]
PARSE_QUANTITY = f"""WITH q AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'to taste' ELSE
    (CASE WHEN p_partkey % 3 = 0 THEN p_size || '/' || p_partkey % 4 ELSE CAST(p_size AS VARCHAR) END) || ' ' || [{', '.join(f"'{u}'" for u in _UNITS)}][p_partkey % 13 + 1] END AS measure,
    [{', '.join("'" + n + "'" for n in numeric.BRITISH_TO_AMERICAN.values())}][p_partkey % {len(numeric.BRITISH_TO_AMERICAN)} + 1] AS name FROM part),
r AS (SELECT *, regexp_extract(trim(measure, ' '), '^([0-9./]+)[ ]*(.*)', 1) AS num, CASE WHEN regexp_matches(trim(measure, ' '), '^[0-9./]') THEN lower(regexp_extract(trim(measure, ' '), '^([0-9./]+)[ ]*(.*)', 2)) ELSE lower(trim(measure, ' ')) END AS u FROM q),
v AS (SELECT *, CASE WHEN contains(num, '/') THEN TRY_CAST(string_split(num, '/')[1] AS DOUBLE) / nullif(TRY_CAST(string_split(num, '/')[2] AS DOUBLE), 0) ELSE TRY_CAST(num AS DOUBLE) END AS value FROM r),
w AS (SELECT *, coalesce(value, 1) AS amount, CASE WHEN u <> '' THEN u ELSE 'piece' END AS unit FROM v)
SELECT p_partkey, measure, round(amount, 6) AS amount, unit,
  round(amount * CASE unit {' '.join(f"WHEN '{k}' THEN {g}" for k, g in numeric.UNIT_GRAMS.items())} ELSE 100 END, 4) AS grams,
  CASE name {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in numeric.SYNONYMS.items())} ELSE name END AS synonym FROM w"""


def embedding_text(spark, sf_dir):
    """The text that a document is embedded by, labelled and plain, as digests of the whole."""
    d = catalogue(spark, sf_dir)
    plain = text.join_non_empty(" ", F.col("title"), F.array_join("steps", " "), F.array_join("terms", " "), F.col("lang"), F.col("source"))
    labelled = text.join_non_empty(" | ", F.col("title"), F.concat(F.lit("Language: "), F.col("lang")), F.concat(F.lit("Terms: "), F.array_join(F.slice("terms", 1, 20), ", ")))
    return d.select("doc_id", F.md5(plain).alias("plain_md5"), labelled.alias("labelled"), F.array_join(text.ensure_list(F.concat_ws(",", "lang", "source")), ";").alias("tags"))


EMBEDDING_TEXT = f"""WITH {CATALOGUE} SELECT doc_id,
  md5(array_to_string(list_filter([title, array_to_string(steps, ' '), array_to_string(terms, ' '), lang, source], lambda x: x IS NOT NULL AND x <> ''), ' ')) AS plain_md5,
  array_to_string(list_filter([title, 'Language: ' || lang, 'Terms: ' || array_to_string(terms[1:20], ', ')], lambda x: x IS NOT NULL AND x <> ''), ' | ') AS labelled,
  array_to_string(list_filter([trim(lang, ' '), trim(source, ' ')], lambda x: x IS NOT NULL AND x <> ''), ';') AS tags FROM d"""

QUERIES = {
    "title_normalized": (title_normalized, TITLE_NORMALIZED),
    "dedup_keep_first": (dedup_keep_first, DEDUP_KEEP_FIRST),
    "raw_quality_filter": (raw_quality_filter, RAW_QUALITY_FILTER),
    "first_failing_filter": (first_failing_filter, FIRST_FAILING_FILTER),
    "quality_score": (quality_score, QUALITY_SCORE),
    "tier_assign": (tier_assign, TIER_ASSIGN),
    "change_detect": (change_detect, CHANGE_DETECT),
    "provenance_seed": (provenance_seed, PROVENANCE_SEED),
    "tier_distribution": (tier_distribution, TIER_DISTRIBUTION),
    "flag_coverage": (flag_coverage, FLAG_COVERAGE),
    "blocker_top20": (blocker_top20, BLOCKER_TOP20),
    "enrichment_queue": (work_queues, WORK_QUEUES),
    "keyword_class": (keyword_class, KEYWORD_CLASS),
    "flag_inference_word": (_flag_query(lambda terms, title: flags.by_word(terms)), FLAGS_WORD),
    "flag_inference_mixed": (_flag_query(flags.mixed), FLAGS_MIXED),
    "flag_inference_seven": (flag_inference_seven, FLAGS_SEVEN),
    "flag_inference_ten": (flag_inference_ten, FLAGS_TEN),
    "flag_inference_substring": (_flag_query(lambda terms, title: flags.by_substring(terms)), FLAGS_SUBSTRING),
    "parse_quantity": (parse_quantity, PARSE_QUANTITY),
    "embedding_text": (embedding_text, EMBEDDING_TEXT),
}
