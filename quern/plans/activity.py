"""Queries: conversations, events, reports over numbers, and ranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import numeric
from quern.operators import dedup, flags, ranking
from quern.plans.catalogue import CATALOGUE, catalogue
from quern.sources.tables import table


def first_message_per_session(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    first = dedup.top_per_group(turns.where("role = 'user'"), ["conv_id"], [F.col("turn")], 1).select("conv_id", F.col("text").alias("first_text"))
    return turns.select("conv_id").distinct().join(first, "conv_id", "left").withColumn("first_text", F.coalesce("first_text", F.lit("")))


FIRST_MESSAGE = """SELECT c.conv_id, coalesce(f.text, '') AS first_text FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN (SELECT * FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1) f USING (conv_id)"""


def session_query_count(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("query_count"), F.count(F.lit(1)).alias("messages"), F.max("turn").alias("last_turn"))


def oldest_n_messages(spark, sf_dir):
    return dedup.top_per_group(table(spark, sf_dir, "conversations"), ["conv_id"], [F.col("turn"), F.col("role"), F.col("text")], 3).select("conv_id", "turn", "role", "rank_in_group")


def latest_feedback(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(200).select("event_id", "user_id", "event_type", "value")


def feedback_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("int"))
    return e.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean_value"), F.min("value").alias("least"), F.max("value").alias("most"),
        F.countDistinct("user_id").alias("users"), F.sum("k").alias("sum_k"), F.count("k").alias("with_k"),
    )


def trending_window(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("value"))
    return n.select(F.unix_timestamp("w.start").alias("start_s"), "event_type", "n", "value")


def session_window(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"), F.sum("n").alias("events"))


SESSION_WINDOW = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), n AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL)
SELECT user_id, count(*) AS sessions, max(n) AS longest, CAST(sum(n) AS BIGINT) AS events FROM n GROUP BY user_id"""


def user_export(spark, sf_dir):
    """Every customer with their orders as one ordered list."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"), F.count(F.lit(1)).alias("n"))
    both = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return both.select("c_custkey", "c_name", F.coalesce(F.array_join("keys", ","), F.lit("")).alias("orders"), F.coalesce("n", F.lit(0)).alias("n_orders"))


USER_EXPORT = """SELECT c_custkey, c_name, coalesce(keys, '') AS orders, coalesce(n, 0) AS n_orders FROM customer
LEFT JOIN (SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS keys, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey"""


def label_distribution(spark, sf_dir):
    n = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return n.select("lang", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2).alias("percent"), F.coalesce(F.col("lang").isin("en", "de", "fr"), F.lit(False)).alias("in_vocabulary"))


def nutrition_stats(spark, sf_dir):
    """Least, greatest, mean and count of three numeric fields of order lines, a row each."""
    li = table(spark, sf_dir, "lineitem").select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in ("l_quantity", "l_discount", "l_tax")])).alias("x")).select("x.*")
    return li.groupBy("field").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.round(F.avg("v"), 2).alias("mean"), F.count("v").alias("n"))


def macro_outliers(spark, sf_dir):
    """Order lines whose price is over a fifth away from what their part's price and quantity give."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    estimate = F.col("l_quantity") * F.col("p_retailprice")
    off = F.round(F.abs(F.col("l_extendedprice") - estimate) / estimate * 100, 4)
    both = li.join(p, F.col("l_partkey") == F.col("p_partkey")).where(estimate > 0).withColumn("off", off).where("off > 20")
    return both.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("off"), 2).alias("mean_off"))


def completeness(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    known = sum((F.col(c).isNotNull().cast("int") for c in ("lang", "source", "quality", "toxic")), F.lit(0))
    bucket = F.when(known == 0, "none").when(known == 4, "full").otherwise("partial")
    coverage = F.round(F.coalesce(F.try_divide(F.count("quality") * 100.0, F.count(F.lit(1))), F.lit(0.0)), 2)
    return d.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), coverage.alias("coverage"))


def counts_by_dimension(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in ("p_brand", "p_type", "p_size")])
    n = p.select(F.explode(pairs).alias("x")).groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n"))
    return dedup.top_per_group(n, ["dimension"], [F.col("n").desc(), F.col("value")], 12).select("dimension", "value", "n", "rank_in_group")


def remaining_need(spark, sf_dir):
    targets = spark.createDataFrame([("en", 500), ("de", 200), ("it", 50)], "lang string, target int")
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return targets.join(counts, "lang", "left").select("lang", F.greatest(F.lit(0), F.col("target") - F.coalesce("n", F.lit(0))).alias("need"))


def fuzzy_lookup(spark, sf_dir):
    """Each distinct part name by the best of a few known names: exact, then prefix, then edit distance over sorted words."""
    known = F.array(*[F.struct(F.lit(name).alias("known"), F.lit(i).alias("rank")) for i, name in enumerate(("small ring", "red widget", "blue bolt", "large", "gear green"))])
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    words = lambda c: F.array_join(F.array_sort(F.split(c, " ")), " ")
    a, b = words(F.col("p_name")), words(F.col("known"))
    ratio = F.round(100.0 * (1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))), 2)
    rule = F.when(F.col("p_name") == F.col("known"), 1).when(F.col("p_name").startswith(F.col("known")), 2).when(ratio >= 70, 3)
    tried = names.select("p_name", F.explode(known).alias("k")).select("p_name", "k.*")
    scored = tried.withColumn("rule", rule).withColumn("ratio", ratio).where("rule IS NOT NULL")
    return dedup.top_per_group(scored, ["p_name"], [F.col("rule"), F.col("ratio").desc(), F.col("rank")], 1).select("p_name", "known", "rule", "ratio")


_SORTED = "array_to_string(list_sort(string_split({}, ' ')), ' ')"
FUZZY = f"""WITH k(known, rank) AS (VALUES ('small ring', 1), ('red widget', 2), ('blue bolt', 3), ('large', 4), ('gear green', 5)),
n AS (SELECT DISTINCT p_name, known, rank, {_SORTED.format('p_name')} AS a, {_SORTED.format('known')} AS b FROM part, k),
r AS (SELECT *, round(100 * (1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE), 2) AS ratio FROM n),
s AS (SELECT *, CASE WHEN p_name = known THEN 1 WHEN starts_with(p_name, known) THEN 2 WHEN ratio >= 70 THEN 3 END AS rule FROM r)
SELECT p_name, known, rule, ratio FROM s WHERE rule IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY rule, ratio DESC, rank) = 1"""

PROFILE = {"affinities": [("en", "like"), ("fr", "love"), ("es", "never")], "spectrum": "vegetarian", "restrictions": ["nut allergy"], "flavors": {"the": 0.9, "of": 0.4, "de": 0.1}, "skill": 2}


def _ranked(spark, sf_dir):
    """Overlap and diet ask only whether some term matches, so they take the distinct ones, and two flags are made of twelve."""
    d = catalogue(spark, sf_dir).withColumn("names", F.array_distinct("terms")).withColumn("tags", F.array_compact(F.array("lang")))
    d = d.withColumn("f", flags.by_substring(F.col("names"), only=("is_vegetarian", "is_nut_free")))
    return d.withColumn("difficulty", F.when(F.col("n_chars") % 7 > 0, (F.col("n_chars") % 5 + 1).cast("int")))


_RANKED = f"""{CATALOGUE}, b AS (SELECT *, CASE WHEN lang IS NULL THEN [] ELSE [lang] END AS tags, CASE WHEN n_chars % 7 > 0 THEN CAST(n_chars % 5 + 1 AS INT) END AS difficulty,
  len(list_filter(terms, lambda x: {' OR '.join(f"contains(x, '{w}')" for k in ('meat', 'poultry', 'fish', 'shellfish') for w in flags.CATEGORIES[k])})) = 0 AS is_vegetarian,
  len(list_filter(terms, lambda x: {' OR '.join(f"contains(x, '{w}')" for w in flags.CATEGORIES['nut'])})) = 0 AS is_nut_free FROM d)"""


def rank_composite(spark, sf_dir):
    d, f = _ranked(spark, sf_dir), {"is_vegetarian": F.col("f.is_vegetarian")}
    factors = {
        "ingredient_overlap": ranking.ingredient_overlap(F.col("names"), ["the", "que", "und"], ["ham"]),
        "dietary_compliance": ranking.dietary_compliance(F.col("names"), f, ["rum"], ["egg", "the"], "vegetarian"),
        "cuisine_affinity": ranking.cuisine_affinity(F.col("tags"), PROFILE["affinities"]),
        "difficulty_match": ranking.difficulty_match(F.col("difficulty"), "home_cook"),
        "time_fit": ranking.time_fit(F.col("n_chars"), 2000),
        "flavor_affinity": ranking.flavor_affinity(F.col("terms"), PROFILE["flavors"]),
        "novelty_bonus": ranking.novelty_bonus(F.col("tags"), ["en", "de"], 6.0),
    }
    scored = d.select("doc_id", ranking.composite(factors).alias("score"))
    best = scored.select("doc_id", F.round("score", 4).alias("match_score"), ranking.match_tier(F.round("score", 9)).alias("match_tier"))
    return best.orderBy(F.col("match_score").desc(), "doc_id").limit(50)


RANK = f"""WITH {_RANKED}, n AS (SELECT *, list_filter(terms, lambda x: trim(x, ' ') <> '') AS names FROM b),
s AS (SELECT doc_id, 0.30::DOUBLE * CASE WHEN len(names) = 0 THEN 0.3 WHEN x > 0 THEN greatest(0, hits - 0.5) ELSE hits END
  + 0.25::DOUBLE * CASE WHEN rum > 0 OR NOT is_vegetarian THEN 0 ELSE greatest(0, 1 - CASE WHEN egg > 0 THEN 0.3 ELSE 0 END - CASE WHEN the > 0 THEN 0.3 ELSE 0 END) END
  + 0.15::DOUBLE * CASE lang WHEN 'en' THEN 0.75 WHEN 'fr' THEN 1 WHEN 'es' THEN 0 ELSE 0.5 END
  + 0.10::DOUBLE * CASE WHEN difficulty IS NULL THEN 0.5 WHEN difficulty <= 2 THEN 1 - (2 - difficulty) * 0.1 ELSE greatest(0, 1 - (difficulty - 2) * 0.35) END
  + 0.10::DOUBLE * CASE WHEN n_chars IS NULL THEN 0.5 WHEN n_chars <= 2000 THEN 0.7 + 0.3 * n_chars / 2000 ELSE greatest(0, 1 - (n_chars - 2000) / 2000 * 0.8) END
  + 0.05::DOUBLE * coalesce(flavor, 0.5) + 0.05::DOUBLE * CASE WHEN lang IS NULL THEN 0.5 WHEN lang IN ('en', 'de') THEN 0.6 ELSE 0.8 END AS score
 FROM (SELECT *, len(list_filter(names, lambda n: contains(n, 'ham') OR contains('ham', n))) AS x, len(list_filter(names, lambda n: contains(n, 'rum'))) AS rum,
  len(list_filter(names, lambda n: contains(n, 'egg'))) AS egg, len(list_filter(names, lambda n: contains(n, 'the'))) AS the,
  ({' + '.join(f"CAST(len(list_filter(names, lambda n: contains(n, '{w}') OR contains('{w}', n))) > 0 AS INT)" for w in ('the', 'que', 'und'))}) / 3.0::DOUBLE AS hits,
  list_avg(list_filter(list_transform(names, lambda n: CASE n WHEN 'the' THEN 1.0::DOUBLE WHEN 'of' THEN 0.4 WHEN 'de' THEN 0 END), lambda v: v IS NOT NULL)) AS flavor FROM n))
SELECT doc_id, round(score, 4) AS match_score, CASE WHEN round(score, 9) >= 0.8 THEN 'full_match' WHEN round(score, 9) >= 0.5 THEN 'close_match' ELSE 'stretch_pick' END AS match_tier
FROM s ORDER BY match_score DESC, doc_id LIMIT 50"""


def client_score(spark, sf_dir):
    d, f = _ranked(spark, sf_dir), {k: F.col(f"f.{k}") for k in ("is_vegetarian", "is_nut_free")}
    score = ranking.client_score(F.col("tags"), f, F.col("terms"), F.col("difficulty"), F.array_compact(F.array("source")), PROFILE, "src1")
    return d.select("doc_id", score.alias("score"), numeric.season((F.col("doc_id") % 12 + 1).cast("int")).alias("season"), numeric.daypart((F.col("doc_id") % 24).cast("int")).alias("daypart"))


CLIENT = f"""WITH {_RANKED} SELECT doc_id, CAST(least(100, greatest(0, floor(CASE WHEN lang IS NULL THEN 12.25 WHEN lang = 'fr' THEN 35 WHEN lang = 'en' THEN floor(0.7::DOUBLE * 35 + 0.5) ELSE 12 END
  + greatest(0, CASE WHEN is_vegetarian THEN 25 ELSE 0 END - CASE WHEN is_nut_free THEN 0 ELSE 15 END)
  + coalesce(floor(list_sum(list_transform(terms, lambda t: CASE t WHEN 'the' THEN 0.9::DOUBLE WHEN 'of' THEN 0.4 WHEN 'de' THEN 0.1 ELSE 0 END)) / nullif(len(terms), 0) * 20 + 0.5), 0)
  + CASE WHEN coalesce(difficulty, 1) <= 2 THEN 10 WHEN difficulty = 3 THEN 6 ELSE 2 END
  + CASE WHEN source IS NULL THEN 5 WHEN contains(source, 'src1') THEN 10 ELSE 2 END + 0.5))) AS INT) AS score,
  CASE WHEN doc_id % 12 + 1 BETWEEN 3 AND 5 THEN 'spring' WHEN doc_id % 12 + 1 BETWEEN 6 AND 8 THEN 'summer' WHEN doc_id % 12 + 1 BETWEEN 9 AND 11 THEN 'autumn' ELSE 'winter' END AS season,
  CASE WHEN doc_id % 24 BETWEEN 5 AND 9 THEN 'breakfast' WHEN doc_id % 24 BETWEEN 11 AND 13 THEN 'lunch' WHEN doc_id % 24 BETWEEN 17 AND 21 THEN 'dinner' END AS daypart FROM b"""

QUERIES = {
    "first_message_per_session": (first_message_per_session, FIRST_MESSAGE),
    "session_query_count": (session_query_count, "SELECT conv_id, count(*) FILTER (role = 'user') AS query_count, count(*) AS messages, max(turn) AS last_turn FROM conversations GROUP BY conv_id"),
    "oldest_n_messages": (oldest_n_messages, "SELECT conv_id, turn, role, CAST(n AS INT) AS rank_in_group FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations) WHERE n <= 3"),
    "latest_feedback": (latest_feedback, "SELECT event_id, user_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 200"),
    "feedback_summary": (feedback_summary, "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean_value, min(value) AS least, max(value) AS most, count(DISTINCT user_id) AS users, CAST(sum(CAST(props ->> '$.k' AS INT)) AS BIGINT) AS sum_k, count(props ->> '$.k') AS with_k FROM events GROUP BY event_type"),
    "trending_window": (trending_window, "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start_s, event_type, count(*) AS n, round(sum(value), 3) AS value FROM events GROUP BY 1, 2"),
    "session_window": (session_window, SESSION_WINDOW),
    "user_export": (user_export, USER_EXPORT),
    "label_distribution": (label_distribution, "SELECT lang, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent, coalesce(lang IN ('en', 'de', 'fr'), false) AS in_vocabulary FROM documents GROUP BY lang"),
    "nutrition_stats": (nutrition_stats, " UNION ALL ".join(f"SELECT '{c}' AS field, min({c}) AS least, max({c}) AS most, round(avg({c}), 2) AS mean, count({c}) AS n FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax"))),
    "macro_outliers": (macro_outliers, "SELECT l_returnflag, count(*) AS n, round(avg(off), 2) AS mean_off FROM (SELECT l_returnflag, round(abs(l_extendedprice - l_quantity * p_retailprice) / (l_quantity * p_retailprice) * 100, 4) AS off FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity * p_retailprice > 0) WHERE off > 20 GROUP BY l_returnflag"),
    "completeness": (completeness, "SELECT CASE k WHEN 0 THEN 'none' WHEN 4 THEN 'full' ELSE 'partial' END AS bucket, count(*) AS n, round(count(quality) * 100.0::DOUBLE / count(*), 2) AS coverage FROM (SELECT *, (lang IS NOT NULL)::INT + (source IS NOT NULL)::INT + (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT AS k FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1"),
    "counts_by_dimension": (counts_by_dimension, "WITH n AS (SELECT 'p_brand' AS dimension, p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2 UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY 2) SELECT *, CAST(row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value) AS INT) AS rank_in_group FROM n QUALIFY rank_in_group <= 12"),
    "remaining_need": (remaining_need, "SELECT lang, greatest(0, target - (SELECT count(*) FROM documents d WHERE d.lang = t.lang)) AS need FROM (VALUES ('en', 500), ('de', 200), ('it', 50)) t(lang, target)"),
    "fuzzy_lookup": (fuzzy_lookup, FUZZY),
    "rank_composite": (rank_composite, RANK),
    "client_score": (client_score, CLIENT),
}
