"""Queries: vector and geographic search, pages, samples, lookups and whole-table changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import filters, retrieval
from quern.sources import tables
from quern.sources.tables import table


def _query_vector(vectors) -> list[float]:
    """The vector with id 0: one row."""
    row = vectors.where("vec_id = 0").select("embedding").first()
    return [] if row is None else list(row["embedding"])


_SIM = """q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, round(CASE WHEN list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) = 0 OR list_dot_product(v, v) = 0 THEN 0
  ELSE list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) END, 6) AS similarity FROM embeddings, q)"""


def vector_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    hits = retrieval.vector_top_k(vectors, _query_vector(vectors), 20)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return retrieval.with_documents(hits, docs).select("vec_id", "similarity", "retrieval_rank", "lang", "source")


VECTOR_TOPK = f"""WITH {_SIM}, k AS (SELECT *, CAST(row_number() OVER (ORDER BY similarity DESC, vec_id) AS INT) AS retrieval_rank FROM s ORDER BY similarity DESC, vec_id LIMIT 20)
SELECT vec_id, similarity, retrieval_rank, lang, source FROM k JOIN documents ON doc_id = vec_id"""


def _filtered(nulls: str):
    def query(spark, sf_dir):
        vectors = table(spark, sf_dir, "embeddings")
        docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
        keep = filters.dietary_flag(F.col("quality") == 1, True, nulls) & filters.dietary_flag(F.col("toxic") == 1, False, nulls) & filters.max_time(F.col("n_chars"), 2500, nulls)
        return retrieval.filtered_top_k(vectors, docs, _query_vector(vectors), keep, 20).select("vec_id", "similarity", "lang")

    return query


_KEEP = {
    "lenient": "coalesce(quality = 1, false) AND NOT coalesce(toxic = 1, false) AND (n_chars IS NULL OR n_chars <= 2500)",
    "strict": "quality = 1 AND NOT toxic = 1 AND n_chars <= 2500",
}
FILTERED = {k: f"WITH {_SIM} SELECT vec_id, similarity, lang FROM s JOIN documents ON doc_id = vec_id LEFT JOIN labels USING (doc_id) WHERE {v} ORDER BY similarity DESC, vec_id LIMIT 20" for k, v in _KEEP.items()}


def overfetch_then_filter(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    found = retrieval.overfetch_top_k(vectors, docs, _query_vector(vectors), filters.dietary_flag(F.col("quality") == 1), 10)
    return found.select("vec_id", "similarity", "retrieval_rank")


OVERFETCH = f"""WITH {_SIM}, k AS (SELECT *, CAST(row_number() OVER (ORDER BY similarity DESC, vec_id) AS INT) AS retrieval_rank FROM s ORDER BY similarity DESC, vec_id LIMIT 40)
SELECT vec_id, similarity, retrieval_rank FROM k JOIN documents ON doc_id = vec_id LEFT JOIN labels USING (doc_id) WHERE coalesce(quality = 1, false) ORDER BY retrieval_rank LIMIT 10"""


def geo_radius(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    places = c.select(
        F.col("c_custkey").alias("place_id"), F.col("c_name").alias("name"), (F.col("c_acctbal") > 0).alias("is_open"),
        (F.lit(48.0) + (F.col("c_custkey") * 7919 % 1000) / 500.0).alias("lat"), (F.lit(11.0) + (F.col("c_custkey") * 104729 % 1000) / 500.0).alias("lng"),
    )
    return retrieval.geo_search(places, 49.0, 12.0, 40_000.0, 50).select("place_id", "name", F.round("distance_m", 2).alias("distance_m"))


GEO_RADIUS = """WITH p AS (SELECT c_custkey AS place_id, c_name AS name, 48 + (c_custkey * 7919 % 1000) / 500.0::DOUBLE AS lat, 11 + (c_custkey * 104729 % 1000) / 500.0::DOUBLE AS lng FROM customer WHERE c_acctbal > 0),
h AS (SELECT *, pow(sin(radians(lat - 49) / 2), 2) + cos(radians(49)) * cos(radians(lat)) * pow(sin(radians(lng - 12) / 2), 2) AS a FROM p)
SELECT place_id, name, round(d, 2) AS distance_m FROM (SELECT *, round(12742000 * atan2(sqrt(a), sqrt(1 - a)), 3) AS d FROM h) WHERE d <= 40000 ORDER BY d, place_id LIMIT 50"""


def keyset_page(spark, sf_dir):
    return retrieval.keyset_page(table(spark, sf_dir, "orders"), "o_orderkey", 500, 100).select("o_orderkey", "o_totalprice")


def offset_page(spark, sf_dir):
    return retrieval.offset_page(table(spark, sf_dir, "orders"), ["o_orderkey"], 700, 100).select("o_orderkey", "o_totalprice")


def sample_window(spark, sf_dir):
    return retrieval.sample_window(table(spark, sf_dir, "orders"), "o_orderkey", 300, 20, 42).select("o_orderkey", "o_totalprice")


def union_by_priority(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return retrieval.by_priority([d.where("lang = 'en'").withColumn("tag", F.lit("english")), d.withColumn("tag", F.lit("all"))], "doc_id")


def combined_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"), "lang")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("body"), "url")
    both = tables.combined({"documents": docs, "pages": pages}, "combined")
    return both.groupBy("source_table").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("body")).alias("chars"), F.count("lang").alias("langs"), F.count("url").alias("urls"))


def anti_join_new(spark, sf_dir):
    """Documents whose text, lower-cased and trimmed, no conversation turn has; and customers without an order."""
    docs, turns = table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations")
    key = F.md5(text.dedup_key(F.col("text")))
    return retrieval.only_new(docs.where("text IS NOT NULL"), turns, key, key).select("doc_id", "lang")


def customers_without_orders(spark, sf_dir):
    return tables.delete_ids(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey").select("c_custkey", "c_name")


def semi_join_saved(spark, sf_dir):
    order = [F.col("o_orderdate").desc(), F.col("o_orderkey")]
    return retrieval.saved(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", order, 30).select("c_custkey", "c_name")


def upsert_merge(spark, sf_dir):
    """Orders in which urgent ones come again with ten added, and ones with new keys."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    new = o.where("o_orderpriority = '1-URGENT'").withColumn("o_totalprice", F.round(F.col("o_totalprice") + 10, 2))
    more = o.where("o_orderkey < 100").withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    return tables.upsert(o, new.unionByName(more), "o_orderkey")


UPSERT = """WITH n AS (SELECT o_orderkey, o_orderpriority, round(o_totalprice + 10, 2) AS o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT -o_orderkey - 1, o_orderpriority, o_totalprice FROM orders WHERE o_orderkey < 100)
SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n) UNION ALL FROM n"""


def update_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return tables.update(c, {"c_mktsegment": F.lit("DEBTOR"), "c_acctbal": F.lit(0.0)}, F.col("c_acctbal") < 0)


def cascade_delete(spark, sf_dir):
    """Order lines left after the customers of one segment go with their orders."""
    gone = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'")
    orders = table(spark, sf_dir, "orders").join(gone, F.col("o_custkey") == F.col("c_custkey"), "left_semi").withColumnRenamed("o_orderkey", "l_orderkey")
    return tables.delete_ids(table(spark, sf_dir, "lineitem"), orders, "l_orderkey").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def limit_then_filter(spark, sf_dir):
    return filters.limit_then_filter(table(spark, sf_dir, "documents"), [F.col("doc_id")], 200, F.lower("lang").contains("e"), 50).select("doc_id", "lang")


QUERIES = {
    "vector_topk": (vector_topk, VECTOR_TOPK),
    "vector_topk_filtered_lenient": (_filtered("lenient"), FILTERED["lenient"]),
    "vector_topk_filtered_strict": (_filtered("strict"), FILTERED["strict"]),
    "overfetch_then_filter": (overfetch_then_filter, OVERFETCH),
    "geo_radius": (geo_radius, GEO_RADIUS),
    "keyset_page": (keyset_page, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100"),
    "offset_page": (offset_page, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 700"),
    "sample_window": (sample_window, "SELECT o_orderkey, o_totalprice FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 200 OFFSET 300) ORDER BY md5(o_orderkey || ':42') LIMIT 20"),
    "union_by_priority": (union_by_priority, "SELECT doc_id, lang, source, CASE WHEN lang = 'en' THEN 'english' ELSE 'all' END AS tag FROM documents"),
    "combined_sources": (combined_sources, "SELECT 'documents' AS source_table, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, count(lang) AS langs, 0 AS urls FROM documents UNION ALL SELECT 'pages', count(*), CAST(sum(length(html)) AS BIGINT), 0, count(url) FROM pages"),
    "anti_join_new": (anti_join_new, "SELECT doc_id, lang FROM documents WHERE text IS NOT NULL AND lower(trim(text, ' ')) NOT IN (SELECT lower(trim(text, ' ')) FROM conversations WHERE text IS NOT NULL)"),
    "customers_without_orders": (customers_without_orders, "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "semi_join_saved": (semi_join_saved, "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM (SELECT o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 30))"),
    "upsert_merge": (upsert_merge, UPSERT),
    "update_rows": (update_rows, "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'DEBTOR' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer"),
    "cascade_delete": (cascade_delete, "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY') GROUP BY l_returnflag"),
    "limit_then_filter": (limit_then_filter, "SELECT doc_id, lang FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 200) WHERE contains(lower(lang), 'e') ORDER BY doc_id LIMIT 50"),
}
