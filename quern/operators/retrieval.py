"""Exact vector search, geographic search, pages, samples and lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import numeric


def similarities(vectors: DataFrame, query: Sequence[float], id_col: str = "vec_id") -> DataFrame:
    """id and similarity of every vector with the query; of an id's several vectors the best. One scan, no shuffle but of ids."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.groupBy(id_col).agg(F.max(F.round(numeric.cosine(F.col("embedding"), q), 6)).alias("similarity"))


def vector_top_k(vectors: DataFrame, query: Sequence[float], k: int, id_col: str = "vec_id") -> DataFrame:
    """The k most similar ids with their retrieval_rank, ties to the smaller id: a top-k per partition, then one merge."""
    best = similarities(vectors, query, id_col).orderBy(F.col("similarity").desc(), F.col(id_col)).limit(k)
    return best.withColumn("retrieval_rank", F.row_number().over(Window.orderBy(F.col("similarity").desc(), F.col(id_col))))


def with_documents(hits: DataFrame, docs: DataFrame, id_col: str = "vec_id", doc_col: str = "doc_id") -> DataFrame:
    """Hits joined with their documents; hits without one go. Hits are a top-k, so they are the broadcast side."""
    return docs.join(F.broadcast(hits), docs[doc_col] == hits[id_col])


def filtered_top_k(vectors: DataFrame, docs: DataFrame, query: Sequence[float], keep: Column, k: int) -> DataFrame:
    """The k most similar among the documents that pass: filter first, so k is met whenever there are k."""
    scored = similarities(vectors, query)
    return scored.join(docs.where(keep), scored["vec_id"] == docs["doc_id"]).orderBy(F.col("similarity").desc(), "vec_id").limit(k)


def overfetch_top_k(vectors: DataFrame, docs: DataFrame, query: Sequence[float], keep: Column, k: int, times: int = 4) -> DataFrame:
    """``times * k`` candidates, then the filter, then k: fewer than k come back where the filter is hard."""
    found = with_documents(vector_top_k(vectors, query, times * k), docs).where(keep)
    return found.orderBy("retrieval_rank").limit(k)


def geo_search(places: DataFrame, lat: float, lng: float, radius_m: float, limit: int, keyword: str | None = None) -> DataFrame:
    """Open places within the radius, nearest first; a box on latitude goes to the scan before distances are computed."""
    span = radius_m / 111_000.0
    d = numeric.haversine_m(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng"))
    near = places.where(F.col("is_open") & F.col("lat").between(lat - span, lat + span))
    if keyword:
        near = near.where(F.lower("name").contains(keyword.lower()))
    near = near.withColumn("distance_m", F.round(d, 3)).where(F.col("distance_m") <= radius_m)
    return near.orderBy("distance_m", "place_id").limit(limit)


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """The page after a key: the predicate goes to the scan."""
    return df.where(F.col(key) > after).orderBy(key).limit(size)


def offset_page(df: DataFrame, order: Sequence[str], offset: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(size)


def seeded_order(key: Column, seed: int) -> Column:
    """A reproducible shuffle's sort key."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def sample_window(df: DataFrame, key: str, offset: int, n: int, seed: int) -> DataFrame:
    """``n`` rows drawn from the 10 n rows after ``offset``."""
    return offset_page(df, [key], offset, 10 * n).orderBy(seeded_order(F.col(key), seed)).limit(n)


def by_priority(sources: Sequence[DataFrame], key: str) -> DataFrame:
    """The union of sources with one row for each key, from the first source that has it."""
    ranked = [s.withColumn("__source", F.lit(i)) for i, s in enumerate(sources)]
    union = ranked[0]
    for other in ranked[1:]:
        union = union.unionByName(other, allowMissingColumns=True)
    first = Window.partitionBy(key).orderBy("__source")
    return union.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "__source")


def only_new(df: DataFrame, known: DataFrame, key: Column, known_key: Column) -> DataFrame:
    """Rows whose key is not among the known ones."""
    return df.withColumn("__key", key).join(known.select(known_key.alias("__key")).distinct(), "__key", "left_anti").drop("__key")


def saved(docs: DataFrame, marks: DataFrame, doc_key: str, mark_key: str, order: Sequence[Column], n: int) -> DataFrame:
    """Documents among the first ``n`` marks."""
    first = marks.orderBy(*order).limit(n).select(F.col(mark_key).alias("__mark")).distinct()
    return docs.join(F.broadcast(first), docs[doc_key] == F.col("__mark"), "left_semi")
