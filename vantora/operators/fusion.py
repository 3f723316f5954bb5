"""Combining rankings: full outer joins of (qid, id, score) and sums over ranks.

An empty ranking counts as absent, a document missing from a ranking gets 0 from it. Results are ordered by
score rounded to nine digits and by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .knn import ranked

#: The constant of reciprocal ranks and the least range of a normalised list.
RRF_K, LEAST_RANGE = 60, 1e-6
#: What stands for infinity in scaled scores.
LARGEST = 1e300
#: Names of the dense and sparse fusions.
FUSIONS = {"weighted": "weighted", "linear": "weighted", "rrf": "rrf", "reciprocal_rank_fusion": "rrf", "max": "max", "maximum": "max"}


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    """(qid, id, a, b) with the limits of each list; infinite scores count as the largest numbers."""
    out = None
    finite = F.greatest(F.least("score", F.lit(LARGEST)), F.lit(-LARGEST))
    for name, df in (("a", a.withColumn("score", finite)), ("b", b.withColumn("score", finite))):
        limits = df.groupBy("qid").agg(F.min("score").alias(f"{name}_min"), F.max("score").alias(f"{name}_max"))
        rows = df.select("qid", "id", F.col("score").alias(name)).join(limits, "qid")
        out = rows if out is None else out.join(rows, ["qid", "id"], "full_outer")
    return out


def _top(rows: DataFrame, score: Column, k: int, ascending: bool = False) -> DataFrame:
    return ranked(rows.select("qid", "id", F.round(score, 9).alias("score")), k, ascending=ascending)


def weighted(vectors: DataFrame, text: DataFrame, alpha: float, k: int, distances: bool = True) -> DataFrame:
    """alpha * vector part + (1 - alpha) * text part of lists scaled to 0..1; distances are turned around."""
    def scaled(n):
        return (F.col(n) - F.col(f"{n}_min")) / F.greatest(F.col(f"{n}_max") - F.col(f"{n}_min"), F.lit(LEAST_RANGE))

    part = 1 - scaled("a") if distances else scaled("a")
    return _top(_both(vectors, text), alpha * F.coalesce(part, F.lit(0.0)) + (1 - alpha) * F.coalesce(scaled("b"), F.lit(0.0)), k)


def rrf(lists: list[tuple[DataFrame, bool, float]], k: int, constant: float = RRF_K) -> DataFrame:
    """Weighted reciprocal ranks: lists of (ranking, whether smaller scores are better, weight)."""
    parts = None
    for df, ascending, weight in lists:
        order = [F.col("score").asc() if ascending else F.col("score").desc(), "id"]
        rank = F.row_number().over(W.partitionBy("qid").orderBy(*order))
        rows = df.select("qid", "id", (F.lit(weight) / (constant + rank)).alias("part"))
        parts = rows if parts is None else parts.unionByName(rows)
    return _top(parts.groupBy("qid", "id").agg(F.sum("part").alias("part")), F.col("part"), k)


def dense_sparse_weighted(dense: DataFrame, sparse: DataFrame, w_dense: float, w_sparse: float, k: int) -> DataFrame:
    """Distances turned around and products, each scaled to 0..1; a list with one value counts 1."""
    def scaled(n, value):
        return F.when(F.col(f"{n}_max") > F.col(f"{n}_min"), value / (F.col(f"{n}_max") - F.col(f"{n}_min"))).when(F.col(n).isNotNull(), 1.0).otherwise(0.0)

    return _top(_both(dense, sparse), w_dense * scaled("a", F.col("a_max") - F.col("a")) + w_sparse * scaled("b", F.col("b") - F.col("b_min")), k)


def dense_sparse_max(dense: DataFrame, sparse: DataFrame, k: int) -> DataFrame:
    """The larger of 1 - distance / largest distance and product / largest product."""
    a = F.when(F.col("a_max") > 0, 1 - F.col("a") / F.col("a_max")).otherwise(0.0)
    b = F.when(F.col("b_max") > 0, F.col("b") / F.col("b_max")).otherwise(0.0)
    return _top(_both(dense, sparse), F.greatest(F.when(F.col("a").isNotNull(), a).otherwise(0.0), F.when(F.col("b").isNotNull(), b).otherwise(0.0)), k)


def dense_sparse(method: str, dense: DataFrame, sparse: DataFrame, k: int, w_dense: float = 0.5, w_sparse: float = 0.5) -> DataFrame:
    """Fusion by name; unknown names mean weighted."""
    kind = FUSIONS.get(method.lower(), "weighted")
    if kind == "rrf":
        return rrf([(dense, True, w_dense), (sparse, False, w_sparse)], k)
    return dense_sparse_max(dense, sparse, k) if kind == "max" else dense_sparse_weighted(dense, sparse, w_dense, w_sparse, k)


#: Fusions of a query of several vectors: aggregate and whether smaller is better.
MULTI = {
    "sum": (lambda: F.sum(F.col("score") * F.col("weight")), False),
    "max": (lambda: F.max("score"), False),
    "min": (lambda: F.min("score"), True),
    "avg": (lambda: F.avg("score"), True),
    "rrf": (lambda: F.sum(F.col("weight") / (RRF_K + F.col("rank"))), False),
}


def multi(results: DataFrame, groups: DataFrame, method: str, k: int) -> DataFrame:
    """(qid, id, score, query_matches, rank) of queries that consist of several vectors.

    ``results``: qid, id, score, rank of the single vectors; ``groups``: qid, gid, weight. Unknown methods mean rrf.
    """
    agg, ascending = MULTI.get(method, MULTI["rrf"])
    rows = results.join(groups, "qid").groupBy(F.col("gid").alias("g"), "id").agg(F.round(agg(), 9).alias("score"), F.count("*").alias("query_matches"))
    return ranked(rows.withColumnRenamed("g", "qid"), k, ascending=ascending)


def per_query_scores(results: DataFrame, groups: DataFrame) -> DataFrame:
    """(qid, id, query_matches, scores): scores in millionths of all vectors of the query in order, ``-`` where it isn't near."""
    slots = groups.groupBy("gid").agg(F.sort_array(F.collect_list("qid")).alias("members"))
    found = results.join(groups, "qid").groupBy("gid", "id").agg(F.map_from_entries(F.collect_list(F.struct("qid", F.round(F.col("score") * 1e6).cast("bigint").cast("string").alias("s")))).alias("by"))
    text = F.array_join(F.transform("members", lambda q: F.coalesce(F.try_element_at(F.col("by"), q), F.lit("-"))), ",")
    return found.join(slots, "gid").select(F.col("gid").alias("qid"), "id", F.size("by").cast("bigint").alias("query_matches"), text.alias("scores"))
