"""Sparse vectors, as arrays of indices and values or as rows (id, dim, weight)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, guarded_join, settled
from .knn import DIGITS, _better, ranked

#: Queries that are scored at once.
QUERY_BLOCK = 512

#: Values nearer to zero than this are left out.
TINY = 1e-10


def is_valid(indices: Column, values: Column) -> Column:
    """Whether both arrays exist, have one length, and the indices ascend strictly."""
    rising = F.forall(F.sequence(F.lit(1), F.greatest(F.size(indices) - 1, F.lit(1))), lambda i: F.coalesce(F.get(indices, i) > F.get(indices, i - 1), i >= F.size(indices)))
    return F.coalesce((F.size(indices) == F.size(values)) & (rising | (F.size(indices) < 2)), F.lit(False))


def from_pairs(rows: DataFrame, key: str, indices: str, values: str) -> DataFrame:
    """(id, dim, weight): of repeated indices the last counts, values near zero are left out."""
    pairs = rows.select(F.col(key).alias("id"), F.posexplode(F.arrays_zip(indices, values)).alias("pos", "p"))
    pairs = pairs.select("id", "pos", F.col(f"p.{indices}").alias("dim"), F.col(f"p.{values}").cast("double").alias("weight")).where("dim is not null and weight is not null")
    last = pairs.groupBy("id", "dim").agg(F.max_by("weight", "pos").alias("weight"))
    return last.where(F.abs("weight") >= TINY)


def from_dense(vectors: DataFrame, least: float = TINY) -> DataFrame:
    """(id, dim, weight) of the components whose size is above ``least``."""
    rows = vectors.select("id", F.posexplode("vector").alias("dim", "weight")).select("id", "dim", F.col("weight").cast("double").alias("weight"))
    return rows.where(F.abs("weight") > least)


def norms(rows: DataFrame) -> DataFrame:
    """(id, nnz, max_dim, norm)."""
    return rows.groupBy("id").agg(F.count("*").alias("nnz"), F.max("dim").alias("max_dim"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))


def normalize(rows: DataFrame) -> DataFrame:
    """The rows scaled to length one."""
    return rows.join(norms(rows).select("id", "norm"), "id").select("id", "dim", (F.col("weight") / F.col("norm")).alias("weight"))


def dot(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, id, score) for all pairs that share a dimension; ``queries``: qid, dim, weight. Sums form before the shuffle."""
    hits = rows.join(queries.select("qid", "dim", F.col("weight").alias("w")), "dim")
    return hits.groupBy("qid", "id").agg(F.round(F.sum(F.col("weight") * F.col("w")), 9).alias("score"))


def arrays(rows: DataFrame) -> DataFrame:
    """(id, dims, weights) of rows (id, dim, weight): a vector in a row."""
    cells = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("dim", "weight"))).alias("c"))
    return cells.select("id", F.transform("c", lambda x: x.dim.cast("bigint")).alias("dims"), F.transform("c", lambda x: x.weight).alias("weights"))


def arrays_from_dense(vectors: DataFrame, least: float = TINY) -> DataFrame:
    """(id, dims, weights) of the components whose size is above ``least``; nothing is shuffled."""
    cells = F.filter(F.transform("vector", lambda x, i: F.struct(i.cast("bigint").alias("dim"), x.cast("double").alias("weight"))), lambda c: F.abs(c.weight) > least)
    return vectors.select("id", cells.alias("c")).select("id", F.transform("c", lambda x: x.dim).alias("dims"), F.transform("c", lambda x: x.weight).alias("weights"))


def search(vectors: DataFrame, queries: DataFrame, k: int, allowed: DataFrame | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """(qid, id, score, rank): the k largest products of vectors (id, dims, weights), or rows (id, dim, weight), that share a dimension with the query.

    ``queries``: qid, dim, weight, taken in blocks of bounded size; ``allowed`` (id) is applied before. Each task keeps its
    best k of each query, so no row for every pair is made.
    """
    spark, schema = vectors.sparkSession, "qid long, id long, score double"
    vectors = vectors if "dims" in vectors.columns else arrays(vectors)
    rows = vectors.where("id is not null").select("id", "dims", "weights")
    if allowed is not None:
        rows = guarded_join(rows, allowed.select("id").distinct(), ["id"], "left_semi", salts=1)
    given = cut(queries.where("qid is not null").select("qid", F.col("dim").cast("bigint").alias("dim"), "weight"))
    blocks = -(-given.select("qid").distinct().count() // block)
    out = None
    for i in range(blocks):
        part = given.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i).collect()  # the components of about ``block`` queries
        if not part:
            continue
        qids = sorted({r.qid for r in part})
        found = settled(rows.mapInArrow(_local_best([tuple(r) for r in part], qids, k), schema), blocks)
        out = found if out is None else out.unionByName(found)
    return ranked(out if out is not None else spark.createDataFrame([], schema), k, ascending=False)


def _local_best(cells: list[tuple[int, int, float]], qids: list[int], k: int):
    """Best k vectors of each query among a task's rows: products of runs of components with the queries' columns."""
    dims = np.unique([d for _, d, _ in cells])
    weight, has = np.zeros((len(dims) + 1, len(qids))), np.zeros((len(dims) + 1, len(qids)), bool)
    row, col = np.searchsorted(dims, [d for _, d, _ in cells]), np.searchsorted(qids, [q for q, _, _ in cells])
    np.add.at(weight, (row, col), [w for _, _, w in cells])
    has[row, col] = True

    def run(batches):
        best = (np.full((len(qids), k), np.inf), np.full((len(qids), k), np.iinfo(np.int64).max))
        for b in batches:
            ids, column = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            owner = np.repeat(np.arange(len(ids)), np.asarray(column.value_lengths().fill_null(0)))
            dim, w = np.asarray(column.flatten()), np.asarray(b.column(2).flatten(), np.float64)
            at = np.minimum(np.searchsorted(dims, dim), len(dims) - 1)
            keep = np.flatnonzero(dims[at] == dim)
            owner, at, w = owner[keep], at[keep], w[keep]
            for lo in range(0, len(ids), 1_024):
                i, j = np.searchsorted(owner, (lo, lo + 1_024))
                if i < j:
                    who, first = np.unique(owner[i:j], return_index=True)
                    score = -np.round(np.add.reduceat(weight[at[i:j]] * w[i:j, None], first, axis=0), DIGITS) + 0.0
                    shared = np.logical_or.reduceat(has[at[i:j]], first, axis=0)
                    _better(best, np.arange(len(qids)), np.where(shared, score, np.inf).T, ids[who], k)
        scores, who = best
        keep = np.isfinite(scores)
        cols = [np.broadcast_to(np.array(qids)[:, None], keep.shape)[keep], who[keep], -scores[keep] + 0.0]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["qid", "id", "score"])

    return run


def stats(rows: DataFrame) -> DataFrame:
    """One row: vectors, dimensions in use, postings, mean number of components."""
    return rows.agg(F.countDistinct("id").alias("n_vectors"), F.countDistinct("dim").alias("n_dims"), F.count("*").alias("n_postings")).withColumn("avg_nnz", F.col("n_postings") / F.col("n_vectors"))
