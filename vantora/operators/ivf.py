"""Inverted lists: a coarse quantizer, assignment of all vectors, and search in the nearest lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, guarded_join, settled
from . import knn, quant

#: Lists whose centroids fit on the driver and in every task.
MAX_LISTS = 65_536


def label_centroids(vectors: DataFrame, label: str = "label") -> DataFrame:
    """(list_id, centroid): the mean vector of each label."""
    rows = vectors.select(F.col(label).cast("long").alias("list_id"), F.posexplode("vector").alias("pos", "x"))
    means = rows.groupBy("list_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("list_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s.x).alias("centroid"))


def train_centroids(vectors: DataFrame, lists: int, rounds: int = 25) -> DataFrame:
    """(list_id, centroid) by k-means on a bounded sample."""
    rows = quant.training_sample(vectors).orderBy("id").select("vector").toArrow()["vector"].to_pylist()
    centres = quant.kmeans(np.array(rows, np.float64), lists, rounds)
    return vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "list_id long, centroid array<double>")


def assign(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """Adds list_id and list_dist, the nearest centroid of each vector; ties go to the smaller list."""
    rows = centroids.orderBy("list_id").limit(MAX_LISTS + 1).collect()
    if len(rows) > MAX_LISTS:
        raise ValueError(f"more than {MAX_LISTS} lists")
    ids, c = np.array([r.list_id for r in rows]), np.array([r.centroid for r in rows], np.float64)

    def run(batches):
        for b in batches:
            x = np.asarray(b.column("vector").flatten(), np.float64).reshape(-1, c.shape[1])
            own, dist = np.empty(len(x), np.int64), np.empty(len(x))
            for lo in range(0, len(x), 4_096):
                d = np.round(knn.score_matrix(c, x[lo : lo + 4_096], "l2"), 9)
                at = d.argmin(axis=1)
                own[lo : lo + 4_096], dist[lo : lo + 4_096] = ids[at], d[np.arange(len(at)), at]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own), pa.array(dist)], names=[*b.schema.names, "list_id", "list_dist"])

    given = vectors.where(F.size("vector") == c.shape[1])
    schema = ", ".join(f"`{n}` {t}" for n, t in given.dtypes)
    return given.mapInArrow(run, f"{schema}, list_id long, list_dist double")


def probe(queries: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """(qid, list_id, score, rank): the nprobe nearest lists of each query."""
    lists = centroids.select(F.col("list_id").alias("id"), F.col("centroid").alias("vector"))
    return knn.knn_join(lists, queries, nprobe).withColumnRenamed("id", "list_id")


def flat_search(assigned: DataFrame, queries: DataFrame, centroids: DataFrame, k: int, nprobe: int, metric: str = "l2") -> DataFrame:
    """Exact scores within the probed lists. Stored partitioned by ``list_id``, only those are read."""
    return knn.knn_join(assigned, queries, k, metric, probes=probe(queries, centroids, nprobe).select("qid", "list_id"))


def exact_search(assigned: DataFrame, queries: DataFrame, centroids: DataFrame, k: int) -> DataFrame:
    """The k nearest by Euclidean distance as of all vectors: the nearest list of each query bounds its k-th distance,
    and each list is searched that may hold a nearer vector, by the distance of its centroid and its radius."""
    # at most MAX_LISTS lists, see assign()
    radius = assigned.groupBy("list_id").agg(F.max("list_dist").alias("radius"))
    first = flat_search(assigned, queries, centroids, k, 1).where(F.col("rank") == k).select("qid", F.col("score").alias("bound"))
    pairs = probe(queries, centroids, MAX_LISTS).join(radius, "list_id").join(first, "qid", "left")
    probes = cut(pairs.where("bound is null or score - radius <= bound + 1e-6").select("qid", "list_id"))
    return knn.knn_join(assigned, queries, k, "l2", probes=probes)


def residuals(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """(id, list_id, vector): what is left of each vector without its centroid."""
    rows = guarded_join(assigned, centroids, ["list_id"], spread=F.col("id"))
    return rows.select("id", "list_id", F.zip_with("vector", "centroid", lambda x, c: x.cast("double") - c).alias("vector"))


def list_stats(assigned: DataFrame) -> DataFrame:
    """One row: lists in use, vectors, sizes of the smallest, largest and mean list."""
    sizes = assigned.groupBy("list_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("n_lists"), F.sum("n").alias("n_vectors"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.round(F.avg("n"), 6).alias("mean_size"))


def pq_search(coded: DataFrame, queries: DataFrame, centroids: DataFrame, pq: quant.ProductQuantizer, k: int, nprobe: int, block: int = 512) -> DataFrame:
    """(qid, id, score, rank): search in residual codes (id, list_id, codes), of the query's ``nprobe`` nearest lists.

    For each of its lists a query has tables of the subspace distances between its residual to the list's centroid
    and the codebook; the distance of a code is a sum of entries of these. Nothing is decoded, and only probed
    lists are read.
    """
    spark, books, schema = coded.sparkSession, pq.books, "qid long, id long, score double"
    probes = probe(queries, centroids, nprobe).select("qid", "list_id")
    parts = probes.join(queries.select("qid", "qvec"), "qid").join(centroids, "list_id")
    parts = cut(parts.select("qid", "list_id", F.zip_with("qvec", "centroid", lambda q, c: q.cast("double") - c).alias("left")))
    blocks = -(-queries.count() // block)
    rows = coded.where("id is not null").select("id", "codes", "list_id")
    out = None
    for i in range(blocks):
        asked = parts.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i).collect()  # about `block` queries, nprobe rows each
        if not asked:
            continue
        lists = sorted({r.list_id for r in asked})

        def run(batches, asked=asked):
            qids = np.array(sorted({r.qid for r in asked}))
            of_list: dict[int, list] = {}
            for r in asked:
                of_list.setdefault(r.list_id, []).append(r)
            tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            best = (np.full((len(qids), k), np.inf), np.full((len(qids), k), np.iinfo(np.int64).max))
            for b in batches:
                ids, own = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
                codes = np.asarray(b.column(1).flatten()).reshape(len(ids), -1)
                for x in np.unique(own).tolist():
                    if x not in of_list:
                        continue
                    if x not in tables:
                        left = np.array([r.left for r in of_list[x]], np.float64).reshape(-1, books.shape[0], 1, books.shape[2])
                        tables[x] = np.searchsorted(qids, [r.qid for r in of_list[x]]), ((left - books) ** 2).sum(axis=3)
                    who, table = tables[x]
                    at = np.flatnonzero(own == x)
                    for lo in range(0, len(at), 4_096):
                        part = at[lo : lo + 4_096]
                        score = sum(table[:, j, codes[part, j]] for j in range(codes.shape[1]))
                        knn._better(best, who, np.round(score, knn.DIGITS), ids[part], k)
            scores, names = best
            keep = np.isfinite(scores).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.repeat(qids, k)[keep], names.ravel()[keep], scores.ravel()[keep])], names=["qid", "id", "score"])

        read = rows.where(F.col("list_id").isin(lists)) if len(lists) <= knn.LISTED else rows
        found = settled(read.mapInArrow(run, schema), blocks)
        out = found if out is None else out.unionByName(found)
    return knn.ranked(out if out is not None else spark.createDataFrame([], schema), k)
