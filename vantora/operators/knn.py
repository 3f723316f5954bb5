"""Exact nearest neighbours of a stated set of queries.

Queries are taken in blocks of bounded size. Each task scores its vectors against a block by one matrix
product for each Arrow batch and keeps the best k of each query, so only k rows of each task and query are
shuffled; the final choice ranks those. Filters go below the scan of the vectors. Where there are many blocks
they are worked off one after the other, so the driver holds one of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import SCORES
from ..session import settled

#: Queries that a task scores at once; more are taken block by block.
QUERY_BLOCK = 2_048
#: Scores that a task holds at once.
SLICE = 2_000_000
#: Scores are rounded to this many digits before they are ranked, ties go to the smaller id.
DIGITS = 9
TINY = 1e-10
#: Lists that are named in a filter at most.
LISTED = 4_096


def score_matrix(m: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Scores (queries, rows), smaller is better."""
    products = q @ m.T
    if metric == "dot":
        return -products
    qq, mm = (q * q).sum(axis=1), (m * m).sum(axis=1)
    if metric == "cosine":
        lengths = np.sqrt(qq)[:, None] * np.sqrt(mm)
        sims = np.divide(products, lengths, out=np.zeros_like(products), where=(np.sqrt(qq)[:, None] >= TINY) & (np.sqrt(mm) >= TINY))
        return 1 - sims
    squared = np.maximum(qq[:, None] + mm - 2 * products, 0)
    near = squared < 1e-6 * (qq[:, None] + mm)  # cancellation: compute these directly
    if near.any():
        i, j = np.nonzero(near)
        squared[i, j] = ((q[i] - m[j]) ** 2).sum(axis=1)
    return squared if metric == "l2_squared" else np.sqrt(squared)


def _better(best, rows, scores, ids, k):
    """Merges the scores (queries, candidates) of some queries (``rows``) into their best k."""
    old, who = best
    scores = np.concatenate([old[rows], scores], axis=1)
    names = np.concatenate([who[rows], np.broadcast_to(ids, (len(rows), len(ids)))], axis=1)
    if scores.shape[1] > 4 * k:
        bound = np.partition(scores, k - 1, axis=1)[:, k - 1 : k]
        width = int((scores <= bound).sum(axis=1).max())
        pick = np.argsort(scores, axis=1, kind="stable")[:, :width]
        scores, names = np.take_along_axis(scores, pick, 1), np.take_along_axis(names, pick, 1)
    order = np.lexsort((names, scores), axis=1)[:, :k]
    old[rows], who[rows] = np.take_along_axis(scores, order, 1), np.take_along_axis(names, order, 1)


def _local_top(qids, qvecs, k, metric, probes=None):
    """Best k of each query among a task's rows; with ``probes`` (qid -> list ids) only rows of those lists (third column)."""
    groups = {}
    for n in {len(v) for v in qvecs}:
        at = [i for i, v in enumerate(qvecs) if len(v) == n]
        own = np.array([qids[i] for i in at])
        asks: dict[int, list[int]] = {}
        for i, qid in enumerate(own.tolist()) if probes is not None else ():
            for x in probes.get(qid, ()):
                asks.setdefault(x, []).append(i)
        groups[n] = (own, np.array([qvecs[i] for i in at], np.float64), {x: np.array(v) for x, v in asks.items()})

    def run(batches):
        best = {n: (np.full((len(g[0]), k), np.inf), np.full((len(g[0]), k), np.iinfo(np.int64).max)) for n, g in groups.items()}
        for b in batches:
            column = b.column(1)
            ids = b.column(0).to_numpy(zero_copy_only=False)
            lengths = np.asarray(column.value_lengths().fill_null(0))
            flat, starts = np.asarray(column.flatten(), np.float64), np.r_[0, np.cumsum(lengths)]
            for n, (qid, q, asks) in groups.items():
                at = np.flatnonzero(lengths == n)
                parts = [(np.arange(len(qid)), at)]
                if probes is not None:
                    lists = b.column(2).to_numpy(zero_copy_only=False)[at]
                    parts = [(asks[x], at[lists == x]) for x in np.unique(lists).tolist() if x in asks]
                for rows, own in parts:
                    step = max(128, SLICE // len(rows))
                    for lo in range(0, len(own), step):
                        part = own[lo : lo + step]
                        m = flat[starts[part][:, None] + np.arange(n)]
                        s = np.round(score_matrix(m, q[rows], metric), DIGITS) + 0.0
                        _better(best[n], rows, np.where(np.isnan(s), np.inf, s), ids[part], k)
        for n, (qid, _, _) in groups.items():
            scores, who = best[n]
            keep = np.isfinite(scores).ravel()
            cols = [np.repeat(qid, k)[keep], who.ravel()[keep], scores.ravel()[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["qid", "id", "score"])

    return run


def ranked(found: DataFrame, k: int, by: str = "score", partition: str = "qid", ascending: bool = True) -> DataFrame:
    """The best k of each partition with their rank; the limit is applied before the shuffle."""
    order = F.col(by).asc() if ascending else F.col(by).desc()
    rank = F.row_number().over(W.partitionBy(partition).orderBy(order, "id"))
    return found.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)


def knn_join(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", block: int = QUERY_BLOCK, probes: DataFrame | None = None) -> DataFrame:
    """(qid, id, score, rank): the k nearest vectors of every query.

    ``vectors``: id, vector; ``queries``: qid, qvec. Only vectors of the query's length are compared; null
    vectors and ids are left out, NaN scores are never near. With ``probes`` (qid, list_id) a query sees only
    the vectors of its lists (column ``list_id``). Scores are rounded to 9 digits. No queries or
    no vectors give no rows.
    """
    spark = vectors.sparkSession
    given = queries.where("qid is not null and qvec is not null").select("qid", "qvec")
    n = given.count()
    base = vectors.where("id is not null and vector is not null").select("id", "vector", *(["list_id"] if probes is not None else []))
    schema = "qid long, id long, score double"
    out = None
    blocks = math.ceil(n / block)
    for i in range(blocks):
        part = given.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i) if blocks > 1 else given
        rows = part.collect()  # about `block` queries
        if not rows:
            continue
        seen = None
        if probes is not None:
            own = probes.join(part.select("qid"), "qid", "left_semi")
            seen = {r.qid: r.lists for r in own.groupBy("qid").agg(F.collect_set("list_id").alias("lists")).collect()}
        run = _local_top([r.qid for r in rows], [r.qvec for r in rows], k, metric, seen)
        given_lists = sorted({x for v in seen.values() for x in v}) if seen else []
        # only the lists that a query of the block asks for are read; stored by list_id, other folders are not opened
        read = base.where(F.col("list_id").isin(given_lists)) if 0 < len(given_lists) <= LISTED else base
        found = settled(read.mapInArrow(run, schema), blocks)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    return ranked(out, k)


def paged(results: DataFrame, page: int, partition: str = "qid") -> DataFrame:
    """Adds batch_index, total_batches, results_so_far and is_last to ranked results."""
    n = F.count("*").over(W.partitionBy(partition))
    batch = F.floor((F.col("rank") - 1) / page)
    last = F.ceil(n / page)
    return results.withColumns({
        "batch_index": batch.cast("bigint"),
        "total_batches": last.cast("bigint"),
        "results_so_far": F.least((batch + 1) * page, n).cast("bigint"),
        "is_last": batch + 1 == last,
    })


def rerank(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Exact scores for candidates (qid, id), and the k best: the second stage after approximate scores."""
    rows = candidates.select("qid", "id").join(vectors.select("id", "vector"), "id").join(queries.select("qid", "qvec"), "qid")
    score = F.round(SCORES[metric](F.col("vector"), F.col("qvec")), DIGITS)
    return ranked(rows.select("qid", "id", score.alias("score")), k)


#: Base and largest expansion, least share below which ids are filtered first, share above which results are filtered, share of k that ends a search early, growth of an attempt.
BASE_EXPANSION, MAX_EXPANSION, PRE_BELOW, POST_ABOVE, EARLY_SHARE, GROWTH = 2.0, 10.0, 0.1, 0.5, 0.8, 1.5


def expansion(selectivity: Column, k: int) -> Column:
    """How many candidates a filtered search looks at: the rarer the matches, the more."""
    factor = (
        F.when(selectivity < 0.01, MAX_EXPANSION)
        .when(selectivity < 0.1, F.least(F.lit(MAX_EXPANSION), BASE_EXPANSION * F.sqrt(1 / selectivity)))
        .otherwise(BASE_EXPANSION)
    )
    return F.floor(F.round(k * factor, DIGITS)).cast("bigint")


def strategy(matching: Column, total: Column) -> Column:
    """none, pre, post or hybrid, by the share of rows that match."""
    share = matching / F.greatest(total, F.lit(1))
    return F.when(matching == total, "none").when(share < PRE_BELOW, "pre").when(share > POST_ABOVE, "post").otherwise("hybrid")


def expanding_search(vectors: DataFrame, queries: DataFrame, matches: Column, k: int, metric: str = "l2") -> DataFrame:
    """Filtered search that grows its candidates: near vectors first, then the filter, until enough match.

    The hybrid strategy starts from the base expansion and grows by half until at least ``EARLY_SHARE`` of k match or the expansion for
    the filter's selectivity is reached; all attempts are prefixes of one ranking, so one search serves them.
    """
    counts = vectors.agg(F.count("*").alias("n"), F.count_if(matches).alias("m")).select("n", "m", strategy(F.col("m"), F.col("n")).alias("s"), expansion(F.col("m") / F.greatest("n", F.lit(1)), k).alias("e")).first()
    most = k if counts.s == "none" else counts.e
    attempts = [most]
    if counts.s == "hybrid":
        attempts, at = [], int(k * BASE_EXPANSION)
        while at < most:
            attempts.append(at)
            at = int(at * GROWTH)
        attempts.append(max(most, int(k * BASE_EXPANSION)) if not attempts else most)
    near = knn_join(vectors, queries, max(attempts), metric)
    valid = near.join(vectors.where(matches).select("id"), "id", "left_semi")
    so_far = F.row_number().over(W.partitionBy("qid").orderBy("rank"))
    valid = valid.withColumn("so_far", so_far)
    # the first attempt that finds enough, else the last
    found = [F.count_if(F.col("rank") <= a) for a in attempts]
    enough = [F.when(f >= EARLY_SHARE * k, F.lit(a)) for f, a in zip(found, attempts)]
    limit = valid.groupBy("qid").agg(F.coalesce(*enough, F.lit(attempts[-1])).alias("limit"))
    kept = valid.join(limit, "qid").where((F.col("rank") <= F.col("limit")) & (F.col("so_far") <= k))
    return kept.select("qid", "id", "score", F.col("so_far").cast("bigint").alias("rank"))
