"""The most similar vectors for every vector, by a hash-prefix forest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut, guarded_join
from . import forest
from .vectors import lists_to_matrices, unit, usable, with_copies

#: Neighbours kept for each row beyond k, so that leaving out the row itself never leaves fewer than k.
SPARE = 1
#: Rows with at least a fourth of the budget near them in a block lie in a crowd that may be larger than the
#: block; they are searched again in a second forest with so many times the budget.
CROWD_SHARE, CROWD_BUDGET = 4, 4
#: Pairs of a block, times k and its rows, beyond which each row is cut to its best before pairs are made.
DENSE = 8
#: What a cosine may be off by where vectors of one direction are one row, and ids of a direction that a task compares at once.
SLACK, MEMBERS = 1e-6, 16_384


def block_neighbours(k: int, least: float, crowd: int):
    """Work on a block: for each row its k most similar other rows with at least that cosine, and whether at least ``crowd`` rows are that near."""

    def best(ids, r, c, exact):
        """The k first of each row, of pairs (row, other, cosine) in any order."""
        order = np.lexsort((ids[c], -exact, r))
        r, c, exact = r[order], c[order], exact[order]
        top = np.arange(len(r)) - np.searchsorted(r, r) < k
        return r[top], c[top], exact[top]

    def each_once(m: np.ndarray):
        """Pairs (row, later row) with at least the cosine, and how many others each row has; None if they are many."""
        single, rows, others, held = m.astype(np.float32), [], [], 0
        for lo in range(0, len(m), 512):
            near = single[lo : lo + 512] @ single[lo:].T >= least - 1e-5
            r, c = np.nonzero(near)
            later = c > r
            rows.append(r[later] + lo)
            others.append(c[later] + lo)
            held += len(rows[-1])
            if held > DENSE * k * len(m):
                return None
        return np.concatenate(rows), np.concatenate(others)

    def sparse(ids: np.ndarray, m: np.ndarray, pairs):
        r, c = pairs
        count = np.bincount(r, minlength=len(m)) + np.bincount(c, minlength=len(m))
        exact = np.round(np.einsum("ij,ij->i", m[r], m[c]), 12)
        keep = exact >= least
        r, c, exact = r[keep], c[keep], exact[keep]
        r, c, exact = best(ids, np.r_[r, c], np.r_[c, r], np.r_[exact, exact])
        return [(ids[r], ids[c], exact, count[r] >= crowd)] if len(r) else []

    def dense(ids: np.ndarray, m: np.ndarray):
        single, found = m.astype(np.float32), []
        for lo in range(0, len(ids), 512):
            sims = single[lo : lo + 512] @ single.T
            sims[np.arange(len(sims)), np.arange(lo, lo + len(sims))] = -2
            near = sims >= least - 1e-5
            count = near.sum(axis=1)
            wide = count > 4 * k
            if wide.any():  # keep what can be among the best before sorting
                at = np.flatnonzero(wide)
                bound = -np.partition(-sims[at], 2 * k, axis=1)[:, 2 * k] - 1e-6
                near[at] &= sims[at] >= bound[:, None]
            r, c = np.nonzero(near)
            exact = np.round(np.einsum("ij,ij->i", m[lo + r], m[c]), 12)
            keep = exact >= least
            r, c, exact = best(ids, r[keep], c[keep], exact[keep])
            if len(r):
                found.append((ids[lo + r], ids[c], exact, count[r] >= crowd))
        return found

    def work(ids: np.ndarray, m: np.ndarray) -> pa.RecordBatch | None:
        pairs = each_once(m)
        found = dense(ids, m) if pairs is None else sparse(ids, m, pairs)
        if not found:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["rep", "other", "sim", "crowded"])

    return work


def _member_sims(k: int):
    """Work on some rows and members of one direction: for each row its k most similar members."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            right = right.sort_by("member")
            ids, members = left["id"].to_numpy(), right["member"].to_numpy()
            (_, a), (_, b) = next(lists_to_matrices(left["vector"])), next(lists_to_matrices(right["own"]))
            a, b, top = unit(a), unit(b), min(k, len(members))
            for lo in range(0, len(a), 256):
                sims = np.round(a[lo : lo + 256] @ b.T, 12)
                bound = np.partition(sims, -top, axis=1)[:, -top][:, None]
                above, tied = sims > bound, sims == bound
                r, c = np.nonzero(above | (tied & (np.cumsum(tied, axis=1) <= top - above.sum(axis=1, keepdims=True))))
                found.append((ids[lo + r], members[c], sims[r, c]))
        return pa.table([np.concatenate(x) for x in zip(*found)], names=["id", "other", "sim"])

    return work


def _exact_members(all_rows: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(id, other, sim): for the ids of ``rep`` of each pair (rep, other) the k most similar ids of ``other``, by their own vectors."""
    chunks = all_rows.where("id = rep").select(F.col("rep").alias("other"), F.ceil(F.col("n_copies") / MEMBERS).cast("int").alias("n"))
    targets = cut(pairs.select("other").distinct().join(chunks, "other"))
    asking = all_rows.select("rep", "id", "vector").join(pairs, "rep").join(targets, "other")
    asking = asking.select("other", "id", "vector", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk"))
    asked = guarded_join(all_rows.select(F.col("rep").alias("other"), F.col("id").alias("member"), F.col("vector").alias("own")), targets, ["other"], spread=F.col("member"))
    asked = asked.select("other", "member", "own", F.pmod(F.xxhash64("member"), F.col("n")).cast("int").alias("chunk"))
    return asking.groupBy("other", "chunk").cogroup(asked.groupBy("other", "chunk")).applyInArrow(_member_sims(k), "id long, other long, sim double")


def most_similar(vectors: DataFrame, k: int, least: float, **forest_options) -> DataFrame:
    """(id, other, sim): for each id its k most similar ids of the same group with cosine >= ``least``.

    ``vectors``: grp, id, vector, all usable. Ties go to the smaller id. Vectors of one direction are one row of
    the forest; afterwards each stands for the smallest of its ids or, where the vectors differ by rounding, for
    those that are nearest by their own vectors. A group of one row has no neighbours.
    """
    all_rows = with_copies(vectors)
    reps = all_rows.where("id = rep").select("grp", "rep", "vector")
    schema = "rep long, other long, sim double, crowded boolean"
    mixed = not all_rows.where("mixed").isEmpty()
    # by the direction's first vector a cosine may be off by the angle, and the order with it
    given, wanted = least, k
    if mixed:
        least, k = least - SLACK, k + 3
    first = forest_options | {"budget": forest_options.get("budget", forest.BUDGET)}
    crowd = max(first["budget"] // CROWD_SHARE, 4 * k)
    # at most k rows of each tree meet in a group
    best = F.slice(F.array_sort(F.collect_set(F.struct((-F.col("sim")).alias("far"), "other"))), 1, k)
    found = forest.over_blocks(reps, reps.count(), block_neighbours(k, least, crowd), schema, **first)
    near = cut(found.groupBy("rep").agg(best.alias("b"), F.max("crowded").alias("crowded")))
    dense = near.where("crowded").select("rep")
    n_dense = dense.count()
    lists = near.select("rep", "b")
    if n_dense:
        second = first | {"budget": CROWD_BUDGET * first["budget"], "seed": forest.SEED + 1}
        again = forest.over_blocks(reps.join(dense, "rep", "left_semi"), n_dense, block_neighbours(k, least, crowd), schema, **second)
        more = again.groupBy("rep").agg(best.alias("b"))
        both = F.flatten(F.collect_list("b"))
        lists = lists.unionByName(more).groupBy("rep").agg(F.slice(F.array_sort(F.array_distinct(both)), 1, k).alias("b"))
    near = lists.select("rep", F.inline("b")).select("rep", "other", (-F.col("far")).alias("sim"))
    k, exact = wanted, None
    if mixed:
        near = cut(near)
        kinds = all_rows.where("id = rep").select("rep", "n_copies", "mixed")
        pairs = near.select("rep", "other").join(kinds, "rep").join(kinds.select(F.col("rep").alias("other"), F.col("mixed").alias("other_mixed")), "other")
        # more than k of one direction need no others but those of cosine 1, whichever their vectors are
        pairs = cut(pairs.where(f"(mixed or other_mixed) and n_copies <= {k}").select("rep", "other"))
        exact = _exact_members(all_rows, pairs, k)
        near = near.join(pairs, ["rep", "other"], "left_anti")
    # ids of exact copies, at most k + 1 of each group
    smallest = W.partitionBy("rep").orderBy("id")
    copies = (
        all_rows.where("n_copies > 1").select("rep", "id").withColumn("_rn", F.row_number().over(smallest)).where(f"_rn <= {k + SPARE}").select("rep", "id")
    )
    other_ids = copies.withColumnRenamed("rep", "other")
    reached = near.join(other_ids, "other", "left").select("rep", F.coalesce("id", "other").alias("other"), "sim")
    own = copies.select("rep", F.col("id").alias("other"), F.lit(1.0).alias("sim"))
    lists = (
        reached.unionByName(own)
        .groupBy("rep")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("far"), "other"))), 1, k + SPARE).alias("b"))
    )
    mine = all_rows.select("id", "rep").join(lists, "rep")
    out = mine.select("id", F.inline(F.slice(F.filter("b", lambda x: x.other != F.col("id")), 1, k))).select("id", "other", (-F.col("far")).alias("sim"))
    if exact is None:
        return out
    out = out.unionByName(exact).where(F.col("sim") >= given)
    return out.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("far"), "other"))), 1, k).alias("b")).select("id", F.inline("b")).select("id", "other", (-F.col("far")).alias("sim"))


def similar_pairs(requests: DataFrame, config: DataFrame, k: int = 5, least: float = 0.8, **forest_options) -> DataFrame:
    """(id_a, id_b), id_a < id_b: one is among the k most similar of the other, with cosine >= ``least``."""
    found = most_similar(usable(requests, config), k, least, **forest_options)
    return found.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
