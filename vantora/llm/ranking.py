"""One ranking from several differently scaled scores: a walk over ranks.

From an item the walk picks one of the scores and jumps uniformly to an item that is ranked higher by it;
with a small probability it starts anew anywhere. Where no item is higher it stays. An item without that
score is below all that have it. The share of time the walk spends at an item orders the items. Only ranks
matter, so no score's range decides. A step costs sorted prefix sums, not pairs.

Small queries are walked side by side in vectorised batches. A query with more than ``TASK_ITEMS`` items is
ranked and walked by all tasks: its orders are cut into blocks, and a step adds up blocks before items.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut, skew_join, task_count

#: Items of a query that one task may hold; the limits of a batch of small queries.
TASK_ITEMS = 200_000
#: Probability of starting anew, and steps of the power iteration: each leaves at most three quarters of the
#: distance to its limit, so 128 leave 1e-16 of it, less than p4_ranking rounds.
DAMPING, STEPS = 0.25, 128
#: Ranks of a block in the distributed walk, ties or items of a task there, and steps after which it looks whether it may stop.
BLOCK, TASK_ROWS, LOOK = 4096, 200_000, 8
#: Weights are compared after rounding to so many digits of their query's mean weight.
DIGITS = 9


def out_schema(k: int) -> str:
    return "query_id long, id long, " + ", ".join(f"p{j} long" for j in range(k)) + ", weight double, place long, ahead long"


def latest_scores(results: DataFrame, scores: list[tuple[str, bool]]) -> DataFrame:
    """(query_id, id, s0, s1, ...): for each (query_id, id) the row of latest scored_at, all scores ascending = better.

    ``scores``: column and whether larger is better. Null and NaN become null; -0.0 equals 0.0. A null
    scored_at loses; of rows at one instant the greatest scores count. Null query ids and ids are left out.
    """
    clean = [F.when(~F.isnan(c), F.when(F.col(c) == 0, 0.0).otherwise(-F.col(c) if up else F.col(c))).alias(f"s{i}") for i, (c, up) in enumerate(scores)]
    rows = results.where("query_id is not null and id is not null").select("query_id", "id", F.struct("scored_at", *clean).alias("r"))
    return rows.groupBy("query_id", "id").agg(F.max("r").alias("r")).select("query_id", "id", *[f"r.s{i}" for i in range(len(scores))])


def walk(query: np.ndarray, scores: np.ndarray, damping: float = DAMPING, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Places (0: none) and weights of the items of many queries at once; ``query`` must be sorted."""
    n, k = scores.shape
    start = np.searchsorted(query, query)
    stop = np.searchsorted(query, query, side="right")
    size = stop - start
    places, orders, better, ends, heads = np.zeros((n, k), np.int64), [], [], [], []
    for j in range(k):
        s = scores[:, j]
        order = np.lexsort((s, query))  # NaN last
        q, v = query[order], s[order]
        new = np.r_[True, (q[1:] != q[:-1]) | ((v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1])))] if n else np.zeros(0, bool)
        at = np.arange(n)
        lead = np.maximum.accumulate(np.where(new, at, 0))  # first of the tie, in sorted order
        tail = np.r_[np.flatnonzero(new)[1:], n][np.cumsum(new) - 1] if n else at
        has = ~np.isnan(v)
        places[order, j] = np.where(has, lead - start[order] + 1, 0)
        orders.append(order)
        better.append(lead - start[order])  # without the score: all that have it
        ends.append(np.where(has, tail, stop[order]))  # worse items lie from here to the end of the query
        heads.append(stop[order])
    weight = 1.0 / np.maximum(size, 1)
    base = damping / np.maximum(size, 1)
    for _ in range(steps):
        total = np.zeros(n)
        for order, b, e, h in zip(orders, better, ends, heads):
            w = weight[order] / k
            sums = np.r_[0.0, np.cumsum(np.where(b > 0, w / np.maximum(b, 1), 0.0))]
            total[order] += np.where(b == 0, w, 0.0) + np.maximum(sums[h] - sums[e], 0.0)
        weight = base + (1 - damping) * total
    return places, weight


def ordered(query: np.ndarray, ids: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rounded weights, places by them (ties to the smaller id) and how many items have a greater weight; ``query`` must be sorted."""
    start = np.searchsorted(query, query)
    size = np.maximum(np.searchsorted(query, query, side="right") - start, 1)
    scaled = np.round(weight * size, DIGITS)
    order = np.lexsort((ids, -scaled, query))
    place, ahead, at = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64), np.arange(len(ids))
    q, v = query[order], scaled[order]
    new = np.r_[True, (q[1:] != q[:-1]) | (v[1:] != v[:-1])][: len(ids)]
    place[order] = at - start[order] + 1
    ahead[order] = np.maximum.accumulate(np.where(new, at, 0)) - start[order]
    return scaled / size, place, ahead


def _small(damping: float, steps: int):
    def flush(rows: pa.Table):
        q = rows["query_id"].to_numpy()
        s = np.stack([rows[c].to_numpy(zero_copy_only=False).astype(np.float64) for c in rows.column_names if c.startswith("s")], axis=1)
        places, weight = walk(q, s, damping, steps)
        weight, place, ahead = ordered(q, rows["id"].to_numpy(), weight)
        cols = [rows["query_id"].combine_chunks(), rows["id"].combine_chunks(), *[pa.array(places[:, j], mask=places[:, j] == 0) for j in range(s.shape[1])], pa.array(weight), pa.array(place), pa.array(ahead)]
        return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols], names=["query_id", "id", *[f"p{j}" for j in range(s.shape[1])], "weight", "place", "ahead"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) < 20_000:
                continue
            rows = pa.Table.from_batches(held)
            q = rows["query_id"].to_numpy()
            done = int(np.searchsorted(q, q[-1]))  # the last query may go on in the next batch
            if done:
                yield flush(rows.slice(0, done))
            held = rows.slice(done).to_batches()
        if held:
            yield flush(pa.Table.from_batches(held))

    return run


def _before(values: DataFrame, order: list, count: str, parts: int) -> DataFrame:
    """Adds ``before``, the sum of ``count`` over the query's rows that come earlier; no task holds a whole query.

    Rows are range partitioned by query and ``order``, summed up within their partition and shifted by the
    partitions before.
    """
    rows = cut(values.repartitionByRange(parts, "query_id", *order).withColumn("_part", F.spark_partition_id()))
    earlier = (W.unboundedPreceding, -1)
    within = F.coalesce(F.sum(count).over(W.partitionBy("query_id", "_part").orderBy(*order).rowsBetween(*earlier)), F.lit(0))
    sizes = rows.groupBy("query_id", "_part").agg(F.sum(count).alias("_n"))
    shift = F.coalesce(F.sum("_n").over(W.partitionBy("query_id").orderBy("_part").rowsBetween(*earlier)), F.lit(0))
    # a row for each partition and query in it
    sizes = sizes.select("query_id", "_part", shift.alias("_shift"))
    return rows.withColumn("_within", within).join(sizes, ["query_id", "_part"]).withColumn("before", F.col("_within") + F.col("_shift")).drop("_part", "_within", "_shift")


def _ranked(rows: DataFrame, j: int, parts: int) -> DataFrame:
    """Adds p<j> (place, null without the score) and b<j> (how many are better).

    Ties are one row while places are counted, and a tie of very many items is joined by broadcast.
    """
    name, s = f"s{j}", F.col(f"s{j}")
    has = rows.where(s.isNotNull())
    ties = cut(_before(has.groupBy("query_id", name).agg(F.count("*").alias("n_tie")), [name], "n_tie", parts))
    ranked = skew_join(has, ties, ["query_id", name], "n_tie").drop("n_tie").withColumn(f"p{j}", F.col("before") + 1)
    # items without the score are below all that have it; the large queries are few
    having = ties.groupBy("query_id").agg(F.sum("n_tie").alias("before"))
    none = rows.where(s.isNull()).join(F.broadcast(having), "query_id", "left").withColumn(f"p{j}", F.lit(None).cast("long"))
    both = ranked.unionByName(none.select(ranked.columns))
    return both.withColumn(f"b{j}", F.coalesce("before", F.lit(0))).drop("before")


def large_walk(rows: DataFrame, k: int, damping: float = DAMPING, steps: int = STEPS, block: int = BLOCK) -> DataFrame:
    """The same walk for queries of any size, as joins and windows over blocks of ranks."""
    parts = task_count(rows.sparkSession, rows.count(), TASK_ROWS)
    for j in range(k):
        rows = _ranked(rows, j, parts)
    sizes = rows.groupBy("query_id").agg(F.count("*").alias("n"))
    keep = ["query_id", "id", *[f"p{j}" for j in range(k)], *[f"b{j}" for j in range(k)], "n"]
    # items that lack a score share one place below all others, which nobody jumps to: their mass is one sum
    rows = cut(rows.join(sizes, "query_id").select(*keep, (1.0 / F.col("n")).alias("weight")))
    for step in range(steps):
        gains = None
        for j in range(k):
            b, p = F.col(f"b{j}"), F.col(f"p{j}")
            out = F.when(b > 0, F.col("weight") / k / b).otherwise(0.0)
            # mass leaving each tie, by place; ties are added up before the shuffle
            ties = rows.groupBy("query_id", F.coalesce(p, F.lit(2**62)).alias("place")).agg(F.sum(out).alias("mass"))
            ties = ties.withColumn("blk", F.floor(F.col("place") / block))
            blocks = ties.groupBy("query_id", "blk").agg(F.sum("mass").alias("m"))
            after = F.coalesce(F.sum("m").over(W.partitionBy("query_id").orderBy(F.desc("blk")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
            blocks = blocks.select("query_id", "blk", after.alias("later"))
            worse = F.coalesce(F.sum("mass").over(W.partitionBy("query_id", "blk").orderBy(F.desc("place")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
            come = ties.withColumn("worse", worse).join(blocks, ["query_id", "blk"]).select("query_id", F.col("place").alias("_at"), (F.col("worse") + F.col("later")).alias(f"g{j}"))
            # items without a place match nothing; they are spread
            at = F.coalesce(p, -1 - F.pmod(F.xxhash64("id"), F.lit(4096)))
            gains = (rows if gains is None else gains).withColumn("_at", at).join(come, ["query_id", "_at"], "left").drop("_at")
        total = None
        for j in range(k):
            part = F.coalesce(F.col(f"g{j}"), F.lit(0.0)) + F.when(F.col(f"b{j}") == 0, F.col("weight") / k).otherwise(0.0)
            total = part if total is None else total + part
        moved = gains.withColumn("_old", F.col("weight")).withColumn("weight", F.lit(damping) / F.col("n") + (1 - damping) * total)
        rows = cut(moved.select(*keep, "weight", "_old"))
        if step % LOOK == LOOK - 1 and rows.agg(F.max(F.abs(F.col("weight") - F.col("_old")) * F.col("n"))).first()[0] < 10.0 ** (-DIGITS - 2):
            break
        rows = rows.drop("_old")
    rows = rows.withColumn("_w", F.round(F.col("weight") * F.col("n"), DIGITS)).withColumn("one", F.lit(1))
    ties = rows.groupBy("query_id", "_w").agg(F.count("*").alias("n_tie")).withColumn("_far", -F.col("_w"))
    ties = _before(ties, ["_far"], "n_tie", parts).select("query_id", "_w", "n_tie", F.col("before").alias("ahead"))
    rows = skew_join(rows, cut(ties), ["query_id", "_w"], "n_tie").withColumn("_far", -F.col("_w"))
    rows = _before(rows, ["_far", "id"], "one", parts)
    return rows.select("query_id", "id", *[F.col(f"p{j}").cast("long") for j in range(k)], (F.col("_w") / F.col("n")).alias("weight"), (F.col("before") + 1).cast("long").alias("place"), F.col("ahead").cast("long"))


def rank_walk(results: DataFrame, scores: list[tuple[str, bool]], task_items: int = TASK_ITEMS, damping: float = DAMPING, steps: int = STEPS, block: int = BLOCK) -> DataFrame:
    """(query_id, id, p0.., weight, place, ahead): each item's place by each score (null: none) and its share of the walk.

    A place is 1 + the number of items that are better. Ties share a place. Weights are rounded to nine digits of
    their query's mean weight; ``place`` orders the items by weight and id, ``ahead`` counts those of greater
    weight. No rows give no rows.
    """
    rows = latest_scores(results, scores)
    k = len(scores)
    big = rows.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") > task_items).select("query_id")
    big_rows = cut(big)
    schema = out_schema(k)
    if big_rows.isEmpty():
        return rows.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(_small(damping, steps), schema)
    # the large queries are at most rows / task_items many
    rows = cut(rows)
    small = rows.join(F.broadcast(big_rows), "query_id", "left_anti") if big_rows.count() < 10_000 else rows.join(big_rows, "query_id", "left_anti")
    small = small.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(_small(damping, steps), schema)
    large = rows.join(F.broadcast(big_rows), "query_id", "left_semi") if big_rows.count() < 10_000 else rows.join(big_rows, "query_id", "left_semi")
    return small.unionByName(large_walk(large, k, damping, steps, block))


def leaders(ranked: DataFrame, most: int, k: int) -> DataFrame:
    """(query_id, id) of the items that are among the first ``most`` places by all ``k`` scores, of the walk's leaders.

    An item that is no better than another by any score gets no more weight: whatever jumps to it may also jump to
    the other, with the same chance. So only what is better by a score can have more weight, which at most
    ``most`` - 1 items are by each: such an item has at most k * (most - 1) ahead of it in the walk. Its places by the
    scores are then looked at.
    """
    within = [F.col(f"p{j}") <= most for j in range(k)]
    first = ranked.where(F.col("ahead") <= k * (most - 1))
    for condition in within:
        first = first.where(condition)
    return first.select("query_id", "id")
