"""Shards: a consistent hash ring, routing, scatter and gather, and what moves when a shard joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Virtual nodes of a shard; a moved vector is counted with so many bytes.
VNODES, MOVED_BYTES = 150, 512
#: Multipliers of the portable 32-bit hashes.
KEY_MUL, NODE_MUL, NODE_ADD = 2654435761, 2246822519, 374761393
LOCAL_BITS = 48
LOCAL_MASK = (1 << LOCAL_BITS) - 1


def key_hash(key: Column) -> Column:
    """A 32-bit position of a number."""
    return F.pmod(F.pmod(key, F.lit(1 << 32)) * F.lit(KEY_MUL).cast("decimal(20,0)"), F.lit(1 << 32).cast("decimal(20,0)")).cast("bigint")


def ring(shards: list[int], vnodes: int = VNODES) -> list[tuple[int, int]]:
    """Sorted (position, shard) of all virtual nodes; of nodes at one position the smaller shard holds."""
    nodes: dict[int, int] = {}
    for s in sorted(shards, reverse=True):
        for v in range(vnodes):
            nodes[((s * 1000 + v) * NODE_MUL + NODE_ADD) % (1 << 32)] = s
    return sorted(nodes.items())


def route(position: Column, nodes: list[tuple[int, int]]) -> Column:
    """The shard of the first node at or after the position, wrapping around."""
    places, owners = np.array([p for p, _ in nodes]), np.array([s for _, s in nodes])

    @F.pandas_udf("bigint")
    def owner(h: pd.Series) -> pd.Series:
        at = np.searchsorted(places, h.to_numpy(), side="left") % len(places)
        return pd.Series(owners[at])

    return owner(position)


def name_hash(name: Column) -> Column:
    """A 32-bit position of a name: the first four bytes of its MD5 sum."""
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("bigint")


def vector_hash(vector: Column) -> Column:
    """A 32-bit position of a new vector by its first four components, in millionths."""
    first = F.transform(F.slice(vector, 1, 4), lambda x: F.floor(x.cast("double") * 1_000_000 + 0.5).cast("bigint").cast("string"))
    return name_hash(F.array_join(first, ","))


def by_global_ids(rows: DataFrame, gids: DataFrame) -> DataFrame:
    """Rows (shard, id, ...) that global ids (gid) name."""
    shard, local = split_id(F.col("gid"))
    return rows.join(gids.select("gid", shard.alias("shard"), local.alias("id")), ["shard", "id"])


def global_id(shard: Column, local: Column) -> Column:
    return F.shiftleft(shard.cast("bigint"), LOCAL_BITS).bitwiseOR(local.bitwiseAND(F.lit(LOCAL_MASK)))


def split_id(gid: Column) -> tuple[Column, Column]:
    """(shard, local) of a global id."""
    return F.shiftrightunsigned(gid, LOCAL_BITS), gid.bitwiseAND(F.lit(LOCAL_MASK))


def scatter_gather(found: DataFrame, k: int) -> DataFrame:
    """(qid, shard, id, score, rank): the k best of each shard first, then of all."""
    local = F.row_number().over(W.partitionBy("qid", "shard").orderBy("score", "id"))
    best = found.withColumn("_local", local).where(F.col("_local") <= k).drop("_local")
    rank = F.row_number().over(W.partitionBy("qid").orderBy("score", "id"))
    return best.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)


def rebalance(ids: DataFrame, before: list[int], added: int) -> DataFrame:
    """(id, old_shard, new_shard) of the ids whose shard changes when one is added."""
    h = key_hash(F.col("id"))
    rows = ids.select("id", route(h, ring(before)).alias("old_shard"), route(h, ring([*before, added])).alias("new_shard"))
    return rows.where("old_shard <> new_shard")


def shard_stats(routed: DataFrame) -> DataFrame:
    """(shard, n, share)."""
    counts = routed.groupBy("shard").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("shard", "n", (F.col("n") / F.col("total")).alias("share"))
