"""Changes of a collection as frames: appends, deletes, updates, patches and compaction.

A collection is an append-only table of rows with ids and a table of deleted ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Share of deleted rows from which a collection should be rebuilt.
REBUILD_SHARE = 0.3


def dense_numbers(df: DataFrame, order: str, name: str = "number", start: int = 0) -> DataFrame:
    """Adds numbers from ``start`` in the order of a unique column; no task holds more than its range.

    Rows are range partitioned, numbered within their partition, and shifted by the sizes of the partitions
    before, which are as few as there are partitions. The partitions are materialised first, so that the
    numbers agree however often a part is recomputed.
    """
    from ..session import cut

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(df.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(W.partitionBy("_part").orderBy(order)) - 1
    numbered = rows.withColumn("_i", within).join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")  # a row for each partition
    return numbered.withColumn(name, (F.col("_i") + F.col("_before") + start).cast("bigint")).drop("_part", "_i", "_before")


def append_ids(existing: DataFrame, new_rows: DataFrame, order: str) -> DataFrame:
    """New rows with ids that follow the largest existing id, in the order given."""
    last = existing.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
    return dense_numbers(new_rows, order, "id", last + 1)


def newly_deleted(rows: DataFrame, tombstones: DataFrame, asked: DataFrame) -> DataFrame:
    """(id) of the asked ids that exist and were not deleted before, each once."""
    ids = asked.select("id").where("id is not null").distinct()
    return ids.join(rows.select("id"), "id", "left_semi").join(tombstones.select("id"), "id", "left_anti")


def updated(rows: DataFrame, changes: DataFrame, order: str = "id") -> tuple[DataFrame, DataFrame]:
    """An update deletes the old id and appends the new row: (tombstones, appended rows with new ids and ``old_id``)."""
    hit = changes.join(rows.select("id"), "id", "left_semi")
    return hit.select("id"), append_ids(rows, hit.withColumnRenamed("id", "old_id"), "old_id")


def patched(metadata: Column, patch: Column) -> Column:
    """The map with the keys of the patch replaced or added; a null map is an empty one."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    old, new = F.coalesce(metadata, empty), F.coalesce(patch, empty)
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)


def compacted(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The rows that are left, with ids renumbered densely in the old order; the old id is kept as ``old_id``."""
    left = rows.join(tombstones.select("id").distinct(), "id", "left_anti")
    return dense_numbers(left.withColumnRenamed("id", "old_id"), "old_id", "id")


def deletion_stats(rows: DataFrame, tombstones: DataFrame, share: float = REBUILD_SHARE) -> DataFrame:
    """One row: total, deleted, ratio, needs_rebuild."""
    dead = rows.join(tombstones.select("id").distinct().withColumn("dead", F.lit(1)), "id", "left")
    out = dead.agg(F.count("*").alias("total"), F.count("dead").alias("deleted"))
    ratio = F.when(F.col("total") > 0, F.col("deleted") / F.col("total")).otherwise(0.0)
    return out.select("total", "deleted", F.round(ratio, 6).alias("ratio"), (ratio >= share).alias("needs_rebuild"))
