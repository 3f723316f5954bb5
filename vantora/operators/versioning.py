"""Version histories: append-only rows (vector_id, version_id, ts, is_deleted, ...), read as of any time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Versions of a vector that are kept by default.
MAX_VERSIONS = 100


def _newest_first():
    return W.partitionBy("vector_id").orderBy(F.desc("version_id"))


def retained(history: DataFrame, most: int = MAX_VERSIONS) -> DataFrame:
    """The newest ``most`` versions of each vector; the limit is applied before the shuffle."""
    return history.withColumn("_rn", F.row_number().over(_newest_first())).where(F.col("_rn") <= most).drop("_rn")


def latest(history: DataFrame) -> DataFrame:
    """The newest version of each vector, also if it marks a deletion."""
    return retained(history, 1)


def as_of(history: DataFrame, ts) -> DataFrame:
    """The newest version of each vector at a time, deletion marks included."""
    return latest(history.where(F.col("ts") <= ts))


def snapshot_at(history: DataFrame, ts) -> DataFrame:
    """All vectors that were live at a time."""
    return as_of(history, ts).where("not is_deleted")


def in_range(history: DataFrame, start, end) -> DataFrame:
    """Versions made between two times, both included."""
    return history.where(F.col("ts").between(start, end))


def version(history: DataFrame, vector_id: int, version_id: int) -> DataFrame:
    return history.where((F.col("vector_id") == vector_id) & (F.col("version_id") == version_id))


def active_ids(history: DataFrame) -> DataFrame:
    return latest(history).where("not is_deleted").select("vector_id")


def modified_since(history: DataFrame, ts) -> DataFrame:
    """(vector_id) with a version after a time."""
    return history.where(F.col("ts") > ts).select("vector_id").distinct()


def rollback(history: DataFrame, targets: DataFrame, ts: Column, next_version: int) -> DataFrame:
    """New versions copied from old ones: ``targets`` (vector_id, version_id). Missing and deleted targets give none."""
    from .mutation import dense_numbers

    old = history.join(targets, ["vector_id", "version_id"], "left_semi").where("not is_deleted")
    text = F.concat(F.lit("rollback to version "), F.col("version_id").cast("string"))
    new = old.withColumns({"description": text, "ts": ts}).drop("version_id")
    return dense_numbers(new, "vector_id", "version_id", next_version)


def deleted(history: DataFrame, ids: DataFrame, ts: Column, next_version: int) -> DataFrame:
    """Marker versions that delete the given ids (vector_id): one for each that is live; the other columns are null."""
    live = active_ids(history).join(ids.select("vector_id").distinct(), "vector_id", "left_semi")
    from .mutation import dense_numbers

    marks = dense_numbers(live, "vector_id", "version_id", next_version).withColumns({"ts": ts, "is_deleted": F.lit(True)})
    rest = [F.lit(None).cast(t).alias(n) for n, t in history.dtypes if n not in ("vector_id", "version_id", "ts", "is_deleted")]
    return marks.select("vector_id", "version_id", "ts", "is_deleted", *rest).select(history.columns)


def diff(history: DataFrame, value: Column, keys: Column) -> DataFrame:
    """Each version against the one before: whether the value changed and by how much, keys added, removed and kept."""
    rows = history.select("vector_id", "version_id", value.alias("value"), keys.alias("keys"))
    before = W.partitionBy("vector_id").orderBy("version_id")
    rows = rows.withColumns({"from_version": F.lag("version_id").over(before), "old_value": F.lag("value").over(before), "old_keys": F.lag("keys").over(before)})
    rows = rows.where("from_version is not null")
    return rows.select(
        "vector_id", "from_version", F.col("version_id").alias("to_version"),
        (~F.col("value").eqNullSafe(F.col("old_value"))).alias("value_changed"),
        F.abs(F.col("value") - F.col("old_value")).alias("distance"),
        F.array_sort(F.array_except("keys", "old_keys")).alias("added"),
        F.array_sort(F.array_except("old_keys", "keys")).alias("removed"),
        F.array_sort(F.array_intersect("keys", "old_keys")).alias("kept"),
    )


def compact(history: DataFrame, cutoff, keep_deleted: bool = True) -> DataFrame:
    """Drops versions before a time, and deletion marks if wanted, but never the newest version of a vector."""
    newest = history.groupBy("vector_id").agg(F.max("version_id").alias("_newest"))
    rows = history.join(newest, "vector_id")
    keep = F.col("ts") >= cutoff
    if not keep_deleted:
        keep = keep & ~F.col("is_deleted")
    return rows.where(keep | (F.col("version_id") == F.col("_newest"))).drop("_newest")


def stats(history: DataFrame) -> DataFrame:
    """One row: vectors, live and deleted ones, versions, mean versions, next version id."""
    one = history.groupBy("vector_id").agg(F.count("*").alias("n"), F.max("version_id").alias("last"), F.max_by("is_deleted", "version_id").alias("gone"))
    return one.agg(
        F.count("*").alias("n_vectors"), F.count_if(~F.col("gone")).alias("n_active"), F.count_if("gone").alias("n_deleted"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_versions"),
        F.round(F.avg("n"), 6).alias("mean_versions"), (F.coalesce(F.max("last"), F.lit(0)) + 1).alias("next_version"),
    )
