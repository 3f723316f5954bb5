"""Processing only new or changed records: a high watermark per consumer over a commit sequence.

A run fixes its upper bound when it starts, selects what lies between the watermark and that bound, and
publishes the selected rows together with the new watermark by one rename. A run that dies before the
rename leaves no trace that a later run reads; one that dies after it is complete. The next run starts from
what was published, so nothing is skipped and nothing comes twice.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, delete_path, file_names, guarded_join, publish_text, read_text

#: Absent parts of a fingerprint must differ from every present text.
_NONE = "\u0000"


def last_success(runs: DataFrame) -> DataFrame:
    """One row for each replica with the watermark of its latest successful run.

    ``runs``: replica, primary_addr, last_seq, last_sync, status. Success is status ``Synced`` in any case and
    with any outer blanks. The latest ``last_sync`` wins, then the greatest ``last_seq``; a null ``last_sync``
    loses against any other. A replica without success keeps its primary and gets a null watermark, and so
    does one whose last success has no ``last_seq``. Rows without a replica or primary are ignored.
    """
    ok = F.lower(F.trim("status")) == "synced"
    mark = F.when(ok, F.struct("last_sync", "last_seq"))
    return (
        runs.where(F.col("replica").isNotNull() & F.col("primary_addr").isNotNull())
        .groupBy("replica", "primary_addr")
        .agg(F.max(mark).alias("_m"))
        .select("replica", "primary_addr", F.col("_m.last_seq").alias("low_seq"), F.col("_m.last_sync").alias("low_time"))
    )


def entry_versions(entries: DataFrame) -> DataFrame:
    """One row for each (primary_addr, seq): first and last arrival, and whether its copies differ.

    Copies differ if op, coll_name, id or payload do. Everything is a min or max, so copies of a hot entry are
    combined before the shuffle. Rows without primary_addr or seq are ignored; null arrivals count for nothing.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit(_NONE)) for c in ("op", "coll_name", "id", "payload")]
    return (
        entries.where(F.col("primary_addr").isNotNull() & F.col("seq").isNotNull())
        .select("primary_addr", "seq", "arrived_at", F.xxhash64(*text).alias("_fp"))
        .groupBy("primary_addr", "seq")
        .agg(
            F.min("arrived_at").alias("first_at"),
            F.max("arrived_at").alias("last_at"),
            (F.min("_fp") != F.max("_fp")).alias("changed"),
        )
    )


def upper_bound(entries: DataFrame) -> DataFrame:
    """The bound a run fixes at its start: the greatest seq and arrival of each primary."""
    return entries.where(F.col("primary_addr").isNotNull()).groupBy("primary_addr").agg(
        F.max("seq").alias("high_seq"), F.max("arrived_at").alias("high_time")
    )


def changes_since(entries: DataFrame, marks: DataFrame, bound: DataFrame | None = None) -> DataFrame:
    """(replica, seq) of every entry that is new or changed since the replica's watermark.

    An entry is new if its seq lies above the watermark or its first copy arrived after it, and changed if its
    copies differ and the last of them arrived after it: that last copy then differs from an earlier one. With
    a ``bound`` entries beyond it are left to the next run.
    """
    found = guarded_join(entry_versions(entries), marks, ["primary_addr"], spread=F.col("seq"))
    new = F.col("low_time").isNull() & F.col("low_seq").isNull()
    new = new | F.col("low_seq").isNull() | (F.col("seq") > F.col("low_seq")) | (F.col("first_at") > F.col("low_time"))
    hit = F.coalesce(new | (F.col("changed") & (F.col("last_at") > F.col("low_time"))), F.lit(False))
    found = found.where(hit)
    if bound is not None:
        found = guarded_join(found, bound, ["primary_addr"], spread=F.col("seq")).where(
            (F.col("seq") <= F.col("high_seq")) & (F.col("first_at").isNull() | (F.col("first_at") <= F.col("high_time")))
        )
    return found.select("replica", "seq")


@dataclass
class CommittedRuns:
    """Runs of one consumer under ``root``: a manifest ``run-N`` names the run's folder of rows and watermark.

    Rows and watermark are written into a folder of their own name; the manifest then appears by one rename, so a
    run is there as a whole or not at all, and a run that dies leaves a folder that nobody reads. Two writers
    of one number have different folders, and only one gets the manifest.
    """

    spark: SparkSession
    root: str

    def committed(self) -> list[int]:
        """Numbers of the runs that were published."""
        return sorted(int(n[4:]) for n in file_names(self.spark, self.root) if n.startswith("run-"))

    def _folder(self, run: int) -> str:
        return json.loads(read_text(self.spark, f"{self.root}/run-{run}"))["folder"]

    def marks(self, run: int | None = None) -> DataFrame | None:
        """The watermarks that a run (the last one) published, or None before the first."""
        runs = self.committed()
        if not runs:
            return None
        return self.spark.read.parquet(f"{self._folder(runs[-1] if run is None else run)}/mark")

    def rows(self, run: int) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder(run)}/rows")

    def publish(self, run: int, rows: DataFrame, mark: DataFrame) -> DataFrame:
        """Writes rows and watermark, publishes both at once, and gives the published rows."""
        folder = f"{self.root}/data/{run}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{folder}/rows")
        mark.coalesce(1).write.parquet(f"{folder}/mark")
        if not publish_text(self.spark, f"{self.root}/run-{run}", json.dumps({"folder": folder})):
            delete_path(self.spark, folder)
            raise RuntimeError(f"run {run} was published by another writer")
        return self.spark.read.parquet(f"{folder}/rows")

    def replicate(self, entries: DataFrame, runs: DataFrame) -> DataFrame:
        """One run for all replicas: what is new or changed since each one's watermark, up to a bound fixed at the start.

        A replica's watermark is the one this consumer published last; ``runs`` gives those of replicas that it does
        not know yet. The new watermarks (the bound, never below the old one) are published with the rows, so
        a second run over the same entries gives none. Entries without an arrival are new by their seq only.
        """
        earlier = self.committed()
        seed = last_success(runs)
        marks = seed
        if earlier:
            known = self.marks().select("replica", "primary_addr", "low_seq", "low_time")
            marks = cut(known.unionByName(seed.join(known, ["replica", "primary_addr"], "left_anti")))
        bound = cut(upper_bound(entries))
        found = changes_since(entries, marks, bound)
        new = marks.join(bound, "primary_addr", "left").select("replica", "primary_addr", F.greatest("low_seq", "high_seq").alias("low_seq"), F.greatest("low_time", "high_time").alias("low_time"))
        return self.publish((earlier or [0])[-1] + 1, found, new)

    def process(self, source: DataFrame, seq: str, transform=lambda df: df, key: list[str] | None = None) -> int | None:
        """Process the rows of ``source`` above the watermark, once; gives the run's number, None if none is new.

        The bound is read first, so rows that arrive while the run works belong to the next one. ``seq`` must
        not fall from commit to commit; rows with a null ``seq`` are never selected. Where several rows may have one
        ``seq``, and one of them may come after a run has seen the others, ``key`` names the columns that tell
        rows apart: rows at the watermark itself are then taken again unless their key was processed. Keys must be
        unique within a ``seq``; the published mark holds those at the bound.
        """
        runs = self.committed()
        mark = self.marks() if runs else None
        newer = source.where(F.col(seq).isNotNull())
        if mark is not None:
            low = mark.select(F.max("seq")).first()[0]
            if key is None:
                newer = newer.where(F.col(seq) > F.lit(low))
            else:
                seen = mark.where("key is not null").select(F.col("seq").alias(seq), F.col("key").alias("_key"))
                newer = newer.where(F.col(seq) >= F.lit(low)).withColumn("_key", F.to_json(F.struct(*key))).join(seen, [seq, "_key"], "left_anti").select(*source.columns)
        high = newer.agg(F.max(seq)).first()[0]
        if high is None:
            return None
        run = (runs or [0])[-1] + 1
        taken = newer.where(F.col(seq) <= F.lit(high))
        if key is None:
            new = self.spark.createDataFrame([(high, None)], "seq long, key string")
        else:
            taken = cut(taken)  # the rows and their keys must be of one reading
            new = taken.where(F.col(seq) == F.lit(high)).select(F.col(seq).cast("long").alias("seq"), F.to_json(F.struct(*key)).alias("key"))
            if mark is not None and high == low:
                new = new.unionByName(mark.where("key is not null").select("seq", "key"))
        self.publish(run, transform(taken), new)
        return run
