"""Ingest by micro-batches: every batch is checked, appended once and counted.

A batch is written under its number, so one that is repeated after a failure replaces what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mutation import dense_numbers
from ..session import file_names, publish_text


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A parquet folder or file as a stream, with the schema it has now."""
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # a pattern, since a stream takes a plain path for a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def append_batches(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Runs through what the stream has now and appends every batch as ``target/batch=N``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def catch_up(spark: SparkSession, log: str, after: int, target: str, checkpoint: str) -> None:
    """A replica's stream: entries of a folder of log segments from a number on, appended batch by batch.

    Segments that were taken are remembered in the checkpoint, so a later call takes new ones only.
    """
    from ..sources.files import WAL

    entries = spark.readStream.schema(WAL).option("recursiveFileLookup", True).json(log)
    append_batches(entries.where(F.col("seq") >= after), target, checkpoint)


def append_with_progress(stream: DataFrame, target: str, checkpoint: str) -> list[dict]:
    """``append_batches`` that tells for each batch its number, rows and the rows so far."""
    seen: list[dict] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")
        n = batch.sparkSession.read.parquet(f"{target}/batch={number}").count()
        seen.append({"batch": number, "rows": n, "total": (seen[-1]["total"] if seen else 0) + n})

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return seen


def append_groups(stream: DataFrame, keys: list[str], aggregates, target: str, checkpoint: str) -> None:
    """Incremental statistics: partial aggregates of each batch, to be added up by the reader."""

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(*aggregates).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def running_counts(stream: DataFrame, keys: list[str], aggregates, target: str, checkpoint: str) -> None:
    """Statistics kept as the stream's state: every batch writes the whole current result under its number.

    A result counts once it is marked as done, so a reader (``latest_result``) never meets half of one.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")
        publish_text(spark, f"{target}/done/{number}", "")

    counts = stream.groupBy(*keys).agg(*aggregates)
    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_result(spark: SparkSession, target: str) -> DataFrame:
    """The last whole result of ``running_counts``."""
    done = [int(n) for n in file_names(spark, f"{target}/done") if n.isdigit()]
    if not done:
        raise KeyError(f"no result in {target}")
    return spark.read.parquet(f"{target}/batch={max(done)}")


def windowed_counts(stream: DataFrame, time: str, window: str, late: str, keys: list[str]) -> DataFrame:
    """Rows in each window of event time; rows later than the watermark are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("n"))


def chunk_progress(rows: DataFrame, order: str, chunk: int) -> DataFrame:
    """(chunk, rows, done, percent) of an upload in chunks of ``chunk`` rows."""
    numbered = dense_numbers(rows, order, "number")
    sizes = numbered.groupBy(F.floor(F.col("number") / chunk).cast("bigint").alias("chunk")).agg(F.count("*").alias("rows"))
    total = numbered.agg(F.count("*").alias("total"))
    # all chunks but the last are full, so what is done follows from the number
    done = F.least((F.col("chunk") + 1) * chunk, F.col("total"))
    return sizes.crossJoin(F.broadcast(total)).select("chunk", "rows", done.alias("done"), F.round(100.0 * done / F.col("total"), 6).alias("percent"))
