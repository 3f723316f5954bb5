"""Files: raw vector files, JSON-lines logs in segments, and parquet tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WAL = "seq long, ts timestamp, op string, coll_name string, id long, payload string"


def read_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(id, vector) of a file of little-endian float32 records; the id is the record's place. A torn last record is an error.

    The file is cut into ranges of whole records, which the tasks read on their own.
    """
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jvm_path).getLen()
    if size % (4 * dim):
        raise ValueError("the file does not hold whole records")
    records = spark.sparkContext.binaryRecords(path, 4 * dim).zipWithIndex()
    rows = records.map(lambda r: (r[1], bytearray(r[0])))
    raw = spark.createDataFrame(rows, "id long, raw binary")

    def decode(batches):
        for b in batches:
            flat = np.frombuffer(b"".join(b.column(1).to_pylist()), "<f4")
            offsets = np.arange(b.num_rows + 1, dtype=np.int32) * dim
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "vector"])

    return raw.mapInArrow(decode, "id long, vector array<float>")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a folder of JSON-lines segments; unreadable lines are left out."""
    return spark.read.schema(WAL).json(path).where("seq is not null")


#: Entries of a log segment.
SEGMENT = 10_000
_PARTS = [c.split()[0] for c in WAL.split(", ")]


def checksum() -> Column:
    """CRC-32 of an entry's JSON form."""
    return F.crc32(F.to_json(F.struct(*_PARTS)).cast("binary"))


def write_log(entries: DataFrame, path: str, per_segment: int = SEGMENT) -> None:
    """Writes entries as JSON lines with checksums, a folder for each segment of the sequence."""
    rows = entries.select(*_PARTS).withColumn("crc", checksum()).withColumn("segment", F.floor(F.col("seq") / per_segment))
    rows.repartitionByRange("segment", "seq").sortWithinPartitions("seq").write.partitionBy("segment").mode("append").json(path)


def checked_log(spark: SparkSession, path: str) -> DataFrame:
    """The log's entries with ``intact``: whether an entry still has the checksum it was written with."""
    rows = spark.read.schema(WAL + ", crc long, segment long").json(path).where("seq is not null")
    return rows.withColumn("intact", F.coalesce(F.col("crc") == checksum(), F.lit(False)))


def tail(entries: DataFrame, after: int) -> DataFrame:
    """Entries with a sequence at or after a number."""
    return entries.where(F.col("seq") >= after)


def truncate_before(entries: DataFrame, seq: int, per_segment: int = SEGMENT) -> DataFrame:
    """What remains when the segments that lie wholly before a number are dropped: its own segment stays whole."""
    return entries.where(F.col("seq") >= seq // per_segment * per_segment)
