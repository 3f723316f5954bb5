"""Session helpers: shared storage, lineage cuts and size-guarded joins."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it was counted and holds at most this many rows.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named parquet table (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where a session on one machine has none (tests) a temporary folder is made and set once; on a cluster that is an error.
    """
    sc = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if current is None:
        if not conf and not sc.master.split("[")[0] == "local":
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        conf = conf or f"file://{tempfile.mkdtemp(prefix='vantora-')}"
        sc.setCheckpointDir(conf)
        current = sc.getCheckpointDir()
    return conf or current


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def file_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if there is no folder."""
    fs, path = _hadoop(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, path = _hadoop(spark, path)
    stream = fs.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a small file appear at once under a name that is free; False where another writer has it.

    The file is written aside and renamed. A file is renamed, never a folder: HDFS refuses to rename a file onto
    an existing one, where it would move a folder into an existing one.
    """
    fs, target = _hadoop(spark, path)
    fs.mkdirs(target.getParent())
    work = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{uuid.uuid4().hex}")
    out = fs.create(work, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.exists(target) and fs.rename(work, target):
        return True
    fs.delete(work, False)
    return False


def delete_path(spark: SparkSession, path: str) -> bool:
    fs, path = _hadoop(spark, path)
    return fs.delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Blocks of queries whose plans and data the driver holds at once.
BLOCKS_AT_ONCE = 4


def settled(found: DataFrame, blocks: int) -> DataFrame:
    """The results of one of many blocks of queries: computed now if they are many, so that one block is held at a time."""
    return cut(found) if blocks > BLOCKS_AT_ONCE else found


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether the frame has at most ``rows`` rows; reads no more than needed to know."""
    return df.limit(rows + 1).count() <= rows


def guarded_join(
    big: DataFrame,
    side: DataFrame,
    on: list[str],
    how: str = "inner",
    spread: Column | None = None,
    rows: int = BROADCAST_ROWS,
    salts: int = 16,
) -> DataFrame:
    """Join ``big`` with a side that is usually small.

    The side is broadcast only after its size was checked. A larger one is joined by shuffle, whatever Spark guesses of
    its size, and its rows are repeated under ``salts`` salts so that a hot key of ``big`` spreads over as many tasks;
    with one salt, for keys that hardly repeat in ``big``, nothing is repeated.
    """
    if is_small(side, rows):
        return big.join(F.broadcast(side), on, how)
    if salts == 1:
        return big.join(side.hint("merge"), on, how)
    spread = spread if spread is not None else F.monotonically_increasing_id()
    salted = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (
        big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
        .join(salted.hint("merge"), [*on, "_salt"], how)
        .drop("_salt")
    )


def skew_join(big: DataFrame, side: DataFrame, on: list[str], count: str, how: str = "inner", hot: int = 1_000_000) -> DataFrame:
    """Join ``big`` with a side of unique keys that counts the rows of ``big`` with each key.

    Keys with at least ``hot`` rows are joined by broadcast, so that none of them meets in one task; there are at
    most rows / hot of them, and only a counted number of them is broadcast. All other keys are shuffled.
    ``how``: inner or left.
    """
    heavy = side.where(F.col(count) >= hot)
    n = heavy.limit(BROADCAST_ROWS + 1).count()
    if n == 0 or n > BROADCAST_ROWS:
        return big.join(side, on, how)
    keys = F.broadcast(heavy.select(*on))
    light = big.join(keys, on, "left_anti").join(side.where(F.col(count) < hot), on, how)
    return big.join(F.broadcast(heavy), on).unionByName(light)


def task_count(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions for ``rows`` rows of ``per_task`` each, at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def spread(df: DataFrame) -> DataFrame:
    """The frame over at least as many partitions as there are task slots; a table in few files is shuffled once."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(2 * slots)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives this package to the session's Python workers, once, so that they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}.zip"  # Spark serves it to the executors
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)
