"""Usable vectors of a request log, exact copies, and their compact form for shuffles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut, guarded_join


#: Width of a cell of directions times the root of the dimension, and the angle to a cell's pivot within which
#: directions count as one: twice the angle, 9e-7, gives a cosine above 1 - 5e-13.
CELL, SAME = 2e-5, 4.5e-7


def usable(requests: DataFrame, config: DataFrame) -> DataFrame:
    """(grp, id, vector): for each id its usable request of greatest req_no.

    Usable: not null, of the collection's ``dim``, finite, not all zero. Null ids, null collections and
    collections without configuration are left out. ``grp`` is a 64-bit hash of the collection's name.
    """
    dims = config.where("coll_name is not null and dim is not null").groupBy("coll_name").agg(F.max("dim").alias("dim"))
    rows = requests.where("id is not null and vector is not null").select("id", "req_no", "coll_name", "vector")
    rows = guarded_join(rows, dims, ["coll_name"], spread=F.col("id"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where((F.size("vector") == F.col("dim")) & finite & F.exists("vector", lambda x: x != 0))
    newest = W.partitionBy("id").orderBy(F.desc_nulls_last("req_no"), F.col("vector").desc())
    return (
        rows.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").select(F.xxhash64("coll_name").alias("grp"), "id", "vector")
    )


def _celled(batches):
    """Adds the cell of each vector's direction, as a 64-bit hash of the unit vector on a grid."""
    for b in batches:
        cell = np.zeros(b.num_rows, np.int64)
        for at, m in lists_to_matrices(b.column("vector")):
            dim = m.shape[1]
            odd = np.random.default_rng(dim).integers(-(1 << 62), 1 << 62, dim) * 2 + 1
            cell[at] = (np.floor(unit(m) * (np.sqrt(dim) / CELL)).astype(np.int64) * odd).sum(axis=1)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=[*b.schema.names, "_cell"])


def _near_pivot(batches):
    """(id, _bundle): the cell's pivot for rows of its direction."""
    for b in batches:
        bundled = np.zeros(b.num_rows, bool)
        pivots = dict((at.tobytes(), p) for at, p in lists_to_matrices(b.column("_pv")))
        for at, m in lists_to_matrices(b.column("vector")):
            p = pivots.get(at.tobytes())
            if p is not None:
                bundled[at] = ((unit(m) - unit(p)) ** 2).sum(axis=1) <= SAME * SAME
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.asarray(b.column("_pivot")), mask=~bundled)], names=["id", "_bundle"])


def with_copies(vectors: DataFrame) -> DataFrame:
    """Adds ``rep``, the smallest id of the same direction in the group, ``n_copies`` and ``mixed``; materialised.

    Vectors are the same if 96 bits of two hashes agree. Of one direction are also those within the angle ``SAME``
    of the smallest id's vector in their cell: any two of them have a cosine that is 1 to twelve digits. ``mixed``:
    the copies are not all the same vector, so their cosines to others may differ by rounding.
    """
    keyed = cut(vectors.select("grp", "id", "vector").mapInArrow(_celled, "grp long, id long, vector array<float>, _cell long").withColumns({"_k1": F.xxhash64("vector"), "_k2": F.hash("vector")}))
    cells = keyed.groupBy("grp", "_cell").agg(F.min("id").alias("_pivot"), F.min("_k1").alias("_a"), F.max("_k1").alias("_z")).where("_a <> _z")
    cells = cut(cells.select("grp", "_cell", "_pivot"))
    rows = keyed.drop("_cell").withColumn("_bundle", F.lit(None).cast("long"))
    if not cells.isEmpty():
        own = cells.select("grp", "_pivot", F.col("_pivot").alias("id"))
        pivots = guarded_join(keyed, own, ["grp", "id"]).select("grp", "_cell", "_pivot", F.col("vector").alias("_pv"))
        beside = guarded_join(keyed, pivots, ["grp", "_cell"], spread=F.col("id"))
        bundles = cut(beside.select("id", "vector", "_pivot", "_pv").mapInArrow(_near_pivot, "id long, _bundle long").where("_bundle is not null"))
        rows = guarded_join(rows.drop("_bundle"), bundles, ["id"], "left")
    raw, bundled = F.col("_k1").alias("_raw"), F.col("_bundle").isNotNull()
    rows = rows.select("grp", "id", "vector", raw, F.coalesce("_bundle", "_k1").alias("_k1"), F.when(bundled, 0).otherwise(F.col("_k2")).alias("_k2"), bundled.alias("_b"))
    key = ["grp", "_k1", "_k2", "_b"]
    same = rows.groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("n_copies"), (F.min("_raw") != F.max("_raw")).alias("mixed"))
    return cut(rows.join(same, key).drop(*key[1:], "_raw"))


def pack(matrix: np.ndarray) -> pa.Array:
    """Rows of float32 as binary, as float16 where all rows survive that without loss."""
    with np.errstate(over="ignore"):
        small = matrix.astype(np.float16)
        exact = (small.astype(np.float32) == matrix).all()
    data = small if exact else matrix
    n, width = len(matrix), data.shape[1] * data.itemsize
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def unpack(column: pa.Array, dim: int) -> np.ndarray:
    """The float32 rows of what ``pack`` made."""
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1])
    out = np.empty((len(column), dim), np.float32)
    for width, kind in ((2, np.float16), (4, np.float32)):
        at = np.flatnonzero(sizes == dim * width)
        if len(at):
            out[at] = np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), kind).reshape(-1, dim)
    return out


def lists_to_matrices(column: pa.Array):
    """Splits an array column by length: (row numbers, matrix) for each length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths())
    flat, starts = np.asarray(column.flatten(), dtype=np.float32), np.r_[0, np.cumsum(lengths)]
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        yield at, flat[starts[at][:, None] + np.arange(dim)]


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision and safe for very large and very small numbers."""
    m = matrix.astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)
