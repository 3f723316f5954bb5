"""Codes for vectors: scalar quantization, product quantization and sign bits.

Training statistics are aggregates over all vectors; only codebooks and limits, whose size is that of a few
vectors, reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as vec
from ..session import settled

#: A range below this has no scale of its own.
TINY = 1e-10
#: Vectors that a codebook is trained on at most, chosen by a hash of their id; encoding covers all vectors.
TRAIN_ROWS = 65_536
#: Subspaces of a product code by dimension, codes of a subspace.
SUBSPACES = ((32, 4), (128, 8), (512, 16))
CODES = 256


def dim_limits(vectors: DataFrame) -> DataFrame:
    """(pos, lo, hi, scale): limits of each component; scale is 255 / range, 1 where the range is nothing."""
    rows = vectors.select(F.posexplode("vector").alias("pos", "x")).select("pos", F.col("x").cast("double").alias("x"))
    out = rows.groupBy("pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return out.withColumn("scale", F.when(F.col("hi") - F.col("lo") > TINY, 255.0 / (F.col("hi") - F.col("lo"))).otherwise(1.0))


@dataclass(frozen=True)
class ScalarQuantizer:
    """Bytes for components, between limits learnt from all vectors."""

    lo: tuple[float, ...]
    scale: tuple[float, ...]

    @classmethod
    def train(cls, vectors: DataFrame) -> ScalarQuantizer:
        rows = dim_limits(vectors).orderBy("pos").collect()  # a row for each component
        return cls(tuple(r.lo for r in rows), tuple(r.scale for r in rows))

    def _arrays(self):
        return F.array(*map(F.lit, self.lo)), F.array(*map(F.lit, self.scale))

    def encode(self, vector: Column) -> Column:
        lo, scale = self._arrays()
        steps = F.zip_with(F.zip_with(vector, lo, lambda x, m: x.cast("double") - m), scale, lambda x, s: x * s)
        return F.transform(steps, lambda x: F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(255)).cast("int"))

    def decode(self, code: Column) -> Column:
        lo, scale = self._arrays()
        return F.zip_with(F.zip_with(code, scale, lambda q, s: q / s), lo, lambda x, m: x + m)

    def pack(self, vectors: DataFrame, column: str = "vector") -> DataFrame:
        """(id, code): a byte for each component, to be stored."""
        lo, scale = np.array(self.lo), np.array(self.scale)

        def run(batches):
            for b in batches:
                for at, m in by_length(b.column(1)):
                    codes = np.clip(np.floor((m.astype(np.float64) - lo) * scale), 0, 255).astype(np.uint8)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), binary(codes)], names=["id", "code"])

        rows = vectors.where(F.col("id").isNotNull() & (F.size(column) == len(self.lo)))
        return rows.select("id", column).mapInArrow(run, "id long, code binary")

    def search(self, coded: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """(qid, id, score, rank): squared distances of float queries to byte codes, by one product with the bytes.

        |q - (c / s + lo)|^2 = |q - lo|^2 - 2 (q - lo) / s . c + |c / s|^2, so nothing is decoded.
        """
        lo, scale = np.array(self.lo), np.array(self.scale)

        def scorer(q: np.ndarray):
            shifted = q - lo
            square, factor = (shifted * shifted).sum(axis=1)[:, None], shifted / scale

            def score(codes: np.ndarray) -> np.ndarray:
                c = codes.astype(np.float64)
                return np.maximum(0.0, square - 2 * factor @ c.T + ((c / scale) ** 2).sum(axis=1))

            return score

        return code_search(coded.select("id", "code"), queries.where(F.size("qvec") == len(self.lo)), k, scorer, lambda dim: dim)

    def symmetric(self, a: Column, b: Column) -> tuple[Column, Column]:
        """Squared distance of two codes: by the mean scale, and by each component's own."""
        lo, scale = self._arrays()
        raw = F.zip_with(a, b, lambda x, y: ((x - y) * (x - y)).cast("double"))
        mean = sum(1 / (s * s) if s > TINY else 0.0 for s in self.scale) / max(1, len(self.scale))
        return vec.total(raw) * mean, vec.total(F.zip_with(raw, scale, lambda x, s: F.when(s > TINY, x / (s * s)).otherwise(0.0)))


def memory_stats(vectors: DataFrame) -> DataFrame:
    """One row: bytes of the vectors as floats and as byte codes."""
    n = F.count("vector")
    dim = F.coalesce(F.max(F.size("vector")), F.lit(0)).cast("bigint")
    out = vectors.agg(n.alias("n_vectors"), dim.alias("dim"))
    raw = F.col("n_vectors") * F.col("dim") * 4
    code = F.col("n_vectors") * F.col("dim") + F.col("dim") * 8
    return out.select("n_vectors", "dim", raw.alias("float_bytes"), code.alias("code_bytes"), F.round(raw / F.greatest(code, F.lit(1)), 6).alias("ratio"))


# product quantization


def subspaces(dim: int) -> int:
    """The number of subspaces for a dimension."""
    return next((m for most, m in SUBSPACES if dim <= most), 32)


def kmeans(points: np.ndarray, k: int, rounds: int = 25, tolerance: float = 1e-6) -> np.ndarray:
    """Lloyd's iterations from evenly spaced rows; an empty cluster starts anew at the point farthest from its centre."""
    n = len(points)
    centres = points[(np.arange(min(k, n)) * n) // max(1, min(k, n))].astype(np.float64)
    for _ in range(rounds):
        d = (points**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * points @ centres.T
        own = d.argmin(axis=1)
        new = centres.copy()
        for c in range(len(centres)):
            rows = points[own == c]
            new[c] = rows.mean(axis=0) if len(rows) else points[d.min(axis=1).argmax()]
        moved = np.abs(new - centres).max() if len(centres) else 0.0
        centres = new
        if moved < tolerance:
            break
    return centres


def training_sample(vectors: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most about ``rows`` vectors, the same in every run."""
    n = vectors.count()
    if n <= rows:
        return vectors
    return vectors.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < int(1_000_003 * rows / n))


def train_codebook(vectors: DataFrame, m: int, codes: int = CODES, rounds: int = 25) -> DataFrame:
    """(m, code, centroid): k-means in each subspace, a task for each, on a bounded sample."""
    dim = vectors.select(F.size("vector").alias("n")).first()
    if dim is None:
        return vectors.sparkSession.createDataFrame([], "m int, code int, centroid array<double>")
    width = dim.n // m
    parts = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.struct(i.cast("int").alias("m"), F.slice("vector", i * width + 1, width).alias("x")))
    rows = training_sample(vectors).select("id", F.inline(parts))

    def train(key, pdf):
        pdf = pdf.sort_values("id")
        centres = kmeans(np.stack(pdf["x"].to_numpy()).astype(np.float64), codes, rounds)
        import pandas as pd

        return pd.DataFrame({"m": key[0], "code": np.arange(len(centres), dtype=np.int32), "centroid": list(centres)})

    return rows.groupBy("m").applyInPandas(train, "m int, code int, centroid array<double>")


class ProductQuantizer:
    """Codes of subvectors; ``books`` is (m, codes, width)."""

    def __init__(self, books: np.ndarray):
        self.books = np.asarray(books, np.float64)

    @classmethod
    def of(cls, codebook: DataFrame) -> ProductQuantizer:
        rows = codebook.orderBy("m", "code").collect()  # m * codes short vectors
        m = 1 + max(r.m for r in rows)
        return cls(np.array([[r.centroid for r in rows if r.m == i] for i in range(m)]))

    def encode(self, vectors: DataFrame, column: str = "vector") -> DataFrame:
        """(id, codes): the nearest centroid of each subspace, the smaller code on a tie (distances to nine digits)."""
        books = self.books

        def run(batches):
            for b in batches:
                column = b.column(1)
                x = np.asarray(column.flatten(), np.float64).reshape(-1, books.shape[0], books.shape[2])
                out = np.empty(x.shape[:2], np.int32)
                for i in range(books.shape[0]):
                    for lo in range(0, len(x), 2_048):
                        d = ((x[lo : lo + 2_048, i, None, :] - books[i]) ** 2).sum(axis=2)
                        out[lo : lo + 2_048, i] = np.round(d, 9).argmin(axis=1)
                offsets = np.arange(len(x) + 1, dtype=np.int32) * books.shape[0]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))], names=["id", "codes"])

        width = books.shape[0] * books.shape[2]
        rows = vectors.where(F.col("id").isNotNull() & (F.size(column) == width))
        return rows.select("id", column).mapInArrow(run, "id long, codes array<int>")

    def decode(self, codes: Column) -> Column:
        books = F.array(*[F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in book]) for book in self.books])
        return F.flatten(F.transform(codes, lambda c, i: F.get(F.get(books, i), c)))

    def search(self, coded: DataFrame, queries: DataFrame, k: int, block: int = 512) -> DataFrame:
        """(qid, id, score, rank): squared distances from each query's tables of subspace distances, k best."""
        from .knn import ranked

        spark, books = coded.sparkSession, self.books
        given = queries.select("qid", "qvec")
        blocks = max(1, -(-given.count() // block))
        out = None
        for i in range(blocks):
            rows = given.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i).collect()  # about `block` queries
            if not rows:
                continue
            q = np.array([r.qvec for r in rows], np.float64).reshape(len(rows), books.shape[0], 1, books.shape[2])
            tables, qids = ((q - books) ** 2).sum(axis=3), np.array([r.qid for r in rows])

            def run(batches, tables=tables, qids=qids):
                for b in batches:
                    ids = b.column(0).to_numpy(zero_copy_only=False)
                    codes = np.asarray(b.column(1).flatten()).reshape(len(ids), -1)
                    for lo in range(0, len(ids), 4_096):
                        part = codes[lo : lo + 4_096]
                        d = np.round(sum(tables[:, j, part[:, j]] for j in range(part.shape[1])), 9)
                        order = np.lexsort((np.broadcast_to(ids[lo : lo + 4_096], d.shape), d), axis=1)[:, :k]
                        cols = [np.repeat(qids, order.shape[1]), ids[lo : lo + 4_096][order].ravel(), np.take_along_axis(d, order, 1).ravel()]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["qid", "id", "score"])

            found = settled(coded.select("id", "codes").mapInArrow(run, "qid long, id long, score double"), blocks)
            out = found if out is None else out.unionByName(found)
        return ranked(out if out is not None else spark.createDataFrame([], "qid long, id long, score double"), k)


# sign bits


def rotation(dim: int, seed: int = 42) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def rotated(vectors: DataFrame, matrix: np.ndarray, key: str = "id", column: str = "vector") -> DataFrame:
    """The vectors turned by the matrix; lengths and distances stay."""

    def run(batches):
        for b in batches:
            x = np.asarray(b.column(1).flatten(), np.float64).reshape(-1, len(matrix)) @ matrix.T
            offsets = np.arange(len(x) + 1, dtype=np.int32) * len(matrix)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))], names=[key, column])

    return vectors.where(F.size(column) == len(matrix)).select(key, column).mapInArrow(run, f"{key} long, {column} array<double>")


def sign_distance(product: Column, query_norm: Column, norm: Column, dim: Column) -> Column:
    """Estimated squared distance from the product of the query and a vector's +1 / -1 signs, never below 0."""
    estimate = product * norm / F.sqrt(dim.cast("double"))
    return F.greatest(F.lit(0.0), query_norm * query_norm + norm * norm - 2 * F.sqrt(F.lit(2 / np.pi)) * estimate)


def sign_codes(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """(id, code, norm): the signs of a vector's components packed into bytes, lowest bit first, and its length."""

    def run(batches):
        for b in batches:
            for at, m in by_length(b.column(1)):
                m = m.astype(np.float64)
                bits = np.packbits(m > 0, axis=1, bitorder="little")
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), binary(bits), pa.array(np.sqrt((m * m).sum(axis=1))), pa.array(np.full(len(at), m.shape[1], np.int32))], names=["id", "code", "norm", "dim"])

    rows = vectors.where(F.col("id").isNotNull() & (F.size(column) > 0)).select("id", column)
    return rows.mapInArrow(run, "id long, code binary, norm double, dim int")


def sign_search(coded: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank) of the k best by estimated distances, from packed signs (id, code, norm, dim).

    Each query has a table of 256 partial products for every byte of a code; a code's product is read from these.
    """

    def scorer(q: np.ndarray):
        dim, width = q.shape[1], -(-q.shape[1] // 8)
        signs = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little") * 2.0 - 1
        padded = np.zeros((len(q), width * 8))
        padded[:, :dim] = q
        tables = np.einsum("qwb,cb->qwc", padded.reshape(len(q), width, 8), signs)
        square = (q * q).sum(axis=1)[:, None]

        def score(codes: np.ndarray, norm: np.ndarray, dims: np.ndarray) -> np.ndarray:
            product = sum(tables[:, j, codes[:, j]] for j in range(width))
            return np.maximum(0.0, square + norm * norm - 2 * np.sqrt(2 / np.pi) * product * norm / np.sqrt(dim))

        return score

    return code_search(coded.select("id", "code", "norm", "dim"), queries, k, scorer, lambda dim: -(-dim // 8))


def by_length(column: pa.Array):
    """(row numbers, matrix) for each length of an array column; nulls and empty arrays give none."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    flat, starts = np.asarray(column.flatten()), np.r_[0, np.cumsum(lengths)]
    for n in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == n)
        yield at, flat[starts[at][:, None] + np.arange(n)]


def binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as binary values."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(rows, np.uint8).tobytes())])


def code_search(coded: DataFrame, queries: DataFrame, k: int, scorer, width, block: int = 512) -> DataFrame:
    """(qid, id, score, rank) of the k best codes of each query.

    ``coded``: id, code (binary) and further numeric columns; ``scorer(q)`` gives a function of (codes, *columns) to
    scores (queries, rows), smaller is better; ``width(dim)`` is a code's length for queries of a dimension. Codes of
    another length are not compared. Scores have nine digits, ties go to the smaller id.
    """
    from .knn import DIGITS, _better, ranked

    spark, schema = coded.sparkSession, "qid long, id long, score double"
    given = queries.where("qid is not null and qvec is not null").select("qid", "qvec")
    blocks = max(1, -(-given.count() // block))
    out = None
    for i in range(blocks):
        rows = given.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i).collect()  # about `block` queries
        if not rows:
            continue

        def run(batches, rows=rows):
            groups = {}
            for n in {len(r.qvec) for r in rows}:
                own = [r for r in rows if len(r.qvec) == n]
                groups[n] = (np.array([r.qid for r in own]), scorer(np.array([r.qvec for r in own], np.float64)), (np.full((len(own), k), np.inf), np.full((len(own), k), np.iinfo(np.int64).max)))
            for b in batches:
                ids, column = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
                sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1])
                more = [c.to_numpy(zero_copy_only=False) for c in b.columns[2:]]
                for n, (qid, score, best) in groups.items():
                    at = np.flatnonzero(sizes == width(n))
                    for lo in range(0, len(at), 4_096):
                        part = at[lo : lo + 4_096]
                        codes = np.frombuffer(b"".join(column.take(pa.array(part)).to_pylist()), np.uint8).reshape(len(part), -1)
                        _better(best, np.arange(len(qid)), np.round(score(codes, *(c[part] for c in more)), DIGITS) + 0.0, ids[part], k)
            for qid, _, (scores, who) in groups.values():
                keep = np.isfinite(scores).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.repeat(qid, k)[keep], who.ravel()[keep], scores.ravel()[keep])], names=["qid", "id", "score"])

        found = settled(coded.mapInArrow(run, schema), blocks)
        out = found if out is None else out.unionByName(found)
    return ranked(out if out is not None else spark.createDataFrame([], schema), k)
