"""Stored indexes: tokenized texts, sparse vectors, codes and lists, kept as folders behind manifests.

An index is a folder with a manifest for each state it had. Additions and removals write new folders and publish the
next manifest; one that was computed from a state that is no longer the newest is refused.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ivf, quant, sparse, text
from ..session import file_names, publish_text, read_text


class StoredIndex:
    """State and folders of an index below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def state(self) -> tuple[int, dict]:
        """Number and content of the newest manifest; -1 and nothing before the first."""
        numbers = [int(n) for n in file_names(self.spark, f"{self.root}/manifests") if n.isdigit()]
        if not numbers:
            return -1, {}
        return max(numbers), json.loads(read_text(self.spark, f"{self.root}/manifests/{max(numbers)}"))

    def publish(self, after: int, state: dict) -> None:
        if not publish_text(self.spark, f"{self.root}/manifests/{after + 1}", json.dumps(state)):
            raise RuntimeError("the index was changed by another writer")

    def write(self, df: DataFrame, *partitions: str) -> str:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        (df.write.partitionBy(*partitions) if partitions else df.write).parquet(folder)
        return folder

    def read(self, folders: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def alive(self, state: dict, schema: str) -> DataFrame:
        """Rows of the newest generation of each id, without removed ids.

        A row counts if no later change touched its id. ``parts`` and ``gone`` list (folder, generation); what was
        added counts from its own generation on, what was removed from the next.
        """
        rows = None
        for folder, generation in state.get("parts", []):
            part = self.read([folder], schema).withColumn("_g", F.lit(generation))
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            return self.spark.createDataFrame([], schema)
        gone = None
        for folder, generation in state.get("gone", []):
            part = self.read([folder], "id long").withColumn("_at", F.lit(generation))
            gone = part if gone is None else gone.unionByName(part)
        if gone is not None:
            last = gone.groupBy("id").agg(F.max("_at").alias("_at"))
            rows = rows.join(last, "id", "left").where(F.col("_at").isNull() | (F.col("_g") >= F.col("_at"))).drop("_at")
        return rows.drop("_g")

    def change(self, added: DataFrame | None, removed: DataFrame | None) -> None:
        """Adds rows, whose ids lose their old rows, or removes ids; not both at once."""
        if (added is None) == (removed is None):
            raise ValueError("either add or remove")
        after, state = self.state()
        generation = after + 1
        parts, gone = state.get("parts", []), state.get("gone", [])
        if added is not None:
            folder = self.write(added)
            parts = [*parts, [folder, generation]]
            ids = self.spark.read.parquet(folder).select("id")
        else:
            ids, generation = removed.select("id"), generation + 1
        gone = [*gone, [self.write(ids.where("id is not null").distinct()), generation]]
        self.publish(after, state | {"parts": parts, "gone": gone})


class TextIndex(StoredIndex):
    """Tokens of documents; searched without reading or splitting the texts again."""

    SCHEMA = "id long, terms array<string>"

    def add(self, docs: DataFrame, key: str = "doc_id", column: str = "text") -> None:
        self.change(text.tokenized(docs, key, column), None)

    def remove(self, ids: DataFrame) -> None:
        """Removes documents: their tokens no longer count in any statistic."""
        self.change(None, ids)

    def tokens(self) -> DataFrame:
        return self.alive(self.state()[1], self.SCHEMA)

    def postings(self) -> DataFrame:
        """(id, term, tf)."""
        return self.tokens().select("id", F.explode("terms").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))

    def search(self, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
        return text.search_tokens(self.tokens(), queries, k, allowed)


class SparseIndex(StoredIndex):
    """Sparse vectors (id, dims, weights); upserts replace."""

    SCHEMA = "id long, dims array<bigint>, weights array<double>"

    def upsert(self, vectors: DataFrame) -> None:
        self.change(vectors.select("id", "dims", "weights"), None)

    def delete(self, ids: DataFrame) -> None:
        self.change(None, ids)

    def vectors(self) -> DataFrame:
        return self.alive(self.state()[1], self.SCHEMA)

    def get(self, id: int) -> DataFrame:
        return self.vectors().where(F.col("id") == id)

    def search(self, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
        return sparse.search(self.vectors(), queries, k, allowed)


class CodeIndex(StoredIndex):
    """Byte codes with their quantizer, trained when it is made; later vectors are coded with the same limits."""

    SCHEMA = "id long, code binary"

    def create(self, vectors: DataFrame) -> None:
        after, state = self.state()
        sq = quant.ScalarQuantizer.train(vectors)
        self.publish(after, state | {"lo": sq.lo, "scale": sq.scale})
        self.add(vectors)

    def quantizer(self) -> quant.ScalarQuantizer:
        _, state = self.state()
        return quant.ScalarQuantizer(tuple(state["lo"]), tuple(state["scale"]))

    def add(self, vectors: DataFrame) -> None:
        self.change(self.quantizer().pack(vectors), None)

    def codes(self) -> DataFrame:
        return self.alive(self.state()[1], self.SCHEMA)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return self.quantizer().search(self.codes(), queries, k)


class ListIndex(StoredIndex):
    """Inverted lists, a folder for each, with their centroids: a search opens only the lists it probes."""

    SCHEMA = "id long, vector array<float>, list_dist double, list_id long"

    def create(self, vectors: DataFrame, centroids: DataFrame) -> None:
        after, _ = self.state()
        rows = ivf.assign(vectors.select("id", "vector"), centroids).select("id", F.col("vector").cast("array<float>").alias("vector"), "list_dist", "list_id")
        self.publish(after, {"centroids": self.write(centroids), "lists": self.write(rows.repartition("list_id"), "list_id")})

    def centroids(self) -> DataFrame:
        return self.read([self.state()[1]["centroids"]], "list_id long, centroid array<double>")

    def lists(self) -> DataFrame:
        return self.read([self.state()[1]["lists"]], self.SCHEMA)

    def search(self, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
        return ivf.flat_search(self.lists(), queries, self.centroids(), k, nprobe)


class ValueIndex(StoredIndex):
    """Postings of metadata values: (id, field, value), one row for each field of a row."""

    SCHEMA = "id long, field string, value string"

    def add(self, rows: DataFrame) -> None:
        self.change(rows.where("id is not null and field is not null and value is not null").select("id", "field", "value"), None)

    def remove(self, ids: DataFrame) -> None:
        self.change(None, ids)

    def rows(self) -> DataFrame:
        return self.alive(self.state()[1], self.SCHEMA)

    def ids(self, field: str, value: str) -> DataFrame:
        return self.rows().where((F.col("field") == field) & (F.col("value") == value)).select("id").distinct()


class ResultCache:
    """Results of searches by key, with the state they were made from; one made from an older state is not used.

    At most ``most`` results are kept: the oldest go first. ``hits`` and ``misses`` count this object's lookups.
    """

    def __init__(self, spark: SparkSession, root: str, most: int = 1_000):
        self.spark, self.root, self.most, self.hits, self.misses = spark, root.rstrip("/"), most, 0, 0
        self.known: dict[str, tuple[int, str]] = {}

    def get(self, key: str, state: int, make) -> DataFrame:
        found = self.known.get(key)
        if found and found[0] == state:
            self.hits += 1
            return self.spark.read.parquet(found[1])
        self.misses += 1
        folder = f"{self.root}/{uuid.uuid4().hex}"
        make().write.parquet(folder)
        self.known.pop(key, None)
        self.known[key] = (state, folder)
        while len(self.known) > self.most:
            self.known.pop(next(iter(self.known)))
        return self.spark.read.parquet(folder)


def blocks_of(vectors: DataFrame, size: int = 256, codec: str = "lz4") -> DataFrame:
    """(block, n, raw_bytes, packed): vectors in blocks of ``size`` consecutive ids, each compressed on its own.

    A block holds the ids and float32 components of its vectors, so one of them is read without the others' blocks.
    """
    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("id")
        ids = table["id"].to_numpy()
        flat = np.asarray(table["vector"].combine_chunks().flatten(), np.float32)
        raw = np.int64(len(ids)).tobytes() + ids.tobytes() + flat.tobytes()
        packed = pa.compress(raw, codec=codec, asbytes=True)
        return pa.table({"block": [int(ids[0] // size)], "n": [len(ids)], "raw_bytes": [len(raw)], "packed": [packed]})

    rows = vectors.where("id is not null and vector is not null").withColumn("block", F.floor(F.col("id") / size))
    return rows.select("block", "id", "vector").groupBy("block").applyInArrow(pack, "block long, n long, raw_bytes long, packed binary")


def from_blocks(blocks: DataFrame, dim: int, ids: list[int] | None = None, size: int = 256, codec: str = "lz4") -> DataFrame:
    """(id, vector) of the compressed blocks; with ``ids`` only their blocks are read."""
    def unpack(batches):
        for b in batches:
            for n, raw, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                data = pa.decompress(packed, decompressed_size=raw, codec=codec, asbytes=True)
                own, flat = np.frombuffer(data, np.int64, n, 8), np.frombuffer(data, np.float32, n * dim, 8 + 8 * n)
                offsets = np.arange(n + 1, dtype=np.int32) * dim
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "vector"])

    if ids is not None:
        blocks = blocks.where(F.col("block").isin(sorted({i // size for i in ids})))
    rows = blocks.select("n", "raw_bytes", "packed").mapInArrow(unpack, "id long, vector array<float>")
    return rows if ids is None else rows.where(F.col("id").isin(list(ids)))


def compression(blocks: DataFrame) -> DataFrame:
    """One row: blocks, vectors, bytes before and after, and their ratio."""
    size = F.length("packed")
    return blocks.agg(F.count("*").alias("n_blocks"), F.sum("n").alias("n_vectors"), F.sum("raw_bytes").alias("raw_bytes"), F.sum(size).alias("packed_bytes"), F.round(F.sum("raw_bytes") / F.sum(size), 4).alias("ratio"))
