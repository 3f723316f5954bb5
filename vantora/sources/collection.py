"""Named collections on shared storage: versions of parquet folders behind a manifest.

A collection is a folder with a manifest for each state it had. A manifest lists the data folders, tombstone
folders and the configuration; a change writes new folders first and then the next manifest, which appears by
a rename. Readers see a whole state or the one before, and a change that dies leaves only unused folders.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import metric_of
from ..operators import filters, knn, mutation
from ..session import delete_path, file_names, publish_text, read_text

SCHEMA = "id long, vector array<float>, metadata map<string,string>"


@dataclass
class Config:
    """What a collection is made with; the dimension is checked on every write."""

    dim: int = 128
    distance: str = "euclidean"
    quantization: bool = False
    indexed_fields: list[str] = field(default_factory=list)
    numeric_fields: list[str] = field(default_factory=list)
    text_fields: list[str] = field(default_factory=list)


class Catalog:
    """Collections below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def names(self) -> list[str]:
        return [n for n in file_names(self.spark, self.root) if self._last(n) is not None]

    def _numbers(self, name: str) -> list[int]:
        return sorted(int(n) for n in file_names(self.spark, f"{self.root}/{name}/manifests") if n.isdigit())

    def _last(self, name: str) -> int | None:
        numbers = self._numbers(name)
        return numbers[-1] if numbers else None

    def read(self, name: str, number: int | None = None) -> dict:
        number = self._last(name) if number is None else number
        if number is None:
            raise KeyError(f"no collection {name}")
        return json.loads(read_text(self.spark, f"{self.root}/{name}/manifests/{number}"))

    def publish(self, name: str, manifest: dict, after: int | None) -> None:
        """The manifest after the one that was read, unless another writer published it first."""
        number = 0 if after is None else after + 1
        if not publish_text(self.spark, f"{self.root}/{name}/manifests/{number}", json.dumps(manifest)):
            raise RuntimeError(f"{name} was changed by another writer")

    def create(self, name: str, config: Config | None = None) -> Collection:
        if self._last(name) is not None:
            raise ValueError(f"collection {name} exists")
        self.publish(name, {"config": asdict(config or Config()), "data": [], "dead": [], "next_id": 0}, None)
        return Collection(self, name)

    def get(self, name: str) -> Collection:
        self.read(name)
        return Collection(self, name)

    def drop(self, name: str) -> bool:
        return delete_path(self.spark, f"{self.root}/{name}")


@dataclass
class Collection:
    catalog: Catalog
    name: str

    def _state(self) -> tuple[int, dict]:
        number = self.catalog._last(self.name)
        return number, self.catalog.read(self.name, number)

    def _write(self, df: DataFrame) -> str:
        folder = f"{self.catalog.root}/{self.name}/data/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return folder

    @property
    def config(self) -> Config:
        return Config(**self._state()[1]["config"])

    def _rows(self, state: dict) -> DataFrame:
        spark = self.catalog.spark
        rows = spark.read.schema(SCHEMA).parquet(*state["data"]) if state["data"] else spark.createDataFrame([], SCHEMA)
        return filters.active(rows, self._dead(state))

    def _dead(self, state: dict) -> DataFrame:
        spark = self.catalog.spark
        return spark.read.schema("id long").parquet(*state["dead"]) if state["dead"] else spark.createDataFrame([], "id long")

    def rows(self) -> DataFrame:
        """The live rows: id, vector, metadata."""
        return self._rows(self._state()[1])

    def append(self, rows: DataFrame, order: str) -> tuple[int, int]:
        """Adds vectors and metadata under new ids in the given order; gives the first id and how many. Vectors of another length are an error."""
        number, state = self._state()
        dim = state["config"]["dim"]
        numbered = mutation.dense_numbers(rows.withColumn("_order", F.col(order)).select("_order", "vector", "metadata"), "_order", "id", state["next_id"])
        ok = F.when(F.size("vector") == dim, F.col("vector")).otherwise(F.raise_error(F.lit(f"a vector has not {dim} components")))
        folder = self._write(numbered.select("id", ok.alias("vector"), "metadata"))
        n = self.catalog.spark.read.parquet(folder).count()
        self.catalog.publish(self.name, state | {"data": [*state["data"], folder], "next_id": state["next_id"] + n}, number)
        return state["next_id"], n

    def delete(self, ids: DataFrame) -> int:
        """Marks ids as deleted; gives how many were live."""
        number, state = self._state()
        folder = self._write(mutation.newly_deleted(self._rows(state), self._dead(state), ids))
        n = self.catalog.spark.read.schema("id long").parquet(folder).count()
        self.catalog.publish(self.name, state | {"dead": [*state["dead"], folder]}, number)
        return n

    def update(self, changes: DataFrame) -> DataFrame:
        """Replaces rows (id, vector, metadata) under new ids; gives (old_id, id)."""
        number, state = self._state()
        hit = changes.join(self._rows(state).select("id"), "id", "left_semi")
        moved = self._write(mutation.dense_numbers(hit.withColumnRenamed("id", "old_id"), "old_id", "id", state["next_id"]))
        rows = self.catalog.spark.read.parquet(moved)
        data, dead = self._write(rows.select("id", "vector", "metadata")), self._write(rows.select(F.col("old_id").alias("id")))
        self.catalog.publish(self.name, state | {"data": [*state["data"], data], "dead": [*state["dead"], dead], "next_id": state["next_id"] + rows.count()}, number)
        return rows.select("old_id", "id")

    def _rewrite(self, number: int, state: dict, rows: DataFrame, **changes) -> str:
        """The next state with these rows only; an error if the state is no longer the one that was read."""
        folder = self._write(rows)
        self.catalog.publish(self.name, state | {"data": [folder], "dead": []} | changes, number)
        return folder

    def patch(self, patches: DataFrame) -> None:
        """Merges metadata (id, patch) into live rows key by key; of several patches of an id the greater map's text counts last."""
        number, state = self._state()
        one = patches.groupBy("id").agg(F.max_by("patch", F.to_json("patch")).alias("patch"))
        rows = self._rows(state).join(one, "id", "left")
        metadata = F.when(F.col("patch").isNotNull(), mutation.patched(F.col("metadata"), F.col("patch"))).otherwise(F.col("metadata"))
        self._rewrite(number, state, rows.select("id", "vector", metadata.alias("metadata")))

    def compact(self) -> dict:
        """Drops deleted rows and renumbers the rest densely; all metadata stays. A change made meanwhile is an error, not lost."""
        number, state = self._state()
        spark = self.catalog.spark
        before = spark.read.schema(SCHEMA).parquet(*state["data"]).count() if state["data"] else 0
        rows = mutation.compacted(self._rows(state), self._dead(state).limit(0)).select("id", "vector", "metadata")
        after = before - self._dead(state).count()
        self._rewrite(number, state, rows, next_id=after)
        return {"before": before, "after": after, "removed": before - after}

    def snapshot(self, name: str | None = None) -> int:
        """The number of the state as it is now; states stay readable. A name, once given, stays with its state."""
        number = self._state()[0]
        if name is not None and not publish_text(self.catalog.spark, f"{self.catalog.root}/{self.name}/snapshots/{name}", str(number)):
            raise ValueError(f"snapshot {name} exists")
        return number

    def named_snapshots(self) -> DataFrame:
        """(name, number, total, deleted, next_id) of the named snapshots, from their manifests."""
        spark, rows = self.catalog.spark, []
        for name in file_names(spark, f"{self.catalog.root}/{self.name}/snapshots"):
            number = int(read_text(spark, f"{self.catalog.root}/{self.name}/snapshots/{name}"))
            if number in self.snapshots():
                state = self.catalog.read(self.name, number)
                total = spark.read.schema(SCHEMA).parquet(*state["data"]).count() if state["data"] else 0
                rows.append((name, number, total, self._dead(state).count(), state["next_id"]))
        return spark.createDataFrame(rows, "name string, number long, total long, deleted long, next_id long")

    def snapshots(self) -> list[int]:
        """Numbers of the states that can be read."""
        return self.catalog._numbers(self.name)

    def drop_snapshot(self, snapshot: int) -> bool:
        """Forgets an older state; its folders go with it where no other state needs them. The newest state stays."""
        if snapshot == self._state()[0]:
            raise ValueError("the newest state can't be dropped")
        if snapshot not in self.snapshots():
            return False
        gone = self.catalog.read(self.name, snapshot)
        delete_path(self.catalog.spark, f"{self.catalog.root}/{self.name}/manifests/{snapshot}")
        needed = {f for n in self.snapshots() for f in (lambda m: m["data"] + m["dead"])(self.catalog.read(self.name, n))}
        for folder in gone["data"] + gone["dead"]:
            if folder not in needed and folder.startswith(f"{self.catalog.root}/{self.name}/"):
                delete_path(self.catalog.spark, folder)
        return True

    def restore(self, snapshot: int, as_name: str | None = None) -> Collection:
        """Back to a state, or that state as another collection."""
        state = self.catalog.read(self.name, snapshot)
        if as_name is None:
            self.catalog.publish(self.name, state, self._state()[0])
            return self
        self.catalog.publish(as_name, state, None)
        return Collection(self.catalog, as_name)

    def counts(self) -> dict:
        _, state = self._state()
        spark = self.catalog.spark
        total = spark.read.schema(SCHEMA).parquet(*state["data"]).count() if state["data"] else 0
        deleted = self._dead(state).count()
        return {"total": total, "active": total - deleted, "deleted": deleted}

    def search(self, queries: DataFrame, k: int, where: filters.Filter | None = None, ids: list[int] | None = None) -> DataFrame:
        """(qid, id, score, rank, metadata) of the k nearest live rows that pass the filters."""
        rows = self.rows()
        if where is not None:
            rows = rows.where(filters.condition(where, filters.map_field()))
        if ids is not None:
            rows = filters.with_ids(rows, ids)
        found = knn.knn_join(rows, queries, k, metric_of(self.config.distance))
        return found.join(rows.select("id", "metadata"), "id", "left").select("qid", "id", "score", "rank", "metadata")


class WriteBuffer:
    """Gathers single rows and appends them as one change when there are ``rows`` of them, or on ``flush``.

    Rows that wait are not in the collection; their ids are known once they are flushed.
    """

    def __init__(self, collection: Collection, rows: int = 256):
        self.collection, self.rows, self.waiting, self.flushes = collection, rows, [], []

    def append(self, vector: list[float], metadata: dict[str, str] | None = None) -> None:
        self.waiting.append((len(self.waiting), vector, metadata))
        if len(self.waiting) >= self.rows:
            self.flush()

    def flush(self) -> tuple[int, int] | None:
        """The first id and how many rows became visible; None if none waited."""
        if not self.waiting:
            return None
        rows = self.collection.catalog.spark.createDataFrame(self.waiting, "n long, vector array<float>, metadata map<string,string>")
        out = self.collection.append(rows, "n")
        self.waiting = []
        self.flushes.append(out)
        return out
