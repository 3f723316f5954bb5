"""Collections, files and streams end to end."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantora.operators import filters as flt
from vantora.session import shared_path
from vantora.sources import files
from vantora.sources.collection import Catalog, Config
from vantora.streaming import ingest


def batch(spark, n, dim=8):
    rng = np.random.default_rng(n)
    return spark.createDataFrame([(i, [float(x) for x in rng.random(dim)], {"category": ("electronics", "books", "clothing")[i % 3], "name": f"product_{i}", "price": str(10 + 5 * i)}) for i in range(n)], "n long, vector array<float>, metadata map<string,string>")


def test_life_of_a_collection(spark):
    cat = Catalog(spark, shared_path(spark, "catalog"))
    assert cat.names() == []
    c = cat.create("things", Config(dim=8))
    with pytest.raises(ValueError):
        cat.create("things")
    assert c.append(batch(spark, 20), "n") == (0, 20) and c.append(batch(spark, 10), "n") == (20, 10)
    with pytest.raises(Exception):
        c.append(batch(spark, 3, dim=7), "n")
    assert c.counts() == {"total": 30, "active": 30, "deleted": 0}
    q = c.rows().where("id = 5").select(F.col("id").alias("qid"), F.col("vector").alias("qvec"))
    first = c.search(q, 3).orderBy("rank").first()
    assert first.id == 5 and first.metadata["name"] == "product_5"
    assert {r.id % 20 % 3 for r in c.search(q, 30, flt.Eq("category", "electronics")).collect()} == {0}
    assert {r.id for r in c.search(q, 30, flt.Eq("category", "books"), ids=[1, 4, 6, 7]).collect()} == {1, 4, 7}
    before = c.snapshot()
    ids = spark.createDataFrame([(5,), (10,), (11,), (999,)], "id long")
    assert c.delete(ids) == 3 and c.delete(ids) == 0 and c.counts()["active"] == 27
    assert not {5, 10, 11} & {r.id for r in c.search(q, 30).collect()}
    moved = c.update(c.rows().where("id = 6").select("id", "vector", F.create_map(F.lit("category"), F.lit("new")).alias("metadata")))
    assert [tuple(r) for r in moved.collect()] == [(6, 30)]
    c.patch(spark.createDataFrame([(30, {"priority": "high", "category": "C"})], "id long, patch map<string,string>"))
    assert {r.id for r in c.search(q, 30, flt.Eq("category", "C") & flt.Eq("priority", "high")).collect()} == {30}
    assert c.compact() == {"before": 27, "after": 27, "removed": 0}
    assert c.delete(spark.createDataFrame([(0,), (1,)], "id long")) == 2 and c.compact() == {"before": 27, "after": 25, "removed": 2}
    assert sorted(r.id for r in c.rows().collect()) == list(range(25)) and c.counts() == {"total": 25, "active": 25, "deleted": 0}
    assert c.restore(before, "copy").counts()["active"] == 30 and cat.names() == ["copy", "things"]
    assert c.restore(before).counts()["active"] == 30 and len(c.snapshots()) > 5
    with pytest.raises(RuntimeError):
        cat.publish("things", {}, 0)
    cat.drop("copy")
    with pytest.raises(KeyError):
        cat.get("copy")


def test_vector_files(spark, tmp_path):
    m = np.random.default_rng(0).random((1000, 4)).astype("<f4")
    (tmp_path / "v.bin").write_bytes(m.tobytes())
    got = files.read_vectors(spark, str(tmp_path / "v.bin"), 4).orderBy("id").collect()
    assert [r.id for r in got] == list(range(1000)) and np.allclose([r.vector for r in got], m)
    (tmp_path / "w.bin").write_bytes(m.tobytes()[:-1])
    with pytest.raises(ValueError):
        files.read_vectors(spark, str(tmp_path / "w.bin"), 4)


def test_logs(spark, tmp_path):
    log = spark.createDataFrame([(i, None, "Insert", "c", i, json.dumps({"dim": 4})) for i in range(250)], files.WAL)
    files.write_log(log, str(tmp_path / "log"), per_segment=100)
    (tmp_path / "log" / "broken.json").write_text("{not json\n")
    back = files.read_log(spark, str(tmp_path / "log"))
    assert back.count() == 250 and files.tail(back, 240).count() == 10 and files.truncate_before(back, 199, 100).count() == 150
    assert spark.read.json(str(tmp_path / "log")).where("segment = 1").count() == 100


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.range(100).selectExpr("id", "id % 3 as g").repartition(4).write.parquet(str(src))
    stream = lambda: ingest.file_stream(spark, str(src), 2)
    for _ in range(2):  # the second run finds nothing new
        ingest.append_batches(stream(), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100
    ingest.append_groups(stream(), ["g"], [F.count("*").alias("n")], str(tmp_path / "groups"), str(tmp_path / "cp2"))
    sums = spark.read.parquet(str(tmp_path / "groups")).groupBy("g").agg(F.sum("n")).collect()
    assert sorted(map(tuple, sums)) == [(0, 34), (1, 33), (2, 33)]
    ingest.running_counts(stream(), ["g"], [F.count("*").alias("n")], str(tmp_path / "counts"), str(tmp_path / "cp3"))
    assert sorted(map(tuple, ingest.latest_result(spark, str(tmp_path / "counts")).collect())) == [(0, 34), (1, 33), (2, 33)]
    timed = spark.range(10).selectExpr("timestamp_seconds(id * 60) as t", "id % 2 as g")
    assert ingest.windowed_counts(timed, "t", "5 minutes", "1 minute", ["g"]).count() == 4


def test_progress(spark):
    got = ingest.chunk_progress(spark.range(25), "id", 10).orderBy("chunk").collect()
    assert [tuple(r) for r in got] == [(0, 10, 10, 40.0), (1, 10, 20, 80.0), (2, 5, 25, 100.0)]
