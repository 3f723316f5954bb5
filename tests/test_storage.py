"""Stored indexes, collections under concurrent changes, settings and what reaches the scans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantora import config
from vantora.operators import filters as flt
from vantora.operators import ivf, knn, quant, sparse
from vantora.session import shared_path, skew_join, table
from vantora.sources import collection as store
from vantora.sources import files, indexes

ROWS = "n long, vector array<float>, metadata map<string,string>"


def rows(spark, n, start=0):
    return spark.createDataFrame([(i, [float(start + i), 1.0], {"k": str(start + i)}) for i in range(n)], ROWS)


def pushed(df):
    plan = df._jdf.queryExecution().toString()
    return plan[plan.index("PushedFilters: [") :].split("]")[0]


@pytest.mark.parametrize("f, part", [
    (flt.Eq("p_brand", "Brand#2"), "EqualTo(p_brand,Brand#2)"), (flt.In("p_brand", ("Brand#1", "Brand#3")), "In(p_brand"),
    (flt.Compare("p_size", "gt", 25), "GreaterThan(p_size"), (flt.Range("p_size", 10, 20), "LessThanOrEqual(p_size"), (flt.Compare("p_retailprice", "lte", 910.5), "LessThanOrEqual(p_retailprice"),
    (flt.Eq("p_brand", "Brand#2") | flt.Compare("p_size", "gt", 45), "Or(EqualTo(p_brand"), (flt.Range("p_size", 10, 20, True), "GreaterThan(p_size"),
])
def test_filters_reach_the_scan(spark, f, part):
    assert part in pushed(flt.matching(table(spark, "/root/testdata/sf0.001", "part"), f))


def test_not_keeps_rows_without_the_field(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, None, None), (3, "b", 50)], "id long, s string, x int")
    assert [r.id for r in flt.matching(df, ~flt.Eq("s", "a")).collect()] == [2, 3]
    assert [r.id for r in flt.matching(df, ~(flt.Eq("s", "a") | flt.Compare("x", "gt", 10))).collect()] == [2]
    assert [r.id for r in flt.matching(df, flt.Eq("x", "5") & flt.Compare("s", "gt", 1)).collect()] == []
    assert [r.id for r in flt.matching(df, flt.In("x", ("5", "50"))).collect()] == [1, 3]


def test_changes_made_meanwhile_are_not_lost(spark):
    c = store.Catalog(spark, shared_path(spark, "catalog")).create("c", store.Config(dim=2))
    c.append(rows(spark, 5), "n")
    c.delete(spark.range(2))
    for change in (lambda x: x.compact(), lambda x: x.patch(spark.createDataFrame([(3, {"p": "q"})], "id long, patch map<string,string>"))):
        other, write = store.Collection(c.catalog, "c"), store.Collection._write
        before = c.rows().count()

        def late(self, df, write=write, other=other):
            folder = write(self, df)
            if self is not other:
                store.Collection._write = write
                other.append(rows(spark, 4, 100), "n")  # another writer comes between reading and publishing
            return folder

        store.Collection._write = late
        try:
            with pytest.raises(RuntimeError):
                change(c)
        finally:
            store.Collection._write = write
        assert c.rows().count() == before + 4
    assert c.compact() == {"before": 13, "after": 11, "removed": 2}
    assert [r.id for r in c.rows().orderBy("id").collect()] == list(range(11))


def test_snapshots_and_buffers(spark):
    c = store.Catalog(spark, shared_path(spark, "catalog")).create("c", store.Config(dim=2))
    buffer = store.WriteBuffer(c, 3)
    assert buffer.flush() is None
    for i in range(5):
        buffer.append([float(i), 0.0], None)
    assert c.rows().count() == 3 and buffer.flush() == (3, 2) and buffer.flushes == [(0, 3), (3, 2)]
    one = c.snapshot("one")
    with pytest.raises(ValueError):
        c.snapshot("one")
    c.delete(spark.range(5))
    assert [tuple(r) for r in c.named_snapshots().collect()] == [("one", one, 5, 0, 5)]
    with pytest.raises(ValueError):
        c.drop_snapshot(c.snapshot())
    copy = c.restore(one, "copy")
    assert copy.rows().count() == 5 and c.rows().count() == 0
    assert c.drop_snapshot(0) and not c.drop_snapshot(0) and c.restore(one).rows().count() == 5


def test_sparse_index(spark):
    index = indexes.SparseIndex(spark, shared_path(spark, "sparse"))
    cells = [(1, [0, 2], [1.0, 2.0]), (2, [1], [5.0]), (3, [2, 9], [-1.0, 4.0]), (4, [], [])]
    index.upsert(spark.createDataFrame(cells, index.SCHEMA))
    q = spark.createDataFrame([(7, 2, 1.0), (7, 9, 0.5), (8, 1, -1.0), (9, 5, 1.0)], "qid long, dim long, weight double")
    assert [tuple(r) for r in index.search(q, 2).orderBy("qid", "rank").collect()] == [(7, 1, 2.0, 1), (7, 3, 1.0, 2), (8, 2, -5.0, 1)]
    index.upsert(spark.createDataFrame([(1, [2], [0.1])], index.SCHEMA))
    index.delete(spark.createDataFrame([(2,)], "id long"))
    assert [tuple(r) for r in index.search(q, 2).orderBy("qid", "rank").collect()] == [(7, 3, 1.0, 1), (7, 1, 0.1, 2)]
    index.upsert(spark.createDataFrame([(2, [1], [1.0])], index.SCHEMA))
    assert index.get(2).first().weights == [1.0] and index.vectors().count() == 4
    assert index.search(q.limit(0), 2).collect() == []


def test_sparse_search_equals_all_products(spark):
    rng = np.random.default_rng(0)
    m = rng.standard_normal((300, 12)) * (rng.random((300, 12)) < 0.3)
    dense = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, vector array<float>")
    cells = sparse.from_dense(dense, 0.0)
    q = cells.where("id % 50 = 0").withColumnRenamed("id", "qid")
    want = knn.ranked(sparse.dot(cells, q), 5, ascending=False)
    for vectors in (sparse.arrays_from_dense(dense, 0.0), sparse.arrays(cells)):
        assert sorted(map(tuple, sparse.search(vectors, q, 5, block=2).collect())) == sorted(map(tuple, want.collect()))


def test_text_index_is_refused_to_a_second_writer(spark):
    index = indexes.TextIndex(spark, shared_path(spark, "text"))
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (3, None)], "doc_id long, text string")
    index.add(docs)
    after, state = index.state()
    index.remove(spark.createDataFrame([(1,), (99,)], "id long"))
    with pytest.raises(RuntimeError):
        index.publish(after, state)
    assert [r.id for r in index.tokens().collect()] == [2]
    q = spark.createDataFrame([(5, "beta"), (6, "alpha")], "qid long, query string")
    assert [(r.qid, r.id) for r in index.search(q, 3).collect()] == [(5, 2)]


def vectors_of(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, vector array<float>")


def test_codes_are_ranked_by_their_own_distances(spark):
    """Byte codes and packed signs give the distances that decoded vectors and signs would, in the same order."""
    rng = np.random.default_rng(3)
    m = (rng.standard_normal((400, 20)) * rng.uniform(0.2, 4, (400, 1))).astype(np.float32)
    df = vectors_of(spark, m)
    q = df.where("id % 80 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("qvec"))
    sq = quant.ScalarQuantizer.train(df)
    back = df.select("id", sq.decode(sq.encode(F.col("vector"))).alias("vector"))
    want = {(r.qid, r.rank): (r.id, r.score) for r in knn.knn_join(back, q, 7, "l2_squared").collect()}
    got = {(r.qid, r.rank): (r.id, r.score) for r in sq.search(sq.pack(df), q, 7).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-6 for k in want)
    found = quant.sign_search(quant.sign_codes(df), q, 7).collect()
    norm = np.linalg.norm(m.astype(np.float64), axis=1)
    for i in range(0, 400, 80):
        x = m[i].astype(np.float64)
        d = np.maximum(0, norm[i] ** 2 + norm**2 - 2 * np.sqrt(2 / np.pi) * (np.where(m > 0, 1.0, -1.0) @ x) * norm / np.sqrt(20))
        assert [r.id for r in sorted((r for r in found if r.qid == i), key=lambda r: r.rank)] == np.lexsort((np.arange(400), np.round(d, 9)))[:7].tolist()


def test_only_probed_lists_are_read(spark):
    rng = np.random.default_rng(1)
    df = vectors_of(spark, rng.standard_normal((200, 4)))
    index = indexes.ListIndex(spark, shared_path(spark, "lists"))
    index.create(df, ivf.train_centroids(df, 8))
    q = df.where("id = 5").select(F.col("id").alias("qid"), F.col("vector").alias("qvec"))
    found = index.search(q, 3, 2)
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "list_id" in plan[plan.index("PartitionFilters: [") :].split("]")[0]
    assert found.first().id == 5
    every = index.search(q, 3, 8)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, knn.knn_join(df, q, 3).collect()))


def test_blocks_are_lossless_and_read_alone(spark):
    m = np.random.default_rng(2).standard_normal((600, 3)).astype(np.float32)
    blocks = indexes.blocks_of(vectors_of(spark, m), 100)
    back = {r.id: r.vector for r in indexes.from_blocks(blocks, 3).collect()}
    assert len(back) == 600 and all(np.float32(back[i]).tolist() == m[i].tolist() for i in back)
    assert sorted(r.id for r in indexes.from_blocks(blocks, 3, [5, 599], 100).collect()) == [5, 599]
    assert indexes.compression(blocks).first().n_blocks == 6
    assert indexes.blocks_of(vectors_of(spark, m).limit(0)).collect() == []


def test_damaged_log_entries_are_told(spark, tmp_path):
    log = spark.createDataFrame([(i, None, "Insert", "c", i, '{"a": 1}') for i in range(20)], files.WAL)
    files.write_log(log, str(tmp_path / "log"), 10)
    for f in (tmp_path / "log").rglob("*.json"):
        f.write_text(f.read_text().replace('"id":7,', '"id":8,'))
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    rows = files.checked_log(spark, str(tmp_path / "log")).collect()
    assert len(rows) == 20 and [r.seq for r in rows if not r.intact] == [7]


def test_a_hot_key_is_joined_by_broadcast(spark):
    big = spark.range(3000).selectExpr("if(id % 2 = 0, 0, id) k", "id v")
    side = big.groupBy("k").agg(F.count("*").alias("n")).where("k % 3 <> 1")
    for how in ("inner", "left"):
        a, b = skew_join(big, side, ["k"], "n", how, hot=100), big.join(side, "k", how)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_settings(tmp_path):
    path = tmp_path / "settings.toml"
    path.write_text('[server]\nport = 80\nopen = false\nnames = ["a"]\n[store]\ndir = "x"\n')
    env = {"APP__SERVER__PORT": "8080", "APP__SERVER__OPEN": "true", "APP__SERVER__NAMES": "b, c", "APP__NEW__DEEP__VALUE": "1.5", "OTHER": "1"}
    got = config.load(str(path), {"store": {"dir": "y", "size": 3}}, env)
    assert got == {"server": {"port": 8080, "open": True, "names": ["b", "c"]}, "store": {"dir": "x", "size": 3}, "new": {"deep": {"value": 1.5}}}
    assert config.load(str(tmp_path / "none.json"), {"a": 1}, {}) == {"a": 1}
    with pytest.raises(ValueError):
        config.load(str(path), None, {"APP__SERVER__OPEN": "maybe"})


def test_many_blocks_of_queries_are_worked_off_one_by_one(spark):
    rng = np.random.default_rng(5)
    df = vectors_of(spark, rng.standard_normal((120, 6)))
    q = df.where("id % 4 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("qvec"))
    assert sorted(map(tuple, knn.knn_join(df, q, 3, block=4).collect())) == sorted(map(tuple, knn.knn_join(df, q, 3).collect()))
    pq = quant.ProductQuantizer.of(quant.train_codebook(df, 2, 8))
    assert sorted(map(tuple, pq.search(pq.encode(df), q, 3, block=4).collect())) == sorted(map(tuple, pq.search(pq.encode(df), q, 3).collect()))


def test_many_allowed_ids_are_neither_broadcast_nor_repeated(spark):
    vectors = spark.createDataFrame([(i, [0, 1], [float(i % 7), 1.0]) for i in range(40)], "id long, dims array<long>, weights array<double>")
    q = spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0)], "qid long, dim long, weight double")
    allowed = spark.range(3, 60_003).select("id", (F.col("id") % 5).alias("size"))
    found = sparse.search(vectors, q, 3, allowed)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "explode" not in plan
    assert [tuple(r) for r in found.orderBy("qid", "rank").collect()] == [(0, 6, 6.0, 1), (0, 13, 6.0, 2), (0, 20, 6.0, 3), (1, 3, 1.0, 1), (1, 4, 1.0, 2), (1, 5, 1.0, 3)]
