"""Values known by hand for the store's operators, and edge cases."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantora.functions import vectors as vec
from vantora.operators import filters as flt
from vantora.operators import fusion, ivf, knn, mutation, quant, sharding, sparse, stats, text, versioning


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is None, x) for x in r))


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def arr(*xs):
    return F.array(*map(F.lit, xs))


def ranking(spark, pairs, q=0):
    return spark.createDataFrame([(q, i, float(s)) for i, s in pairs], "qid long, id long, score double")


def scores(df):
    return {r.id: round(r.score, 9) for r in df.collect()}


def test_scalar_functions(spark):
    a, b = arr(*[float(i) for i in range(1, 9)]), arr(*[float(i) for i in range(2, 10)])
    assert one(spark, vec.l2_squared(a, b), vec.dot(arr(1.0, 2.0, 3.0, 4.0), arr(2.0, 3.0, 4.0, 5.0))) == (8.0, 40.0)
    e, f = arr(1.0, 0.0), arr(1.0, 1.0)
    sim, zero, unit = one(spark, vec.cosine_similarity(e, f), vec.cosine_distance(e, arr(0.0, 0.0)), vec.normalize(arr(3.0, 4.0)))
    assert abs(sim - 0.7071068) < 1e-6 and zero == 1.0 and unit == [0.6, 0.8]
    assert one(spark, vec.norm(arr(3.0, 4.0)), vec.mean(arr(1.0, 3.0)), vec.variance(arr(1.0, 3.0))) == (5.0, 2.0, 1.0)
    words = vec.sign_words(arr(1.0, -1.0, 2.0, 0.0), 4)
    assert one(spark, words, vec.hamming(arr(5, 1), arr(6, 1))) == ([5], 2)
    assert [vec.metric_of(x) for x in ("COS", "ip", "whatever", None)] == ["cosine", "dot", "l2", "l2"]


def test_filters(spark):
    data = [(i, {"price": str(10 + 5 * i), "category": ("electronics", "books", "clothing")[i % 3], "rating": f"{1.0 + (i % 50) * 0.1:.1f}"}) for i in range(100)] + [(100, None), (101, {"price": "n/a"})]
    df = spark.createDataFrame(data, "id long, metadata map<string,string>")

    def n(f):
        return df.where(flt.condition(f, flt.map_field())).count()

    assert n(flt.Compare("price", "gt", 100)) == 81 and n(flt.Range("price", 50, 150)) == 21 and n(flt.Range("price", 100, 200, True)) == 19
    assert n(flt.Compare("rating", "gte", 4.0)) == 40 and n(flt.Eq("category", "books")) == 33 and n(~flt.Eq("category", "books")) == 69
    assert n(flt.In("category", ("books", "clothing")) & flt.Compare("price", "lt", 200)) == 25 and n(flt.And(())) == 102 and n(flt.Or(())) == 0 and n(flt.In("category", ())) == 0
    assert n(flt.from_json({"or": [{"eq": ["category", "books"]}, {"not": {"lte": ["price", 100]}}]})) == n(flt.Eq("category", "books") | ~flt.Compare("price", "lte", 100))
    ids = spark.createDataFrame([(1,), (1,), (5,), (None,), (9999,)], "id long")
    assert rows(flt.with_ids(df, ids).select("id")) == [(1,), (5,)] == rows(flt.with_ids(df, [1, 5, 777]).select("id"))
    assert rows(flt.with_ids(df, list(range(2_000, 4_000)) + [7]).select("id")) == [(7,)]
    assert flt.active(df, ids).count() == 100
    with pytest.raises(ValueError):
        flt.from_json({"near": []})


@pytest.mark.parametrize("metric", ["l2", "l2_squared", "cosine", "dot"])
def test_knn_against_brute_force(spark, metric):
    rng = np.random.default_rng(0)
    m = np.round(rng.standard_normal((400, 8)), 2).astype(np.float32)
    m[50:60] = m[0]
    m[70] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(900, None), (901, [1.0]), (902, [float("nan")] * 8), (None, [0.0] * 8)], "id long, vector array<float>")
    q = df.where("id in (0, 7, 70)").select(F.col("id").alias("qid"), F.col("vector").alias("qvec"))
    got = {(r.qid, r["rank"]): (r.id, r.score) for r in knn.knn_join(df.repartition(5), q, 12, metric).collect()}
    x = m.astype(np.float64)
    for i in (0, 7, 70):
        dots, norms = x @ x[i], np.linalg.norm(x, axis=1)
        s = {"l2": np.sqrt(((x - x[i]) ** 2).sum(1)), "l2_squared": ((x - x[i]) ** 2).sum(1), "dot": -dots, "cosine": 1 - np.divide(dots, norms * norms[i], out=np.zeros(400), where=norms * norms[i] > 0)}[metric]
        want = sorted((round(float(v), 9) + 0.0, j) for j, v in enumerate(s))[:12]
        assert [got[i, r + 1][0] for r in range(12)] == [j for _, j in want]
        assert all(abs(got[i, r + 1][1] - v) < 1e-8 for r, (v, _) in enumerate(want))


def test_knn_in_blocks_of_queries_and_empty(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "id long, vector array<float>")
    q = df.select(F.col("id").alias("qid"), F.col("vector").alias("qvec"))
    assert rows(knn.knn_join(df, q, 3, block=7)) == rows(knn.knn_join(df, q, 3))
    assert knn.knn_join(df, q.limit(0), 3).collect() == [] and knn.knn_join(df.limit(0), q, 3).collect() == []


def test_expansion_and_strategy(spark):
    cases = [0.005, 0.01, 0.05, 0.1, 0.5]
    df = spark.createDataFrame([(float(c),) for c in cases], "s double")
    assert [r.e for r in df.select(knn.expansion(F.col("s"), 10).alias("e")).collect()] == [100, 100, 89, 20, 20]
    assert [one(spark, knn.strategy(F.lit(m), F.lit(1000)))[0] for m in (5, 600, 200, 1000)] == ["pre", "post", "hybrid", "none"]


def test_text(spark):
    docs = spark.createDataFrame([(1, "quick brown fox"), (2, "lazy brown dog"), (3, "quick lazy cat"), (4, None), (5, ""), (6, "a ! b")], "doc_id long, text string")
    index = text.postings(docs)
    q = spark.createDataFrame([(0, "brown"), (1, "brown brown"), (2, "brown QUICK"), (3, ""), (4, "unseen")], "qid long, query string")
    got = {(r.qid, r.id): r.score for r in text.bm25_search(docs, q, 9).collect()}
    assert abs(got[0, 1] - 0.470004) < 1e-6 and abs(got[0, 2] - got[0, 1]) < 1e-9 and abs(got[1, 1] - 2 * got[0, 1]) < 1e-8
    assert {k for k in got if k[0] > 2} == set() and rows(text.must_match(index, q.where("qid = 2"))) == [(2, 1)]
    assert one(spark, text.tokens(F.lit("Hello, World! This is a TEST é."))) == (["hello", "world", "this", "is", "test", "é"],)
    assert {k: round(v, 6) for k, v in got.items()} == {(r.qid, r.id): round(r.score, 6) for r in text.bm25_scores(index, q).collect()}
    assert rows(text.bm25_search(docs, q, 1, block=1)) == rows(text.bm25_search(docs, q, 1)) and text.bm25_search(docs.limit(0), q, 3).collect() == []
    assert rows(text.bm25_search(docs, q.where("qid = 0"), 9, spark.createDataFrame([(2,)], "id long")).select("id")) == [(2,)]
    apple = spark.createDataFrame([(1, "apple apple apple"), (2, "apple")], "doc_id long, text string")
    assert scores(text.bm25_search(apple, spark.createDataFrame([(0, "apple")], "qid long, query string"), 5)) == {1: pytest.approx(0.258779, abs=1e-6), 2: pytest.approx(0.229204, abs=1e-6)}
    assert text.postings(docs.limit(0)).collect() == []


def test_sparse(spark):
    docs = [(0, 0, 1.0), (0, 1, 2.0), (0, 2, 1.0), (1, 1, 1.0), (1, 2, 3.0), (1, 3, 1.0), (2, 0, 2.0), (2, 3, 2.0)]
    df = spark.createDataFrame(docs, "id long, dim int, weight double")
    q = spark.createDataFrame([(9, 0, 1.0), (9, 1, 1.0)], "qid long, dim int, weight double")
    assert scores(sparse.search(df, q, 5)) == {0: 3.0, 2: 2.0, 1: 1.0}
    pairs = spark.createDataFrame([(1, [10, 5, 0, 5], [1.0, 2.0, 3.0, 4.0]), (2, [1], [1e-12]), (3, None, [1.0]), (4, [1, None], [2.0, 3.0])], "k long, i array<int>, v array<double>")
    assert rows(sparse.from_pairs(pairs, "k", "i", "v")) == [(1, 0, 3.0), (1, 5, 4.0), (1, 10, 1.0), (4, 1, 2.0)]
    valid = spark.createDataFrame([([1, 2], [1, 1]), ([2, 1], [1, 1]), ([1, 1], [1, 1]), ([1], [1, 2]), ([], []), (None, [1]), ([1, None], [1, 2]), ([3], [1])], "i array<int>, v array<int>")
    assert [r[0] for r in valid.select(sparse.is_valid(F.col("i"), F.col("v"))).collect()] == [True, False, False, False, True, False, False, True]
    assert rows(sparse.from_dense(spark.createDataFrame([(1, [0.0, 1.0, 0.0, 2.0, 0.0])], "id long, vector array<float>"))) == [(1, 1, 1.0), (1, 3, 2.0)]
    assert abs(sum(r.weight**2 for r in sparse.normalize(df).collect()) - 3) < 1e-9


def test_fusion(spark):
    v, t = ranking(spark, [(1, 0.9), (2, 0.8), (3, 0.7)]), ranking(spark, [(2, 5), (4, 4), (1, 3)])
    assert scores(fusion.weighted(v, t, 0.5, 9, distances=False)) == {2: 0.75, 1: 0.5, 4: 0.25, 3: 0.0}
    a, b = ranking(spark, [(1, 0.9), (2, 0.8)]), ranking(spark, [(2, 5), (1, 3)])
    got = fusion.rrf([(a, False, 1.0), (b, False, 1.0)], 9).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 2] and all(abs(r.score - 0.0325224749) < 1e-9 for r in got)
    d, s = ranking(spark, [(0, 0.1), (1, 0.5), (2, 0.3)]), ranking(spark, [(0, 0.8), (2, 0.6), (3, 0.4)])
    assert scores(fusion.dense_sparse("weighted", d, s, 9)) == {0: 1.0, 2: 0.5, 1: 0.0, 3: 0.0}
    assert scores(fusion.dense_sparse("maximum", d, s, 9)) == {0: 1.0, 2: 0.75, 3: 0.5, 1: 0.0}
    assert scores(fusion.dense_sparse("nonsense", d, s.limit(0), 9)) == {0: 0.5, 1: 0.0, 2: 0.25}
    multi = spark.createDataFrame([(0, 1, 0.1, 1), (0, 2, 0.2, 2), (0, 3, 0.3, 3), (1, 1, 0.15, 1), (1, 3, 0.25, 2), (1, 4, 0.35, 3)], "qid long, id long, score double, rank long")
    g = spark.createDataFrame([(0, 7, 1.0), (1, 7, 1.0)], "qid long, gid long, weight double")
    assert scores(fusion.multi(multi, g, "sum", 3)) == {3: 0.55, 4: 0.35, 1: 0.25}
    assert scores(fusion.multi(multi, g, "max", 1)) == {4: 0.35} and scores(fusion.multi(multi, g, "min", 1)) == {1: 0.1}
    assert rows(fusion.per_query_scores(multi, g).select("id", "query_matches", "scores"))[0] == (1, 2, "100000,150000")
    assert fusion.weighted(v.limit(0), t.limit(0), 0.5, 3).collect() == []


def test_scalar_quantizer(spark):
    df = spark.createDataFrame([(0, [0.0, 0.5, 1.0, -1.0]), (1, [0.5, 0.25, 0.75, 0.0])], "id long, vector array<float>")
    sq = quant.ScalarQuantizer.train(df)
    coded = df.select("id", sq.encode(F.col("vector")).alias("c"))
    assert rows(coded) == [(0, [0, 255, 255, 0]), (1, [255, 0, 0, 255])]
    assert rows(coded.select("id", sq.decode(F.col("c")))) == [(0, [0.0, 0.5, 1.0, -1.0]), (1, [0.5, 0.25, 0.75, 0.0])]
    assert [quant.subspaces(d) for d in (16, 128, 300, 1000)] == [4, 8, 16, 32]


def test_product_codes(spark):
    books = np.array([[[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [1.0, 1.0]]])
    df = spark.createDataFrame([(0, [0.1, 0.1]), (1, [0.9, 0.1]), (2, [0.1, 0.9]), (3, [0.9, 0.9]), (4, [0.5])], "id long, vector array<float>")
    pq = quant.ProductQuantizer(books)
    coded = pq.encode(df)
    assert rows(coded) == [(i, [i]) for i in range(4)]
    q = spark.createDataFrame([(0, [1.0, 1.0])], "qid long, qvec array<float>")
    assert [(r.id, r.score) for r in pq.search(coded, q, 2).orderBy("rank").collect()] == [(3, 0.0), (1, 1.0)]
    assert rows(coded.select("id", pq.decode(F.col("codes"))))[3] == (3, [1.0, 1.0])


def table(spark, name):
    return spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")


def recall(spark, approx, exact):
    a, b = ({(r.qid, r.id) for r in x.collect()} for x in (approx, exact))
    return len(a & b) / len(b)


def test_recall_of_the_approximate_searches(spark):
    v = table(spark, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).cache()
    q = v.where("id < 10").select(F.col("id").alias("qid"), F.col("vector").alias("qvec"))
    exact = knn.knn_join(v, q, 10).cache()
    turn = quant.rotation(64)
    assert np.abs(turn @ turn.T - np.eye(64)).max() < 1e-9
    rv = quant.rotated(v, turn)
    rq = quant.rotated(q.withColumnsRenamed({"qid": "id", "qvec": "vector"}), turn).withColumnsRenamed({"id": "qid", "vector": "qvec"})
    assert recall(spark, knn.rerank(quant.sign_search(quant.sign_codes(rv), rq, 100), v, q, 10), exact) >= 0.9
    c = ivf.train_centroids(v, 8)
    own = ivf.assign(v, c)
    assert recall(spark, ivf.flat_search(own, q, c, 10, 8), exact) == 1.0
    few = recall(spark, ivf.flat_search(own, q, c, 10, 4), exact)
    pq = quant.ProductQuantizer.of(quant.train_codebook(ivf.residuals(own, c), 16, 32))
    coded = pq.encode(ivf.residuals(own, c)).join(own.select("id", "list_id"), "id")
    near = ivf.pq_search(coded, q, c, pq, 50, 8)
    assert few >= 0.5 and recall(spark, knn.rerank(near, v, q, 10), exact) >= 0.7


def test_versions(spark):
    h = spark.createDataFrame([(1, 1, 10, False, 1.0, ["a", "b"]), (1, 2, 20, False, 4.0, ["a", "c"]), (1, 3, 30, True, 4.0, []), (2, 4, 15, False, 2.0, ["a"])], "vector_id long, version_id long, ts long, is_deleted boolean, value double, keys array<string>")
    assert rows(versioning.latest(h).select("vector_id", "version_id")) == [(1, 3), (2, 4)] and rows(versioning.active_ids(h)) == [(2,)]
    assert rows(versioning.snapshot_at(h, 25).select("version_id")) == [(2,), (4,)] and rows(versioning.modified_since(h, 15)) == [(1,)]
    d = versioning.diff(h, F.col("value"), F.col("keys")).orderBy("to_version").first()
    assert (d.value_changed, d.distance, d.added, d.removed, d.kept) == (True, 3.0, ["c"], ["b"], ["a"])
    back = versioning.rollback(h, spark.createDataFrame([(1, 1), (1, 3), (5, 9)], "vector_id long, version_id long"), F.lit(99), 5).collect()
    assert [(r.vector_id, r.version_id, r.value, r.description) for r in back] == [(1, 5, 1.0, "rollback to version 1")]
    assert rows(versioning.compact(h, 18, keep_deleted=False).select("version_id")) == [(2,), (3,), (4,)]
    assert tuple(versioning.stats(h).first()) == (2, 1, 1, 4, 2.0, 5) and versioning.latest(h.limit(0)).collect() == []
    assert versioning.retained(h, 1).count() == 2


def test_changes(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(10)], "id long, x string").repartition(4)
    dead = spark.createDataFrame([(3,), (4,), (4,)], "id long")
    left = mutation.compacted(df, dead).orderBy("id").collect()
    assert [(r.id, r.old_id) for r in left] == list(enumerate([0, 1, 2, 5, 6, 7, 8, 9]))
    assert rows(mutation.newly_deleted(df, dead, spark.createDataFrame([(4,), (5,), (5,), (77,), (None,)], "id long"))) == [(5,)]
    assert tuple(mutation.deletion_stats(df, dead).first()) == (10, 2, 0.2, False) and tuple(mutation.deletion_stats(df.limit(0), dead).first()) == (0, 0, 0.0, False)
    m = spark.sql("select map('a', '1', 'b', '2') as m, map('b', '3', 'c', '4') as p, cast(null as map<string,string>) as n")
    got = m.select(mutation.patched(F.col("m"), F.col("p")), mutation.patched(F.col("n"), F.col("p")), mutation.patched(F.col("m"), F.col("n"))).first()
    assert tuple(got) == ({"a": "1", "b": "3", "c": "4"}, {"b": "3", "c": "4"}, {"a": "1", "b": "2"})


def test_shards(spark):
    ids = spark.range(1000)
    routed = ids.select(sharding.route(sharding.key_hash(F.col("id")), sharding.ring([0, 1, 2], 50)).alias("shard"))
    assert all(150 < r.n < 550 for r in sharding.shard_stats(routed).collect())
    moved = sharding.rebalance(ids, [0, 1, 2], 3).collect()
    assert moved and {r.new_shard for r in moved} == {3}
    for s, i in ((42, 123456789), (0x7FFF, (1 << 48) - 1)):
        a, b = sharding.split_id(sharding.global_id(F.lit(s), F.lit(i)))
        assert one(spark, a, b) == (s, i)


def test_statistics(spark):
    r = spark.createDataFrame([(1, "category", "electronics"), (2, "category", "electronics"), (3, "category", "books"), (4, "category", "clothing"), (4, "category", "clothing"), (1, "n", "5"), (2, "n", "x"), (None, "n", "5"), (3, None, "5"), (3, "n", None)], "id long, field string, value string")
    assert rows(stats.planner_stats(r))[0] == ("category", 3, 4, 1 / 3) and rows(stats.most_common(r))[0] == ("category", "electronics", 2)
    assert rows(stats.field_stats(r))[0] == ("category", 3, 4, 4 / 3, 1, 2) and rows(stats.numeric_stats(r)) == [("n", 1, 1, 5.0, 5.0)]
    ask = spark.createDataFrame([("p", "category", "books"), ("p", "n", "zzz"), ("q", "none", "a")], "plan string, field string, value string")
    assert rows(stats.plans(ask, stats.value_counts(r))) == [("p", "category,n", 0.125, "hybrid"), ("q", "none", 1.0, "post")]
    h = spark.createDataFrame([("a", 0.5), ("a", 5.0), ("a", 50.0), ("a", None)], "g string, v double")
    assert rows(stats.histogram(h, "g", "v", [1.0, 5.0, 10.0])) == [("a", 1.0, 1), ("a", 5.0, 2), ("a", 10.0, 2), ("a", math.inf, 3)]


def test_adaptive_search_is_exact_above_its_threshold(spark):
    import __spark_entry__

    d = "/root/testdata/sf0.1"
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = v.where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("qvec"))
    got = __spark_entry__.queries()["adaptive_search"](spark, d)
    want = knn.knn_join(v, q, 10)
    assert v.count() >= 2000 and {(r.qid, r.id, r["rank"]) for r in got.collect()} == {(r.qid, r.id, r["rank"]) for r in want.collect()}


@pytest.mark.parametrize("name", ["ivf_trained_search", "pq_trained_rerank", "rabitq_rotated_rerank", "ivf_flat_search", "stored_lists_search", "pq_rerank", "rabitq_rerank", "sq_search", "sq_rerank", "two_stage_rerank", "adaptive_search", "ivfpq_search"])
def test_recall_of_trained_searches(spark, name):
    import __spark_entry__

    d = "/root/testdata/sf0.1"
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = v.where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("qvec"))
    share = recall(spark, __spark_entry__.queries()[name](spark, d), knn.knn_join(v, q, 10))
    print(f"RECALL {name} {share:.3f}")
    assert share >= 0.9


def some_texts(spark):
    """Texts of few words, of which one id has two; queries with repeated, unknown and no words; both also as lists."""
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(40)])
    docs = [(i, " ".join(words[np.minimum(rng.geometric(0.12, rng.integers(1, 14)) - 1, 39)])) for i in range(60)]
    asks = [(i, docs[i][1]) for i in range(0, 60, 6)] + [(100, "w0 w0 w1"), (101, "w0"), (102, ""), (103, "w0 unseen"), (None, "w0"), (104, None)]
    docs += [(7, "w0, W39 w1"), (None, "w0 w1"), (61, None), (62, " ")]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(asks, "qid long, query string"), docs, asks


def test_bm25_min_score_equals_all_scores(spark, monkeypatch):
    docs, q, _, _ = some_texts(spark)
    every = rows(text.bm25_scores(text.postings(docs), q.where("qid is not null")).select("qid", "id", "score"))
    for least in (0, -1, 2.5, every[len(every) // 3][2], 1e6):
        want = [(a, b) for a, b, s in every if s >= least]
        for dense in (0.01, 256, 1e9):
            monkeypatch.setattr(text, "DENSE", dense)
            assert rows(text.bm25_min_score(docs, q, least)) == want
    assert rows(text.bm25_min_score(docs, q, 2.5, block=3)) == rows(text.bm25_min_score(docs, q, 2.5)) != []
    assert text.bm25_min_score(docs.limit(0), q, 0).collect() == text.bm25_min_score(docs, q.limit(0), 0).collect() == []


def test_bm25_min_score_shuffles_no_pairs(spark):
    from vantora.plans import search

    plan = search.QUERIES["bm25_min_score"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_must_match_equals_sets_of_words(spark):
    docs, q, texts, asks = some_texts(spark)
    words = {}
    for i, t in texts:
        if i is not None:
            words.setdefault(i, set()).update((t or "").lower().replace(",", "").split())
    want = sorted((a, i) for a, t in asks for i, w in words.items() if a is not None and t and w >= set(t.split()))
    assert (0, 0) in want and (100, 7) in want and all(a not in (102, 103) for a, _ in want)
    assert rows(text.must_match(text.token_rows(docs), q)) == want == rows(text.must_match(text.postings(docs), q))
    assert rows(text.must_match(text.token_rows(docs), q, block=3)) == want
    assert text.must_match(text.token_rows(docs.limit(0)), q).collect() == text.must_match(text.token_rows(docs), q.limit(0)).collect() == []


def test_must_match_shuffles_no_pairs(spark):
    from vantora.plans import search

    plan = search.QUERIES["bm25_must_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
