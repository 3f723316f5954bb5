"""Rank walks and distinctive terms against plain versions."""

import math
from collections import defaultdict
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantora.llm import distinctive, ranking

SCORES = [("a", False), ("b", True), ("c", True)]
ROW = "query_id long, id long, a double, b double, c double, scored_at timestamp, weight string, s0 string, p0 string"
T = datetime(2025, 1, 1)


def rows_of(seed=0, queries=6, items=40):
    rng = np.random.default_rng(seed)
    out = []
    for q in range(queries):
        for i in range(int(rng.integers(1, items))):
            v = [None if x < 0.1 else float("nan") if x < 0.2 else float(np.round(rng.normal() * 10 ** rng.integers(0, 3), 0)) for x in rng.random(3)]
            out.append((q, i, *v, T, "w", "s", "p"))
    return out


def brute(rows, damping=ranking.DAMPING, steps=ranking.STEPS):
    by = defaultdict(dict)
    for q, i, *v in rows:
        by[q][i] = [None if x is None or math.isnan(x) else (x if j == 0 else -x) for j, x in enumerate(v[:3])]
    out = {}
    for q, items in by.items():
        ids, n = list(items), len(items)
        move = np.zeros((n, n))
        for j in range(3):
            for x, i in enumerate(ids):
                mine = items[i][j]
                up = [y for y, o in enumerate(ids) if items[o][j] is not None and (mine is None or items[o][j] < mine)]
                for y in up or [x]:
                    move[x, y] += 1 / 3 / len(up or [x])
        w = np.full(n, 1 / n)
        for _ in range(steps):
            w = damping / n + (1 - damping) * w @ move
        for x, i in enumerate(ids):
            places = tuple(None if items[i][j] is None else 1 + sum(o[j] is not None and o[j] < items[i][j] for o in items.values()) for j in range(3))
            out[q, i] = (places, w[x])
    return out


@pytest.mark.parametrize("options", [{}, {"task_items": 20, "steps": 3, "block": 4}])
def test_walk(spark, options):
    rows = rows_of()
    want = brute(rows, steps=options.get("steps", ranking.STEPS))
    got = {(r.query_id, r.id): ((r.p0, r.p1, r.p2), r.weight) for r in ranking.rank_walk(spark.createDataFrame(rows, ROW), SCORES, **options).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9, k


@pytest.mark.parametrize("options", [{}, {"task_items": 5, "block": 4}])
def test_leaders_are_all_items_of_the_first_places(spark, options):
    rows = rows_of(7, queries=12 if not options else 2, items=60 if not options else 20)
    want = {k for k, (places, _) in brute(rows, steps=0).items() if all(p is not None and p <= 5 for p in places)}
    ranked = ranking.rank_walk(spark.createDataFrame(rows, ROW), SCORES, **options)
    assert {tuple(r) for r in ranking.leaders(ranked, 5, 3).collect()} == want and want
    for q, group in __import__("itertools").groupby(sorted((r.query_id, -r.weight, r.id, r.place, r.ahead) for r in ranked.collect()), key=lambda r: r[0]):
        group = list(group)
        assert [r[3] for r in group] == list(range(1, len(group) + 1))
        assert [r[4] for r in group] == [sum(o[1] < r[1] for o in group) for r in group]


def test_weights_of_a_query_add_up(spark):
    sums = ranking.rank_walk(spark.createDataFrame(rows_of(3), ROW), SCORES).groupBy("query_id").agg(F.sum("weight").alias("w")).collect()
    assert all(abs(r.w - 1) < 1e-9 for r in sums)


def test_a_large_query_is_ordered_by_the_walk(spark, tmp_path):
    from vantora.llm import queries

    n, rng = 20_000, np.random.default_rng(4)
    scores = rng.standard_normal((n, 3))
    rows = [(1, i, *map(float, x), T) for i, x in enumerate(scores)]
    spark.createDataFrame(rows, "query_id long, id long, vector_score double, text_score double, combined_score double, scored_at timestamp").write.parquet(f"{tmp_path}/hybrid_results.parquet")
    _, weight = ranking.walk(np.ones(n, np.int64), scores * [1, -1, -1], steps=400)
    want = np.lexsort((np.arange(n), -np.round(weight * n, 9)))
    got = [r.id for r in queries.p4_ranking(spark, str(tmp_path)).orderBy("place").collect()]
    assert len(got) == n and np.mean(np.array(got) == want) > 0.999


def test_latest_row_counts_and_empty(spark):
    late = datetime(2025, 1, 2)
    rows = [(1, 1, 1.0, 1.0, 1.0, T, "", "", ""), (1, 1, 9.0, 1.0, 1.0, late, "", "", ""), (1, 2, 5.0, 1.0, 1.0, T, "", "", ""), (1, 2, 5.0, 1.0, 1.0, T, "", "", ""), (1, 3, 0.0, -0.0, 1.0, None, "", "", ""), (None, 1, 1.0, 1.0, 1.0, T, "", "", ""), (1, None, 1.0, 1.0, 1.0, T, "", "", "")]
    got = {r.id: (r.p0, r.p1, r.p2) for r in ranking.rank_walk(spark.createDataFrame(rows, ROW), SCORES).collect()}
    assert got == {1: (3, 1, 1), 2: (2, 1, 1), 3: (1, 3, 1)}
    assert ranking.rank_walk(spark.createDataFrame([], ROW), SCORES).collect() == []


TERM = "entry_no long, index_id long, segment_no int, term string, doc_ids array<long>, term_freqs array<int>, tf int, df string"


def test_terms(spark):
    rows = [(1, 1, 0, " Blue", [1, 2, 3], [5, 1, 2], 0, ""), (2, 1, 0, "blue", [1, 4], [7, 1, 9], 0, ""), (3, 1, 0, "RED", [1, None, 2], [1, 3, 0], 0, ""), (4, 1, 0, "red", [3, 3], [None, 4], 0, "")]
    rows += [(5, 1, 0, None, [1], [1], 0, ""), (6, 1, 0, "  ", [1], [1], 0, ""), (7, None, 0, "x", [1], [1], 0, ""), (8, 1, 0, "x", None, [1], 0, ""), (9, 1, 0, "x", [1], None, 0, ""), (10, 1, 0, "x", [], [], 0, ""), (11, 2, 0, "only", [9], [3], 0, ""), (12, 1, 0, "y" * 50_000, [7], [2], 0, "")]
    got = {(r.index_id, r.doc_id, r.term): (r.tf, r.df, r.n_docs, r.llr) for r in distinctive.term_scores(spark.createDataFrame(rows, TERM)).collect()}
    tf = {(1, "blue"): 7, (2, "blue"): 1, (3, "blue"): 2, (4, "blue"): 1, (1, "red"): 1, (3, "red"): 4, (7, "y" * 50_000): 2}
    assert {(k[1], k[2]): v[0] for k, v in got.items() if k[0] == 1} == tf
    total = sum(tf.values())

    def x(v):
        return v * math.log(v / total) if v else 0.0

    for (d, t), n in tf.items():
        doc, term = sum(v for k, v in tf.items() if k[0] == d), sum(v for k, v in tf.items() if k[1] == t)
        llr = 2 * (x(n) + x(doc - n) + x(term - n) + x(total - doc - term + n) - x(doc) - x(total - doc) - x(term) - x(total - term))
        sign = 1 if n * total >= doc * term else -1
        assert abs(got[1, d, t][3] - sign * max(0, llr)) < 1e-5
        assert got[1, d, t][1:3] == (sum(k[1] == t for k in tf), 5)
    assert got[2, 9, "only"] == (3, 1, 1, 0.0)
    assert distinctive.term_scores(spark.createDataFrame([], TERM)).collect() == []
    assert [r.term for r in distinctive.term_scores(spark.createDataFrame(rows, TERM), least_tf=4, least_df=2, one_in=2).collect()] == ["red"]
