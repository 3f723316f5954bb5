from datetime import datetime, timedelta

from vantora.operators import incremental as inc
from vantora.session import shared_path

T = [datetime(2025, 1, 1) + timedelta(hours=i) for i in range(10)]
ENTRY = "primary_addr string, seq long, arrived_at timestamp, op string, coll_name string, id long, payload string, low_seq int"
RUN = "replica string, primary_addr string, last_seq long, last_sync timestamp, status string, changed int"


def test_cases(spark):
    entries = [
        ("p", 1, T[0], "Insert", "c", 1, None, 0),
        ("p", 2, T[0], "Insert", "c", 2, "{}", 0),
        ("p", 2, T[5], "Insert", "c", 2, "{}", 0),  # repeated, unchanged
        ("p", 3, T[0], "Insert", "c", 3, "{}", 0),
        ("p", 3, T[5], "Insert", "c", 3, None, 0),  # changed late
        ("p", 4, T[6], "Insert", "c", 4, None, 0),  # first came late
        ("p", 5, T[4], "Insert", "c", 5, None, 0),  # at the instant of the run
        ("p", 6, T[1], "Insert", "c", 6, None, 0),
        ("p", 6, T[2], "Delete", "c", 6, None, 0),  # changed early
        ("p", 9, T[3], "Insert", "c", 9, None, 0),  # above the watermark
        ("q", 1, T[3], "Insert", "c", 9, None, 0),
        (None, 1, T[3], "Insert", "c", 9, None, 0),
        ("p", None, T[3], "Insert", "c", 9, None, 0),
    ]
    runs = [
        ("a", "p", 8, T[4], "synced", 1), ("a", "p", 8, T[4], "synced", 1), ("a", "p", 2, T[1], "Synced", 1), ("a", "p", 99, T[9], "Error", 1),
        ("b", "p", None, T[4], "Syncing", 1),
        ("d", "none", 1, T[4], "Synced", 1),
        (None, "p", 1, T[4], "Synced", 1),
    ]
    got = sorted(tuple(r) for r in inc.changes_since(spark.createDataFrame(entries, ENTRY), inc.last_success(spark.createDataFrame(runs, RUN))).collect())
    assert got == [("a", 3), ("a", 4), ("a", 9)] + [("b", i) for i in (1, 2, 3, 4, 5, 6, 9)]


def test_replication_is_published_at_once(spark):
    entries = spark.createDataFrame([("p", 1, T[0], "Insert", "c", 1, None, 0), ("p", 2, T[3], "Insert", "c", 2, None, 0)], ENTRY)
    runs = spark.createDataFrame([("a", "p", 1, T[1], "Synced", 1), ("b", "z", None, T[1], "Error", 1)], RUN)
    store = inc.CommittedRuns(spark, shared_path(spark, "replicate"))
    assert [tuple(r) for r in store.replicate(entries, runs).collect()] == [("a", 2)] and store.committed() == [1]
    assert {r.replica: r.low_seq for r in store.marks().collect()} == {"a": 2, "b": None}
    assert store.replicate(entries.limit(0), runs).collect() == [] and store.committed() == [1, 2]


def test_replication_resumes_from_what_it_published(spark):
    first = [("p", i, T[2], "Insert", "c", i, None, 0) for i in range(1, 6)]
    later = [("p", 3, T[4], "Delete", "c", 3, None, 0), ("p", 4, T[4], "Insert", "c", 4, None, 0), ("p", 6, T[4], "Insert", "c", 6, None, 0), ("p", 0, T[5], "Insert", "c", 0, None, 0)]
    runs = spark.createDataFrame([("a", "p", 2, T[3], "Synced", 1), ("b", "p", None, None, "Error", 1)], RUN)
    store = inc.CommittedRuns(spark, shared_path(spark, "resume"))
    one, two = spark.createDataFrame(first, ENTRY), spark.createDataFrame(first + later, ENTRY)
    assert sorted(tuple(r) for r in store.replicate(one, runs).collect()) == [("a", 3), ("a", 4), ("a", 5)] + [("b", i) for i in range(1, 6)]
    assert store.replicate(one, runs).collect() == []
    # a run that dies before it publishes leaves nothing behind
    publish, store.publish = store.publish, lambda *a: 1 / 0
    try:
        store.replicate(two, runs)
    except ZeroDivisionError:
        pass
    store.publish = publish
    assert store.committed() == [1, 2]
    want = [(r, i) for r in "ab" for i in (0, 3, 6)]  # new, changed, late; 4 is a repeated entry
    assert sorted(tuple(r) for r in store.replicate(two, runs).collect()) == want
    assert store.replicate(two, runs).collect() == []


def test_two_writers_of_one_run(spark):
    store = inc.CommittedRuns(spark, shared_path(spark, "writers"))
    rows, mark = spark.createDataFrame([(1,)], "n long"), spark.createDataFrame([(1, None)], "seq long, key string")
    store.publish(1, rows, mark)
    try:
        store.publish(1, rows.where("n > 1"), mark)
        raise AssertionError("published twice")
    except RuntimeError:
        pass
    assert store.rows(1).count() == 1 and store.committed() == [1]


def test_rows_of_one_instant_come_once(spark):
    store = inc.CommittedRuns(spark, shared_path(spark, "instants"))
    parts = [[(1, "a"), (2, "b")], [(1, "a"), (2, "b"), (2, "c")], [(2, "c"), (2, "d"), (2, "b")], [(2, "d"), (3, "e"), (None, "f")]]
    got = []
    for part in parts:
        run = store.process(spark.createDataFrame(part, "n long, v string"), "n", key=["v"])
        got.append(sorted(r.v for r in store.rows(run).collect()))
    assert got == [["a", "b"], ["c"], ["d"], ["e"]]
    assert store.process(spark.createDataFrame(parts[3], "n long, v string"), "n", key=["v"]) is None


def test_empty(spark):
    e, r = spark.createDataFrame([], ENTRY), spark.createDataFrame([], RUN)
    assert inc.changes_since(e, inc.last_success(r), inc.upper_bound(e)).collect() == []


def test_committed_runs(spark):
    runs = inc.CommittedRuns(spark, shared_path(spark, "runs"))
    one = spark.createDataFrame([(1, "a"), (2, "b")], "n long, v string")
    assert runs.process(one, "n") == 1 and runs.process(one, "n") is None

    def fails(df):
        raise RuntimeError("lost")

    two = spark.createDataFrame([(2, "b"), (3, "c"), (None, "d")], "n long, v string")
    try:
        runs.process(two, "n", fails)
    except RuntimeError:
        pass
    assert runs.committed() == [1]
    assert runs.process(two, "n") == 2
    assert [tuple(r) for r in runs.rows(2).collect()] == [(3, "c")]


def test_join_beyond_the_broadcast_bound(spark):
    from vantora.session import guarded_join

    big = spark.range(1000).selectExpr("id % 3 k", "id v")
    side = spark.createDataFrame([(0, "x"), (1, "y"), (5, "z")], "k long, w string")
    a = sorted(map(tuple, guarded_join(big, side, ["k"], "left").collect()), key=str)
    b = sorted(map(tuple, guarded_join(big, side, ["k"], "left", rows=1).collect()), key=str)
    assert a == b and len(a) == 1000
