"""The change feed against a straightforward replay."""

import json
import random
from datetime import datetime, timedelta

import pytest

from vantora.operators import changefeed as cf

SCHEMA = "primary_addr string, seq long, ts timestamp, arrived_at timestamp, op string, coll_name string, id long, payload string"
T0 = datetime(2025, 1, 1)


def replay(rows):
    newest = {}
    for r in rows:
        if r[0] is None or r[1] is None:
            continue
        k = (r[0], r[1])
        if k not in newest or (r[3] or datetime.min) > (newest[k][3] or datetime.min):
            newest[k] = r
    live = {}
    for (p, s), r in sorted(newest.items()):
        op = cf.OPS.get("".join(c for c in (r[4] or "").lower() if c.isalpha()))
        coll, i = r[5], r[6]
        try:
            body = json.loads(r[7]) if r[7] else {}
        except ValueError:
            body = {}
        key = (p, coll, i)
        if op == "insert" and i is not None:
            live[key] = s
        elif op == "insertbatch" and body.get("count", 0) >= 1:
            for x in range(body["start_id"], body["start_id"] + body["count"]):
                live[p, coll, x] = s
        elif op == "delete":
            live.pop(key, None)
        elif op == "deletebatch":
            for x in body.get("ids", []):
                live.pop((p, coll, x), None)
        elif op == "update" and key in live:
            del live[key]
            if body.get("new_id") is not None:
                live[p, coll, body["new_id"]] = s
        elif op == "updatemetadata" and key in live:
            live[key] = s
        elif op == "deletecollection":
            live = {k: v for k, v in live.items() if k[:2] != (p, coll)}
    return {(k[1], k[2], s) for k, s in live.items()}


def feed(seed, n=400, ids=12):
    rng = random.Random(seed)
    rows = []
    for s in range(n):
        op = rng.choice(["Insert", "INSERT", "insert_batch", "BatchInsert", "Delete", "DeleteBatch", "Update", "update", "Update", "UpdateMetadata", "Compact", "DeleteCollection" if rng.random() < 0.1 else "Checkpoint", "odd"])
        p = rng.choice("ab")
        i = rng.randrange(ids)
        body = {"start_id": i, "count": rng.randrange(0, 4), "ids": [i, (i + 1) % ids, i], "new_id": rng.randrange(ids)}
        text = rng.choice([json.dumps(body), json.dumps(body, separators=(",", ":")), json.dumps(body), "{broken" if rng.random() < 0.05 else json.dumps(body)])
        rows.append((p, s, None, T0 + timedelta(seconds=s), op, p + rng.choice("xy"), i, text))
    for r in rng.sample(rows, n // 5):  # late corrections and repetitions
        op = rng.choice([r[4], "Delete", "Insert"])
        rows.append((*r[:3], r[3] + timedelta(days=1), op, *r[5:]))
        rows.append(r)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_replay(spark, seed):
    rows = feed(seed)
    got = {tuple(r) for r in cf.live_keys(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == replay(rows)


def test_long_chain_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(cf, "BLOCK", 8)
    rows = [("p", 0, None, T0, "Insert", "c", 0, None)]
    rows += [("p", i + 1, None, T0, "Update", "c", i, json.dumps({"new_id": i + 1})) for i in range(100)]
    rows += [("p", 200 + i, None, T0, "Update", "c", 500 + i, json.dumps({"new_id": 501 + i})) for i in range(50)]
    rows += [("p", 300, None, T0, "Update", "c", 100, json.dumps({"new_id": 100}))]
    got = {tuple(r) for r in cf.live_keys(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == replay(rows) == {("c", 100, 300)}


@pytest.mark.parametrize("seed", range(2))
def test_replay_in_small_blocks(spark, monkeypatch, seed):
    monkeypatch.setattr(cf, "BLOCK", 16)
    rows = feed(seed + 10)
    got = {tuple(r) for r in cf.live_keys(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == replay(rows)


def test_empty_nulls_and_extra_columns(spark):
    df = spark.createDataFrame([], SCHEMA + ", e string, blk int, kind string")
    assert cf.live_keys(df).collect() == []
    rows = [(None, 1, None, None, "Insert", "c", 1, None), ("p", None, None, None, "Insert", "c", 1, None), ("p", 1, None, None, None, "c", 1, None), ("p", 2, None, None, "Insert", None, 1, None), ("p", 3, None, None, "Insert", "c", None, None), ("p", 4, None, None, "Insert", "c", 7, None)]
    assert [tuple(r) for r in cf.live_keys(spark.createDataFrame(rows, SCHEMA)).collect()] == [("c", 7, 4)]


def test_repository_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/wal_entries.parquet")
    rows = [tuple(r) for r in df.select("primary_addr", "seq", "ts", "arrived_at", "op", "coll_name", "id", "payload").collect()]
    got = {tuple(r) for r in cf.live_keys(df).collect()}
    assert got == replay(rows) and got


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_base_and_feed_equal_a_full_replay(spark, seed):
    rows = [r for r in feed(seed) if r[0] is not None and r[1] is not None]
    half = sorted(r[1] for r in rows)[len(rows) // 2]
    base = cf.merge_changes(spark.createDataFrame([], cf.BASE), frame(spark, [r for r in rows if r[1] <= half]))
    got = cf.merge_changes(base, frame(spark, [r for r in rows if r[1] > half]))
    assert {(r.coll_name, r.id, r.seq) for r in got.collect()} == replay(rows)
    assert sorted(map(tuple, cf.merge_changes(base, frame(spark, [])).collect())) == sorted(map(tuple, base.collect()))


def test_late_and_corrected_entries_replay_their_primary_only(spark):
    old, new = T0, T0 + timedelta(days=1)
    first = [("a", 1, old, old, "Insert", "c", 1, None), ("a", 3, old, old, "Delete", "c", 2, None), ("b", 1, old, old, "Insert", "c", 7, None), ("b", 2, old, old, "Insert", "d", 8, None)]
    later = [("a", 2, new, new, "Insert", "c", 2, None), ("a", 1, new, new, "Insert", "c", 5, None), ("b", 3, new, new, "Update", "c", 7, '{"new_id": 9}'), ("b", 4, new, new, "DeleteCollection", "d", None, None), ("c", 1, new, new, "Insert", "c", 11, None)]
    base = cf.merge_changes(spark.createDataFrame([], cf.BASE), frame(spark, first))
    marks = spark.createDataFrame([("a", 3, old), ("b", 2, old)], "primary_addr string, mark_seq long, mark_time timestamp")
    got = {(r.coll_name, r.id, r.seq) for r in cf.refresh(base, marks, frame(spark, first + later)).collect()}
    assert got == {("c", 5, 1), ("c", 9, 3), ("c", 11, 1)}


def test_large_batches_are_split(spark, monkeypatch):
    rows = [("a", 1, T0, T0, "InsertBatch", "c", None, '{"start_id": 5, "count": 3000000}'), ("a", 2, T0, T0, "DeleteBatch", "c", None, '{"ids": [5, 6]}'), ("a", 3, T0, T0, "Delete", "c", 2000000, None), ("a", 4, T0, T0, "BatchInsert", "c", None, '{"start_id": 1, "count": 3}'), ("a", 5, T0, T0, "InsertBatch", "c", None, '{"count": 100000}')]
    out = cf.live_keys(frame(spark, rows))
    r = out.selectExpr("count(*) n", "min(id) lo", "max(id) hi", "count(distinct id) d").first()
    assert tuple(r) == (3000000 - 3 + 3, 1, 3000004, 3000000)
    monkeypatch.setattr(cf, "BATCH", 4)
    rows = feed(5)
    assert {tuple(r) for r in cf.live_keys(frame(spark, rows)).collect()} == replay(rows)
