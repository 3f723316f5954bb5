"""Applying a feed of inserts, updates and deletes: the live keys after all entries, in log order.

Each log is ordered by ``seq`` within its ``primary_addr``. Copies of an entry are reduced to the one that
arrived last, entries become events on keys, and the latest event of each key decides. An ``Update`` moves a
key only if it was live, which may hang on an earlier ``Update``; such dependencies are resolved by pointer
jumping, in as many rounds as the logarithm of the longest chain.

The changes are merged into a base: of the base only the keys that the feed touches take part, as if they had been set
at their seq; the other rows pass by, those of collections that the feed deletes are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut, guarded_join, is_small, task_count

#: The operations by their letters in lower case, with the two spellings of the batch forms.
OPS = {
    "insert": "insert",
    "insertbatch": "insertbatch",
    "batchinsert": "insertbatch",
    "delete": "delete",
    "deletebatch": "deletebatch",
    "batchdelete": "deletebatch",
    "update": "update",
    "updatemetadata": "updatemetadata",
    "deletecollection": "deletecollection",
}
#: Log positions in a block; the events of one key are ordered block by block.
BLOCK = 1 << 16
#: Ids of a batch that one row is expanded to; larger batches are split and spread first.
BATCH = 1 << 16
BASE = "primary_addr string, coll_name string, id long, seq long"
PAYLOAD = "new_id bigint, start_id bigint, count bigint, ids array<bigint>"
KEY = ["primary_addr", "coll_name", "id"]


def latest_copies(entries: DataFrame) -> DataFrame:
    """One row for each (primary_addr, seq): the copy that arrived last.

    Copies that arrived at the same instant are ordered by op, payload, collection and id, so repeated runs agree. The rank limit is
    applied within each partition before the shuffle, so a hot entry's copies do not travel. Rows without
    primary_addr or seq are ignored, a null arrival loses.
    """
    newest = W.partitionBy("primary_addr", "seq").orderBy(
        F.desc_nulls_last("arrived_at"), F.desc_nulls_last("op"), F.desc_nulls_last("payload"), F.desc_nulls_last("coll_name"), F.desc_nulls_last("id")
    )
    return (
        entries.where(F.col("primary_addr").isNotNull() & F.col("seq").isNotNull())
        .select("primary_addr", "seq", "arrived_at", "op", "coll_name", "id", "payload")
        .withColumn("_rn", F.row_number().over(newest))
        .where("_rn = 1")
        .drop("_rn", "arrived_at")
    )


def normal_op(op):
    """The operation's canonical name; null for those that change nothing and for unknown ones."""
    plain = F.regexp_replace(F.lower(op), "[^a-z]", "")
    names = F.create_map(*[F.lit(x) for pair in OPS.items() for x in pair])
    return F.try_element_at(names, plain)


def _decoded(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries with canonical ops and parsed payloads ``p``, deletions of collections as primary_addr, coll_name, wiped_at)."""
    plain = latest_copies(entries).withColumn("op", normal_op(F.col("op"))).where("op is not null and coll_name is not null")
    body = F.from_json("payload", PAYLOAD)
    plain = plain.withColumn("p", F.when(F.col("op").isin("insertbatch", "deletebatch", "update"), body)).drop("payload")
    wiped = plain.where("op = 'deletecollection'").groupBy("primary_addr", "coll_name").agg(F.max("seq").alias("wiped_at"))
    return plain.where("op <> 'deletecollection'"), wiped


def _large_batches(entries: DataFrame) -> bool:
    """Whether an entry inserts more ids than one row should be expanded to."""
    batches = entries.where(normal_op(F.col("op")) == "insertbatch").select(F.get_json_object("payload", "$.count").try_cast("bigint").alias("n"))
    return not batches.where(F.col("n") > BATCH).isEmpty()


def key_events(entries: DataFrame, wiped: DataFrame | None = None, plain: DataFrame | None = None) -> DataFrame:
    """Events on keys: primary_addr, coll_name, id, seq, kind, other.

    kind: ``set``, ``drop``, ``touch`` (sets the seq if live), ``out`` (an Update leaves the key; other is
    new_id) and ``in`` (it enters; other is the old id). Entries before the last DeleteCollection of their
    collection are left out: nothing of them survives it. Unreadable payloads, counts below 1 and null ids
    give no event; an Update without new_id only drops. A batch of more than ``BATCH`` ids is split into ranges,
    which are spread over tasks before they are expanded.
    """
    if plain is None:
        plain, wiped = _decoded(entries)
    plain = guarded_join(plain, wiped, ["primary_addr", "coll_name"], "left", spread=F.col("seq"))
    plain = plain.where(F.col("wiped_at").isNull() | (F.col("seq") > F.col("wiped_at")))
    large = None
    if _large_batches(entries):
        size, tasks = F.col("p.count"), task_count(entries.sparkSession, 0, 1)
        many = (F.col("op") == "insertbatch") & F.coalesce(size > BATCH, F.lit(False))
        pieces = plain.where(many & F.col("p.start_id").isNotNull()).select("primary_addr", "coll_name", "seq", (F.col("p.start_id") + size).alias("end"), F.explode(F.sequence(F.col("p.start_id"), F.col("p.start_id") + size - 1, F.lit(BATCH).cast("bigint"))).alias("lo"))
        pieces = pieces.repartition(4 * tasks, "primary_addr", "coll_name", "lo")
        ids = F.explode(F.sequence("lo", F.least(F.col("lo") + BATCH, F.col("end")) - 1))
        large = pieces.select("primary_addr", "coll_name", ids.alias("id"), "seq", F.lit("set").alias("kind"), F.lit(None).cast("long").alias("other"))
        plain = plain.where(~many)

    def event(i, kind, other=None):
        return F.struct(i.alias("id"), F.lit(kind).alias("kind"), (F.lit(None).cast("long") if other is None else other).alias("other"))

    batch = F.when((F.col("p.count") >= 1) & F.col("p.start_id").isNotNull(), F.sequence(F.col("p.start_id"), F.col("p.start_id") + F.col("p.count") - 1))
    made = (
        F.when(F.col("op") == "insert", F.array(event(F.col("id"), "set")))
        .when(F.col("op") == "delete", F.array(event(F.col("id"), "drop")))
        .when(F.col("op") == "updatemetadata", F.array(event(F.col("id"), "touch")))
        .when(F.col("op") == "insertbatch", F.transform(batch, lambda i: event(i, "set")))
        .when(F.col("op") == "deletebatch", F.transform(F.array_distinct("p.ids"), lambda i: event(i, "drop")))
        .when(F.col("op") == "update", F.array(event(F.col("id"), "out", F.col("p.new_id")), event(F.col("p.new_id"), "in", F.col("id"))))
    )
    events = plain.select("primary_addr", "coll_name", "seq", F.explode(made).alias("e")).select("primary_addr", "coll_name", "e.id", "seq", "e.kind", "e.other")
    events = events.where("id is not null")
    return events if large is None else events.unionByName(large)


def effective_updates(events: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(primary_addr, seq) of the Updates whose old id was live when they came.

    Before an Update its key is live if the last of ``set``, ``drop`` and ``out`` on it is a ``set``, or if an
    Update that entered it since was effective. The first is decided at once; the second are pointers, which
    are replaced by the pointers of what they point at until none is left. The events of a key are ranked in
    blocks of the log, so a hot key is spread over many tasks.
    """
    touched = events.where("kind <> 'touch'")
    # only keys that an Update leaves are of interest
    out_keys = touched.where("kind = 'out'").select(*KEY).distinct()
    line = touched.join(out_keys, KEY, "left_semi").withColumn("blk", F.floor(F.col("seq") / BLOCK))
    # the nearest hard events before and after, first within blocks of the log, then across them
    hard = F.when(F.col("kind") != "in", F.struct("seq", "kind"))
    inside = W.partitionBy(*KEY, "blk").orderBy("seq", F.when(F.col("kind") == "in", 1).otherwise(0))
    across = W.partitionBy(*KEY).orderBy("blk")
    earlier, later = (W.unboundedPreceding, -1), (1, W.unboundedFollowing)
    blocks = (
        line.groupBy(*KEY, "blk")
        .agg(F.min(hard).alias("_first"), F.max(hard).alias("_last"))
        .withColumn("_carry", F.last("_last", ignorenulls=True).over(across.rowsBetween(*earlier)))
        .withColumn("_ahead", F.first("_first", ignorenulls=True).over(across.rowsBetween(*later)))
        .drop("_first", "_last")
    )
    line = (
        line.withColumn("_prev", F.last(hard, ignorenulls=True).over(inside.rowsBetween(*earlier)))
        .withColumn("_next", F.first(hard, ignorenulls=True).over(inside.rowsBetween(*later)))
        .join(blocks, [*KEY, "blk"])
        .select("primary_addr", "seq", "kind", F.coalesce("_prev", "_carry").alias("prev"), F.coalesce("_next", "_ahead").alias("next"))
    )
    line = cut(line)
    sure = line.where("kind = 'out' and prev.kind = 'set'").select("primary_addr", "seq")
    edges = line.where("kind = 'in' and next.kind = 'out'").select("primary_addr", F.col("next.seq").alias("seq"), F.col("seq").alias("dep"))
    true = cut(sure)
    edges = cut(edges.join(true, ["primary_addr", "seq"], "left_anti"))
    for _ in range(max_rounds):
        if edges.isEmpty():
            return true
        known = true.select("primary_addr", F.col("seq").alias("dep"))
        hit = edges.join(known, ["primary_addr", "dep"], "left_semi").select("primary_addr", "seq").distinct()
        open_edges = edges.join(hit, ["primary_addr", "seq"], "left_anti")
        onward = edges.select("primary_addr", F.col("seq").alias("dep"), F.col("dep").alias("next"))
        # a pointer at an Update without pointers of its own that is not effective leads nowhere and is dropped
        edges = cut(open_edges.join(onward, ["primary_addr", "dep"]).select("primary_addr", "seq", F.col("next").alias("dep")).distinct())
        true = cut(true.unionByName(hit).distinct())
    raise RuntimeError(f"a chain of updates is longer than 2^{max_rounds}")


def _fates(events: DataFrame) -> DataFrame:
    """(primary_addr, coll_name, id, seq) of the keys that are live after all events."""
    good = effective_updates(events).withColumn("ok", F.lit(True))
    moves = events.where("kind in ('in', 'out')").join(good, ["primary_addr", "seq"], "left")
    moves = moves.where("ok or kind = 'out'").drop("ok")  # a key that an Update leaves is dead afterwards in any case
    steady = events.where("kind not in ('in', 'out')")
    fate = F.when(F.col("kind") == "touch", None).otherwise(F.struct("seq", F.when(F.col("kind").isin("set", "in"), 1).otherwise(0).alias("live")))
    return steady.unionByName(moves).groupBy(*KEY).agg(F.max(fate).alias("f"), F.max("seq").alias("seq")).where("f.live = 1").select(*KEY, "seq")


def merge_changes(base: DataFrame, entries: DataFrame) -> DataFrame:
    """(primary_addr, coll_name, id, seq): the base after the entries of a feed, all of them later in their log than the base.

    ``base`` has the same columns and a row for each live key. Its rows are read twice and, as long as the keys of the
    feed are few, not shuffled. An empty base gives the state after the entries alone, no entries give the base.
    """
    plain, wiped = _decoded(entries)
    wiped = cut(wiped)
    events = cut(key_events(entries, wiped, plain))
    base = guarded_join(base.select(*KEY, "seq"), wiped, KEY[:2], "left_anti", spread=F.col("id"))
    keys = events.select(*KEY).distinct()
    if is_small(keys):
        keys = F.broadcast(keys)  # at most BROADCAST_ROWS
    known = base.join(keys, KEY, "left_semi").select(*KEY, "seq", F.lit("set").alias("kind"), F.lit(None).cast("long").alias("other"))
    if not known.isEmpty():
        events = cut(events.unionByName(known))
    return _fates(events).unionByName(base.join(keys, KEY, "left_anti"))


def refresh(base: DataFrame, marks: DataFrame, entries: DataFrame) -> DataFrame:
    """The state after all entries, from a base and the marks it was made at.

    ``marks``: primary_addr, mark_seq, mark_time, the greatest seq and arrival that the base knows. Entries that
    arrived later are merged into the base. Where one of them lies at or below the mark (it is late, or corrects an
    earlier one) the base can't be trusted for its primary, whose log is replayed from the start. Entries
    without an arrival count as known to the base if they lie at or below its mark.
    """
    rows = guarded_join(entries.where("primary_addr is not null and seq is not null"), marks, ["primary_addr"], "left", spread=F.col("seq"))
    fresh = rows.where(F.col("mark_seq").isNull() | (F.col("arrived_at") > F.col("mark_time")) | (F.col("arrived_at").isNull() & (F.col("seq") > F.col("mark_seq"))))
    again = cut(fresh.where(F.col("seq") <= F.col("mark_seq")).select("primary_addr").distinct())
    columns = entries.columns
    replayed = merge_changes(base.limit(0), guarded_join(entries, again, ["primary_addr"], "left_semi", spread=F.col("seq")))
    if not is_small(again, 0):
        fresh = guarded_join(fresh, again, ["primary_addr"], "left_anti", spread=F.col("seq"))
        base = guarded_join(base, again, ["primary_addr"], "left_anti", spread=F.col("id"))
    merged = merge_changes(base, fresh.select(*columns))
    return merged.unionByName(replayed)


def live_keys(entries: DataFrame) -> DataFrame:
    """(coll_name, id, seq) of the keys that are live after all entries, with the seq that last set each: merged into an empty base.

    Empty input gives an empty result. Extra columns are ignored.
    """
    return merge_changes(entries.sparkSession.createDataFrame([], BASE), entries).select("coll_name", "id", "seq")
