"""Queries over a store's tables: reads, logs, statistics, versions, changes, shards and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as vec
from ..operators import changefeed, filters, knn, mutation, sharding, stats, versioning
from ..session import shared_path, table
from ..sources import files
from ..streaming import ingest
from .base import COLL, DEAD, K, V, payload, queries, rounded, tombstones, top, vectors
from .search import near_sql

QUERIES, SQL = {}, {}


def query(sql=None, name=None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


# reads

_TOTAL = "round(list_sum(list_transform(vector, lambda x: x::double)), 6) + 0.0"


def summary(df):
    return df.select("id", F.size("vector").cast("bigint").alias("dim"), (F.round(vec.total(F.col("vector")), 6) + 0.0).alias("total"))


@query(f"with {V} select id, len(vector) as dim, {_TOTAL} as total from v")
def scan_vectors(spark, d):
    return summary(vectors(spark, d))


@query(f"with {V} select id, len(vector) as dim, {_TOTAL} as total from v where id = 42")
def get_by_id(spark, d):
    return summary(vectors(spark, d).where("id = 42"))


@query(f"with {V}, {DEAD}, ask as (select unnest([7, 42, 43, 99, 1000000]) as id) select ask.id::bigint as id, v.id is not null and dead.id is null as found, dead.id is not null as deleted from ask left join v using (id) left join dead on dead.id = ask.id")
def get_active_by_id(spark, d):
    ids = [7, 42, 43, 99, 1_000_000]
    ask = spark.createDataFrame([(i,) for i in ids], "id long")
    have = filters.with_ids(vectors(spark, d), ids).select("id", F.lit(True).alias("v"))
    rows = ask.join(have, "id", "left").join(filters.with_ids(tombstones(spark, d), ids).withColumn("t", F.lit(True)), "id", "left")
    return rows.select("id", (F.col("v").isNotNull() & F.col("t").isNull()).alias("found"), F.col("t").isNotNull().alias("deleted"))


@query(f"with {V} select id, len(vector) as dim, {_TOTAL} as total from v where id in (select o_custkey from orders)")
def batch_get(spark, d):
    """All vectors asked for by a table of ids (the customers of the orders)."""
    return summary(filters.with_ids(vectors(spark, d), table(spark, d, "orders").select(F.col("o_custkey").alias("id"))))


@query("select req_no, (select max(vec_id) from embeddings) + row_number() over (order by req_no) as id from upserts")
def append_batch_ids(spark, d):
    new = table(spark, d, "upserts").select("req_no")
    return mutation.append_ids(vectors(spark, d), new, "req_no").select("req_no", "id")


@query("""
    with last as (select * from metadata_entries where id is not null and meta_key is not null
      qualify row_number() over (partition by id, meta_key order by entry_no desc, meta_value desc nulls last) = 1)
    select id, string_agg(meta_key || '=' || coalesce(meta_value, ''), '|' order by meta_key) as metadata, count(*) as n from last group by id""")
def metadata_get_all(spark, d):
    """All keys and values of each id; the last entry of a key holds."""
    rows = table(spark, d, "metadata_entries").where("id is not null and meta_key is not null")
    last = rows.groupBy("id", "meta_key").agg(F.max(F.struct("entry_no", "meta_value")).alias("v")).select("id", "meta_key", F.col("v.meta_value").alias("v"))
    cells = F.array_sort(F.collect_list(F.struct("meta_key", "v")))
    out = last.groupBy("id").agg(cells.alias("c"))
    return out.select("id", F.array_join(F.transform("c", lambda x: F.concat(x.meta_key, F.lit("="), F.coalesce(x.v, F.lit("")))), "|").alias("metadata"), F.size("c").cast("bigint").alias("n"))


@query("select p_partkey as id, p_brand as brand, p_size::double as size, p_retailprice as price from part")
def typed_payload_projection(spark, d):
    """Declared fields of a map of strings as typed columns."""
    rows = payload(spark, d).select("id", F.create_map(F.lit("brand"), F.col("brand"), F.lit("size"), F.col("size").cast("string"), F.lit("price"), F.col("price").cast("string")).alias("metadata"))
    field = filters.map_field()
    return rows.select("id", field("brand").alias("brand"), *[field(n).try_cast("double").alias(n) for n in ("size", "price")])


@query("select vec_id // 100 as segment_id, count(*) as n, case when vec_id // 100 = (select max(vec_id) // 100 from embeddings) then 'active' else 'sealed' end as state, round(count(*) / 100, 6) as utilization from embeddings group by vec_id // 100")
def segment_stats(spark, d):
    """Segments of a hundred ids: how full each is, and which one is still written."""
    rows = vectors(spark, d).select(F.floor(F.col("id") / 100).alias("segment_id"))
    last = rows.agg(F.max("segment_id").alias("last"))
    counts = rows.groupBy("segment_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(last))
    return counts.select("segment_id", "n", F.when(F.col("segment_id") == F.col("last"), "active").otherwise("sealed").alias("state"), F.round(F.col("n") / 100, 6).alias("utilization"))


@query("with a as (select user_id as id, count(*) as accesses, max(ts) as last_access from events group by user_id), r as (select *, row_number() over (order by last_access desc, id) as rn, (select max(ts) from events) as now from a) select id, accesses, case when rn <= 100 and last_access >= now - interval 1 day then 'hot' else 'cold' end as tier from r")
def tier_assignment(spark, d):
    """Hot: accessed within a day of the newest event, at most the hundred latest."""
    a = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("accesses"), F.max("ts").alias("last_access"))
    now = a.agg((F.max("last_access") - F.expr("interval 1 day")).alias("since"))
    fresh = a.crossJoin(F.broadcast(now)).where("last_access >= since")
    hot = fresh.orderBy(F.desc("last_access"), "id").limit(100).select("id", F.lit("hot").alias("tier"))
    return a.join(hot, "id", "left").select("id", "accesses", F.coalesce("tier", F.lit("cold")).alias("tier"))


# logs

_COPIES = """copies as (
    select * from wal_entries where primary_addr is not null and seq is not null
    qualify row_number() over (partition by primary_addr, seq order by arrived_at desc nulls last, op desc nulls last, payload desc nulls last, coll_name desc nulls last, id desc nulls last) = 1)"""


@query(f"with {_COPIES}, ck as (select primary_addr, max(seq) as ck from copies where lower(op) = 'checkpoint' group by primary_addr) select primary_addr, seq, op from copies left join ck using (primary_addr) where seq > coalesce(ck, -1) and lower(op) <> 'checkpoint'")
def wal_recovery_entries(spark, d):
    """Entries after the last checkpoint of their log."""
    rows = changefeed.latest_copies(table(spark, d, "wal_entries"))
    ck = rows.where(F.lower("op") == "checkpoint").groupBy("primary_addr").agg(F.max("seq").alias("ck"))
    return rows.join(ck, "primary_addr", "left").where((F.col("seq") > F.coalesce("ck", F.lit(-1))) & (F.lower("op") != "checkpoint")).select("primary_addr", "seq", "op")


@query(f"with {_COPIES} select primary_addr, seq, op from copies where seq >= 30000")
def wal_tail(spark, d):
    return files.tail(changefeed.latest_copies(table(spark, d, "wal_entries")), 30_000).select("primary_addr", "seq", "op")


@query(f"with {_COPIES}, r as (select primary_addr, seq, op, row_number() over (partition by primary_addr order by seq) as place, count(*) over (partition by primary_addr) as n from copies where seq >= 30000) select primary_addr, seq, op, place, n > 1000 as has_more from r where place <= 1000")
def wal_page(spark, d):
    """The first page of a thousand entries of each log from a number on, and whether more follow."""
    from pyspark.sql import Window as W

    rows = files.tail(changefeed.latest_copies(table(spark, d, "wal_entries")), 30_000)
    more = rows.groupBy("primary_addr").agg((F.count("*") > 1000).alias("has_more"))
    place = F.row_number().over(W.partitionBy("primary_addr").orderBy("seq"))
    page = rows.withColumn("place", place).where("place <= 1000")
    return page.join(more, "primary_addr").select("primary_addr", "seq", "op", F.col("place").cast("bigint").alias("place"), "has_more")


REPLAY = f"""
    with recursive {_COPIES},
    ops as (select primary_addr, coll_name, id, seq, payload, regexp_replace(lower(op), '[^a-z]', '', 'g') as op from copies),
    wiped as (select primary_addr, coll_name, max(seq) as wiped_at from ops where op = 'deletecollection' group by all),
    kept as (select ops.* from ops left join wiped using (primary_addr, coll_name) where op <> 'deletecollection' and (wiped_at is null or seq > wiped_at)),
    ev as (
      select primary_addr, coll_name, id, seq, 'set' as kind from kept where op = 'insert'
      union all select primary_addr, coll_name, id, seq, 'drop' from kept where op = 'delete'
      union all select primary_addr, coll_name, id, seq, 'touch' from kept where op = 'updatemetadata'
      union all select primary_addr, coll_name, unnest(range((payload->>'start_id')::bigint, (payload->>'start_id')::bigint + (payload->>'count')::bigint)), seq, 'set' from kept where op in ('insertbatch', 'batchinsert')
      union all select distinct primary_addr, coll_name, unnest((payload->'ids')::bigint[]), seq, 'drop' from kept where op in ('deletebatch', 'batchdelete')
      union all select primary_addr, coll_name, id, seq, 'out' from kept where op = 'update'
      union all select primary_addr, coll_name, (payload->>'new_id')::bigint, seq, 'in' from kept where op = 'update'),
    line as (
      select *, last_value(case when kind in ('set', 'drop', 'out') then struct_pack(s := seq, k := kind) end ignore nulls) over past as prev,
        first_value(case when kind in ('set', 'drop', 'out') then struct_pack(s := seq, k := kind) end ignore nulls) over coming as nxt
      from ev where id is not null and kind <> 'touch'
      window past as (partition by primary_addr, coll_name, id order by seq, kind = 'in' rows between unbounded preceding and 1 preceding),
        coming as (partition by primary_addr, coll_name, id order by seq, kind = 'in' rows between 1 following and unbounded following)),
    good as (
      select primary_addr, seq from line where kind = 'out' and prev.k = 'set'
      union select line.primary_addr, line.nxt.s from line join good on good.primary_addr = line.primary_addr and good.seq = line.seq
        where line.kind = 'in' and line.nxt.k = 'out'),
    final as (
      select ev.* from ev left join good using (primary_addr, seq) where id is not null and (kind <> 'in' or good.seq is not null)),
    fate as (
      select primary_addr, coll_name, id, max(seq) as seq,
        max(case when kind <> 'touch' then seq * 2 + (kind in ('set', 'in'))::int end) as f
      from final group by all)
    select coll_name, id, seq from fate where f % 2 = 1"""


@query(REPLAY)
def wal_replay_state(spark, d):
    return changefeed.live_keys(table(spark, d, "wal_entries"))


# projections

_METRIC = "case when lower(trim(distance)) in ('cosine', 'cos') then 'cosine' when lower(trim(distance)) in ('dot', 'dotproduct', 'dot_product', 'inner', 'ip') then 'dot' else 'l2' end"


@query(f"select c.coll_name, dim::bigint as dim, {_METRIC} as metric, coalesce(quantization, false) as quantized, coalesce(len(indexed_fields), 0) as n_indexed, coalesce(len(numeric_fields), 0) as n_numeric, coalesce(len(text_fields), 0) as n_text, count(distinct u.id) as n_ids, count(u.req_no) as n_requests from collection_config c left join upserts u on u.coll_name = c.coll_name group by all")
def collection_info(spark, d):
    config = table(spark, d, "collection_config")
    low = F.lower(F.trim("distance"))
    metric = F.when(low.isin(*[n for n, m in vec.METRIC_NAMES.items() if m == "cosine"]), "cosine").when(low.isin(*[n for n, m in vec.METRIC_NAMES.items() if m == "dot"]), "dot").otherwise("l2")
    counts = table(spark, d, "upserts").groupBy("coll_name").agg(F.countDistinct("id").alias("n_ids"), F.count("req_no").alias("n_requests"))

    def n(c):
        return F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("bigint")

    rows = config.select("coll_name", F.col("dim").cast("bigint").alias("dim"), metric.alias("metric"), F.coalesce("quantization", F.lit(False)).alias("quantized"), n("indexed_fields").alias("n_indexed"), n("numeric_fields").alias("n_numeric"), n("text_fields").alias("n_text"))
    return rows.join(counts, "coll_name", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_ids", "n_requests")})


@query("select vec_id as id, (label::bigint << 48) | vec_id as gid, label::bigint as shard, vec_id as local from embeddings")
def global_id_codec(spark, d):
    rows = vectors(spark, d).select("id", sharding.global_id(F.col("label"), F.col("id")).alias("gid"))
    shard, local = sharding.split_id(F.col("gid"))
    return rows.select("id", "gid", shard.alias("shard"), local.alias("local"))


@query("select l_orderkey, l_linenumber, trunc(l_extendedprice * 1000000)::bigint as micro, round(trunc(l_extendedprice * 1000000) / 1000000, 6) as back from lineitem")
def fixed_point_codec(spark, d):
    micro = (F.col("l_extendedprice") * 1_000_000).try_cast("bigint")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", micro.alias("micro"), F.round(micro / 1_000_000, 6).alias("back"))


# statistics of metadata fields


def field_rows(spark, d):
    return table(spark, d, "metadata_entries").select("id", F.col("meta_key").alias("field"), F.col("meta_value").alias("value"))


FIELDS = "counts as (select meta_key as field, meta_value as value, count(distinct id) as n from metadata_entries where id is not null and meta_key is not null and meta_value is not null group by all)"


@query(f"with {FIELDS} select field, count(*) as unique_values, sum(n)::bigint as total_ids, round(avg(n), 6) as avg_ids, min(n) as min_ids, max(n) as max_ids from counts group by field")
def field_index_stats(spark, d):
    return stats.field_stats(field_rows(spark, d)).withColumn("avg_ids", F.round("avg_ids", 6))


@query(f"with {FIELDS} select field, value, n from counts")
def distinct_values(spark, d):
    return stats.value_counts(field_rows(spark, d))


@query(f"with {FIELDS} select field, value, n from counts qualify row_number() over (partition by field order by n desc, value) = 1")
def most_common(spark, d):
    return stats.most_common(field_rows(spark, d))


PART_LONG = "rows_ as (select p_partkey as id, 'size' as field, p_size::varchar as value from part union all select p_partkey, 'price', p_retailprice::varchar from part union all select p_partkey, 'brand', p_brand from part union all select p_partkey, 'kind', p_type from part)"


def part_rows(spark, d):
    rows = payload(spark, d)
    return rows.unpivot("id", [F.col("size").cast("string").alias("size"), F.col("price").cast("string").alias("price"), "brand", "kind"], "field", "value")


@query(f"with {PART_LONG} select field, count(distinct x) as unique_values, count(*) as n, min(x) as least, max(x) as most from (select field, try_cast(value as double) as x from rows_) where x is not null group by field")
def numeric_field_stats(spark, d):
    return stats.numeric_stats(part_rows(spark, d))


@query(f"with {PART_LONG} select count(distinct field) as n_fields, count(distinct (field, value)) as n_values, count(distinct (id, field, value)) as n_entries, count(distinct id) as n_ids from rows_")
def payload_stats(spark, d):
    rows = part_rows(spark, d)
    counts = stats.value_counts(rows)
    out = counts.agg(F.countDistinct("field").alias("n_fields"), F.count("*").alias("n_values"), F.sum("n").alias("n_entries"))
    return out.crossJoin(F.broadcast(rows.agg(F.countDistinct("id").alias("n_ids"))))


@query(f"with {FIELDS} select field, count(*) as cardinality, sum(n)::bigint as total, round(1 / count(*), 9) as selectivity from counts group by field")
def field_statistics(spark, d):
    return stats.planner_stats(field_rows(spark, d)).withColumn("selectivity", F.round("selectivity", 9))


_ASKED = [("a", "kind", "ECONOMY"), ("a", "brand", "Brand#2"), ("b", "kind", "SMALL"), ("b", "brand", "unknown"), ("c", "nofield", "x"), ("c", "kind", "LARGE"), ("d", "nofield", "y"), ("e", "brand", "Brand#3"), ("e", "size", "7"), ("e", "kind", "PROMO")]
ASKED = "asked as (select * from (values " + ", ".join(map(str, _ASKED)) + f") t(plan, field, value)), {PART_LONG}, counts as (select field, value, count(distinct id) as n from rows_ group by all), f as (select field, count(*) as card, sum(n) as total from counts group by field), sel as (select plan, field, value, case when card is null then 1.0 when n is null then 1.0 / card else n / total end as share from asked left join f using (field) left join counts using (field, value))"


def asked(spark):
    return spark.createDataFrame(_ASKED, "plan string, field string, value string")


@query(f"with {ASKED} select plan, field, value, round(share::double, 9) as share from sel")
def filter_selectivity(spark, d):
    return stats.selectivity(asked(spark), stats.value_counts(part_rows(spark, d))).withColumn("share", F.round("share", 9))


@query(f"with {ASKED} select plan, filter_order, round(share, 6) as share, case when share <= 0 then 'none' when share < 0.1 then 'pre' when share < 0.5 then 'hybrid' else 'post' end as strategy from (select plan, string_agg(field, ',' order by round(share::double, 9), field) as filter_order, exp(sum(ln(round(share::double, 9)))) as share from sel group by plan)")
def filter_plan(spark, d):
    return stats.plans(asked(spark), stats.value_counts(part_rows(spark, d))).withColumn("share", F.round("share", 6))


@query(f"with {V}, {DEAD} select label::bigint as label, count(*) as total, count(*) - count(dead.id) as active, count(dead.id) as deleted from v left join dead using (id) group by label")
def collection_counts(spark, d):
    rows = vectors(spark, d).join(tombstones(spark, d).withColumn("dead", F.lit(1)), "id", "left")
    return rows.groupBy(F.col("label").cast("bigint").alias("label")).agg(F.count("*").alias("total"), (F.count("*") - F.count("dead")).alias("active"), F.count("dead").alias("deleted"))


#: Bounds of the histogram.
BOUNDS = [0.0, 1.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 500.0, 1000.0]


@query("select event_type, nullif(le, 1e300) as le, count(value) filter (value <= le) as n from events cross join (select unnest([0.0, 1.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 500.0, 1000.0, 1e300])::double as le) group by event_type, le")
def latency_histogram(spark, d):
    """Cumulative counts by event type; the null bound holds all values."""
    rows = stats.histogram(table(spark, d, "events"), "event_type", "value", BOUNDS)
    return rows.withColumn("le", F.when(F.col("le") < float("inf"), F.col("le")))


# versions: each user's events

HIST = "h as (select user_id as vector_id, event_id as version_id, ts, event_type = 'error' as is_deleted, value, [event_type, 'b' || ((props->>'k')::int % 3)::varchar] as keys from events)"
_T, _T2 = "2024-01-15 00:00:00", "2024-01-22 12:00:00"


def history(spark, d):
    k = F.get_json_object("props", "$.k").cast("int") % 3
    return table(spark, d, "events").select(F.col("user_id").alias("vector_id"), F.col("event_id").alias("version_id"), "ts", (F.col("event_type") == "error").alias("is_deleted"), "value", F.array("event_type", F.concat(F.lit("b"), k.cast("string"))).alias("keys"))


def at(text):
    return F.lit(text).cast("timestamp_ntz")


def plain(df):
    return df.select("vector_id", "version_id", "is_deleted", "value")


_LAST = "qualify row_number() over (partition by vector_id order by version_id desc) = 1"
_PLAIN = f"with {HIST} select vector_id, version_id, is_deleted, value from h"
query(f"{_PLAIN} qualify row_number() over (partition by vector_id order by version_id desc) <= 20", "version_retention")(lambda spark, d: plain(versioning.retained(history(spark, d), 20)))
query(f"{_PLAIN} {_LAST}", "version_latest")(lambda spark, d: plain(versioning.latest(history(spark, d))))
query(f"{_PLAIN} where vector_id = 46 and version_id = 1", "version_get")(lambda spark, d: plain(versioning.version(history(spark, d), 46, 1)))
query(f"{_PLAIN} where ts <= timestamp '{_T}' {_LAST}", "version_as_of")(lambda spark, d: plain(versioning.as_of(history(spark, d), at(_T))))
query(f"with {HIST} select vector_id, version_id, is_deleted, value, place from (select *, row_number() over (partition by vector_id order by version_id) as place from h)", "version_history")(
    lambda spark, d: plain_history(spark, d)
)
query(f"{_PLAIN} where ts between timestamp '{_T}' and timestamp '{_T2}'", "version_in_range")(lambda spark, d: plain(versioning.in_range(history(spark, d), at(_T), at(_T2))))
query(f"with {HIST} select vector_id, version_id, is_deleted, value from (select * from h where ts <= timestamp '{_T}' {_LAST}) where not is_deleted", "version_snapshot_at")(lambda spark, d: plain(versioning.snapshot_at(history(spark, d), at(_T))))
query(f"with {HIST} select vector_id from (select * from h {_LAST}) where not is_deleted", "version_active_ids")(lambda spark, d: versioning.active_ids(history(spark, d)))
query(f"with {HIST} select distinct vector_id from h where ts > timestamp '2024-01-30 12:00:00'", "version_modified_since")(lambda spark, d: versioning.modified_since(history(spark, d), at("2024-01-30 12:00:00")))


def plain_history(spark, d):
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("vector_id").orderBy("version_id")).cast("bigint")
    return history(spark, d).withColumn("place", place).select("vector_id", "version_id", "is_deleted", "value", "place")


@query(f"with {HIST}, t as (select vector_id, min(version_id) as version_id from h group by vector_id) select vector_id, (select max(version_id) from h) + row_number() over (order by vector_id) as version_id, value, 'rollback to version ' || version_id as description from h join t using (vector_id, version_id) where not is_deleted")
def version_rollback(spark, d):
    """Every vector back to its first version, unless that is a deletion."""
    h = history(spark, d)
    first = h.groupBy("vector_id").agg(F.min("version_id").alias("version_id"))
    nxt = h.agg(F.max("version_id")).first()[0] + 1
    return versioning.rollback(h, first, at(_T2), nxt).select("vector_id", "version_id", "value", "description")


@query(f"""with {HIST}, p as (select *, lag(version_id) over w as from_version, lag(value) over w as old_value, lag(keys) over w as old_keys from h window w as (partition by vector_id order by version_id))
    select vector_id, from_version, version_id as to_version, value is distinct from old_value as value_changed, round(abs(value - old_value), 6) as distance,
      array_to_string(list_sort(list_filter(keys, lambda k: not list_contains(old_keys, k))), ',') as added,
      array_to_string(list_sort(list_filter(old_keys, lambda k: not list_contains(keys, k))), ',') as removed
    from p where from_version is not null""")
def version_diff(spark, d):
    rows = versioning.diff(history(spark, d), F.col("value"), F.col("keys"))
    return rows.select("vector_id", "from_version", "to_version", "value_changed", F.round("distance", 6).alias("distance"), F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


@query(f"with {HIST}, n as (select vector_id, max(version_id) as newest from h group by vector_id) select vector_id, version_id, is_deleted, value from h join n using (vector_id) where (ts >= timestamp '{_T2}' and not is_deleted) or version_id = newest")
def version_compact(spark, d):
    return plain(versioning.compact(history(spark, d), at(_T2), keep_deleted=False))


@query(f"with {HIST}, o as (select vector_id, count(*) as n, max(version_id) as last, arg_max(is_deleted, version_id) as gone from h group by vector_id) select count(*) as n_vectors, count(*) filter (not gone) as n_active, count(*) filter (gone) as n_deleted, sum(n)::bigint as n_versions, round(avg(n), 6) as mean_versions, max(last) + 1 as next_version from o")
def version_stats(spark, d):
    return versioning.stats(history(spark, d))


# changes


@query(f"with {V}, {DEAD} select 5::bigint as id, exists (select 1 from v where id = 5) and not exists (select 1 from dead where id = 5) as newly_deleted, (select count(*) from v) - (select count(*) from (select id from dead union select id from v where id = 5)) as active_after")
def delete_one(spark, d):
    rows, dead = vectors(spark, d), tombstones(spark, d)
    ask = spark.createDataFrame([(5,)], "id long")
    new = mutation.newly_deleted(filters.with_ids(rows, [5]), filters.with_ids(dead, [5]), ask)
    # counts only: the tombstones are distinct ids of rows
    left = rows.agg(F.count("*").alias("n")).crossJoin(F.broadcast(dead.agg(F.countDistinct("id").alias("d")))).crossJoin(F.broadcast(new.agg(F.count("*").alias("m")))).select((F.col("n") - F.col("d") - F.col("m")).alias("active_after"))
    return ask.join(new.withColumn("n", F.lit(True)), "id", "left").select("id", F.coalesce("n", F.lit(False)).alias("newly_deleted")).crossJoin(F.broadcast(left))


@query(f"with {V}, {DEAD}, ask as (select distinct o_custkey as id from orders) select id from ask where id in (select id from v) and id not in (select id from dead)")
def delete_batch_effect(spark, d):
    """Ids that a batch of deletions (the customers of the orders) newly deletes."""
    return mutation.newly_deleted(vectors(spark, d), tombstones(spark, d), table(spark, d, "orders").select(F.col("o_custkey").alias("id")))


@query("select vec_id as old_id, (select max(vec_id) from embeddings) + row_number() over (order by vec_id) as new_id from embeddings where label = 5")
def update_effect(spark, d):
    """New vectors for all ids of one label: each old id and the id that replaces it."""
    rows = vectors(spark, d)
    _, added = mutation.updated(rows, rows.where("label = 5").select("id", "vector"))
    return added.select("old_id", F.col("id").alias("new_id"))


@query("""
    with r as (select id, metadata, row_number() over (partition by id order by req_no) as first, row_number() over (partition by id order by req_no desc) as last from upserts),
    e as (select id, 1 as t, unnest(map_entries(metadata)) as e from r where first = 1 union all select id, 2, unnest(map_entries(metadata)) from r where last = 1),
    m as (select id, e.key as k, arg_max(e.value, t) as v from e group by all)
    select id, string_agg(k || '=' || v, '|' order by k) as metadata from m group by id""")
def metadata_patch(spark, d):
    """The metadata of each id's first request, patched with that of its last."""
    rows = table(spark, d, "upserts")
    ends = rows.groupBy("id").agg(F.min_by(F.struct("metadata"), "req_no").alias("a"), F.max_by(F.struct("metadata"), "req_no").alias("b"))
    out = ends.select("id", mutation.patched(F.col("a.metadata"), F.col("b.metadata")).alias("m")).where(F.size("m") > 0)
    return out.select("id", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e.key, F.lit("="), e.value)), "|").alias("metadata"))


@query(f"with {V}, {DEAD} select id as old_id, row_number() over (order by id) - 1 as id from v where id not in (select id from dead)")
def compact_id_mapping(spark, d):
    return mutation.compacted(vectors(spark, d).select("id"), tombstones(spark, d)).select("old_id", "id")


@query(f"with {V}, {DEAD} select count(*) as before, count(*) - count(dead.id) as after, count(dead.id) as removed, count(dead.id) * 64 * 4 as bytes_freed from v left join dead using (id)")
def compact_stats(spark, d):
    rows = mutation.deletion_stats(vectors(spark, d), tombstones(spark, d))
    return rows.select(F.col("total").alias("before"), (F.col("total") - F.col("deleted")).alias("after"), F.col("deleted").alias("removed"), (F.col("deleted") * 64 * 4).alias("bytes_freed"))


# shards

SHARDS = [0, 1, 2, 3]
RING = f"nodes as (select pos, min(s) as s from (select ((s * 1000 + n)::hugeint * {sharding.NODE_MUL} + {sharding.NODE_ADD}) % 4294967296 as pos, s from (select unnest(range({{n}})) as s) cross join (select unnest(range({sharding.VNODES})) as n)) group by pos), keys as (select vec_id as id, (vec_id::hugeint * {sharding.KEY_MUL}) % 4294967296 as h from embeddings), routed as (select id, h::bigint as position, coalesce(arg_min(s, pos) filter (pos >= h), arg_min(s, pos)) as shard from keys cross join nodes group by id, h)"


def routed(spark, d):
    h = sharding.key_hash(F.col("id"))
    return vectors(spark, d).withColumn("position", h).withColumn("shard", sharding.route(h, sharding.ring(SHARDS)))


@query(f"with {RING.format(n=4)} select id, position, shard from routed")
def ring_route(spark, d):
    return routed(spark, d).select("id", "position", "shard")


@query(f"with {RING.format(n=4)} select shard, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from routed group by shard")
def shard_stats(spark, d):
    return sharding.shard_stats(routed(spark, d)).withColumn("share", F.round("share", 6))


@query(f"with {COLL}, {RING.format(n=4)}, s as ({near_sql()}), l as (select s.*, shard, row_number() over (partition by qid, shard order by score, id) as pos from s join routed using (id)), t as ({top('(select qid, id, score from l where pos <= 10)')}) select t.*, shard from t join routed using (id)")
def sharded_topk(spark, d):
    """The nearest of each shard, then of all; each task keeps its best before anything is shuffled."""
    rows, q = routed(spark, d).withColumn("list_id", F.col("shard")), queries(spark, d)
    # a query asks every shard as a query of its own, so one scan serves all shards
    asked = q.select(F.explode(F.array(*[F.lit(s).cast("bigint") for s in SHARDS])).alias("list_id"), F.col("qid").alias("own"), "qvec").withColumn("qid", F.col("own") * len(SHARDS) + F.col("list_id"))
    near = knn.knn_join(rows, asked.select("qid", "qvec"), K, probes=asked.select("qid", "list_id"))
    found = near.select(F.expr(f"qid div {len(SHARDS)}").alias("qid"), (F.col("qid") % len(SHARDS)).alias("shard"), "id", "score")
    return sharding.scatter_gather(found, K).select("qid", "shard", "id", F.round("score", 6).alias("score"), "rank")


@query(f"with {RING.format(n=4)}, old as (select * from routed) select id, old.shard as old_shard, new.shard as new_shard from old join (with {RING.format(n=5)} select * from routed) new using (id) where old.shard <> new.shard")
def rebalance_plan(spark, d):
    return sharding.rebalance(vectors(spark, d), SHARDS, 4)


# streams


@query("select event_type, count(*) as n, round(sum(value), 4) as total, min(event_id) as first_id, max(event_id) as last_id from events group by event_type")
def stream_ingest_totals(spark, d):
    """The events as a stream of files, appended batch by batch, and totals of what has arrived."""
    root = shared_path(spark, "ingest")
    ingest.append_batches(ingest.file_stream(spark, f"{d}/events.parquet"), f"{root}/rows", f"{root}/checkpoint")
    rows = spark.read.parquet(f"{root}/rows")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("select (rn - 1) // 1000 as chunk, count(*) as rows, max(rn) as done, round(100.0::double * max(rn) / max(n), 6) as percent from (select row_number() over (order by req_no) as rn, count(*) over () as n from upserts) group by (rn - 1) // 1000")
def chunk_progress(spark, d):
    return ingest.chunk_progress(table(spark, d, "upserts").select("req_no"), "req_no", 1_000)


@query("select event_type as value, count(*) as n, min(value) as least, max(value) as most from events group by event_type")
def stream_field_statistics(spark, d):
    """Statistics of a field kept as the state of a stream."""
    root = shared_path(spark, "field-statistics")
    stream = ingest.file_stream(spark, f"{d}/events.parquet").select(F.col("event_type").alias("field_value"), F.col("value").alias("x"))
    ingest.running_counts(stream, ["field_value"], [F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most")], f"{root}/counts", f"{root}/checkpoint")
    return ingest.latest_result(spark, f"{root}/counts").withColumnRenamed("field_value", "value")
