"""Queries of the general problems: incremental runs, wide tables and change feeds, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import changefeed, incremental, wide
from ..session import shared_path, table
from .store import REPLAY


def p2_found(spark, d):
    """New or changed entries of each replica, taken from the published output of one run."""
    runs = incremental.CommittedRuns(spark, shared_path(spark, "p2-found"))
    return runs.replicate(table(spark, d, "wal_entries"), table(spark, d, "replica_state"))


def p2_published(spark, d):
    """Two successive committed runs over the log, the rows of both: each row once, also those of one instant."""
    at = F.coalesce(F.unix_micros(F.col("arrived_at").cast("timestamp")), F.lit(0))  # rows without an arrival come first
    same = F.row_number().over(W.partitionBy(at, "primary_addr", "seq", "op").orderBy(F.lit(0)))
    entries = table(spark, d, "wal_entries").select("primary_addr", "seq", "op", at.alias("at"), same.alias("copy"))
    runs = incremental.CommittedRuns(spark, shared_path(spark, "p2-runs"))
    middle = entries.agg(F.expr("percentile_approx(at, 0.5)")).first()[0]
    # the first run sees only some of the rows that arrived at its last instant
    for part in (entries.where((F.col("at") < F.lit(middle)) | ((F.col("at") == F.lit(middle)) & (F.col("seq") % 2 == 0))), entries):
        runs.process(part, "at", key=["primary_addr", "seq", "op", "copy"])
    out = None
    for n in runs.committed():
        rows = runs.rows(n).select("primary_addr", "seq", "op")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else entries.select("primary_addr", "seq", "op")


def p2_resumed(spark, d):
    """Two runs of replication: over what had arrived by the middle of the log's time, then over all of it."""
    entries = table(spark, d, "wal_entries").where("arrived_at is not null")
    runs = incremental.CommittedRuns(spark, shared_path(spark, "p2-resumed"))
    middle = entries.agg(F.expr("(min(unix_micros(cast(arrived_at as timestamp))) + max(unix_micros(cast(arrived_at as timestamp)))) div 2")).first()[0]
    replicas = table(spark, d, "replica_state").limit(0)
    every = table(spark, d, "replica_state").select("replica", "primary_addr", F.lit(None).cast("long").alias("last_seq"), F.lit(None).cast("timestamp_ntz").alias("last_sync"), F.lit("Error").alias("status"))
    replicas = replicas.select("replica", "primary_addr", "last_seq", "last_sync", "status").unionByName(every)
    out = None
    for number, part in enumerate((entries.where(F.unix_micros(F.col("arrived_at").cast("timestamp")) <= F.lit(middle)), entries), 1):
        rows = runs.replicate(part, replicas).withColumn("run", F.lit(number).cast("bigint"))
        out = rows if out is None else out.unionByName(rows)
    return out


def p3_found(spark, d):
    entries = table(spark, d, "metadata_entries")
    return wide.filled_cells(wide.wide_table(entries))


def p3_wide(spark, d):
    """The core columns of the wide table, as text."""
    entries = table(spark, d, "metadata_entries")
    out = wide.wide_table(entries, ["category", "in_stock", "price", "released_on", "status"])
    return out.select("id", *[F.col(c).cast("string").alias(c) for c in out.columns if c != "id"])


def p7_found(spark, d):
    return changefeed.live_keys(table(spark, d, "wal_entries"))


def p7_merged(spark, d):
    """The live vectors from a base of what had arrived by the middle of the log's time, refreshed with all entries."""
    entries = table(spark, d, "wal_entries")
    middle = entries.agg(F.expr("timestamp_micros((min(unix_micros(cast(arrived_at as timestamp))) + max(unix_micros(cast(arrived_at as timestamp)))) div 2)").alias("t")).select(F.col("t").cast("timestamp_ntz")).first()[0]
    early = entries.where(F.col("arrived_at") <= F.lit(middle)) if middle is not None else entries.limit(0)
    base = changefeed.merge_changes(spark.createDataFrame([], changefeed.BASE), early)
    path = shared_path(spark, "p7-base")
    base.write.parquet(path)
    marks = early.where("primary_addr is not null").groupBy("primary_addr").agg(F.max("seq").alias("mark_seq"), F.max("arrived_at").alias("mark_time"))
    return changefeed.refresh(spark.read.parquet(path), marks, entries).select("coll_name", "id", "seq")


QUERIES = {f.__name__: f for f in (p2_found, p2_published, p2_resumed, p3_found, p3_wide, p7_found, p7_merged)}

_CELLS = r"""
        with keyed as (
          select id, entry_no, meta_value,
            trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(trim(meta_key), '([\p{Ll}\p{N}])(\p{Lu})', '\1_\2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1_\2', 'g'), '[^\p{L}\p{N}]+', '_', 'g')), '_+', '_', 'g'), '_') as attr
          from metadata_entries where id is not null and meta_key is not null),
        latest as (
          select id, attr, regexp_replace(meta_value, '^[\s\x{00a0}\x{2009}\x{3000}]+|[\s\x{00a0}\x{2009}\x{3000}]+$', '', 'g') as v from keyed where attr <> ''
          qualify row_number() over (partition by id, attr order by entry_no desc, meta_value desc nulls last) = 1),
        given as (select * from latest where lower(v) not in ('', 'n/a', 'null', 'none', '-', 'unknown', '?')),
        bare as (
          select *, trim(regexp_replace(regexp_replace(lower(v), '\p{Sc}|\b(usd|eur|gbp|pln|pcs)\b', '', 'g'), '\s*/\s*5$', '')) as b from given),
        parts as (
          select *, regexp_extract(b, 'e([+-]?[0-9]{1,2})$', 1) as e, regexp_replace(b, 'e[+-]?[0-9]{1,2}$', '') as m from bare),
        numbers as (
          select *, case when not regexp_matches(b, '^[+-]?[0-9][0-9.,]*(e[+-]?[0-9]{1,2})?$') then null
            when e <> '' and regexp_matches(m, '^[+-]?[0-9]+[.,][0-9]+$') then replace(m, ',', '.')
            when regexp_matches(m, '[.,][0-9]{1,2}$') then regexp_replace(regexp_replace(m, '[.,]([0-9]{1,2})$', ''), '[.,]', '', 'g') || '.' || regexp_extract(m, '[.,]([0-9]{1,2})$', 1)
            else regexp_replace(m, '[.,]', '', 'g') end as n
          from parts),
        typed as (
          select id, attr, case
            when attr in ('price', 'rating', 'stock_count') then round(try_cast(n as decimal(28, 10)) * 1000000 * case when e = '' then 1 else pow(10, try_cast(e as int)) end)::hugeint::varchar
            when attr = 'in_stock' then case when lower(v) in ('true', 'yes', 'y', 't', '1') then 'true' when lower(v) in ('false', 'no', 'n', 'f', '0') then 'false' end
            when attr = 'released_on' then case
              when regexp_matches(v, '^[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}(T[0-9:]+Z)?$') then try_cast(replace(v[:10], '/', '-') as date)
              when regexp_matches(v, '^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$') then try_cast(v[7:10] || '-' || v[4:5] || '-' || v[1:2] as date)
              when regexp_matches(v, '^[0-9]{8}$') then try_cast(v[1:4] || '-' || v[5:6] || '-' || v[7:8] as date)
              when regexp_matches(v, '^[0-9]{9,15}$') then (date '1970-01-01' + (v::bigint // 86400000)::int)
              when regexp_matches(v, '^[0-9]{1,2} [A-Za-z]{3} [0-9]{4}$') then try_strptime(v, '%-d %b %Y')::date end::varchar
            else v end as cell
          from numbers)"""

SQL = {
    "p2_found": """
        with marks as (
          select replica, primary_addr, last_seq, last_sync, synced from (
            select *, lower(trim(status)) = 'synced' as synced,
              row_number() over (partition by replica, primary_addr
                order by (lower(trim(status)) = 'synced') desc, last_sync desc nulls last, last_seq desc nulls last) as rn
            from replica_state where replica is not null and primary_addr is not null) where rn = 1),
        versions as (
          select primary_addr, seq, min(arrived_at) as first_at, max(arrived_at) as last_at,
            count(distinct (op, coll_name, id, payload)) > 1 as changed
          from wal_entries where primary_addr is not null and seq is not null group by all)
        select replica, seq from versions join marks using (primary_addr)
        where not synced or last_seq is null or seq > last_seq or first_at > last_sync or (changed and last_at > last_sync)""",
    "p3_found": _CELLS + """
        select id, attr, cell from typed where cell is not null""",
    "p3_wide": _CELLS + """,
        own as (select distinct id from latest where attr in ('category', 'in_stock', 'price', 'released_on', 'status'))
        select own.id, max(cell) filter (attr = 'category') as category, max(cell) filter (attr = 'in_stock') as in_stock, max(cell) filter (attr = 'price') as price,
          max(cell) filter (attr = 'released_on') as released_on, max(cell) filter (attr = 'status') as status
        from own left join typed on typed.id = own.id group by own.id""",
    "p2_published": "select primary_addr, seq, op from wal_entries",
    "p2_resumed": """
        with given as (select *, epoch_us(arrived_at) as us from wal_entries where arrived_at is not null),
        mid as (select (min(us) + max(us)) // 2 as m from given),
        half as (select primary_addr, max(seq) as high_seq, max(us) as high_at from given, mid where us <= m and primary_addr is not null group by primary_addr),
        reps as (select distinct replica, primary_addr from replica_state where replica is not null and primary_addr is not null),
        versions as (
          select primary_addr, seq, min(us) as first_at, max(us) as last_at, count(distinct (op, coll_name, id, payload)) > 1 as changed
          from given where primary_addr is not null and seq is not null group by all)
        select distinct replica, seq, 1::bigint as run from given join reps using (primary_addr), mid where us <= m and seq is not null
        union all
        select replica, seq, 2 from versions join reps using (primary_addr) left join half using (primary_addr)
        where high_seq is null or seq > high_seq or first_at > high_at or (changed and last_at > high_at)""",
    "p7_found": REPLAY,
    "p7_merged": REPLAY,
}
