"""Queries over the scalar functions that operators are made of: texts, dates, numbers, arrays, maps and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table

QUERIES, SQL = {}, {}


def query(sql):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query("select p_partkey as id, lower(p_brand) as low, len(string_split(p_name, ' ')) as n_words, try_cast(replace(p_brand, 'Brand#', '') as double) as number, case when starts_with(p_brand, 'Brand#') then p_brand[7:] else p_brand end as bare from part")
def string_functions(spark, d):
    """Lower case, split, numbers in texts and prefixes."""
    b = F.col("p_brand")
    bare = F.when(F.startswith(b, F.lit("Brand#")), F.substring(b, 7, 1_000_000)).otherwise(b)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lower(b).alias("low"), F.size(F.split("p_name", " ")).cast("bigint").alias("n_words"), F.replace(b, F.lit("Brand#"), F.lit("")).try_cast("double").alias("number"), bare.alias("bare"))


@query("select event_id as id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as rfc3339, strftime(ts - interval 30 day, '%Y%m%d') as cutoff, epoch(date_trunc('second', ts))::bigint as seconds, strptime(strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), '%Y-%m-%dT%H:%M:%SZ') = date_trunc('second', ts) as back from events")
def date_functions(spark, d):
    """RFC 3339 there and back, formats, days before and seconds since 1970."""
    ts = F.col("ts").cast("timestamp")
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    back = F.to_timestamp(text, "yyyy-MM-dd'T'HH:mm:ssX")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), text.alias("rfc3339"), F.date_format(ts - F.expr("interval 30 days"), "yyyyMMdd").alias("cutoff"), F.unix_seconds(ts).alias("seconds"), (back == F.date_trunc("second", ts)).alias("back"))


@query("select event_id as id, round(ln(abs(value) + 1), 6) as ln, round(sqrt(abs(value)), 6) as sqrt, floor(value)::bigint as floor, least(greatest(value, 10), 100) as clamped, greatest(value, event_id % 50) as most from events")
def math_functions(spark, d):
    v = F.col("value")
    most = F.greatest(v, (F.col("event_id") % 50).cast("double"))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.round(F.ln(F.abs(v) + 1), 6).alias("ln"), F.round(F.sqrt(F.abs(v)), 6).alias("sqrt"), F.floor(v).alias("floor"), F.least(F.greatest(v, F.lit(10.0)), F.lit(100.0)).alias("clamped"), most.alias("most"))


@query("select vec_id as id, round(list_sum(list_transform(embedding[3:6], lambda x: x::double)), 6) + 0.0 as sliced, round(list_sum(list_transform(list_zip(embedding[1:4], embedding[5:8]), lambda z: z[1]::double * z[2])), 6) + 0.0 as zipped, len(list_concat(embedding[1:3], embedding[9:12])) as joined, round(list_sum(list_transform(embedding[1:8], lambda x, i: x::double * i)), 6) + 0.0 as weighted from embeddings")
def array_functions(spark, d):
    """Slices, pairs, joined arrays and positions."""
    e = F.col("embedding")

    def total(a):
        return F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")), 6) + 0.0

    zipped = F.zip_with(F.slice(e, 1, 4), F.slice(e, 5, 4), lambda x, y: x.cast("double") * y)
    weighted = F.transform(F.slice(e, 1, 8), lambda x, i: x.cast("double") * (i + 1))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), total(F.slice(e, 3, 4)).alias("sliced"), total(zipped).alias("zipped"), F.size(F.concat(F.slice(e, 1, 3), F.slice(e, 9, 4))).cast("bigint").alias("joined"), total(weighted).alias("weighted"))


_ENDS = "ends as (select id, min_by(coalesce(metadata, map([]::varchar[], []::varchar[])), req_no) as a, max_by(coalesce(metadata, map([]::varchar[], []::varchar[])), req_no) as b from upserts where id is not null group by id)"


@query(f"with {_ENDS} select id, array_to_string(list_sort(list_filter(map_keys(b), lambda k: not list_contains(map_keys(a), k))), ',') as added, array_to_string(list_sort(list_filter(map_keys(a), lambda k: not list_contains(map_keys(b), k))), ',') as removed, array_to_string(list_sort(list_filter(map_keys(b), lambda k: list_contains(map_keys(a), k) and a[k] is distinct from b[k])), ',') as changed from ends")
def map_functions(spark, d):
    """Keys that were added, removed and changed between the first and the last request of each id."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    m = F.coalesce("metadata", empty)
    ends = table(spark, d, "upserts").where("id is not null").groupBy("id").agg(F.min_by(m, "req_no").alias("a"), F.max_by(m, "req_no").alias("b"))
    ka, kb = F.map_keys("a"), F.map_keys("b")
    changed = F.filter(F.array_intersect(ka, kb), lambda k: ~F.try_element_at(F.col("a"), k).eqNullSafe(F.try_element_at(F.col("b"), k)))
    return ends.select("id", F.array_join(F.array_sort(F.array_except(kb, ka)), ",").alias("added"), F.array_join(F.array_sort(F.array_except(ka, kb)), ",").alias("removed"), F.array_join(F.array_sort(changed), ",").alias("changed"))


@query("select event_id as id, (props->>'k')::bigint as k, json_extract_string(json_object('event', event_type, 'k', (props->>'k')::bigint), '$.event') as event from events")
def json_functions(spark, d):
    """A field of a JSON text, and one of a text made from fields."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    made = F.to_json(F.struct(F.col("event_type").alias("event"), k.alias("k")))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), k.alias("k"), F.get_json_object(made, "$.event").alias("event"))
