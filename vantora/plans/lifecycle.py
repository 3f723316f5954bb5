"""Queries over what is stored: indexes, snapshots, buffers, logs, shards by name and streams that catch up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changefeed, fusion, ivf, knn, mutation, quant, sharding, sparse, text, versioning
from ..session import file_names, shared_path, table
from ..sources import collection as store
from ..sources import files, indexes
from ..streaming import ingest
from .base import COLL, DEAD, DOCS, K, RANKINGS, Q, V, l2, l2sq, payload, queries, rankings, rounded, text_queries, tombstones, top, vectors
from .codecs import _SQ, IVF, PROBED
from .search import SCALED, SPARSE, near_sql, sparse_arrays, sparse_queries
from .store import _COPIES, HIST, REPLAY, at, history

QUERIES, SQL = {}, {}


def query(sql=None, name=None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


# collections


def new_collection(spark, name, dim=64):
    return store.Catalog(spark, shared_path(spark, "catalog")).create(name, store.Config(dim=dim))


def with_metadata(rows):
    return rows.select("id", "vector", F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"))


@query("select 'a' as name, 64::bigint as dim, (select count(*) from embeddings) as n union all select 'b', 3, 0")
def collection_lifecycle(spark, d):
    """Collections made, filled, listed and dropped: what is left."""
    catalog = store.Catalog(spark, shared_path(spark, "catalog"))
    for name, dim in (("a", 64), ("b", 3), ("c", 5)):
        catalog.create(name, store.Config(dim=dim))
    catalog.get("a").append(with_metadata(vectors(spark, d)), "id")
    catalog.drop("c")
    rows = [(n, catalog.get(n).config.dim, catalog.get(n).counts()["active"]) for n in catalog.names()]
    return spark.createDataFrame(rows, "name string, dim long, n long")


@query("with first as (select vec_id as id from embeddings where vec_id < 50), n as (select count(*) as n from first) select 'before' as name, n as total, 0::bigint as deleted, n as next_id from n union all select 'after', n + (select count(*) from embeddings where vec_id between 50 and 69), least(n, 10), n + (select count(*) from embeddings where vec_id between 50 and 69) from n")
def list_snapshots(spark, d):
    """Named snapshots of a collection that went on changing."""
    c = new_collection(spark, "c")
    rows = with_metadata(vectors(spark, d))
    c.append(rows.where("id < 50"), "id")
    c.snapshot("before")
    c.delete(spark.range(10))
    c.append(rows.where("id between 50 and 69"), "id")
    c.snapshot("after")
    c.delete(spark.range(20))
    return c.named_snapshots().select("name", "total", "deleted", "next_id")


@query("select row_number() over (order by vec_id) - 1 as id, vec_id as source from embeddings where vec_id < 30")
def snapshot_restore(spark, d):
    """A collection that lost all its rows, back to its snapshot."""
    c = new_collection(spark, "c")
    rows = vectors(spark, d).where("id < 30").select("id", "vector", F.create_map(F.lit("source"), F.col("id").cast("string")).alias("metadata"))
    c.append(rows, "id")
    number = c.snapshot("full")
    c.delete(spark.range(1_000))
    c.compact()
    return c.restore(number).rows().select("id", F.col("metadata")["source"].cast("bigint").alias("source"))


@query("select min(rn) as first_id, count(*) as n from (select row_number() over (order by vec_id) - 1 as rn from embeddings where vec_id < 300) group by rn // 128")
def buffered_appends(spark, d):
    """Single appends through a buffer of 128 rows, the rest by an explicit flush: first id and rows of each flush."""
    buffer = store.WriteBuffer(new_collection(spark, "c"), 128)
    for r in vectors(spark, d).where("id < 300").orderBy("id").select("vector").collect():  # a client's single calls
        buffer.append(list(r.vector))
    buffer.flush()
    return spark.createDataFrame(buffer.flushes, "first_id long, n long")


@query("select vec_id as id, case when vec_id % 3 = 0 then 'label=' || label || '|seen=yes' else 'label=' || label end as metadata from embeddings where vec_id < 200")
def metadata_put_batch(spark, d):
    """Metadata of a batch of ids, put into a collection that has some."""
    c = new_collection(spark, "c")
    c.append(with_metadata(vectors(spark, d).where("id < 200")), "id")
    c.patch(spark.range(200).where("id % 3 = 0").select("id", F.create_map(F.lit("seen"), F.lit("yes")).alias("patch")))
    cells = F.array_sort(F.map_entries("metadata"))
    return c.rows().select("id", F.array_join(F.transform(cells, lambda e: F.concat(e.key, F.lit("="), e.value)), "|").alias("metadata"))


@query(f"with {COLL}, {DEAD}, s as ({near_sql(where='id not in (select id from dead)')}) select t.*, v.label::varchar as label from ({top('s')}) t join v using (id)")
def collection_search(spark, d):
    """A stored collection with deletions, searched; the metadata comes with the results."""
    c = new_collection(spark, "c")
    c.append(with_metadata(vectors(spark, d)), "id")  # ids are dense, so the new ids are the old ones
    c.delete(tombstones(spark, d))
    found = c.search(queries(spark, d), K)
    return rounded(found).join(found.select("qid", "id", F.col("metadata")["label"].alias("label")), ["qid", "id"])


@query(f"with {COLL}, s as ({near_sql()}) select t.*, 1::bigint as misses, 2::bigint as hits from ({top('s')}) t")
def cached_search(spark, d):
    """The same search three times through a cache of results."""
    cache = indexes.ResultCache(spark, shared_path(spark, "cache"))
    for _ in range(3):
        found = cache.get("knn l2 10", 0, lambda: rounded(knn.knn_join(vectors(spark, d), queries(spark, d), K)))
    return found.withColumns({"misses": F.lit(cache.misses).cast("bigint"), "hits": F.lit(cache.hits).cast("bigint")})


# stored indexes


@query(f"with {DOCS} {top('bm', order='score desc, id')}")
def stored_text_search(spark, d):
    """BM25 over stored tokens."""
    index = indexes.TextIndex(spark, shared_path(spark, "text"))
    index.add(table(spark, d, "documents"))
    return rounded(index.search(text_queries(spark, d), K))


_KEPT = DOCS.replace("from documents where doc_id is not null", "from documents where doc_id is not null and doc_id % 7 <> 3")


@query(f"with {_KEPT} select (select n_docs from stat) as n_docs, round((select avgdl from stat), 6) as avg_length, count(distinct term) as n_terms, count(*) as n_postings from post")
def text_remove(spark, d):
    """Statistics of a stored text index after documents were removed, some of them twice."""
    index = indexes.TextIndex(spark, shared_path(spark, "text"))
    docs = table(spark, d, "documents")
    index.add(docs)
    gone = docs.where("doc_id % 7 = 3").select(F.col("doc_id").alias("id"))
    index.remove(gone)
    index.remove(gone.where("id % 2 = 0"))
    return text.index_stats(index.postings()).withColumn("avg_length", F.round("avg_length", 6))


_SPARSE_LEFT = SPARSE.replace("abs(vector[pos + 1]::double) > 0.1)", "abs(vector[pos + 1]::double) > 0.1 and id % 5 <> 1)")


@query(f"with {_SPARSE_LEFT} {top('sdot', order='score desc, id')}")
def stored_sparse_search(spark, d):
    """A stored sparse index after inserts, an upsert that replaces and deletions."""
    index = indexes.SparseIndex(spark, shared_path(spark, "sparse"))
    rows = sparse_arrays(spark, d)
    index.upsert(rows.withColumn("weights", F.transform("weights", lambda w: w * 3)).where("id % 2 = 0"))
    index.upsert(rows)
    index.delete(rows.where("id % 5 = 1").select("id"))
    return rounded(index.search(sparse_queries(spark, d), K))


@query(f"with {SPARSE} select id, dim, round(weight, 6) as weight from sp where id = 40")
def sparse_get(spark, d):
    """One vector of a stored sparse index."""
    index = indexes.SparseIndex(spark, shared_path(spark, "sparse"))
    index.upsert(sparse_arrays(spark, d))
    cells = index.get(40).select("id", F.inline(F.arrays_zip("dims", "weights")))
    return cells.select("id", F.col("dims").alias("dim"), F.round("weights", 6).alias("weight"))


@query(f"{_SQ} {top('s')}")
def stored_codes_search(spark, d):
    """Byte codes written with their quantizer, read again and searched."""
    index = indexes.CodeIndex(spark, shared_path(spark, "codes"))
    index.create(vectors(spark, d))
    return rounded(indexes.CodeIndex(spark, index.root).search(queries(spark, d), K))


@query(f"with {IVF}, s as (select qid, id, round({l2('qvec', 'vector')}, 9) as score from pr join asg using (list_id) join q using (qid)) {top('s')}")
def stored_lists_search(spark, d):
    """Inverted lists stored a folder each; a query's lists are the only folders that are opened."""
    index = indexes.ListIndex(spark, shared_path(spark, "lists"))
    rows = vectors(spark, d)
    index.create(rows, ivf.label_centroids(rows))
    return rounded(index.search(queries(spark, d), K, PROBED))


@query("with left_ as (select p_partkey as id, p_brand as brand, p_type as kind from part where p_partkey % 4 <> 0) select 'brand' as field, brand as value, count(*) as n from left_ group by brand union all select 'kind', kind, count(*) from left_ group by kind")
def posting_maintenance(spark, d):
    """Postings of metadata values after ids were removed and some added again."""
    index = indexes.ValueIndex(spark, shared_path(spark, "values"))
    rows = payload(spark, d).unpivot("id", ["brand", "kind"], "field", "value")
    index.add(rows)
    index.remove(rows.where("id % 4 < 2").select("id"))
    index.add(rows.where("id % 4 = 1"))
    return index.rows().groupBy("field", "value").agg(F.countDistinct("id").alias("n"))


@query("select count(distinct vec_id // 256) as n_blocks, count(*) as n_vectors, sum(264)::bigint + 8 * count(distinct vec_id // 256) as raw_bytes from embeddings".replace("sum(264)", "sum(8 + 4 * len(embedding))"))
def block_compression(spark, d):
    """Vectors compressed in blocks of 256 and read again: blocks, vectors and the bytes that come back."""
    blocks = indexes.blocks_of(vectors(spark, d))
    out = indexes.compression(blocks).select("n_blocks", "n_vectors", "raw_bytes")
    back = indexes.from_blocks(blocks, 64).agg(F.count("*").alias("m"))
    return out.crossJoin(F.broadcast(back)).where("m = n_vectors").drop("m")


@query(f"with {V} select id, len(vector) as dim, round(list_sum(list_transform(vector, lambda x: x::double)), 6) + 0.0 as total from v where id in (3, 257, 400)")
def block_random_access(spark, d):
    """Three vectors from compressed blocks; other blocks are left packed."""
    rows = indexes.from_blocks(indexes.blocks_of(vectors(spark, d)), 64, [3, 257, 400])
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rows.select("id", F.size("vector").cast("bigint").alias("dim"), (F.round(total, 6) + 0.0).alias("total"))


# codes: configuration and residual codes with fixed codebooks


@query("select dim, m, 256 as codes, m as code_bytes, round(dim * 4.0 / m, 6)::double as ratio from (select dim, case when dim <= 32 then 4 when dim <= 128 then 8 when dim <= 512 then 16 else 32 end::bigint as m from (select distinct dim::bigint as dim from collection_config where dim is not null union select unnest([16, 128, 512, 1536])::bigint))".replace("256 as codes", "256::bigint as codes"))
def pq_config(spark, d):
    """Product codes by dimension: subspaces, codes of each, bytes of a code and how much smaller it is."""
    dims = table(spark, d, "collection_config").where("dim is not null").select(F.col("dim").cast("bigint").alias("dim"))
    dims = dims.union(spark.createDataFrame([(x,) for x in (16, 128, 512, 1536)], "dim long")).distinct()
    m = F.lit(quant.subspaces(1 << 30))
    for most, n in reversed(quant.SUBSPACES):
        m = F.when(F.col("dim") <= most, n).otherwise(m)
    return dims.withColumn("m", m.cast("bigint")).select("dim", "m", F.lit(quant.CODES).cast("bigint").alias("codes"), F.col("m").alias("code_bytes"), F.round(F.col("dim") * 4 / F.col("m"), 6).alias("ratio"))


@query("select count(*) as n, max(len(embedding))::bigint as dim, sum(len(embedding) * 4)::bigint as float_bytes, sum((len(embedding) + 63) // 64 * 8 + 12)::bigint as code_bytes, round(sum(len(embedding) * 4) / sum((len(embedding) + 63) // 64 * 8 + 12), 6) as ratio from embeddings where len(embedding) > 0")
def rabitq_memory(spark, d):
    """Sign bits in 64-bit words with three statistics of four bytes each, against floats."""
    size = F.size("vector")
    rows = vectors(spark, d).where(size > 0).select((size * 4).alias("f"), (F.floor((size + 63) / 64) * 8 + 12).alias("c"), size.alias("dim"))
    return rows.agg(F.count("*").alias("n"), F.max("dim").cast("bigint").alias("dim"), F.sum("f").alias("float_bytes"), F.sum("c").alias("code_bytes"), F.round(F.sum("f") / F.sum("c"), 6).alias("ratio"))


M = 8
_RES = f"""{IVF},
  res as (select asg.id, list_id, list_transform(list_zip(vector, centroid), lambda z: z[1]::double - z[2]) as r from asg join cent using (list_id)),
  rsub as (select id, list_id, m, r[m * 8 + 1 : m * 8 + 8] as x from (select *, unnest(range({M})) as m from res)),
  rbook as (select m, id as code, x as c from rsub where id < 16),
  renc as (select id, list_id, m, code, c from (select rsub.id, rsub.list_id, rsub.m, code, c, row_number() over (partition by rsub.id, rsub.m order by round({l2sq('x', 'c')}, 9), code) as rn from rsub join rbook on rsub.m = rbook.m) where rn = 1)"""


def _residual(spark, d):
    rows = vectors(spark, d)
    centroids = ivf.label_centroids(rows)
    left = ivf.residuals(ivf.assign(rows.select("id", "vector"), centroids), centroids)
    import numpy as np

    book = np.array([r.vector for r in left.where("id < 16").orderBy("id").collect()], np.float64)  # sixteen residuals
    pq = quant.ProductQuantizer(book.reshape(len(book), M, -1).transpose(1, 0, 2))
    return centroids, pq, pq.encode(left).join(left.select("id", "list_id"), "id")


@query(f"with {_RES} select id, list_id::bigint as list_id, string_agg(code::varchar, ',' order by m) as codes from renc group by id, list_id")
def ivfpq_fixed_encode(spark, d):
    """Residual codes of every vector under label means and a codebook of sixteen residuals."""
    return _residual(spark, d)[2].select("id", "list_id", F.array_join(F.transform("codes", lambda c: c.cast("string")), ",").alias("codes"))


@query(f"""with {_RES},
  qres as (select qid, pr.list_id, list_transform(list_zip(qvec, centroid), lambda z: z[1]::double - z[2]) as r from pr join q using (qid) join cent using (list_id)),
  qsub as (select qid, list_id, m, r[m * 8 + 1 : m * 8 + 8] as y from (select *, unnest(range({M})) as m from qres)),
  s as (select qid, id, round(sum({l2sq('y', 'c')}), 9) as score from qsub join renc using (list_id, m) group by qid, id)
  {top('s')}""")
def ivfpq_fixed_search(spark, d):
    """Search in the probed lists by tables of subspace distances for each query's residual to each list."""
    centroids, pq, coded = _residual(spark, d)
    return rounded(ivf.pq_search(coded, queries(spark, d), centroids, pq, K, PROBED))


@query(f"with {V}, p as (select label::bigint as label, id % 7 as part, pos, x from (select label, id, unnest(range(len(vector))) as pos, unnest(vector)::double as x from v)) select label, pos, round(avg(x), 6) + 0.0 as mean, count(*) as n from p group by label, pos")
def incremental_centroid(spark, d):
    """Centroids kept up to date from counts and sums of seven parts that came one after the other."""
    rows = vectors(spark, d).select(F.col("label").cast("bigint").alias("label"), (F.col("id") % 7).alias("part"), F.posexplode("vector").alias("pos", "x"))
    parts = rows.groupBy("label", F.col("pos").cast("bigint").alias("pos"), "part").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("double")).alias("s"))
    return parts.groupBy("label", "pos").agg((F.round(F.sum("s") / F.sum("n"), 6) + 0.0).alias("mean"), F.sum("n").alias("n"))


@query(f"with {V}, t as (select id, j, list_sum(list_transform(range(64), lambda i: vector[i + 1]::double * case when bit_count((i & j)::bigint) % 2 = 1 then -1 else 1 end)) / 8 as y from (select *, unnest(range(64)) as j from v)) select id, round(sqrt(sum(y * y)), 6) as norm, round(sum(y), 6) + 0.0 as total, round(max(y), 6) as most from t group by id")
def hadamard_rotation(spark, d):
    """Every vector turned by the orthogonal matrix of signs: its length stays, its components mix."""
    import numpy as np

    signs = np.array([[(-1.0) ** bin(i & j).count("1") for i in range(64)] for j in range(64)]) / 8
    turned = quant.rotated(vectors(spark, d), signs)
    v = F.col("vector")
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return turned.select("id", F.round(norm, 6).alias("norm"), (F.round(total, 6) + 0.0).alias("total"), F.round(F.array_max(v), 6).alias("most"))


@query(f"with {SCALED}, f as (select qid, id, round(0.6 * coalesce(1 - (a - a_lo) / greatest(a_hi - a_lo, 1e-6), 0) + 0.4 * coalesce((b - b_lo) / greatest(b_hi - b_lo, 1e-6), 0), 9) as score from pairs_) select t.*, a.score as vector_score, b.score as text_score from ({top('f', order='score desc, id')}) t left join a using (qid, id) left join b using (qid, id)")
def hybrid_component_scores(spark, d):
    """Fused results with the scores they come from."""
    a, b = rankings(spark, d)
    found = rounded(fusion.weighted(a, b, 0.6, K))
    parts = [df.withColumnRenamed("score", n) for df, n in ((a, "vector_score"), (b, "text_score"))]
    return found.join(parts[0], ["qid", "id"], "left").join(parts[1], ["qid", "id"], "left")


# logs


@query(f"with {_COPIES} select primary_addr, count(*) as n, count(*) as intact from copies group by primary_addr")
def wal_checksums(spark, d):
    """The log written in segments with checksums and read again: entries of each primary, and how many are intact."""
    root = shared_path(spark, "log")
    rows = changefeed.latest_copies(table(spark, d, "wal_entries")).withColumn("ts", F.lit(None).cast("timestamp"))
    for primary in [r[0] for r in rows.select("primary_addr").distinct().collect()]:  # a log for each primary
        files.write_log(rows.where(F.col("primary_addr") == primary), f"{root}/{primary.encode().hex()}")
    out = None
    for name in file_names(spark, root):
        part = files.checked_log(spark, f"{root}/{name}").agg(F.count("*").alias("n"), F.count_if("intact").alias("intact"))
        part = part.select(F.lit(bytes.fromhex(name).decode()).alias("primary_addr"), "n", "intact")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.groupBy("primary_addr").agg(F.count("*").alias("n"), F.count("*").alias("intact"))


@query(f"with {_COPIES} select primary_addr, seq, op from copies where seq >= 12345 // 1000 * 1000")
def wal_truncate(spark, d):
    """What is left of the logs when segments of a thousand entries that lie wholly before a number are dropped."""
    return files.truncate_before(changefeed.latest_copies(table(spark, d, "wal_entries")), 12_345, 1_000).select("primary_addr", "seq", "op")


@query(f"with {_COPIES} select seq, op, coll_name from copies where seq >= 30000 and primary_addr = (select min(primary_addr) from wal_entries)")
def wal_catch_up(spark, d):
    """A replica's stream over the segments of one primary's log, from a number on."""
    root = shared_path(spark, "catch-up")
    rows = changefeed.latest_copies(table(spark, d, "wal_entries")).withColumn("ts", F.lit(None).cast("timestamp"))
    first = rows.agg(F.min("primary_addr")).first()[0]
    files.write_log(rows.where(F.col("primary_addr") == F.lit(first)), f"{root}/log")
    ingest.catch_up(spark, f"{root}/log", 30_000, f"{root}/rows", f"{root}/checkpoint")
    ingest.catch_up(spark, f"{root}/log", 30_000, f"{root}/rows", f"{root}/checkpoint")  # nothing new, nothing twice
    names = [n for n in file_names(spark, f"{root}/rows") if n.startswith("batch=")]
    if not names:
        return rows.limit(0).select("seq", "op", "coll_name")
    return spark.read.schema(files.WAL).parquet(*[f"{root}/rows/{n}" for n in names]).select("seq", "op", "coll_name")


@query(REPLAY)
def wal_recovery_from_base(spark, d):
    """Recovery from a stored base and the entries that arrived after it."""
    from .problems import p7_merged

    return p7_merged(spark, d)


@query("""with r as (select * from replica_state where replica is not null and primary_addr is not null),
  last as (select replica, primary_addr, lower(trim(status)) as status, last_seq from r qualify row_number() over (partition by replica, primary_addr order by last_sync desc nulls last, run_no desc nulls last, last_seq desc nulls last, lower(trim(status)) desc) = 1),
  head as (select primary_addr, max(seq) as head from wal_entries where primary_addr is not null group by primary_addr)
  select replica, primary_addr, status, last_seq, head, head - last_seq as lag, status = 'synced' and head <= last_seq as up_to_date from last left join head using (primary_addr)""")
def replica_status(spark, d):
    """Each replica's latest run: its status and how far it is behind its primary."""
    from pyspark.sql import Window as W

    rows = table(spark, d, "replica_state").where("replica is not null and primary_addr is not null").withColumn("status", F.lower(F.trim("status")))
    newest = W.partitionBy("replica", "primary_addr").orderBy(*[F.desc_nulls_last(c) for c in ("last_sync", "run_no", "last_seq")], F.desc("status"))
    last = rows.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").select("replica", "primary_addr", "status", "last_seq")
    head = table(spark, d, "wal_entries").where("primary_addr is not null").groupBy("primary_addr").agg(F.max("seq").alias("head"))
    out = last.join(head, "primary_addr", "left")
    return out.select("replica", "primary_addr", "status", "last_seq", "head", (F.col("head") - F.col("last_seq")).alias("lag"), ((F.col("status") == "synced") & (F.col("head") <= F.col("last_seq"))).alias("up_to_date"))


# versions, shards and streams


@query(f"with {HIST}, live as (select vector_id from (select * from h qualify row_number() over (partition by vector_id order by version_id desc) = 1) where not is_deleted and vector_id % 3 = 0) select vector_id, (select max(version_id) from h) + row_number() over (order by vector_id) as version_id, true as is_deleted from live")
def version_delete(spark, d):
    """Marker versions that delete every third vector, for those that are live."""
    h = history(spark, d)
    nxt = h.agg(F.max("version_id")).first()[0] + 1
    ids = h.where("vector_id % 3 = 0").select("vector_id")
    return versioning.deleted(h, ids, at("2024-02-01 00:00:00"), nxt).select("vector_id", "version_id", "is_deleted")


_NODES = f"nodes as (select pos, min(s) as s from (select ((s * 1000 + n)::hugeint * {sharding.NODE_MUL} + {sharding.NODE_ADD}) % 4294967296 as pos, s from (select unnest(range(4)) as s) cross join (select unnest(range({sharding.VNODES})) as n)) group by pos)"
_ROUTE = "coalesce(arg_min(s, pos) filter (pos >= h), arg_min(s, pos))"


@query(f"with {_NODES}, k as (select distinct coll_name, ('0x' || md5(coll_name)[:8])::bigint as h from collection_config where coll_name is not null) select coll_name, h as position, {_ROUTE} as shard from k cross join nodes group by coll_name, h")
def route_collections(spark, d):
    """The shard of each collection, by its name."""
    names = table(spark, d, "collection_config").where("coll_name is not null").select("coll_name").distinct()
    h = sharding.name_hash(F.col("coll_name"))
    return names.select("coll_name", h.alias("position"), sharding.route(h, sharding.ring([0, 1, 2, 3])).alias("shard"))


_FIRST4 = "array_to_string(list_transform(embedding[:4], lambda x: floor(x::double * 1000000 + 0.5)::bigint::varchar), ',')"


@query(f"with {_NODES}, k as (select vec_id as id, ('0x' || md5({_FIRST4})[:8])::bigint as h from embeddings), r as (select id, {_ROUTE} as shard from k cross join nodes group by id, h) select id, shard, row_number() over (partition by shard order by id) - 1 as local, (shard << 48) | (row_number() over (partition by shard order by id) - 1) as gid from r")
def sharded_insert(spark, d):
    """New vectors routed by their first components; each shard numbers its own, and the two make the global id."""
    from pyspark.sql import Window as W

    shard = sharding.route(sharding.vector_hash(F.col("vector")), sharding.ring([0, 1, 2, 3]))
    rows = vectors(spark, d).select("id", shard.alias("shard"))
    parts = None
    for s in range(4):  # a shard is a store of its own
        own = mutation.dense_numbers(rows.where(F.col("shard") == s), "id", "local")
        parts = own if parts is None else parts.unionByName(own)
    return parts.select("id", "shard", "local", sharding.global_id(F.col("shard"), F.col("local")).alias("gid"))


@query("select label::bigint as shard, vec_id as id, (label::bigint << 48) | vec_id as gid from embeddings where vec_id % 10 = 3 and label <> 3")
def get_by_global_id(spark, d):
    """Rows that global ids name, without those that were deleted by theirs."""
    rows = vectors(spark, d).select(F.col("label").cast("bigint").alias("shard"), "id")
    gids = rows.where("id % 10 = 3").select(sharding.global_id(F.col("shard"), F.col("id")).alias("gid"))
    dead = rows.where("shard = 3").select(sharding.global_id(F.col("shard"), F.col("id")).alias("gid"))
    return sharding.by_global_ids(rows, gids.join(dead, "gid", "left_anti")).select("shard", "id", "gid")


@query("select 0::bigint as batch, count(*) as rows, count(*) as total from events")
def stream_progress(spark, d):
    """What an ingest tells after each of its batches."""
    root = shared_path(spark, "progress")
    seen = ingest.append_with_progress(ingest.file_stream(spark, f"{d}/events.parquet"), f"{root}/rows", f"{root}/checkpoint")
    return spark.createDataFrame([(s["batch"], s["rows"], s["total"]) for s in seen], "batch long, rows long, total long")
