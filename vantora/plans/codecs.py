"""Queries over quantized vectors and inverted lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as vec
from ..operators import ivf, knn, quant
from ..operators.knn_matrix import distance_table
from .base import COLL, K, Q, V, dot, l2, l2sq, queries, rounded, top, vectors
from .search import words_sql

QUERIES, SQL = {}, {}


def query(sql=None, name=None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


LIMITS = f"{V}, {Q}, lim as (select pos, min(x) as lo, max(x) as hi, case when max(x) - min(x) > 1e-10 then 255.0::double / (max(x) - min(x)) else 1.0 end as scale from (select unnest(range(len(vector))) as pos, unnest(vector)::double as x from v) group by pos)"
CODED = f"{LIMITS}, arr as (select list(lo order by pos) as lo, list(scale order by pos) as scale from lim), coded as (select id, vector, lo, scale, list_transform(list_zip(vector, lo, scale), lambda z: least(greatest(floor((z[1]::double - z[2]) * z[3]), 0), 255)::int) as code from v cross join arr), dec as (select id, vector, code, list_transform(list_zip(code, lo, scale), lambda z: z[1] / z[3] + z[2]) as back, scale from coded)"


@query(f"with {LIMITS} select pos, round(lo, 6) as lo, round(hi, 6) as hi, round(scale, 4) as scale from lim")
def sq_train(spark, d):
    return quant.dim_limits(vectors(spark, d)).select(F.col("pos").cast("bigint").alias("pos"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), F.round("scale", 4).alias("scale"))


@query(f"with {LIMITS} select pos, round(lo, 6) as lo, round(hi, 6) as hi from lim")
def dim_min_max(spark, d):
    return sq_train(spark, d).select("pos", "lo", "hi")


def _coded(spark, d):
    rows = vectors(spark, d)
    sq = quant.ScalarQuantizer.train(rows)
    return sq, rows.select("id", "vector", sq.encode(F.col("vector")).alias("code"))


@query(f"with {CODED} select id, array_to_string(code, ',') as code from coded")
def sq_encode(spark, d):
    return _coded(spark, d)[1].select("id", F.array_join(F.transform("code", lambda x: x.cast("string")), ",").alias("code"))


@query(f"with {CODED} select id, round(list_max(list_transform(list_zip(vector, back), lambda z: abs(z[1]::double - z[2]))), 6) as worst, round({l2sq('vector', 'back')} / len(vector), 8) as mean_square from dec")
def sq_decode_error(spark, d):
    sq, rows = _coded(spark, d)
    rows = rows.withColumn("back", sq.decode(F.col("code")))
    worst = F.array_max(F.zip_with("vector", "back", lambda x, y: F.abs(x.cast("double") - y)))
    return rows.select("id", F.round(worst, 6).alias("worst"), F.round(vec.l2_squared(F.col("vector"), F.col("back")) / F.size("vector"), 8).alias("mean_square"))


_SQ = f"with {CODED}, s as (select qid, id, round({l2sq('qvec', 'back')}, 9) + 0.0 as score from q cross join dec)"


@query(f"{_SQ} {top('s')}")
def sq_search(spark, d):
    """Float queries against byte codes."""
    rows = vectors(spark, d)
    sq = quant.ScalarQuantizer.train(rows)
    return rounded(sq.search(sq.pack(rows), queries(spark, d), K))


@query(f"{_SQ}, c as ({top('s', 4 * K)}), e as (select c.qid, c.id, round({l2('qvec', 'vector')}, 9) as score from c join q using (qid) join v using (id)) {top('e')}")
def sq_rerank(spark, d):
    rows = vectors(spark, d)
    sq = quant.ScalarQuantizer.train(rows)
    return rounded(knn.rerank(sq.search(sq.pack(rows), queries(spark, d), 4 * K), rows, queries(spark, d), K))


@query(f"with {CODED}, p as (select a.id, a.code as x, b.code as y, a.scale from dec a join dec b on b.id = a.id + 1) select id, round(list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * list_sum(list_transform(scale, lambda s: 1 / (s * s))) / len(scale), 6) as by_mean_scale, round(list_sum(list_transform(list_zip(x, y, scale), lambda z: (z[1] - z[2]) * (z[1] - z[2]) / (z[3] * z[3]))), 6) as by_own_scale from p")
def sq_symmetric(spark, d):
    """Codes against codes: each vector and its successor."""
    sq, rows = _coded(spark, d)
    both = rows.select("id", F.col("code").alias("x")).join(rows.select((F.col("id") - 1).alias("id"), F.col("code").alias("y")), "id")
    mean, own = sq.symmetric(F.col("x"), F.col("y"))
    return both.select("id", F.round(mean, 6).alias("by_mean_scale"), F.round(own, 6).alias("by_own_scale"))


_MEM = "select n_vectors, dim, n_vectors * dim * 4 as float_bytes, n_vectors * dim + dim * 8 as code_bytes, round(n_vectors * dim * 4 / (n_vectors * dim + dim * 8), 6) as ratio from (select count(embedding) as n_vectors, max(len(embedding))::bigint as dim from embeddings)"


@query(_MEM)
def quantized_memory_stats(spark, d):
    return quant.memory_stats(vectors(spark, d))


@query(f"with {LIMITS} select count(*) as dim, round(min(scale), 4) as least_scale, round(max(scale), 4) as most_scale, round(avg(hi - lo), 6) as mean_range, (select count(*) from v) as n_trained from lim")
def quantizer_stats(spark, d):
    rows = vectors(spark, d)
    lim = quant.dim_limits(rows).agg(F.count("*").alias("dim"), F.round(F.min("scale"), 4).alias("least_scale"), F.round(F.max("scale"), 4).alias("most_scale"), F.round(F.avg(F.col("hi") - F.col("lo")), 6).alias("mean_range"))
    return lim.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n_trained"))))


# product codes: a fixed codebook (the subvectors of the first 64 vectors) for what SQL can check, trained ones beside it

#: Subspaces, vectors that are the fixed codebook, and candidates that are ranked again by exact distances.
M, BOOK, PQ_AGAIN, SIGN_AGAIN, COARSE_AGAIN = 8, 64, 40 * K, 20 * K, 4 * K
PQ = f"""{COLL},
  book as (select m, id as code, vector[m * 8 + 1 : m * 8 + 8] as c from (select *, unnest(range({M})) as m from v where id < {BOOK})),
  sub as (select id, m, vector[m * 8 + 1 : m * 8 + 8] as x from (select *, unnest(range({M})) as m from v)),
  enc as (select id, m, code, c from (select sub.id, sub.m, code, c, row_number() over (partition by sub.id, sub.m order by round({l2sq('x', 'c')}, 9), code) as rn from sub join book on sub.m = book.m) where rn = 1),
  qs as (select qid, m, qvec[m * 8 + 1 : m * 8 + 8] as y from (select *, unnest(range({M})) as m from q)),
  adc as (select qid, enc.id, round(sum({l2sq('y', 'enc.c')}), 9) as score from qs join enc using (m) group by qid, enc.id)"""


def fixed_pq(spark, d):
    rows = vectors(spark, d).where(f"id < {BOOK}").orderBy("id").select("vector").collect()  # the codebook: 64 vectors
    import numpy as np

    books = np.array([r.vector for r in rows], np.float64).reshape(len(rows), M, -1).transpose(1, 0, 2)
    return quant.ProductQuantizer(books)


@query(f"with {PQ} select id, string_agg(code::varchar, ',' order by m) as codes from enc group by id")
def pq_encode(spark, d):
    return fixed_pq(spark, d).encode(vectors(spark, d)).select("id", F.array_join(F.transform("codes", lambda c: c.cast("string")), ",").alias("codes"))


@query(f"with {PQ} {top('adc')}")
def pq_adc_search(spark, d):
    pq = fixed_pq(spark, d)
    return rounded(pq.search(pq.encode(vectors(spark, d)), queries(spark, d), K))


@query(f"with {PQ}, c as ({top('adc', PQ_AGAIN)}), e as (select c.qid, c.id, round({l2('qvec', 'vector')}, 9) as score from c join q using (qid) join v using (id)) {top('e')}")
def pq_rerank(spark, d):
    pq = fixed_pq(spark, d)
    near = pq.search(pq.encode(vectors(spark, d)), queries(spark, d), PQ_AGAIN)
    return rounded(knn.rerank(near, vectors(spark, d), queries(spark, d), K))


@query()
def pq_train(spark, d):
    """A trained codebook: (m, code, centroid)."""
    return quant.train_codebook(vectors(spark, d), M, 64)


# inverted lists around the mean vector of each label

#: Lists that a query of the fixed lists probes, of ten.
PROBED = 8
IVF = f"""{COLL},
  mean as (select label as list_id, pos, avg(x) as x from (select label, unnest(range(len(vector))) as pos, unnest(vector)::double as x from v) group by label, pos),
  cent as (select list_id, list(x order by pos) as centroid from mean group by list_id),
  asg as (select id, vector, list_id, dist from (select v.id, v.vector, list_id, round({l2('vector', 'centroid')}, 9) as dist, row_number() over (partition by v.id order by round({l2('vector', 'centroid')}, 9), list_id) as rn from v cross join cent) where rn = 1),
  pr as (select qid, list_id, score, rn as rank from (select qid, list_id, round({l2('qvec', 'centroid')}, 9) as score, row_number() over (partition by qid order by round({l2('qvec', 'centroid')}, 9), list_id) as rn from q cross join cent) where rn <= {PROBED})"""


@query(f"with {IVF} select id, list_id::bigint as list_id, round(dist, 6) as dist from asg")
def ivf_assign(spark, d):
    rows = vectors(spark, d)
    return ivf.assign(rows.select("id", "vector"), ivf.label_centroids(rows)).select("id", "list_id", F.round("list_dist", 6).alias("dist"))


@query(f"with {IVF} select qid, list_id::bigint as list_id, round(score, 6) as score, rank from pr")
def ivf_probe(spark, d):
    return ivf.probe(queries(spark, d), ivf.label_centroids(vectors(spark, d)), PROBED).select("qid", "list_id", F.round("score", 6).alias("score"), "rank")


def ivf_search(spark, d, nprobe):
    rows = vectors(spark, d)
    centroids = ivf.label_centroids(rows)
    return ivf.flat_search(ivf.assign(rows.select("id", "vector"), centroids), queries(spark, d), centroids, K, nprobe)


@query(f"with {IVF}, s as (select qid, id, round({l2('qvec', 'vector')}, 9) as score from pr join asg using (list_id) join q using (qid)) {top('s')}")
def ivf_flat_search(spark, d):
    return rounded(ivf_search(spark, d, PROBED))


@query(f"with {IVF}, n as (select list_id, count(*) as n from asg group by list_id) select count(*) as n_lists, sum(n)::bigint as n_vectors, min(n) as smallest, max(n) as largest, round(avg(n), 6) as mean_size from n")
def ivf_list_stats(spark, d):
    rows = vectors(spark, d)
    return ivf.list_stats(ivf.assign(rows.select("id", "vector"), ivf.label_centroids(rows)))


def _ivfpq(spark, d):
    rows = vectors(spark, d).select("id", "vector")
    centroids = ivf.train_centroids(rows, 16)
    left = ivf.residuals(ivf.assign(rows, centroids), centroids)
    pq = quant.ProductQuantizer.of(quant.train_codebook(left, 16, 64))
    return centroids, pq, pq.encode(left).join(left.select("id", "list_id"), "id")


@query()
def ivfpq_encode(spark, d):
    """Trained lists and residual codes of every vector."""
    return _ivfpq(spark, d)[2].select("id", "list_id", F.array_join(F.transform("codes", lambda c: c.cast("string")), ",").alias("codes"))


@query(f"with {V}, own as (select label as list_id, vector, id from v), n as (select list_id, pos, avg(x) as mean, count(*) as n from (select list_id, unnest(range(len(vector))) as pos, unnest(vector)::double as x from own) group by list_id, pos) select list_id::bigint as list_id, pos, round(mean, 6) + 0.0 as mean, n from n")
def kmeans_step(spark, d):
    """One update: the mean of each cluster's members by component."""
    rows = vectors(spark, d).select(F.col("label").cast("bigint").alias("list_id"), F.posexplode("vector").alias("pos", "x"))
    return rows.groupBy("list_id", F.col("pos").cast("bigint").alias("pos")).agg((F.round(F.avg(F.col("x").cast("double")), 6) + 0.0).alias("mean"), F.count("*").alias("n"))


# sign bits, without rotation for what SQL can check


@query(f"with {V}, w as (select id, {words_sql('vector')} as w from v) select id, w[1]::bigint as word0, w[2]::bigint as word1 from w")
def rabitq_sign_bits(spark, d):
    words = vec.sign_words(F.col("vector"), 64)
    return vectors(spark, d).select("id", words.alias("w")).select("id", F.get("w", F.lit(0)).alias("word0"), F.get("w", F.lit(1)).alias("word1"))


_SIGN = f"""{COLL}, g as (select id, vector, sqrt({dot('vector', 'vector')}) as norm, list_transform(vector, lambda x: case when x > 0 then 1.0 else -1.0 end) as signs from v),
  s as (select qid, id, round(greatest(0.0, {dot('qvec', 'qvec')} + norm * norm - 2 * sqrt(2 / pi()) * {dot('qvec', 'signs')} * norm / sqrt(len(vector))), 9) + 0.0 as score from q cross join g)"""


@query(f"with {_SIGN} select qid, id, round(score, 6) as score from s")
def rabitq_distance(spark, d):
    """Estimated squared distance of every query to every vector from its signs and norm."""
    rows, q = vectors(spark, d), queries(spark, d)
    signs = F.transform("vector", lambda x: F.when(x > 0, 1.0).otherwise(-1.0))
    products = distance_table(rows.select("id", signs.alias("vector")), q, 12).select("qid", "id", "dot")
    norms = rows.select("id", vec.norm(F.col("vector")).alias("norm"), F.size("vector").alias("dim"))
    out = products.join(norms, "id").join(q.select("qid", vec.norm(F.col("qvec")).alias("query_norm")), "qid")
    return out.select("qid", "id", F.round(quant.sign_distance(F.col("dot"), F.col("query_norm"), F.col("norm"), F.col("dim")), 6).alias("score"))


@query(f"with {_SIGN}, c as ({top('s', SIGN_AGAIN)}), e as (select c.qid, c.id, round({l2('qvec', 'vector')}, 9) as score from c join q using (qid) join v using (id)) {top('e')}")
def rabitq_rerank(spark, d):
    rows, q = vectors(spark, d), queries(spark, d)
    return rounded(knn.rerank(quant.sign_search(quant.sign_codes(rows), q, SIGN_AGAIN), rows, q, K))


# trained lists and codebooks and turned signs; tests/test_operators.py measures recall on whole tables

LISTS, PROBES, SUBSPACES, SUBCODES, PQ_CANDIDATES, SIGN_CANDIDATES = 16, 12, 16, 64, 10 * K, 20 * K


@query()
def ivf_trained_search(spark, d):
    rows = vectors(spark, d).select("id", "vector")
    centroids = ivf.train_centroids(rows, LISTS)
    return rounded(ivf.flat_search(ivf.assign(rows, centroids), queries(spark, d), centroids, K, PROBES))


@query()
def ivfpq_search(spark, d):
    """Trained lists and residual codes; the candidates are ranked again by exact distances."""
    rows, q = vectors(spark, d), queries(spark, d)
    centroids, pq, coded = _ivfpq(spark, d)
    return rounded(knn.rerank(ivf.pq_search(coded, q, centroids, pq, PQ_CANDIDATES, PROBES), rows, q, K))


@query()
def pq_trained_rerank(spark, d):
    rows, q = vectors(spark, d), queries(spark, d)
    pq = quant.ProductQuantizer.of(quant.train_codebook(rows, SUBSPACES, SUBCODES))
    return rounded(knn.rerank(pq.search(pq.encode(rows), q, PQ_CANDIDATES), rows, q, K))


@query()
def rabitq_rotated_rerank(spark, d):
    rows, q = vectors(spark, d), queries(spark, d)
    dim = rows.where("vector is not null").select(F.size("vector").alias("n")).first()
    if dim is None:
        return rounded(knn.knn_join(rows, q, K))
    turn = quant.rotation(dim.n)
    near = quant.sign_search(quant.sign_codes(quant.rotated(rows, turn)), quant.rotated(q, turn, "qid", "qvec"), SIGN_CANDIDATES)
    return rounded(knn.rerank(near, rows, q, K))


@query(f"with {COLL}, s as (select qid, id, round({l2sq('qvec', 'vector')}, 9) as score from (select qid, list_transform(qvec, lambda x: round(x::double, 1)) as qvec from q) cross join (select id, list_transform(vector, lambda x: round(x::double, 1)) as vector from v)), c as ({top('s', COARSE_AGAIN)}), e as (select c.qid, c.id, round({l2('qvec', 'vector')}, 9) as score from c join q using (qid) join v using (id)) {top('e')}")
def two_stage_rerank(spark, d):
    """Four times k candidates by coarse components (one digit), then exact distances."""
    rows, q = vectors(spark, d), queries(spark, d)

    def coarse(c):
        return F.transform(c, lambda x: F.round(x.cast("double"), 1))

    near = knn.knn_join(rows.select("id", coarse("vector").alias("vector")), q.select("qid", coarse("qvec").alias("qvec")), COARSE_AGAIN, "l2_squared")
    return rounded(knn.rerank(near, rows, q, K))
