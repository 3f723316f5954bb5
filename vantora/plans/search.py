"""Queries over vectors: filters, exact and filtered search, text, sparse vectors and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as vec
from ..operators import filters as flt
from ..operators import fusion, ivf, knn, mutation, sparse, text
from ..operators.knn_matrix import distance_table
from ..session import table
from .base import COLL, DEAD, DOCS, K, META, RANKINGS, Q, V, collection, cosine, dot, l2, l2sq, payload, queries, rankings, rounded, text_queries, tombstones, top, vectors

QUERIES, SQL = {}, {}


def query(sql=None, name=None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


# nearest neighbours

SCORE_SQL = {"l2": l2("qvec", "vector"), "cosine": cosine("qvec", "vector"), "dot": f"-{dot('qvec', 'vector')}", "l2_squared": l2sq("qvec", "vector")}


def near_sql(metric="l2", where="true", source="coll"):
    return f"select qid, id, round({SCORE_SQL[metric]}, 9) + 0.0 as score from q cross join {source} where {where}"


for _m in ("l2", "cosine", "dot"):
    query(f"with {COLL}, s as ({near_sql(_m)}) {top('s')}", f"knn_{_m}")(lambda spark, d, m=_m: rounded(knn.knn_join(vectors(spark, d), queries(spark, d), K, m)))

FILTERS = {
    "filter_eq": (flt.Eq("brand", "Brand#2"), "brand = 'Brand#2'"),
    "filter_in": (flt.In("brand", ("Brand#1", "Brand#3", "Brand#9")), "brand in ('Brand#1', 'Brand#3', 'Brand#9')"),
    "filter_and": (flt.from_map({"kind": "ECONOMY", "name": "blue bolt"}), "kind = 'ECONOMY' and name = 'blue bolt'"),
    "filter_gt": (flt.Compare("price", "gt", 950), "price > 950"),
    "filter_gte": (flt.Compare("size", "gte", 30), "size >= 30"),
    "filter_lt": (flt.Compare("size", "lt", 12), "size < 12"),
    "filter_lte": (flt.Compare("price", "lte", 910.5), "price <= 910.5"),
    "filter_range": (flt.Range("size", 10, 20), "size between 10 and 20"),
    "filter_between_exclusive": (flt.Range("size", 10, 20, True), "size > 10 and size < 20"),
    "filter_numeric_eq": (flt.Compare("size", "eq", 7), "size = 7"),
    "filter_or": (flt.Eq("brand", "Brand#2") | flt.Compare("size", "gt", 45), "brand = 'Brand#2' or size > 45"),
    "filter_not": (~flt.Eq("kind", "ECONOMY"), "not coalesce(kind = 'ECONOMY', false)"),
    "filter_dsl_nested": (
        flt.from_json({"and": [{"or": [{"eq": ["kind", "SMALL"]}, {"in": ["brand", ["Brand#4", "Brand#5"]]}]}, {"not": {"range": ["size", 5, 15]}}, {"lt": ["price", 1500]}]}),
        "(kind = 'SMALL' or brand in ('Brand#4', 'Brand#5')) and not (size between 5 and 15) and price < 1500",
    ),
}
for _n, (_f, _w) in FILTERS.items():
    query(f"with {META} select id, brand, kind, size::bigint as size from meta where {_w}", _n)(
        lambda spark, d, f=_f: flt.matching(payload(spark, d), f).select("id", "brand", "kind", F.col("size").cast("bigint").alias("size"))
    )


@query("select p_partkey as id, p_name as name from part where p_partkey in (3, 17, 99, 100, 512, 100000)")
def filter_ids(spark, d):
    return flt.with_ids(payload(spark, d), [3, 17, 99, 100, 512, 100000]).select("id", "name")


@query("select p_partkey as id, p_name as name from part where p_partkey between 50 and 149")
def filter_id_range(spark, d):
    return payload(spark, d).where(F.col("id").between(50, 149)).select("id", "name")


@query(f"with {V}, {DEAD} select id, label::bigint as label from v where id not in (select id from dead)")
def filter_active(spark, d):
    return flt.active(vectors(spark, d), tombstones(spark, d)).select("id", F.col("label").cast("bigint").alias("label"))


@query("select p_brand as brand, count(distinct p_partkey) as n_ids, count(distinct case when p_size > 25 then p_partkey end) as n_large from part group by p_brand")
def bitmap_count(spark, d):
    """Sizes of unions of id sets by bitmaps: one bitmap for each brand and bucket of ids, combined with or."""
    def count(df, name):
        bits = df.groupBy("brand", F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
        return bits.groupBy("brand").agg(F.sum(F.bitmap_count("bits")).alias(name))

    rows = payload(spark, d)
    return count(rows, "n_ids").join(count(rows.where("size > 25"), "n_large"), "brand", "left").select("brand", "n_ids", F.coalesce("n_large", F.lit(0)).cast("bigint").alias("n_large"))


@query(f"with {COLL}, s as ({near_sql(where='brand in (' + repr('Brand#1') + ', ' + repr('Brand#2') + ', ' + repr('Brand#7') + ')')}) {top('s')}")
def knn_filtered(spark, d):
    rows = flt.matching(collection(spark, d), flt.In("brand", ("Brand#1", "Brand#2", "Brand#7")))
    return rounded(knn.knn_join(rows, queries(spark, d), K))


_COMBINED = flt.In("kind", ("ECONOMY", "SMALL", "LARGE")) & flt.Range("size", 5, 45)
_COMBINED_SQL = "kind in ('ECONOMY', 'SMALL', 'LARGE') and size between 5 and 45 and id between 10 and 1000000 and id not in (select id from dead)"


@query(f"with {COLL}, {DEAD}, s as ({near_sql('cosine', _COMBINED_SQL)}) select t.*, brand, kind, size::bigint as size from ({top('s')}) t join meta using (id)")
def knn_combined_filter(spark, d):
    """The flagship: metadata, range, id range and tombstones below the search, metadata with the results."""
    rows = flt.matching(collection(spark, d), _COMBINED).where(F.col("id").between(10, 1_000_000))
    found = knn.knn_join(flt.active(rows, tombstones(spark, d)), queries(spark, d), K, "cosine")
    return rounded(found).join(payload(spark, d).select("id", "brand", "kind", F.col("size").cast("bigint").alias("size")), "id")


@query(f"with {COLL}, s as ({near_sql()}) select t.* from ({top('s')}) t join meta using (id) where size > 20")
def knn_post_filter(spark, d):
    """The filter after the search: fewer than k rows may remain."""
    found = rounded(knn.knn_join(vectors(spark, d), queries(spark, d), K))
    return found.join(payload(spark, d).where("size > 20").select("id"), "id", "left_semi")


@query(f"with {COLL}, s as ({near_sql()}) select t.*, brand, kind from ({top('s')}) t left join meta using (id)")
def knn_with_metadata(spark, d):
    return rounded(knn.knn_join(vectors(spark, d), queries(spark, d), K)).join(payload(spark, d).select("id", "brand", "kind"), "id", "left")


@query(f"with {COLL}, s as ({near_sql()}) select t.*, len(vector)::bigint as dim, round(list_sum(list_transform(vector, lambda x: x::double)), 6) as total from ({top('s')}) t join v using (id)")
def knn_with_vectors(spark, d):
    found = rounded(knn.knn_join(vectors(spark, d), queries(spark, d), K)).join(vectors(spark, d).select("id", "vector"), "id")
    return found.select("qid", "id", "score", "rank", F.size("vector").cast("bigint").alias("dim"), F.round(vec.total(F.col("vector")), 6).alias("total"))


@query(f"with {COLL}, s as ({near_sql()}) {top('s', 50)}")
def knn_join(spark, d):
    return rounded(knn.knn_join(vectors(spark, d), queries(spark, d), 50))


#: Collections with fewer vectors are searched exactly.
ADAPTIVE_ROWS = 2_000


@query(f"with {COLL}, s as ({near_sql()}) {top('s')}")
def adaptive_search(spark, d):
    """All vectors below ``ADAPTIVE_ROWS``, else the trained lists that can hold a neighbour; the result is exact either way."""
    rows = vectors(spark, d)
    if rows.count() < ADAPTIVE_ROWS:
        return rounded(knn.knn_join(rows, queries(spark, d), K))
    centroids = ivf.train_centroids(rows.select("id", "vector"), 16)
    return rounded(ivf.exact_search(ivf.assign(rows.select("id", "vector"), centroids), queries(spark, d), centroids, K))


@query(f"with {COLL}, s as ({near_sql()}), n as ({top('s', 100)}) {top('(select n.qid, n.id, n.score from n join meta using (id) where size > 20)')}")
def knn_oversample_filter(spark, d):
    """Ten times as many candidates, then the filter, then k."""
    near = knn.knn_join(vectors(spark, d), queries(spark, d), 10 * K)
    kept = near.join(payload(spark, d).where("size > 20").select("id"), "id", "left_semi").select("qid", "id", F.round("score", 6).alias("score"))
    return rounded(knn.ranked(kept, K))


@query("select label, n, m, strategy, expansion from (select label, (select count(*) from embeddings) as n, count(*) as m from embeddings group by label) cross join lateral (select case when m = n then 'none' when m / n < 0.1 then 'pre' when m / n > 0.5 then 'post' else 'hybrid' end as strategy, floor(round(10 * case when m / n < 0.01 then 10.0 when m / n < 0.1 then least(10.0, 2.0 * sqrt(n / m)) else 2.0 end, 9))::bigint as expansion)".replace("select label, n", "select label::bigint as label, n"))
def navix_expansion(spark, d):
    """Strategy and candidates for a filter on each label."""
    rows = vectors(spark, d)
    total = rows.agg(F.count("*").alias("n"))
    m = rows.groupBy(F.col("label").cast("bigint").alias("label")).agg(F.count("*").alias("m")).crossJoin(F.broadcast(total))
    return m.select("label", "n", "m", knn.strategy(F.col("m"), F.col("n")).alias("strategy"), knn.expansion(F.col("m") / F.col("n"), K).alias("expansion"))


@query(f"with {COLL}, s as ({near_sql()}), n as (select *, row_number() over (partition by qid order by score, id) as pos from s) {top('(select qid, id, score from n join v using (id) where pos <= 20 and label in (1, 2, 4))')}")
def navix_search(spark, d):
    return rounded(knn.expanding_search(vectors(spark, d), queries(spark, d), F.col("label").isin(1, 2, 4), K))


@query(f"with {V}, {Q} select qid, id, round({l2sq('qvec', 'vector')}, 6) + 0.0 as l2_squared, round({dot('qvec', 'vector')}, 6) + 0.0 as dot, round({cosine('qvec', 'vector')}, 6) + 0.0 as cosine from q cross join v")
def batch_distances(spark, d):
    """All three distances of every query to every vector."""
    return distance_table(vectors(spark, d), queries(spark, d))


@query(f"with {V}, m as (select vector as w from v where id = 0) select id, round({dot('vector', 'w')}, 6) + 0.0 as product from v cross join m")
def matrix_vector_mul(spark, d):
    """The collection as a matrix times one vector, given as a literal so that the product stays in generated code."""
    rows = vectors(spark, d)
    w = rows.where("id = 0").first().vector
    product = sum((F.get("vector", F.lit(i)).cast("double") * F.lit(float(x)) for i, x in enumerate(w[1:], 1)), F.get("vector", F.lit(0)).cast("double") * F.lit(float(w[0])))
    return rows.select("id", (F.round(product, 6) + 0.0).alias("product"))


@query(f"with {V}, {DEAD} select count(*) as total, count(dead.id) as deleted, round(count(dead.id) / count(*), 6) as ratio, count(dead.id) / count(*) >= 0.3 as needs_rebuild from v left join dead using (id)")
def deletion_stats(spark, d):
    return mutation.deletion_stats(vectors(spark, d), tombstones(spark, d))


@query("select region, count(*) as n, min(vec_id) as first_id from (select vec_id, array_to_string(list_transform(embedding[:8], lambda x: trunc((x::double + 1) * 10 / 2)::int), ',') as region from embeddings) group by region")
def region_buckets(spark, d):
    """Vectors by the cell of a grid over their first eight components."""
    cell = F.array_join(F.transform(F.slice("vector", 1, 8), lambda x: ((x.cast("double") + 1) * 10 / 2).cast("int").cast("string")), ",")
    return vectors(spark, d).groupBy(cell.alias("region")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(f"with {COLL}, s as ({near_sql()}) select qid, id, score, rank, (rank - 1) // 20 as batch_index, ((n + 19) // 20)::bigint as total_batches, least(((rank - 1) // 20 + 1) * 20, n) as results_so_far, (rank - 1) // 20 + 1 = (n + 19) // 20 as is_last from (select *, count(*) over (partition by qid) as n from ({top('s', 50)}))")
def paged_search(spark, d):
    return knn.paged(rounded(knn.knn_join(vectors(spark, d), queries(spark, d), 50)), 20)


# scalar functions, for every vector against its successor in the collection

PAIRS = f"{V}, p as (select a.id, a.vector as x, b.vector as y from v a join v b on b.id = a.id + 1)"


def pairs(spark, d):
    rows = vectors(spark, d)
    return rows.select("id", F.col("vector").alias("x")).join(rows.select((F.col("id") - 1).alias("id"), F.col("vector").alias("y")), "id")


for _n, _f, _s in (
    ("vec_l2_squared", vec.l2_squared, l2sq("x", "y")),
    ("vec_l2", vec.l2, l2("x", "y")),
    ("vec_dot", vec.dot, dot("x", "y")),
    ("vec_cosine", vec.cosine_distance, cosine("x", "y")),
):
    query(f"with {PAIRS} select id, round({_s}, 6) + 0.0 as value from p", _n)(lambda spark, d, f=_f: pairs(spark, d).select("id", (F.round(f(F.col("x"), F.col("y")), 6) + 0.0).alias("value")))


@query(f"with {V} select id, pos, round(vector[pos + 1]::double / sqrt({dot('vector', 'vector')}), 6) + 0.0 as value from (select *, unnest(range(len(vector))) as pos from v)")
def vec_normalize(spark, d):
    rows = vectors(spark, d).select("id", F.posexplode(vec.normalize(F.col("vector"))).alias("pos", "value"))
    return rows.select("id", F.col("pos").cast("bigint").alias("pos"), (F.round("value", 6) + 0.0).alias("value"))


@query(f"with {V} select id, round(sqrt({dot('vector', 'vector')}), 6) as norm from v")
def vec_norm(spark, d):
    return vectors(spark, d).select("id", F.round(vec.norm(F.col("vector")), 6).alias("norm"))


_BYTES = "list_transform({0}, lambda x: floor(least(greatest((x::double + 1) * 127.5, 0), 255))::bigint)"


@query(f"with {PAIRS}, c as (select id, {_BYTES.format('x')} as x, {_BYTES.format('y')} as y from p) select id, list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as l2_squared, list_sum(list_transform(list_zip(x, y), lambda z: z[1] * z[2]))::bigint as dot from c")
def vec_u8_distance(spark, d):
    def byte(c):
        return F.transform(c, lambda x: F.floor(F.least(F.greatest((x.cast("double") + 1) * 127.5, F.lit(0.0)), F.lit(255.0))).cast("bigint"))

    def fold(f):
        return F.aggregate(F.zip_with("a", "b", f), F.lit(0).cast("bigint"), lambda s, x: s + x)

    rows = pairs(spark, d).select("id", byte("x").alias("a"), byte("y").alias("b"))
    return rows.select("id", fold(lambda x, y: (x - y) * (x - y)).alias("l2_squared"), fold(lambda x, y: x * y).alias("dot"))


_WORD = "list_sum(list_transform(range({lo}, {hi}), lambda i: case when {v}[i + 1] > 0 then 1::bigint << (i - {lo}) else 0 end))::bigint"


def words_sql(v):
    return f"[{_WORD.format(v=v, lo=0, hi=32)}, {_WORD.format(v=v, lo=32, hi=64)}]"


@query(f"with {PAIRS}, w as (select id, {words_sql('x')} as a, {words_sql('y')} as b from p) select id, (bit_count(xor(a[1], b[1])) + bit_count(xor(a[2], b[2])))::bigint as distance from w")
def hamming(spark, d):
    rows = pairs(spark, d).select("id", vec.sign_words(F.col("x"), 64).alias("a"), vec.sign_words(F.col("y"), 64).alias("b"))
    return rows.select("id", vec.hamming(F.col("a"), F.col("b")).alias("distance"))


@query(f"with {V}, m as (select id, vector, list_sum(list_transform(vector, lambda x: x::double)) / len(vector) as mean from v) select id, round(sqrt({dot('vector', 'vector')}), 6) as norm, round(mean, 6) + 0.0 as mean, round({dot('vector', 'vector')} / len(vector) - mean * mean, 6) as variance from m")
def vector_stats(spark, d):
    v = F.col("vector")
    return vectors(spark, d).select("id", F.round(vec.norm(v), 6).alias("norm"), (F.round(vec.mean(v), 6) + 0.0).alias("mean"), F.round(vec.variance(v), 6).alias("variance"))


# text


@query(f"with {DOCS} select id, term, tf from post")
def term_frequencies(spark, d):
    return text.postings(table(spark, d, "documents"))


@query(f"with {DOCS} select id, count(*) as n_tokens, count(distinct term) as n_terms from toks group by id")
def tokenize(spark, d):
    words = table(spark, d, "documents").select(F.col("doc_id").alias("id"), text.tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    return words.select("id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_terms"))


@query(f"with {DOCS} select id, dl from len")
def doc_lengths(spark, d):
    return text.lengths(text.postings(table(spark, d, "documents")))


@query(f"with {DOCS} {top('bm', order='score desc, id')}")
def bm25_search(spark, d):
    return rounded(text.bm25_search(table(spark, d, "documents"), text_queries(spark, d), K))


@query(f"with {DOCS}, ok as (select doc_id as id from documents where lang = 'en' and n_chars between 100 and 5000) {top('(select qid, id, score from bm join ok using (id))', order='score desc, id')}")
def bm25_filtered(spark, d):
    docs = table(spark, d, "documents")
    ok = flt.matching(docs, flt.Eq("lang", "en") & flt.Range("n_chars", 100, 5000)).select(F.col("doc_id").alias("id"))
    return rounded(text.bm25_search(docs, text_queries(spark, d), K, ok))


@query(f"with {DOCS} select qid, id from bm where score >= 60")
def bm25_min_score(spark, d):
    return text.bm25_min_score(table(spark, d, "documents"), text_queries(spark, d), 60)


@query(f"with {DOCS}, need as (select qid, count(*) as need from qt group by qid) select qid, id from qt join post using (term) join need using (qid) group by qid, id, need having count(*) = need")
def bm25_must_match(spark, d):
    return text.must_match(text.token_rows(table(spark, d, "documents")), text_queries(spark, d))


@query(f"with {DOCS} select (select n_docs from stat) as n_docs, round((select avgdl from stat), 6) as avg_length, count(distinct term) as n_terms, count(*) as n_postings from post")
def text_index_stats(spark, d):
    return text.index_stats(text.postings(table(spark, d, "documents"))).withColumn("avg_length", F.round("avg_length", 6))


# sparse vectors: components of the embeddings above 0.1 in size

SPARSE_PARTS = "sp as (select id, pos as dim, vector[pos + 1]::double as weight from (select *, unnest(range(len(vector))) as pos from v) where abs(vector[pos + 1]::double) > 0.1), sq as (select id as qid, dim, weight as w from sp where id % 100 = 0), sdot as (select qid, id, round(sum(weight * w), 9) as score from sp join sq using (dim) group by qid, id)"
SPARSE = f"{V}, {SPARSE_PARTS}"


def sparse_rows(spark, d):
    return sparse.from_dense(vectors(spark, d), 0.1)


def sparse_arrays(spark, d):
    return sparse.arrays_from_dense(vectors(spark, d), 0.1)


def sparse_queries(spark, d):
    return sparse_rows(spark, d).where("id % 100 = 0").withColumnRenamed("id", "qid")


@query("select entry_no, coalesce(len(doc_ids) = len(term_freqs) and list_bool_and(list_transform(range(1, len(doc_ids)), lambda i: coalesce(doc_ids[i + 1] > doc_ids[i], false))) is not false, false) as valid from term_entries")
def sparse_validate(spark, d):
    return table(spark, d, "term_entries").select("entry_no", sparse.is_valid(F.col("doc_ids"), F.col("term_freqs")).alias("valid"))


@query("""
    with p as (
      select index_id, lower(trim(term)) as term, entry_no, i, doc_ids[i + 1] as dim, term_freqs[i + 1] as f
      from (select *, unnest(range(least(len(doc_ids), len(term_freqs)))) as i from term_entries)
      where doc_ids[i + 1] is not null and term_freqs[i + 1] is not null),
    last as (select entry_no, dim, arg_max(f, i) as f from p group by all)
    select entry_no as id, count(*) as nnz, max(dim) as max_dim, round(sqrt(sum(f::double * f)), 6) as norm from last where f <> 0 group by entry_no""")
def sparse_from_pairs(spark, d):
    """Each row of term_entries as a sparse vector of frequencies, its size, largest index and norm."""
    rows = table(spark, d, "term_entries").dropDuplicates(["entry_no"])
    return sparse.norms(sparse.from_pairs(rows, "entry_no", "doc_ids", "term_freqs")).withColumn("norm", F.round("norm", 6))


@query(f"with {SPARSE} select id, dim, round(weight, 6) as weight from sp")
def sparse_from_dense(spark, d):
    return sparse_rows(spark, d).select("id", F.col("dim").cast("bigint").alias("dim"), F.round("weight", 6).alias("weight"))


@query(f"with {SPARSE} select qid, id, round(score, 6) + 0.0 as score from sdot")
def sparse_dot(spark, d):
    return sparse.dot(sparse_rows(spark, d), sparse_queries(spark, d)).select("qid", "id", (F.round("score", 6) + 0.0).alias("score"))


@query(f"with {SPARSE} select id, count(*) as nnz, max(dim) as max_dim, round(sqrt(sum(weight * weight)), 6) as norm from sp group by id")
def sparse_norms(spark, d):
    return sparse.norms(sparse_rows(spark, d)).select("id", "nnz", F.col("max_dim").cast("bigint").alias("max_dim"), F.round("norm", 6).alias("norm"))


@query(f"with {SPARSE} {top('sdot', order='score desc, id')}")
def sparse_search(spark, d):
    return rounded(sparse.search(sparse_arrays(spark, d), sparse_queries(spark, d), K))


@query(f"with {SPARSE}, {META} {top('(select sdot.* from sdot join meta using (id) where size > 20)', order='score desc, id')}")
def sparse_search_filtered(spark, d):
    return rounded(sparse.search(sparse_arrays(spark, d), sparse_queries(spark, d), K, payload(spark, d).where("size > 20")))


@query(f"with {SPARSE} select count(distinct id) as n_vectors, count(distinct dim) as n_dims, count(*) as n_postings, round(count(*) / count(distinct id), 6) as avg_nnz from sp")
def sparse_stats(spark, d):
    return sparse.stats(sparse_rows(spark, d)).withColumn("avg_nnz", F.round("avg_nnz", 6))


# fusion of the two rankings of every query of hybrid_results

SCALED_PARTS = """la as (select qid, min(score) as lo, max(score) as hi from a group by qid),
  lb as (select qid, min(score) as lo, max(score) as hi from b group by qid),
  sa as (select a.qid, a.id, score, lo, hi from a join la on a.qid = la.qid),
  sb as (select b.qid, b.id, score, lo, hi from b join lb on b.qid = lb.qid),
  pairs_ as (select coalesce(sa.qid, sb.qid) as qid, coalesce(sa.id, sb.id) as id, sa.score as a, sa.lo as a_lo, sa.hi as a_hi, sb.score as b, sb.lo as b_lo, sb.hi as b_hi
    from sa full outer join sb on sa.qid = sb.qid and sa.id = sb.id)"""
SCALED = f"{RANKINGS}, {SCALED_PARTS}"


@query(f"with {SCALED} {top('(select qid, id, round(0.6 * coalesce(1 - (a - a_lo) / greatest(a_hi - a_lo, 1e-6), 0) + 0.4 * coalesce((b - b_lo) / greatest(b_hi - b_lo, 1e-6), 0), 9) as score from pairs_)', order='score desc, id')}")
def hybrid_weighted(spark, d):
    a, b = rankings(spark, d)
    return rounded(fusion.weighted(a, b, 0.6, K))


RRF = f"""{RANKINGS},
  ranks as (
    select qid, id, {{wa}} / (60 + row_number() over (partition by qid order by score, id)) as part from a
    union all select qid, id, {{wb}} / (60 + row_number() over (partition by qid order by score desc, id)) from b),
  fused as (select qid, id, round(sum(part), 9) as score from ranks group by qid, id)"""


@query(f"with {RRF.format(wa='1.0::double', wb='1.0::double')} {top('fused', order='score desc, id', digits=9)}")
def hybrid_rrf(spark, d):
    a, b = rankings(spark, d)
    return fusion.rrf([(a, True, 1.0), (b, False, 1.0)], K)


@query(f"with {RRF.format(wa='0.7::double', wb='0.3::double')} {top('fused', order='score desc, id', digits=9)}")
def fuse_dense_sparse_rrf(spark, d):
    a, b = rankings(spark, d)
    return fusion.dense_sparse("reciprocal_rank_fusion", a, b, K, 0.7, 0.3)


_FW = "round(0.5 * case when a_hi > a_lo then (a_hi - a) / (a_hi - a_lo) when a is not null then 1 else 0 end + 0.5 * case when b_hi > b_lo then (b - b_lo) / (b_hi - b_lo) when b is not null then 1 else 0 end, 9)"


@query(f"with {SCALED} {top(f'(select qid, id, {_FW} as score from pairs_)', order='score desc, id')}")
def fuse_dense_sparse_weighted(spark, d):
    a, b = rankings(spark, d)
    return rounded(fusion.dense_sparse("linear", a, b, K))


@query(f"with {SCALED} {top('(select qid, id, round(greatest(case when a is not null and a_hi > 0 then 1 - a / a_hi else 0 end, case when b is not null and b_hi > 0 then b / b_hi else 0 end), 9) as score from pairs_)', order='score desc, id')}")
def fuse_dense_sparse_max(spark, d):
    a, b = rankings(spark, d)
    return rounded(fusion.dense_sparse("max", a, b, K))


@query(f"""with {COLL}, {DEAD}, {DOCS},
  s as ({near_sql('cosine', 'id not in (select id from dead)')}), vr as (select * from ({top('s', 2 * K, digits=9)})),
  tr as (select * from ({top('(select bm.qid, bm.id, bm.score from bm where id not in (select id from dead))', 2 * K, order='score desc, id', digits=9)})),
  parts as (select qid, id, 1 / (60 + rank::double) as part from vr union all select qid, id, 1 / (60 + rank::double) from tr)
  {top('(select qid, id, round(sum(part), 9) as score from parts group by qid, id)', order='score desc, id', digits=9)}""")
def hybrid_filtered(spark, d):
    """Vectors and texts under one id: twice k candidates of each without the deleted ones, fused by ranks."""
    dead = tombstones(spark, d)
    near = knn.knn_join(flt.active(vectors(spark, d), dead), queries(spark, d), 2 * K, "cosine")
    docs = table(spark, d, "documents")
    alive = flt.active(docs.select(F.col("doc_id").alias("id")), dead)
    best = text.bm25_search(docs, text_queries(spark, d), 2 * K, alive)
    return fusion.rrf([(near.select("qid", "id", "score"), True, 1.0), (best.select("qid", "id", "score"), False, 1.0)], K)


@query(f"""with {COLL}, {SPARSE_PARTS}, s as ({near_sql()}),
  a as (select qid, id, score from ({top('s', 3 * K, digits=9)})), b as (select qid, id, score from ({top('sdot', 3 * K, order='score desc, id', digits=9)})),
  {SCALED_PARTS} {top(f'(select qid, id, {_FW} as score from pairs_)', order='score desc, id')}""")
def hybrid_dense_sparse(spark, d):
    """Dense and sparse search of the same queries, three times k candidates each."""
    near = knn.knn_join(vectors(spark, d), queries(spark, d), 3 * K)
    best = sparse.search(sparse_arrays(spark, d), sparse_queries(spark, d), 3 * K)
    return rounded(fusion.dense_sparse("weighted", near.select("qid", "id", "score"), best.select("qid", "id", "score"), K))


# queries of several vectors: those of one label together

MULTI = f"{COLL}, s as ({near_sql()}), n as ({top('s', 2 * K, digits=9)}), g as (select id as qid, label as gid, 1.0::double / (1 + id % 7) as weight from v where id % 100 = 0)"


def multi_input(spark, d):
    near = knn.knn_join(vectors(spark, d), queries(spark, d), 2 * K)
    groups = vectors(spark, d).where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("label").cast("bigint").alias("gid"), (1.0 / (1 + F.col("id") % 7)).alias("weight"))
    return near, groups


for _n, _method, _agg, _order, _weighted in (
    ("multi_sum", "sum", "sum(score)", "desc", False),
    ("multi_weighted", "sum", "sum(score * weight)", "desc", True),
    ("multi_max", "max", "max(score)", "desc", False),
    ("multi_min", "min", "min(score)", "asc", False),
    ("multi_avg", "avg", "avg(score)", "asc", False),
    ("multi_rrf", "rrf", "sum(1.0::double / (60 + rank))", "desc", False),
):

    def _multi(spark, d, method=_method, weighted=_weighted):
        near, groups = multi_input(spark, d)
        groups = groups if weighted else groups.withColumn("weight", F.lit(1.0))
        return fusion.multi(near, groups, method, K).select("qid", "id", F.round("score", 8).alias("score"), "query_matches", "rank")

    query(f"with {MULTI}, f as (select gid::bigint as qid, id, round({_agg}, 9) as score, count(*) as query_matches from n join g using (qid) group by gid, id) select qid, id, round(score, 8) as score, query_matches, rank from (select *, row_number() over (partition by qid order by score {_order}, id) as rank from f) where rank <= {K}", _n)(_multi)


@query(f"with {MULTI}, m as (select gid, qid from g), e as (select distinct gid, id from n join g using (qid)), c as (select e.gid, e.id, m.qid, n.score from e join m using (gid) left join n on n.qid = m.qid and n.id = e.id) select gid::bigint as qid, id, count(score) as query_matches, string_agg(coalesce(round(score * 1e6)::bigint::varchar, '-'), ',' order by c.qid) as scores from c group by gid, id")
def multi_per_query_scores(spark, d):
    near, groups = multi_input(spark, d)
    return fusion.per_query_scores(near, groups)
