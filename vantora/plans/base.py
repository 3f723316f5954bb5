"""How the operators' inputs are read from the tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table

K = 10


def vectors(spark, d):
    """(id, vector, label) of the embeddings."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def queries(spark, d):
    """The stated query set: every vector whose id is divisible by 100."""
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


def payload(spark, d):
    """(id, brand, kind, name, size, price) of the parts, as metadata of the vectors."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))


def collection(spark, d):
    return vectors(spark, d).join(payload(spark, d), "id", "left")


def tombstones(spark, d):
    """Deleted ids: the vectors of one label."""
    return table(spark, d, "embeddings").where("label = 3").select(F.col("vec_id").alias("id"))


def text_queries(spark, d):
    """Every text whose id is divisible by 100, as a query."""
    return table(spark, d, "documents").where("doc_id % 100 = 0 and text is not null").select(F.col("doc_id").alias("qid"), F.col("text").alias("query"))


def rankings(spark, d):
    """Two rankings of each query of hybrid_results: (qid, id, score) by distance and by text score."""
    rows = table(spark, d, "hybrid_results").where("query_id is not null and id is not null")
    last = rows.groupBy("query_id", "id").agg(F.max_by(F.struct("vector_score", "text_score"), "scored_at").alias("r"))

    def one(c):
        return last.select(F.col("query_id").alias("qid"), "id", F.col(f"r.{c}").alias("score")).where(F.col("score").isNotNull() & ~F.isnan("score"))

    return one("vector_score"), one("text_score")


def zsum(a, b, term):
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: {term}))"


def dot(a, b):
    return zsum(a, b, "z[1]::double * z[2]::double")


def l2sq(a, b):
    return zsum(a, b, "(z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)")


def l2(a, b):
    return f"sqrt({l2sq(a, b)})"


def cosine(a, b):
    return f"(1 - {dot(a, b)} / sqrt({dot(a, a)} * {dot(b, b)}))"


V = "v as (select vec_id as id, embedding as vector, label from embeddings)"
Q = "q as (select vec_id as qid, embedding as qvec from embeddings where vec_id % 100 = 0)"
META = "meta as (select p_partkey as id, p_brand as brand, p_type as kind, p_name as name, p_size as size, p_retailprice as price from part)"
COLL = f"{V}, {Q}, {META}, coll as (select * from v left join meta using (id))"
DEAD = "dead as (select vec_id as id from embeddings where label = 3)"
RANKINGS = """
  latest as (
    select query_id as qid, id, vector_score, text_score from hybrid_results where query_id is not null and id is not null
    qualify row_number() over (partition by query_id, id order by scored_at desc nulls last) = 1),
  a as (select qid, id, vector_score as score from latest where vector_score is not null and not isnan(vector_score)),
  b as (select qid, id, text_score as score from latest where text_score is not null and not isnan(text_score))"""
DOCS = r"""
  toks as (
    select doc_id as id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: strlen(t) > 1)) as term
    from documents where doc_id is not null),
  post as (select id, term, count(*) as tf from toks group by all),
  len as (select id, sum(tf)::bigint as dl from post group by id),
  stat as (select count(*) as n_docs, avg(dl) as avgdl from len),
  df as (select term, count(*) as df from post group by term),
  qt as (select id as qid, term, count(*) as n from toks where id % 100 = 0 group by all),
  bm as (
    select qid, id, round(sum(n * ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) as score, count(*) as matched
    from qt join post using (term) join df using (term) join len using (id) cross join stat group by qid, id)"""


def top(source, k=K, order="score, id", by="qid", digits=6, extra=""):
    """SQL: the best k of each query with their rank."""
    return f"""select qid, id, round(score, {digits}) as score, rank from (
        select *, row_number() over (partition by {by} order by {order}) as rank from {source}) where rank <= {k} {extra}"""


def rounded(df, digits=6):
    """(qid, id, score, rank) with the score rounded for output."""
    return df.select("qid", "id", F.round("score", digits).alias("score"), "rank")
