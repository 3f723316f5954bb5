"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from . import clusters, distinctive, leakage, mojibake, neighbours, ranking, tokens
from .vectors import usable


def p1_found(spark, d):
    return clusters.cluster_members(table(spark, d, "upserts"), table(spark, d, "collection_config"), table(spark, d, "codebooks"))


def p1_clusters(spark, d):
    """Each cluster of vectors with its size, radius and three most typical members."""
    found = clusters.members(usable(table(spark, d, "upserts"), table(spark, d, "collection_config")))
    return clusters.typical(found)


def p5_found(spark, d):
    return neighbours.similar_pairs(table(spark, d, "upserts"), table(spark, d, "collection_config"))


SCORES = [("vector_score", False), ("text_score", True), ("combined_score", True)]


def p4_found(spark, d):
    """Items among the first five places by every score, from the leaders of the walk."""
    return ranking.leaders(ranking.rank_walk(table(spark, d, "hybrid_results"), SCORES), 5, len(SCORES))


def p4_ranking(spark, d):
    """One ranking for each query, by the walk's weight; ties go to the smaller id."""
    return ranking.rank_walk(table(spark, d, "hybrid_results"), SCORES).select("query_id", "id", F.round("weight", 9).alias("weight"), "place")


def p6_found(spark, d):
    """Scored terms that are frequent in a document and rare in its index."""
    scored = distinctive.term_scores(table(spark, d, "term_entries"), least_tf=5, least_df=2, one_in=20)
    return scored.where(~F.isnan("llr")).select("index_id", "doc_id", "term")


def p6_scores(spark, d):
    """The log-likelihood ratio of every term of every document."""
    return distinctive.term_scores(table(spark, d, "term_entries"))


def p8_ids(spark, d):
    return tokens.encode(table(spark, d, "documents"))


def p9_found(spark, d):
    """Texts that hold at least twelve consecutive words of an item."""
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), similar=None)
    return found.where("exact").select("doc_id", "item_id")


def p9_similar(spark, d):
    """All leaks, with those whose window is only similar to one of the item."""
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "exact")


def p10_found(spark, d):
    return mojibake.damaged_texts(table(spark, d, "documents"))


def p10_restored(spark, d):
    """Damaged texts as they were, and what was done to them."""
    return mojibake.restored_texts(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_clusters, p4_found, p4_ranking, p5_found, p6_found, p6_scores, p8_ids, p9_found, p9_similar, p10_found, p10_restored)}

_USABLE = """
    usable as (
      select coll_name, id, vec, sqrt(list_sum(list_transform(vec, lambda x: x * x))) as norm from (
        select u.coll_name, u.id, list_transform(u.vector, lambda x: x::double) as vec,
          row_number() over (partition by u.id order by u.req_no desc) as rn
        from upserts u join collection_config c on u.coll_name = c.coll_name
        where u.vector is not null and len(u.vector) = c.dim
          and list_bool_and(list_transform(u.vector, lambda x: isfinite(x)))
          and list_bool_or(list_transform(u.vector, lambda x: x <> 0))) where rn = 1),
    sims as (
      select a.id as id_a, b.id as id_b,
        round(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: z[1] * z[2])) / (a.norm * b.norm), 12) as sim
      from usable a join usable b on a.coll_name = b.coll_name and a.id < b.id),
    linked as (
      select id_a, id_b, sim from sims where sim >= 0.8 union all select id_b, id_a, sim from sims where sim >= 0.8)"""

_PLACE = """case when {c} is not null and not isnan({c}) then
              rank() over (partition by query_id, ({c} is not null and not isnan({c})) order by {sign}{c}) end"""

_TERMS = """
        with occ as (
          select index_id, term, doc_id, max(tf)::bigint as tf from (
            select index_id, lower(trim(term, ' \t\n\r\u00a0')) as term,
              unnest(doc_ids[:least(len(doc_ids), len(term_freqs))]) as doc_id,
              unnest(term_freqs[:least(len(doc_ids), len(term_freqs))]) as tf
            from term_entries where index_id is not null)
          where doc_id is not null and tf > 0 and term <> '' group by all),
        terms as (select index_id, term, count(*) as df, sum(tf)::double as term_total from occ group by all),
        docs as (select index_id, doc_id, sum(tf)::double as doc_total from occ group by all),
        idx as (select index_id, count(*) as n_docs, sum(doc_total) as total from docs group by all),
        scored as (select * from occ join terms using (index_id, term) join docs using (index_id, doc_id) join idx using (index_id))"""

_XLOG = "(case when {0} > 0 then {0} * ln({0} / total) else 0 end)"

SQL = {
    "p1_found": f"""
        with recursive {_USABLE},
        reach as (
          select id_a as id, id_b as other from linked
          union select r.id, l.id_b from reach r join linked l on r.other = l.id_a),
        roots as (select id, least(id, min(other)) as root from reach group by id),
        codes as (
          select codebook_id * 1000 + i as id, codebook_id, c from (
            select codebook_id, subvector_dim, unnest(centroids) as c, unnest(range(len(centroids))) as i from codebooks)
          where len(c) = subvector_dim and list_bool_and(list_transform(c, lambda x: isfinite(x)))
            and list_bool_or(list_transform(c, lambda x: x <> 0))),
        close as (
          select a.id as id_a, b.id as id_b from codes a join codes b on a.codebook_id = b.codebook_id and a.id <> b.id
          where list_sum(list_transform(list_zip(a.c, b.c), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double))) <= 0.05 * 0.05),
        code_reach as (
          select id_a as id, id_b as other from close
          union select r.id, c.id_b from code_reach r join close c on r.other = c.id_a),
        code_roots as (select id, least(id, min(other)) as root from code_reach group by id),
        every as (select 'vector' as member_kind, id, root from roots union all select 'codebook', id, root from code_roots)
        select member_kind, id as member_id, root as cluster_id from every
        qualify count(*) over (partition by member_kind, root) >= 3""",
    "p1_clusters": f"""
        with recursive {_USABLE},
        reach as (
          select id_a as id, id_b as other from linked
          union select r.id, l.id_b from reach r join linked l on r.other = l.id_a),
        roots as (select id, least(id, min(other)) as cluster_id from reach group by id),
        mem as (select cluster_id, u.id, list_transform(vec, lambda x: x / norm) as u from roots join usable u using (id)),
        sized as (select cluster_id, count(*) as size from mem group by cluster_id having count(*) >= 3),
        comp as (
          select cluster_id, pos, avg(x) as x from (
            select cluster_id, unnest(range(len(u))) as pos, unnest(u) as x from mem join sized using (cluster_id)) group by all),
        means as (select cluster_id, list(x order by pos) as mean, sqrt(sum(x * x)) as length from comp group by cluster_id),
        scored as (
          select cluster_id, size, round(sqrt(greatest(0.0, 1 - length * length)), 6) as radius, id,
            round(list_sum(list_transform(list_zip(u, mean), lambda z: z[1] * z[2])) / greatest(length, 1e-300), 6) as sim
          from mem join sized using (cluster_id) join means using (cluster_id))
        select * from (select *, row_number() over (partition by cluster_id order by sim desc, id) as place from scored) where place <= 3""",
    "p5_found": f"""
        with {_USABLE},
        best as (select id_a, id_b from linked qualify row_number() over (partition by id_a order by sim desc, id_b) <= 5)
        select distinct least(id_a, id_b) as id_a, greatest(id_a, id_b) as id_b from best""",
    "p4_found": f"""
        with latest as (
          select * from hybrid_results where query_id is not null and id is not null
          qualify row_number() over (partition by query_id, id order by scored_at desc nulls last) = 1),
        places as (
          select query_id, id,
            {_PLACE.format(c="vector_score", sign="")} as p0,
            {_PLACE.format(c="text_score", sign="-")} as p1,
            {_PLACE.format(c="combined_score", sign="-")} as p2
          from latest)
        select query_id, id from places where p0 <= 5 and p1 <= 5 and p2 <= 5""",
    "p4_ranking": """
        with recursive latest as (
          select query_id, id, vector_score, text_score, combined_score from hybrid_results where query_id is not null and id is not null
          qualify row_number() over (partition by query_id, id order by scored_at desc nulls last) = 1),
        vals as (
          select query_id, id, unnest([0, 1, 2]) as j,
            unnest([case when isnan(vector_score) then null else vector_score end, case when isnan(text_score) then null else -text_score end, case when isnan(combined_score) then null else -combined_score end]) as v
          from latest),
        sizes as (select query_id, count(*) as n from latest group by query_id),
        up as (select a.query_id, a.id as a, b.id as b, a.j from vals a join vals b on a.query_id = b.query_id and a.j = b.j where b.v is not null and (a.v is null or b.v < a.v)),
        deg as (select query_id, a, j, count(*) as c from up group by all),
        move as (
          select query_id, a, b, sum(p) as p from (
            select query_id, a, b, 1.0::double / 3 / c as p from up join deg using (query_id, a, j)
            union all select v.query_id, v.id, v.id, case when c is null then 1.0::double / 3 else 0 end from vals v left join deg d on d.query_id = v.query_id and d.a = v.id and d.j = v.j)
          group by all),
        walk as (
          select 0 as t, query_id, id, 1.0::double / n as w, n from latest join sizes using (query_id)
          union all
          select any_value(t) + 1, walk.query_id, b, 0.25 / any_value(n) + 0.75 * sum(w * p), any_value(n)
          from walk join move on move.query_id = walk.query_id and a = id where t < 128 group by walk.query_id, b),
        last as (select query_id, id, n, round(w * n, 9) as s from walk where t = 128)
        select query_id, id, round(s / n, 9) as weight, row_number() over (partition by query_id order by s desc, id) as place from last""",
    "p6_found": _TERMS + """
        select index_id, doc_id, term from scored where tf >= 5 and df >= 2 and df * 20 <= n_docs""",
    "p6_scores": _TERMS + f"""
        select index_id, doc_id, term, tf, df, n_docs,
          round(case when tf * total >= doc_total * term_total then 1.0 else -1.0 end * greatest(0.0, 2 * (
            {" + ".join(map(_XLOG.format, ("tf", "(doc_total - tf)", "(term_total - tf)", "(total - doc_total - term_total + tf)")))}
            - {" - ".join(map(_XLOG.format, ("doc_total", "(total - doc_total)", "term_total", "(total - term_total)")))})), 6) + 0.0 as llr
        from scored""",
    "p9_found": r"""
        with texts as (
          select 'd' as kind, doc_id as id, text as t from documents where text is not null
          union all select 'i', item_id, question from eval_items where question is not null
          union all select 'i', item_id, answer from eval_items where answer is not null),
        words as (
          select kind, id, regexp_extract_all(nfc_normalize(lower(nfc_normalize(regexp_replace(t, '[\x{00ad}\x{200b}-\x{200f}\x{2060}-\x{206f}\x{fe00}-\x{fe0f}\x{feff}]', '', 'g')))), '[\p{L}\p{M}\p{N}]+') as w
          from texts),
        grams as (
          select distinct kind, id, array_to_string(w[i + 1 : i + 12], ' ') as g
          from (select *, unnest(range(len(w) - 11)) as i from words where len(w) >= 12))
        select distinct d.id as doc_id, i.id as item_id from grams d join grams i using (g) where d.kind = 'd' and i.kind = 'i'""",
}
