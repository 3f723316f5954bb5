"""How distinctive a term is for a record: the log-likelihood ratio of a two-by-two table.

The table counts the term and all other terms, in the record and in the remaining collection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, guarded_join, skew_join


def occurrences(entries: DataFrame) -> DataFrame:
    """(index_id, term, doc_id, tf): every term of every document once, with its largest frequency.

    Terms are lower-case without outer white space. An occurrence needs a doc id and a frequency > 0 at the
    same position, so the longer of two unequal arrays loses its end. Null or blank terms, null indexes and
    null arrays give nothing. Repeated postings of a hot term are combined before the shuffle.
    """
    term = F.lower(F.regexp_replace("term", r"^[\s\u00a0]+|[\s\u00a0]+$", ""))
    rows = entries.where("index_id is not null and doc_ids is not null and term_freqs is not null")
    rows = rows.select("index_id", term.alias("term"), F.explode(F.arrays_zip("doc_ids", "term_freqs")).alias("o"))
    rows = rows.select("index_id", "term", F.col("o.doc_ids").alias("doc_id"), F.col("o.term_freqs").alias("tf"))
    rows = rows.where("term <> '' and doc_id is not null and tf > 0")
    return rows.groupBy("index_id", "term", "doc_id").agg(F.max("tf").cast("long").alias("tf"))


def log_likelihood(k11: Column, k12: Column, k21: Column, k22: Column) -> Column:
    """Twice the log-likelihood ratio of the table, never below 0; a cell of 0 adds nothing."""
    def h(*cells):
        total = sum(cells[1:], cells[0])
        parts = [F.when(c > 0, c * F.ln(c / total)).otherwise(0.0) for c in cells]
        return sum(parts[1:], parts[0])

    return F.greatest(F.lit(0.0), 2 * (h(k11, k12, k21, k22) - h(k11 + k12, k21 + k22) - h(k11 + k21, k12 + k22)))


def term_scores(entries: DataFrame, least_tf: int = 1, least_df: int = 1, one_in: int = 1) -> DataFrame:
    """(index_id, doc_id, term, tf, df, n_docs, llr): the score of each term of each document of an index.

    ``llr`` is positive where the term is more frequent in the document than in the rest, negative where it is
    rarer. A document that is the whole index has no rest and scores 0. Statistics are of all documents; the
    limits (least frequency in the document, least number of documents, at most one in so many of the index's
    documents) only choose rows.
    """
    occ = cut(occurrences(entries))  # read four times
    terms = occ.groupBy("index_id", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("term_total"))
    docs = cut(occ.groupBy("index_id", "doc_id").agg(F.sum("tf").alias("doc_total"), F.count("*").alias("doc_terms")))
    indexes = docs.groupBy("index_id").agg(F.count("*").alias("n_docs"), F.sum("doc_total").alias("total"))
    terms = guarded_join(terms, indexes, ["index_id"], spread=F.col("term"))
    terms = terms.where((F.col("df") >= least_df) & (F.col("df") * one_in <= F.col("n_docs")))
    # a term of very many documents, or a document of very many terms, must not meet in one task
    rows = skew_join(occ.where(F.col("tf") >= least_tf), cut(terms), ["index_id", "term"], "df")
    rows = skew_join(rows, docs, ["index_id", "doc_id"], "doc_terms")
    k11 = F.col("tf").cast("double")
    k12, k21 = F.col("doc_total") - k11, F.col("term_total") - k11
    k22 = F.col("total") - k11 - k12 - k21
    sign = F.when(k11 * F.col("total") >= F.col("doc_total").cast("double") * F.col("term_total"), 1.0).otherwise(-1.0)
    llr = F.round(sign * log_likelihood(k11, k12, k21, k22), 6) + 0.0
    return rows.select("index_id", "doc_id", "term", "tf", "df", "n_docs", llr.alias("llr"))
