"""Distances of whole query blocks, by matrix products."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settled
from .knn import QUERY_BLOCK, score_matrix


def distance_table(vectors: DataFrame, queries: DataFrame, digits: int = 6, block: int = QUERY_BLOCK) -> DataFrame:
    """(qid, id, l2_squared, dot, cosine) of a stated query set against all vectors, in blocks of queries.

    Values are rounded to ``digits``. Vectors of another length than the query are left out, as are nulls.
    """
    given = queries.where("qid is not null and qvec is not null").select("qid", "qvec")
    blocks = max(1, math.ceil(given.count() / block))
    base = vectors.where("id is not null and vector is not null").select("id", "vector")
    out = None
    for i in range(blocks):
        rows = given.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i).collect()  # about `block` queries

        def run(batches, rows=rows):
            for b in batches:
                ids, column = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
                lengths = np.asarray(column.value_lengths().fill_null(0))
                flat, starts = np.asarray(column.flatten(), np.float64), np.r_[0, np.cumsum(lengths)]
                for n in {len(r.qvec) for r in rows}:
                    own = [r for r in rows if len(r.qvec) == n]
                    at = np.flatnonzero(lengths == n)
                    for lo in range(0, len(at), 1_024):
                        part = at[lo : lo + 1_024]
                        m, q = flat[starts[part][:, None] + np.arange(n)], np.array([r.qvec for r in own], np.float64)
                        cols = [np.repeat([r.qid for r in own], len(part)), np.tile(ids[part], len(own))]
                        cols += [np.round(s * score_matrix(m, q, k).ravel(), digits) + 0.0 for s, k in ((1, "l2_squared"), (-1, "dot"), (1, "cosine"))]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["qid", "id", "l2_squared", "dot", "cosine"])

        found = settled(base.mapInArrow(run, "qid long, id long, l2_squared double, dot double, cosine double"), blocks)
        out = found if out is None else out.unionByName(found)
    return out
