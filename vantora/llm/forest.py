"""Hash-prefix forest: in each tree the vectors of a group lie sorted by a long hash string.

A vector's hash string in a tree is the sides it takes of that tree's hyperplanes. In the sorted array of a
tree the rows that share a prefix lie side by side. From the full string every row ascends to shorter
prefixes until the rows below that prefix would exceed the candidate budget; this is done for all rows at
once, in every tree to the same budget. The arrays are range partitioned by group, tree, hash string and id,
so neither a large group nor many equal strings can fill one task, and each task streams its slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import task_count
from .vectors import lists_to_matrices, pack, unit, unpack

#: Trees of the forest, bits of a hash string, and candidates a row is compared with in each tree.
TREES, BITS, BUDGET = 10, 48, 2048
#: Cuts through equal strings share one row in so many with the cut before, so that a cluster is not cut with them.
OVERLAP = 8
#: Rows of a slice that a task holds at once.
BUFFER = 32_768
SEED = 20250101


def planes(dim: int, trees: int = TREES, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """Hyperplane normals (dim, trees * bits), orthogonal in runs of ``dim``."""
    rng = np.random.default_rng(seed + dim)
    runs = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-trees * bits // dim))]
    return np.concatenate(runs, axis=1)[:, : trees * bits].astype(np.float32)


def hash_strings(matrix: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """Hash strings of unit rows as integers (rows, trees), first bit highest."""
    sides = (matrix.astype(np.float32) @ planes(matrix.shape[1], trees, bits, seed) > 0).reshape(len(matrix), trees, bits)
    return sides @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))


def _hashed(trees: int, bits: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            grp, rep = (np.asarray(b.column(n)) for n in ("grp", "rep"))
            for at, m in lists_to_matrices(b.column("vector")):
                hashes, packed = hash_strings(unit(m), trees, bits, seed), pack(m)
                for t in range(trees):
                    cols = [pa.array(grp[at]), pa.array(np.full(len(at), t, np.int32)), pa.array(hashes[:, t]), pa.array(rep[at]), packed, pa.array(np.full(len(at), m.shape[1], np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, names=["grp", "tree", "h", "rep", "vec", "dim"])

    return run


def prefix_blocks(h: np.ndarray, budget: int, bits: int = BITS, overlap: int = 0) -> list[tuple[int, int]]:
    """Cuts of a sorted hash array: longest prefixes whose rows fit the budget, small neighbours joined.

    Rows whose full strings agree and exceed the budget are cut in the order they have, and each cut shares
    ``overlap`` rows with the one before.
    """
    leaves, stack = [], [(0, len(h), bits - 1)]
    while stack:
        lo, hi, bit = stack.pop()
        if hi - lo <= budget:
            if hi > lo:
                leaves.append((lo, hi))
        elif bit < 0:
            leaves += [(i, min(i + budget, hi)) for i in range(lo, hi - overlap, budget - overlap)]
        else:
            mid = lo + int(np.searchsorted(h[lo:hi] >> bit & 1, 1))
            stack += [(mid, hi, bit - 1), (lo, mid, bit - 1)]
    out: list[tuple[int, int]] = []
    for lo, hi in leaves:
        if out and hi - out[-1][0] <= budget:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def _blocks(work: Callable[[np.ndarray, np.ndarray], pa.RecordBatch | None], budget: int, bits: int):
    def flush(parts: list[pa.RecordBatch], last: bool):
        t = pa.Table.from_batches(parts).combine_chunks()
        rep, h, dim = t["rep"].to_numpy(), t["h"].to_numpy(), t["dim"][0].as_py()
        m = unit(unpack(t["vec"].chunk(0), dim))
        cuts = prefix_blocks(h, budget, bits, budget // OVERLAP)
        keep = [] if last else [t.slice(cuts[-1][0]).to_batches()[0]]
        return keep, [work(rep[lo:hi], m[lo:hi]) for lo, hi in (cuts if last else cuts[:-1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        key = None
        for b in batches:
            if not b.num_rows:
                continue
            # a column of a group's rows: cut the batch where group, tree or dimension changes
            cols = [np.asarray(b.column(n)) for n in ("grp", "tree", "dim")]
            edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            for lo, hi in zip(np.r_[0, edges], np.r_[edges, b.num_rows]):
                now = tuple(int(c[lo]) for c in cols)
                if parts and now != key:
                    _, found = flush(parts, True)
                    yield from (f for f in found if f is not None)
                    parts = []
                key = now
                parts.append(b.slice(lo, hi - lo))
                if sum(p.num_rows for p in parts) >= BUFFER:
                    parts, found = flush(parts, False)
                    yield from (f for f in found if f is not None)
        if parts:
            _, found = flush(parts, True)
            yield from (f for f in found if f is not None)

    return run


def over_blocks(vectors: DataFrame, rows: int, work, schema: str, trees: int = TREES, budget: int = BUDGET, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """Applies ``work(ids, unit rows)`` to every candidate block of every tree.

    ``vectors``: grp, rep (unique within grp), vector; ``rows``: about how many. ``work`` returns a record batch of ``schema`` or None.
    """
    hashed = vectors.select("grp", "rep", "vector").mapInArrow(_hashed(trees, bits, seed), "grp long, tree int, h long, rep long, vec binary, dim int")
    parts = task_count(vectors.sparkSession, rows * trees, 131_072)
    order = ["grp", "tree", "dim", "h", "rep"]
    return hashed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_blocks(work, budget, bits), schema)
