"""Clusters of mutually similar vectors, by cluster features.

1. Every task builds trees of cluster features over its own rows, one for each group, of bounded size.
2. The leaves of the tasks' trees are merged in a tree of reductions until each group has one tree.
3. Ward's agglomeration joins the leaves of a group into regions of bounded population. A region that is still too
   large is built anew from its own rows.
4. One full pass assigns every row to its nearest region, and to others that are about as near.
5. Within a region the rows that have it as their nearest are compared exactly with all rows assigned to it. Links make
   clusters within regions, and shared members merge these across regions (connected components).
6. A last pass adds up the features of the clusters and finds the members nearest to each centroid.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, cut, is_small, skew_join, task_count
from .features import FeatureTree, ward
from .graph import components, join_labels
from .vectors import lists_to_matrices, pack, unit, unpack, usable, with_copies

#: Leaves of a task's tree and of a merged tree, leaves of all trees of a task, trees that one reduction merges.
LEAVES, MERGED_LEAVES, TASK_LEAVES, FAN = 256, 512, 65_536, 16
#: Rows of a group that a task gathers before they enter its tree.
GATHER = 1_024
#: Rows of a region that Ward's agglomeration may join, and times that more for a region to be built anew.
REGION, OVERSIZE = 2_048, 4
#: Regions of a row at most, and standard deviations within which a region counts as about as near as the nearest:
#: for a random direction the cosines to two regions differ from a partner's by reach * sqrt(2 / dim).
REGIONS, DEVIATIONS = 8, 3.0
#: Times that regions are built anew.
DEPTH = 4
LEAF = "grp long, dim int, part int, n double, ls array<float>, ss double"
PLACE = "grp long, dim int, region int, n double, centre array<float>"
KEY = ["grp", "dim", "region"]
PLACED = "grp long, dim int, region int, chunk int, rep long, main boolean, crowd boolean, vec binary"


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows, np.float32).ravel()))


def _grow(most: int):
    """Trees over a task's rows (grp, rep, vector); their leaves as features."""

    def leaves(grp: int, tree: FeatureTree, part: int) -> pa.RecordBatch:
        n, dim = len(tree), tree.ls.shape[1]
        cols = [np.full(n, grp, np.int64), np.full(n, dim, np.int32), np.full(n, part, np.int32), tree.n]
        return pa.RecordBatch.from_arrays([*map(pa.array, cols), _lists(tree.ls), pa.array(tree.ss)], names=["grp", "dim", "part", "n", "ls", "ss"])

    def run(batches):
        part = TaskContext.get().partitionId()
        trees: dict[tuple[int, int], FeatureTree] = {}
        waiting: dict[tuple[int, int], list[np.ndarray]] = {}

        def enter(key) -> None:
            trees.setdefault(key, FeatureTree(key[1], most)).add_rows(np.concatenate(waiting.pop(key)))

        for b in batches:
            grp = np.asarray(b.column("grp"))
            for at, m in lists_to_matrices(b.column("vector")):
                own = grp[at]
                for g in np.unique(own):
                    key = (int(g), m.shape[1])
                    waiting.setdefault(key, []).append(unit(m[own == g]))
                    if sum(map(len, waiting[key])) >= GATHER:
                        enter(key)
            # leaves merge later as well as now, so full trees can be given away at any time
            if sum(len(x) for w in waiting.values() for x in w) > TASK_LEAVES:
                for key in list(waiting):
                    enter(key)
            while sum(map(len, trees.values())) > TASK_LEAVES:
                key = max(trees, key=lambda k: len(trees[k]))
                yield leaves(key[0], trees.pop(key), part)
        for key in list(waiting):
            enter(key)
        for key, tree in trees.items():
            yield leaves(key[0], tree, part)

    return run


def _merged(table: pa.Table, most: int) -> tuple[FeatureTree, int, int]:
    table = table.combine_chunks()
    dim = table["dim"][0].as_py()
    n, ss = table["n"].to_numpy(), table["ss"].to_numpy()
    ls = np.asarray(table["ls"].chunk(0).flatten(), np.float64).reshape(-1, dim)
    order = np.lexsort((ls[:, 0], -n))  # the same tree in whatever order the leaves come
    tree = FeatureTree(dim, most)
    tree.add(n[order], ls[order], ss[order])
    return tree, table["grp"][0].as_py(), dim


def _reduce(most: int):
    def run(table: pa.Table) -> pa.Table:
        tree, grp, dim = _merged(table, most)
        k, part = len(tree), table["part"][0].as_py() // FAN
        cols = [np.full(k, grp, np.int64), np.full(k, dim, np.int32), np.full(k, part, np.int32), tree.n]
        return pa.table([*map(pa.array, cols), _lists(tree.ls), pa.array(tree.ss)], names=["grp", "dim", "part", "n", "ls", "ss"])

    return run


def _agglomerate(most: int, region: int):
    """The last reduction of a group and Ward's agglomeration of its leaves."""

    def run(table: pa.Table) -> pa.Table:
        tree, grp, dim = _merged(table, most)
        label = ward(tree.n, tree.ls / tree.n[:, None], region)
        k = int(label.max()) + 1
        sums = np.zeros((k, dim))
        np.add.at(sums, label, tree.ls)
        n = np.bincount(label, tree.n, k)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        cols = [np.full(k, grp, np.int64), np.full(k, dim, np.int32), np.arange(k, dtype=np.int32), n]
        return pa.table([*map(pa.array, cols), _lists(sums / np.maximum(length, 1e-12))], names=["grp", "dim", "region", "n", "centre"])

    return run


def find_regions(rows: DataFrame, region: int = REGION, leaves: int = LEAVES, merged: int = MERGED_LEAVES) -> DataFrame:
    """(grp, dim, region, n, centre): regions of each group of ``rows`` (grp, rep, vector), with unit centres; materialised."""
    found = rows.mapInArrow(_grow(leaves), LEAF)
    parts = rows.rdd.getNumPartitions()
    while parts > FAN:
        found = found.groupBy("grp", "dim", F.expr(f"part div {FAN}")).applyInArrow(_reduce(merged), LEAF)
        parts = -(-parts // FAN)
    return cut(found.groupBy("grp", "dim").applyInArrow(_agglomerate(merged, region), PLACE))


def _assign(at_most: int, reach: float, known):
    """Rows (grp, rep, vector) with their regions; ``known`` gives {(grp, dim): (regions, chunks, centres)}."""

    def place(grp, dim, rep, m, u, regions, pieces, centres):
        sims = u @ centres.T
        many = min(at_most, len(regions))
        top = np.argpartition(-sims, many - 1, axis=1)[:, :many]
        score = np.take_along_axis(sims, top, 1)
        best = score.max(axis=1, keepdims=True)
        near = score >= best - DEVIATIONS * reach * np.sqrt(2 / dim)
        row, col = np.nonzero(near)
        place, main = top[row, col], score[row, col] == best[row, 0]
        # a region that could not be split: its crowd (rows so near its centre that all are linked) is cut into
        # chunks, which every other row of the region sees
        chunks = pieces[place]
        crowd = (chunks > 1) & (((u[row] - centres[place]) ** 2).sum(axis=1) <= (reach / 2) ** 2 * (1 - 1e-9))
        times = np.where(crowd, 1, chunks)
        again = np.repeat(np.arange(len(row)), times)
        chunk = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
        chunk = np.where(crowd[again], rep[row[again]] % chunks[again], chunk)
        row, place, main, crowd = row[again], place[again], main[again], crowd[again]
        cols = [np.full(len(row), grp, np.int64), np.full(len(row), dim, np.int32), regions[place].astype(np.int32), chunk.astype(np.int32), rep[row], main, crowd]
        return pa.RecordBatch.from_arrays([*map(pa.array, cols), pack(m).take(pa.array(row))], names=[c.split()[0] for c in PLACED.split(", ")])

    def run(batches):
        of = known()
        for b in batches:
            if not b.num_rows:
                continue
            grp, rep = np.asarray(b.column("grp")), np.asarray(b.column("rep"))
            for at, m in lists_to_matrices(b.column("vector")):
                u = unit(m)
                for g in np.unique(grp[at]):
                    own = np.flatnonzero(grp[at] == g)
                    yield place(int(g), m.shape[1], rep[at[own]], m[own], u[own], *of[int(g), m.shape[1]])

    return run


def _by_group(rows: list[tuple]) -> dict:
    """{(grp, dim): (regions, chunks, centres)} of rows of the regions' table."""
    out: dict = {}
    for grp, dim, *rest in sorted(rows, key=lambda r: r[:3]):
        out.setdefault((grp, dim), []).append(rest)
    return {k: (np.array([r[0] for r in v]), np.array([r[1] for r in v]), np.array([r[2] for r in v], np.float64)) for k, v in out.items()}


def assign(rows: DataFrame, regions: DataFrame, least: float, at_most: int = REGIONS) -> DataFrame:
    """Every row (grp, rep, vector) with each of its regions (grp, dim, region, n, chunks, centre); ``main`` marks the nearest.

    The regions are sent to all tasks if they are few, else rows meet the regions of their group in salted groups.
    """
    reach = float(np.sqrt(2 - 2 * least))
    rows, known = rows.select("grp", "rep", "vector"), [*KEY, "chunks", "centre"]
    if is_small(regions):
        sent = rows.sparkSession.sparkContext.broadcast(_by_group([tuple(r) for r in regions.select(*known).collect()]))  # at most BROADCAST_ROWS
        return rows.mapInArrow(_assign(at_most, reach, lambda: sent.value), PLACED)
    # a salt for each 50 000 rows of a group, so that no task holds more of one
    salts = cut(regions.groupBy("grp").agg(F.ceil(F.sum("n") / BROADCAST_ROWS).cast("long").alias("salts")).withColumn("n", F.col("salts") * BROADCAST_ROWS))
    salted = skew_join(rows, salts, ["grp"], "n").select("grp", "rep", "vector", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int").alias("salt"))
    every = salts.select("grp", F.explode(F.sequence(F.lit(0), F.col("salts").cast("int") - 1)).alias("salt"))
    beside = regions.select(*known).join(every, "grp").toDF(*(f"_{c}" for c in ("grp", *known[1:], "salt")))

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        of = _by_group([tuple(r.values()) for r in right.select([f"_{c}" for c in known]).to_pylist()])
        found = list(_assign(at_most, reach, lambda: of)(left.select(["grp", "rep", "vector"]).to_batches()))
        schema = pa.schema([("grp", pa.int64()), ("dim", pa.int32()), ("region", pa.int32()), ("chunk", pa.int32()), ("rep", pa.int64()), ("main", pa.bool_()), ("crowd", pa.bool_()), ("vec", pa.binary())])
        return pa.Table.from_batches(found, schema)

    return salted.groupBy("grp", "salt").cogroup(beside.groupBy("_grp", "_salt")).applyInArrow(both, PLACED)


def link_rows(m: np.ndarray, main: np.ndarray, least: float) -> np.ndarray:
    """For each unit row the first row of its cluster: rows with cosine >= ``least``, one of them in ``main``, and chains of such."""
    label, single = np.arange(len(m)), m.astype(np.float32)
    mains = np.flatnonzero(main)
    step = max(16, 2_000_000 // max(1, len(m)))
    for lo in range(0, len(mains), step):
        at = mains[lo : lo + step]
        sims = single[at] @ single.T
        r, c = np.nonzero(sims >= least - 1e-5)
        close = sims[r, c] < least + 1e-5
        if close.any():
            i = np.flatnonzero(close)
            close[i] = np.round(np.einsum("ij,ij->i", m[at[r[i]]], m[c[i]]), 12) < least
        label = join_labels(label, at[r[~close]], c[~close])
    return label


def _links(least: float):
    """Clusters within regions, from rows sorted by region: each row with the first of its cluster."""

    def close(parts: list[pa.RecordBatch]):
        t = pa.Table.from_batches(parts).combine_chunks()
        rep, dim = t["rep"].to_numpy(), t["dim"][0].as_py()
        label = link_rows(unit(unpack(t["vec"].chunk(0), dim)), t["main"].to_numpy(), least)
        at = np.flatnonzero(label != np.arange(len(rep)))
        return pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(rep[label[at]])], names=["a", "b"])

    def run(batches):
        parts, key = [], None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [np.asarray(b.column(n)) for n in ("grp", "dim", "region", "chunk")]
            edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            for lo, hi in zip(np.r_[0, edges], np.r_[edges, b.num_rows]):
                now = tuple(int(c[lo]) for c in cols)
                if parts and now != key:
                    yield close(parts)
                    parts = []
                key = now
                parts.append(b.slice(lo, hi - lo))
        if parts:
            yield close(parts)

    return run


def similar_edges(rows: DataFrame, count: int, least: float, region: int = REGION, depth: int = DEPTH, **options) -> DataFrame:
    """(a, b): edges that tie the similar rows (grp, rep, vector) of a group; ``count``: about how many rows."""
    regions = find_regions(rows, region, **options)
    # a group that fell into one region only can't be split by another try
    sizes = regions.groupBy("grp", "dim").agg(F.count("*").alias("k"))
    too_large = F.col("n") > OVERSIZE * region
    regions = regions.join(sizes, ["grp", "dim"]).withColumn("anew", too_large & (F.col("k") > 1) & F.lit(depth > 1))
    regions = cut(regions.withColumn("chunks", F.when(F.col("anew"), 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("n") / (OVERSIZE * region)))).cast("long")).drop("k"))
    crowded = not regions.where("chunks > 1").isEmpty()
    deeper = not regions.where("anew").isEmpty()
    placed = assign(rows, regions, least)
    if crowded or deeper:
        placed = cut(placed)
    again = regions.where("anew").select(*KEY)
    own = placed.join(again, KEY, "left_anti") if deeper else placed
    order = [*KEY, "chunk", "rep"]
    parts = task_count(rows.sparkSession, 4 * count, 65_536)
    edges = own.repartition(parts, *order[:4]).sortWithinPartitions(*order).mapInArrow(_links(least), "a long, b long")
    if crowded:
        # the chunks of a crowd are tied by its smallest row
        heads = own.where("crowd").groupBy(*order[:4]).agg(F.min("rep").alias("a"))
        first = heads.groupBy(*KEY).agg(F.min("a").alias("b"))
        edges = edges.unionByName(heads.join(first, KEY).select("a", "b"))
    if deeper:
        def lists(batches):
            for b in batches:
                for dim in np.unique(b.column("dim")):
                    at = pa.array(np.flatnonzero(np.asarray(b.column("dim")) == dim))
                    vectors = _lists(unpack(b.column("vec").take(at), int(dim)))
                    yield pa.RecordBatch.from_arrays([b.column("grp").take(at), b.column("rep").take(at), vectors], names=["grp", "rep", "vector"])

        inner = placed.join(again, KEY, "left_semi")
        inner = inner.select(F.xxhash64(*KEY).alias("grp"), "dim", "rep", "vec").mapInArrow(lists, "grp long, rep long, vector array<float>")
        edges = edges.unionByName(similar_edges(inner, count, least, region, depth - 1, **options))
    return edges


def members(vectors: DataFrame, least: float = 0.8, smallest: int = 3, **options) -> DataFrame:
    """(grp, id, cluster_id, size, vector): members of clusters with at least ``smallest`` ids.

    Vectors of a group with cosine >= ``least`` belong together, also by a chain of such pairs; cluster_id is the
    smallest id. Vectors of one direction are one row of the trees. No vectors give no rows.
    """
    rows = with_copies(vectors)
    reps = rows.where("id = rep").select("grp", "rep", "vector")
    edges = similar_edges(reps, reps.count(), least, **options)
    roots = components(edges).withColumnRenamed("node", "rep")
    placed = rows.join(roots, "rep", "left").select("grp", "id", F.coalesce("root", "rep").alias("cluster_id"), "vector")
    sizes = placed.groupBy("cluster_id").agg(F.count("*").alias("size")).where(F.col("size") >= smallest)
    return skew_join(placed, sizes, ["cluster_id"], "size").select("grp", "id", "cluster_id", "size", "vector")


def typical(found: DataFrame, top: int = 3) -> DataFrame:
    """(cluster_id, size, radius, place, id, sim): each cluster with its ``top`` members nearest to the centroid.

    ``radius`` is the root mean square distance of the unit vectors to their mean, from the features alone.
    Ties go to the smaller id. The features add up before the shuffle, and so does the choice of the members.
    """
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = found.withColumn("u", F.transform("vector", lambda x: x / norm)).drop("vector")
    feature = rows.groupBy("cluster_id").agg(F.count("*").alias("size"), vector_to_array(Summarizer.mean(array_to_vector("u"))).alias("mean"))
    length = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x * x))
    feature = feature.withColumn("length", length).withColumn("radius", F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("length") * F.col("length"))))
    rows = skew_join(rows.select("cluster_id", "id", "u"), cut(feature), ["cluster_id"], "size")
    sim = F.aggregate(F.zip_with("u", "mean", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) / F.greatest("length", F.lit(1e-300))
    rows = rows.select("cluster_id", "size", F.round("radius", 6).alias("radius"), "id", F.round(sim, 6).alias("sim"))
    place = F.row_number().over(W.partitionBy("cluster_id").orderBy(F.desc("sim"), "id"))
    return rows.withColumn("place", place).where(F.col("place") <= top)


CODES = "codebook_id long, pos int, first int, size int, typical boolean"


def code_clusters(codebooks: DataFrame, reach: float = 0.05, smallest: int = 3, top: int = 3) -> DataFrame:
    """(codebook_id, pos, first, size, typical): members of clusters among the centroids of one codebook.

    Centroids at Euclidean distance <= ``reach`` belong together, also by chains. Centroids that are null, not
    finite, all zero or not ``subvector_dim`` long are left out, as are codebooks without id or centroids.
    A codebook lies in one row, so its size is bounded by what a row can hold, and it is one region.
    """

    def linked(m: np.ndarray) -> np.ndarray:
        label = np.arange(len(m))
        for lo in range(0, len(m), 64):
            d2 = ((m[lo : lo + 64, None, :] - m[None]) ** 2).sum(axis=2)
            r, c = np.nonzero(d2 <= reach * reach * (1 + 1e-12))
            label = join_labels(label, r + lo, c)
        return label

    def run(batches):
        for b in batches:
            out = []
            for book, dim, codes in zip(*(b.column(n).to_pylist() for n in ("codebook_id", "subvector_dim", "centroids"))):
                rows = [(i, c) for i, c in enumerate(codes) if c is not None and len(c) == dim and None not in c and np.isfinite(c).all() and np.any(c)]
                if len(rows) < smallest:
                    continue
                pos, m = np.array([i for i, _ in rows]), np.array([c for _, c in rows], np.float64)
                first = linked(m)
                for f in np.unique(first):
                    at = np.flatnonzero(first == f)
                    if len(at) >= smallest:
                        far = np.round(((m[at] - m[at].mean(axis=0)) ** 2).sum(axis=1), 12)
                        near = set(np.lexsort((pos[at], far))[:top].tolist())
                        out += [(book, int(pos[x]), int(pos[f]), len(at), i in near) for i, x in enumerate(at)]
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["codebook_id", "pos", "first", "size", "typical"])

    given = codebooks.where("codebook_id is not null and centroids is not null and subvector_dim is not null")
    return given.select("codebook_id", "subvector_dim", "centroids").mapInArrow(run, CODES)


def cluster_members(requests: DataFrame, config: DataFrame, codebooks: DataFrame, **options) -> DataFrame:
    """(member_kind, member_id, cluster_id) of the vectors' and the centroids' clusters of at least three."""
    found = members(usable(requests, config), **options)
    code = F.col("codebook_id") * 1000
    return found.select(F.lit("vector").alias("member_kind"), F.col("id").alias("member_id"), "cluster_id").unionByName(
        code_clusters(codebooks).select(F.lit("codebook").alias("member_kind"), (code + F.col("pos")).alias("member_id"), (code + F.col("first")).alias("cluster_id"))
    )
