"""Evaluation texts leaking into a corpus.

Every text is read as words and cut into windows: of as many words as a passage needs, for passages that stand word by
word in a text, and of as many words as an item's question or answer has, for whole items that were edited. A
window's fingerprint is the SimHash of its words. Fingerprints are looked up in several indexes, one for each block of their bits:
two fingerprints that differ in fewer bits than there are blocks agree in one block at least, so no pair
within that radius is missed. Windows may be similar and their fingerprints far apart, so for similar windows the
word shingles are looked up too: of a window that is similar enough, any shingles with more of its weight than may
differ hold one that the other has. Candidates are then compared exactly, by the weighted similarity of their word
shingles and word by word.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread

#: Words of a window, words of a shingle, least similarity, bits of difference and blocks of 64 / BLOCKS bits.
WINDOW, SHINGLE, SIMILAR, RADIUS, BLOCKS = 12, 5, 0.8, 3, 4
#: Windows of the items that are held at once; more items take more passes over the corpus.
ITEM_WINDOWS = 400_000
#: Words that a task handles in one go.
CHUNK_WORDS = 40_000
#: Characters without a width of their own, left out wherever they stand.
INVISIBLE = [0xAD, 0x034F, 0x061C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF]
_INVISIBLE = re.compile("[" + "".join(map(chr, sorted(INVISIBLE))) + "]+")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def words(text: str) -> list[str]:
    """The words of a text: runs of letters and digits, whatever the case, composition and invisible characters."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", _INVISIBLE.sub("", text))
        text = unicodedata.normalize("NFC", text.casefold())
        return _WORD.findall(text)
    return _WORD.findall(text.lower())


class _Hashes(dict):
    """Word hashes; forgets them when there are many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """(words + 1, 64): how many of the words before each place have each bit."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    out = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=out[1:])
    return out


def fingerprints(hashes: np.ndarray, window: int = WINDOW, sums: np.ndarray | None = None) -> np.ndarray:
    """SimHash of every window of a run of word hashes: the majority of each bit.

    With the ``sums`` before each place windows of any length cost one difference; without them sums over runs of 1, 2,
    4, ... words, in bytes where they fit, are put together to the window's length.
    """
    if sums is not None:
        return np.packbits(2 * (sums[window:] - sums[:-window]) > window, axis=1).view(np.uint64).ravel()
    run = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).astype(np.uint8 if window < 256 else np.int32, copy=False)
    total, done, size = None, 0, 1
    while size <= window:
        if window & size:
            part = run[done : done + len(hashes) - window + 1]
            total = part if total is None else total + part
            done += size
        if 2 * size <= window:
            run = run[:-size] + run[size:]
        size *= 2
    return np.packbits(total > window // 2, axis=1).view(np.uint64).ravel()


def shingle_hashes(rows: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the word shingles of windows (rows of word hashes)."""
    out = np.zeros((len(rows), rows.shape[1] - size + 1), np.uint64)
    for i in range(size):
        out = (out ^ rows[:, i : i + out.shape[1]]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def weighted_similarity(a: np.ndarray, b: np.ndarray, weights_a: np.ndarray, weights_b: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Weighted Jaccard similarity of windows' shingles; a shingle weighs as much as its words have characters."""
    sa, sb = shingle_hashes(a, size), shingle_hashes(b, size)
    wa = sum(weights_a[:, i : i + sa.shape[1]] for i in range(size)).astype(np.float64)
    wb = sum(weights_b[:, i : i + sb.shape[1]] for i in range(size)).astype(np.float64)
    same = sa[:, :, None] == sb[:, None, :]
    shared = (wa * same.any(axis=2)).sum(axis=1)
    either = wa.sum(axis=1) + (wb * ~same.any(axis=1)).sum(axis=1)
    return shared / np.maximum(either, 1e-9)


class ItemIndex:
    """Distinct windows of some length of the items, their items, and one lookup table for each block of fingerprint bits."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW, blocks: int = BLOCKS):
        hashes, rows, sizes, owners = _Hashes(), [], [], []
        for item, text in items:
            w = words(text)
            if len(w) >= window:
                h = np.array([hashes[x] for x in w], np.uint64)
                rows.append(np.lib.stride_tricks.sliding_window_view(h, window))
                sizes.append(np.lib.stride_tricks.sliding_window_view(np.array([len(x) for x in w], np.int32), window))
                owners.append(np.full(len(w) - window + 1, item, np.int64))
        self.window, self.blocks = window, blocks
        rows = np.concatenate(rows) if rows else np.zeros((0, window), np.uint64)
        self.rows, first, where = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        self.sizes = np.concatenate(sizes)[first] if sizes else np.zeros((0, window), np.int32)
        pairs = np.unique(np.stack([where.ravel(), np.concatenate(owners)], axis=1), axis=0) if owners else np.zeros((0, 2), np.int64)
        self.owner_of = pairs[:, 1]
        self.owner_from = np.searchsorted(pairs[:, 0], np.arange(len(self.rows) + 1))
        bits = np.unpackbits(np.ascontiguousarray(self.rows).view(np.uint8).reshape(len(self.rows), window, 8), axis=2).astype(np.int32) if len(self.rows) else np.zeros((0, window, 64), np.int32)
        self.prints = np.packbits(bits.sum(axis=1) * 2 > window, axis=1).view(np.uint64).ravel() if len(self.rows) else np.zeros(0, np.uint64)
        shingles = shingle_hashes(self.rows) if len(self.rows) else np.zeros((0, 1), np.uint64)
        order = np.argsort(shingles, axis=None, kind="stable")
        self.shingles, self.holder = shingles.ravel()[order], order // max(1, shingles.shape[1])
        self.tables = []
        for block in range(blocks):
            key = self.block(self.prints, block)
            order = np.argsort(key, kind="stable")
            self.tables.append((order, np.searchsorted(key[order], np.arange((1 << 64 // blocks) + 1))))

    def block(self, prints: np.ndarray, i: int) -> np.ndarray:
        width = 64 // self.blocks
        return (prints >> np.uint64(i * width) & np.uint64((1 << width) - 1)).astype(np.int64)

    def candidates(self, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position in ``prints``, window of an item) within the radius, each once."""
        found = []
        for i, (order, starts) in enumerate(self.tables):
            key = self.block(prints, i)
            lo, n = starts[key], starts[key + 1] - starts[key]
            at = np.repeat(np.arange(len(prints)), n)
            other = order[np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
            near = np.bitwise_count(prints[at] ^ self.prints[other]) <= radius
            found.append(np.stack([at[near], other[near]], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def sharing(self, hashes: np.ndarray, sizes: np.ndarray, starts: np.ndarray, similar: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position in ``starts``, window of an item), each once: all that may reach the similarity, and others."""
        each = self.window - SHINGLE + 1
        own = shingle_hashes(hashes[None, :])[0]
        lo = np.searchsorted(self.shingles, own)
        n = np.searchsorted(self.shingles, own, side="right") - lo
        view = np.lib.stride_tricks.sliding_window_view
        held = np.flatnonzero(view(n > 0, each).any(axis=1)[starts])
        # the rarest shingles of each window, until they weigh more than what may differ
        first = starts[held]
        counts, weight = view(n, each)[first], view(np.convolve(sizes, np.ones(SHINGLE, np.int64), "valid"), each)[first]
        order = np.argsort(counts, axis=1, kind="stable")
        weight = np.take_along_axis(weight, order, 1)
        before = np.cumsum(weight, axis=1) - weight
        r, c = np.nonzero(before <= (1 - similar) * weight.sum(axis=1, keepdims=True) + 1e-6)
        at = first[r] + order[r, c]
        other = self.holder[np.repeat(lo[at] - np.r_[0, np.cumsum(n[at])[:-1]], n[at]) + np.arange(n[at].sum())] if len(at) else np.zeros(0, np.int64)
        pairs = np.unique(np.stack([np.repeat(held[r], n[at]), other], axis=1), axis=0)
        return pairs[:, 0], pairs[:, 1]


def item_sized(items: list[tuple[int, str]], least: int, blocks: int) -> list[ItemIndex]:
    """An index of whole passages for each length that passages of at least ``least`` words have."""
    by_length: dict[int, list[tuple[int, str]]] = {}
    for item, text in items:
        n = len(words(text))
        if n >= least:
            by_length.setdefault(n, []).append((item, text))
    return [ItemIndex(part, n, blocks) for n, part in sorted(by_length.items())]


def _scan(passages: ItemIndex, whole: list[ItemIndex], radius: int, similar: float):
    """Passages must stand word by word in a text, windows of the size of whole items must be similar."""
    least = passages.window

    def matches(index: ItemIndex, h, sizes, owner, sums, exactly: bool):
        """(text, item, similarity, whether word by word) of the windows of an index."""
        window = index.window
        if len(h) < window or not len(index.rows):
            return None
        starts = np.flatnonzero(owner[: len(h) - window + 1] == owner[window - 1 :])
        if not len(starts):
            return None
        at, other = index.candidates(fingerprints(h, window, sums)[starts], radius)
        if not exactly:
            more = np.stack(index.sharing(h, sizes, starts, similar), axis=1)
            at, other = np.unique(np.concatenate([np.stack([at, other], axis=1), more]), axis=0).T
        if not len(at):
            return None
        at, view = starts[at], np.lib.stride_tricks.sliding_window_view
        mine, theirs = view(h, window)[at], index.rows[other]
        exact = (mine == theirs).all(axis=1)
        score = np.ones(len(at))
        rest = np.flatnonzero(~exact)
        if exactly:
            keep = exact
        else:
            for lo in range(0, len(rest), 4_096):
                part = rest[lo : lo + 4_096]
                score[part] = weighted_similarity(mine[part], theirs[part], view(sizes, window)[at[part]], index.sizes[other[part]])
            keep = exact | (score >= similar)
        at, other, exact, score = at[keep], other[keep], exact[keep], score[keep]
        n = index.owner_from[other + 1] - index.owner_from[other]
        item = index.owner_of[np.repeat(index.owner_from[other] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())] if len(other) else np.zeros(0, np.int64)
        return np.repeat(owner[at], n), item, np.repeat(score, n), np.repeat(exact, n)

    def chunk(keys: list[int], texts: list[list[str]], hashes: _Hashes):
        """Rows (key, item, similarity, whether word by word) of some texts."""
        flat = [w for t in texts for w in t]
        h = np.array([hashes[w] for w in flat], np.uint64)
        owner = np.repeat(np.arange(len(texts)), np.array([len(t) for t in texts]))
        sums = bit_sums(h) if whole else None
        sizes = np.array([len(w) for w in flat], np.int32) if whole else None
        best: dict[tuple[int, int], tuple[float, bool]] = {}
        for index in (passages, *whole):
            found = matches(index, h, sizes, owner, sums, index is passages)
            for k, i, s, e in zip(*(x.tolist() for x in found)) if found else ():
                old = best.get((k, i), (0.0, False))
                best[k, i] = (max(old[0], s), old[1] or e)
        return [(keys[k], i, s, e) for (k, i), (s, e) in best.items()]

    def run(batches):
        hashes = _Hashes()
        keys, texts, held = [], [], 0

        def flush():
            rows = chunk(keys, texts, hashes) if held else None
            if rows:
                return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.bool_()))], names=["doc_id", "item_id", "similarity", "exact"])
            return None

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words(text) if text else []
                if len(w) >= least:
                    keys.append(key)
                    texts.append(w)
                    held += len(w)
                if held >= CHUNK_WORDS:
                    out = flush()
                    if out is not None:
                        yield out
                    keys, texts, held = [], [], 0
        out = flush()
        if out is not None:
            yield out

    return run


def leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW, radius: int = RADIUS, blocks: int = BLOCKS, similar: float | None = SIMILAR, item_windows: int = ITEM_WINDOWS) -> DataFrame:
    """(doc_id, item_id, similarity, exact): corpus texts that hold a passage of an item's question or answer, or all of it edited.

    ``exact``: ``window`` consecutive words of the item stand consecutively in the text. Otherwise a run of as many
    words as the question or answer has is similar to it by weighted shingles of five words; without ``similar`` only
    exact ones are looked for. Passages shorter than a window, null texts and rows with null ids give
    nothing; an item listed under two ids is reported under both. The items are a stated query set, taken in
    blocks of about ``item_windows`` windows, one after the other, so that one index is held at a time; the corpus is
    read once for each block and never shuffled.
    """
    if radius >= blocks or 64 % blocks:
        raise ValueError("the radius must be below the number of blocks, which must divide 64")
    spark = documents.sparkSession
    passages = items.where("item_id is not null").select("item_id", F.explode(F.array("question", "answer")).alias("passage")).where("passage is not null")
    corpus = spread(documents.where("doc_id is not null and text is not null").select("doc_id", "text"))
    # windows a passage can have: at most its characters; blocks are chosen by a hash
    total = passages.agg(F.sum(F.length("passage"))).first()[0] or 0
    n_blocks = -(-total // (2 * item_windows)) or 1
    out = None
    for i in range(n_blocks):
        part = passages.where(F.pmod(F.xxhash64("item_id", "passage"), F.lit(n_blocks)) == i) if n_blocks > 1 else passages
        given = [(r.item_id, r.passage) for r in part.collect()]  # about ``item_windows`` words
        index = spark.sparkContext.broadcast((ItemIndex(given, window, blocks), item_sized(given, window, blocks) if similar is not None else []))
        found = corpus.mapInArrow(lambda b, index=index: _scan(*index.value, radius, similar)(b), "doc_id long, item_id long, similarity double, exact boolean")
        if n_blocks > 1:
            found = cut(found)
            index.destroy()
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.max("exact").alias("exact"))
