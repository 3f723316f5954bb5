"""Encoding a corpus with a public byte-level BPE vocabulary.

Distinct words are put into a trie. The last token of a prefix is known once those of its own prefixes are:
it is the one token that ends the prefix, whose remainder has a last token it may follow. So each trie node
needs one step, and words that share a prefix share its states. A word's tokens are read back along the
nodes where its tokens begin.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..session import spread

#: Default place of the vocabulary: base64 tokens and their ranks, a line each.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits a text into words before pairs are merged.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A vocabulary larger than this is not sent to the tasks.
MAX_VOCABULARY = 64 << 20
#: Nodes after which a task starts a new trie, to bound its memory; results don't change.
MAX_NODES = 300_000
#: Pairs of tokens that a task remembers whether they may follow each other.
MAX_PAIRS = 1_000_000


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY + 1)
    if len(data) > MAX_VOCABULARY:
        raise ValueError("the vocabulary is too large")
    return data


class PrefixTrie:
    """Encodes words of bytes; states of shared prefixes are computed once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.tokens = {i: t for t, i in ranks.items()}
        self.follows: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # node * 256 + byte
        self.last, self.back = [-1], [-1]  # last token of the prefix; node of what is before it
        self.words: dict[str, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Plain pair merging, for two tokens at a time."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, a: int, b: int) -> bool:
        key = (a, b)
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) > MAX_PAIRS:
                self.follows.clear()
            known = self.follows[key] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def encode(self, text: str) -> tuple[int, ...]:
        word = text.encode()
        node, path, child, last = 0, [0], self.child, self.last
        for i, byte in enumerate(word):
            nxt = child.get(node << 8 | byte)
            if nxt is None:
                nxt = self._grow(word, i + 1, path)
                child[node << 8 | byte] = nxt
            node = nxt
            path.append(node)
        out = []
        while node:
            out.append(last[node])
            node = self.back[node]
        return tuple(reversed(out))

    def _grow(self, word: bytes, end: int, path: list[int]) -> int:
        for start in range(max(0, end - self.longest), end):
            token = self.ranks.get(word[start:end])
            if token is not None and (start == 0 or self.may_follow(self.last[path[start]], token)):
                self.last.append(token)
                self.back.append(path[start])
                return len(self.last) - 1
        raise ValueError("the vocabulary lacks a byte")

    def ids(self, text: str, split) -> list[int]:
        out: list[int] = []
        words = self.words
        for w in split(text):
            known = words.get(w)
            if known is None:
                if len(self.last) > MAX_NODES:
                    self.clear()
                    words = self.words
                known = words[w] = self.encode(w)
            out += known
        return out


@lru_cache(maxsize=2)
def trie_of(vocabulary: bytes) -> PrefixTrie:
    return PrefixTrie({base64.b64decode(t): int(i) for t, i in map(bytes.split, vocabulary.splitlines()) if t})


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of each text, no special tokens; null and empty texts give an empty list.

    Strings that look like special tokens are plain text. Whole texts are encoded, in one pass without shuffle.
    """
    spark = documents.sparkSession
    data = spark.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches):
        trie, split = trie_of(data.value), regex.compile(PATTERN).findall
        for b in batches:
            ids, ends = array("i"), [0]
            for t in b.column(1).to_pylist():
                if t:
                    ids.extend(trie.ids(t, split))
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(np.asarray(ends, np.int32)), pa.array(np.frombuffer(ids, np.int32) if len(ids) else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return spread(documents.select(key, text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
