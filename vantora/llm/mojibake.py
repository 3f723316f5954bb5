"""Texts that were decoded with the wrong character encoding, and what they said before.

A noisy channel: someone wrote a text, its bytes in one encoding were read in another. The source is a model
of the corpus: how often each character follows two others, counted over all texts. The channel is undone by
taking a damaged span back to its bytes and reading those as another encoding. Where bytes were lost (a
replacement character, or an incomplete sequence) the byte lattice gets wildcards, and a Viterbi search over
the model and the corpus' word frequencies chooses the likeliest reading. A span counts as damaged if another
reading is so much likelier that it outweighs how rare damage is; readings as UTF-8 need little, because byte
sequences that are valid UTF-8 by chance are rare, readings with wildcards more, and their words must be known.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Encodings a text may have been read in, and those it may have been written in beside UTF-8.
READ_AS = "cp1252 latin-1 mac_roman cp437 cp850 cp1251 cp1250 koi8-r cp866 iso8859-15 cp1254 cp1253 mac_cyrillic iso8859-2 cp852".split()
WRITTEN_IN = "cp1252 cp1251 cp1250 iso8859-2 koi8-r cp866 mac_roman cp437 cp850 cp852 mac_cyrillic iso8859-5 shift_jis euc_jp gbk".split()
#: Encodings with several bytes for a character in which UTF-8 may have been read.
WIDE = ["gbk", "shift_jis"]
#: How much likelier (natural logarithm) another reading must be: as UTF-8, and as any other encoding.
UTF8_GAIN, OTHER_GAIN = 1.0, 4.5
#: Of the sequences that another encoding's reading rests on, so many must occur in the corpus so often.
SEEN_SHARE, SEEN_TIMES = 0.8, 2
#: Buckets of the hashed counts of three, two and one characters. They bound the model whatever the corpus;
#: sequences of three and of two are counted under two hashes, of which the smaller count holds.
TRI, BI, UNI, WORDS = 1 << 21, 1 << 18, 1 << 16, 1 << 19
BUCKETS = 2 * TRI + 2 * BI + UNI + 2 * WORDS
#: How much likelier a reading with lost bytes must be, and the weight of a word's frequency in it.
LOSS_GAIN, WORD_WEIGHT = 3.0, 0.5
#: States that the search keeps where several lost characters follow each other in a word (one alone is searched in
#: full), UTF-8 layers undone, windows remembered.
BEAM, LAYERS, MEMORY = 256, 3, 60_000
LOST = "\ufffd"
#: A window: characters beyond ASCII with up to two others on each side, which is all the model looks at.
WINDOW = re.compile(r"[!-~]{0,2}(?:[^\x00-\x7f](?:[!-~]{1,3}(?=[^\x00-\x7f]))?)+[!-~]{0,2}")
#: A word with a letter beyond ASCII, which is what word frequencies are counted of.
WORD = re.compile(r"(?<![^\W\d_])[^\W\d_]*[^\x00-\x7f\W\d_][^\W\d_]*")
_LETTERS_BEFORE, _LETTERS_AFTER = re.compile(r"[^\W\d_]{0,40}\Z"), re.compile(r"[^\W\d_]{0,40}")
#: What may stand where a continuation byte was lost: a blank or question mark in its place, or nothing.
STAND_INS = " ?\xa0"
_LEAD = re.compile(rb"[\xc2-\xf4][\x80-\xbf]")
_EDGE = 2
_M1, _M2, _M3 = 73856093, 19349663, 83492791
_N1, _N2, _N3 = 49979687, 86028121, 32452843


def _codes(text: str) -> np.ndarray:
    """Code points with digits as 0 and each run of ASCII white space as one edge, edges around."""
    c = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    c[(c >= 48) & (c <= 57)] = 48
    blank = (c == 32) | ((c >= 9) & (c <= 13))
    c[blank] = _EDGE
    return c[~(blank & np.r_[False, blank[:-1]])]


def word_places(word: str) -> tuple[int, int]:
    """The two counters of a word, whatever its case."""
    h = xxhash.xxh3_64_intdigest(word.casefold().encode("utf-8", "surrogatepass"))
    return h & WORDS - 1, (h >> 32) & WORDS - 1


def corpus_counts(documents: DataFrame) -> DataFrame:
    """(bucket, n): hashed counts of characters after two, one and no others, and of words beyond ASCII, over all texts."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        start_of_words = BUCKETS - 2 * WORDS

        def add(keys, size, start):
            total[start : start + size] += np.bincount(keys & np.uint32(size - 1), minlength=size)

        for b in batches:
            texts = b.column(0).to_pylist()
            codes = [_codes(text) for text in texts]
            if not codes:
                continue
            words = Counter(w for text in texts if not text.isascii() for w in WORD.findall(text))
            if words:
                places, n = np.array([word_places(w) for w in words]), np.array(list(words.values()))
                np.add.at(total, start_of_words + places[:, 0], n)
                np.add.at(total, start_of_words + WORDS + places[:, 1], n)
            c = np.concatenate(codes)  # an edge stands between two texts
            x, y, z = c[:-2], c[1:-1], c[2:]
            m1, m2, m3, n1, n2, n3 = map(np.uint32, (_M1, _M2, _M3, _N1, _N2, _N3))  # only low bits count
            add(x * m1 ^ y * m2 ^ z * m3, TRI, 0)
            add(x * n1 ^ y * n2 ^ z * n3, TRI, TRI)
            add(c[:-1] * m2 ^ c[1:] * m3, BI, 2 * TRI)
            add(c[:-1] * n2 ^ c[1:] * n3, BI, 2 * TRI + BI)
            add(c, UNI, 2 * TRI + 2 * BI)
        at = np.flatnonzero(total)
        for lo in range(0, len(at), 50_000):
            part = at[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["bucket", "n"])

    texts = documents.where("text is not null").select("text")
    return spread(texts).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def collected(counts: DataFrame) -> bytes:
    """The counts as one array; at most ``BUCKETS`` numbers however large the corpus."""
    rows = counts.toArrow()
    total = np.zeros(BUCKETS, np.float32)
    total[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return total.tobytes()


@lru_cache(maxsize=None)
def _to_byte(encoding: str) -> dict[str, int]:
    """Character to byte of the upper half; bytes without a character stand for the control of their number."""
    out: dict[str, int] = {}
    for b in range(128, 256):
        out.setdefault(bytes([b]).decode(encoding, "ignore") or chr(b), b)
    return out


@lru_cache(maxsize=None)
def _to_char(encoding: str) -> list[str]:
    back = {b: c for c, b in _to_byte(encoding).items()}
    return [chr(b) if b < 128 else back.get(b, chr(b)) for b in range(256)]


@lru_cache(maxsize=None)
def _sequence(encoding: str) -> re.Pattern:
    """What a UTF-8 sequence of at least two bytes looks like when read in an encoding."""
    chars = _to_char(encoding)

    def one_of(lo, hi):
        return "[" + re.escape("".join(chars[lo:hi])) + "]"

    return re.compile(one_of(0xC2, 0xF5) + one_of(0x80, 0xC0))


class Channel:
    """Finds and undoes damage in texts, under the counts of a corpus."""

    def __init__(self, counts: bytes):
        n = np.frombuffer(counts, np.float32)
        ends = np.cumsum([TRI, TRI, BI, BI, UNI, WORDS])
        self.tri, self.tri2, self.bi, self.bi2, self.uni, self.word, self.word2 = (array("f", x.tobytes()) for x in np.split(n, ends))
        self.total = max(1.0, sum(self.uni))
        self.logs: dict[int, float] = {}
        self.memory: dict[tuple[str, bool, bool], tuple[float, str, str]] = {}
        self._guesses: list[str] | None = None
        self._completions: dict[tuple[str, bytes], list[str]] = {}
        self.losses: dict[tuple[str, bool, bool, str, bool], tuple[float, str]] = {}
        self.gaps: dict[tuple[str, bool, bool], list[str]] = {}
        self._leads: dict[str, frozenset[str]] | None = None
        self.quiet: set[tuple[str, bool, bool]] = set()

    def step(self, a: int, b: int, c: int) -> float:
        """Log probability of c after a, b; smoothed by shorter contexts."""
        key = (a << 21 | b) << 21 | c
        known = self.logs.get(key)
        if known is not None:
            return known
        if len(self.logs) > 4 * MEMORY:
            self.logs.clear()
        p1 = (self.uni[c & UNI - 1] + 0.1) / (self.total + 1e4)
        n1 = self.uni[b & UNI - 1]
        p2 = (self.two(b, c) + 5 * p1) / (n1 + 5)
        p3 = (self.three(a, b, c) + 5 * p2) / (self.two(a, b) + 5) if a else p2
        known = self.logs[key] = math.log(min(p3, 1.0))
        return known

    def two(self, b: int, c: int) -> float:
        return min(self.bi[(b * _M2 ^ c * _M3) & BI - 1], self.bi2[(b * _N2 ^ c * _N3) & BI - 1])

    def three(self, a: int, b: int, c: int) -> float:
        return min(self.tri[(a * _M1 ^ b * _M2 ^ c * _M3) & TRI - 1], self.tri2[(a * _N1 ^ b * _N2 ^ c * _N3) & TRI - 1])

    def words(self, word: str) -> float:
        """How often the corpus has a word with letters beyond ASCII."""
        i, j = word_places(word)
        return min(self.word[i], self.word2[j])

    def usual(self, window: str, at_start: bool, at_end: bool) -> bool:
        """Whether most sequences around the window's characters beyond ASCII occur in the corpus."""
        c = self.codes(window, at_start, at_end)
        odd = [i for i in range(2, len(c)) if max(c[i - 2 : i + 1]) > 127] or [len(c)]
        return sum(i < len(c) and self.three(c[i - 2], c[i - 1], c[i]) >= SEEN_TIMES for i in odd) >= SEEN_SHARE * len(odd)

    @staticmethod
    def codes(window: str, at_start: bool, at_end: bool) -> list[int]:
        c = [48 if "0" <= x <= "9" else ord(x) for x in window]
        return [_EDGE] * at_start + c + [_EDGE] * at_end

    def steps(self, window: str, at_start: bool, at_end: bool) -> list[float]:
        c = self.codes(window, at_start, at_end)
        return [self.step(c[i - 2] if i > 1 else 0, c[i - 1], c[i]) for i in range(1, len(c))]

    def score(self, window: str, at_start: bool, at_end: bool) -> float:
        return sum(self.steps(window, at_start, at_end))

    def doubt(self, window: str, at_start: bool, at_end: bool) -> float:
        """An upper limit of what another reading with as many characters can gain."""
        c, s = self.codes(window, at_start, at_end), self.steps(window, at_start, at_end)
        return -sum(x for i, x in enumerate(s, 1) if max(c[max(0, i - 2) : i + 1]) > 127)

    # readings as UTF-8

    def as_utf8(self, window: str, encoding: str, at_start: bool, at_end: bool) -> str | None:
        """The window with its characters of ``encoding`` read as UTF-8, where they form it; None if nowhere."""
        if not _sequence(encoding).search(window):
            return None
        to_byte, to_char = _to_byte(encoding), _to_char(encoding)
        out, run, changed = [], bytearray(), False

        def close():
            nonlocal changed
            if run:
                if _LEAD.search(run):
                    text = run.decode("utf-8", "surrogateescape")
                    changed = changed or len(text) < len(run)
                    out.append("".join(to_char[ord(x) - 0xDC00] if "\udc80" <= x <= "\udcff" else x for x in text))
                else:
                    out.append("".join(to_char[x] for x in run))
                run.clear()

        for x in window:
            o = ord(x)
            b = o if o < 128 else to_byte.get(x)
            if b is None:
                close()
                out.append(x)
            else:
                run.append(b)
        close()
        return "".join(out) if changed else None

    def best_utf8(self, window: str, at_start: bool, at_end: bool, layers: int = LAYERS) -> tuple[float, str, str]:
        """(score, text, channel) of the likeliest reading after undoing up to ``layers`` layers."""
        best = (-math.inf, window, "")
        seen = set()
        for d in READ_AS:
            x = self.as_utf8(window, d, at_start, at_end)
            if x is None or x in seen:
                continue
            seen.add(x)
            here = (self.score(x, at_start, at_end), x, f"utf-8 read as {d}")
            if layers > 1 and not x.isascii():
                deep = self.best_utf8(x, at_start, at_end, layers - 1)
                here = max(here, (deep[0], deep[1], f"{deep[2]}, {here[2]}"))
            best = max(best, here)
        for d in WIDE:
            if any(c >= "\u2e80" for c in window):
                try:
                    x = window.encode(d).decode("utf-8")
                except UnicodeError:
                    continue
                best = max(best, (self.score(x, at_start, at_end), x, f"utf-8 read as {d}"))
        return best

    # readings in other encodings

    def best_other(self, window: str, at_start: bool, at_end: bool) -> tuple[float, str, str]:
        best, seen = (-math.inf, window, ""), {window}
        for d in READ_AS:
            to_byte = _to_byte(d)
            data = bytearray()
            for x in window:
                b = ord(x) if x < "\x80" else to_byte.get(x)
                if b is None:
                    break
                data.append(b)
            else:
                for s in WRITTEN_IN:
                    try:
                        x = data.decode(s)
                    except UnicodeDecodeError:
                        continue
                    if x not in seen:
                        seen.add(x)
                        best = max(best, (self.score(x, at_start, at_end), x, f"{s} read as {d}"))
        return best

    # lost bytes

    def guesses(self) -> list[str]:
        """All characters beyond ASCII that the corpus has more than once, the most frequent first."""
        if self._guesses is None:
            known = [chr(i) for i in range(0xA0, UNI) if self.uni[i] >= SEEN_TIMES and not 0xD800 <= i < 0xE000 and chr(i) != LOST]
            self._guesses = sorted(known, key=lambda c: (-self.uni[ord(c)], c))
        return self._guesses

    def completions(self, encoding: str, start: bytes) -> list[str]:
        """Characters of the corpus whose UTF-8 bytes are ``start`` and one more: a wildcard of the lattice."""
        key = (encoding, start)
        known = self._completions.get(key)
        if known is None:
            known = [c for b in range(0x80, 0xC0) if len(c := (start + bytes([b])).decode("utf-8", "ignore")) == 1 and ord(c) < UNI and self.uni[ord(c)] >= SEEN_TIMES and ord(c) >= 0xA0]
            self._completions[key] = known
        return known

    def leads(self) -> dict[str, frozenset[str]]:
        """For each encoding the characters that may begin a sequence with a lost last byte."""
        if self._leads is None:

            def begins(d: str, b: int) -> bool:
                if 0xC2 <= b < 0xE0:
                    return bool(self.completions(d, bytes([b])))
                return 0xE0 <= b < 0xF0 and any(self.completions(d, bytes([b, x])) for x in range(0x80, 0xC0))

            self._leads = {d: frozenset(c for c, b in _to_byte(d).items() if begins(d, b)) for d in READ_AS}
        return self._leads

    def incomplete(self, window: str, at_start: bool, at_end: bool) -> list[str]:
        """The encodings in which a window may hold a sequence with a lost byte, if it is in doubt at all."""
        key = (window, at_start, at_end)
        known = self.gaps.get(key)
        if known is None:
            if len(self.gaps) > MEMORY:
                self.gaps.clear()
            known = [d for d, leads in self.leads().items() if not leads.isdisjoint(window)]
            if known and self.doubt(window, at_start, at_end) <= UTF8_GAIN:
                known = []
            self.gaps[key] = known
        return known

    def arcs(self, window: str, encoding: str) -> list[list[tuple[int, list[str]]]]:
        """The byte lattice of a window read in an encoding: for each place the steps (characters taken, readings).

        A character may stay as it is; characters whose bytes are a UTF-8 sequence may be read as that; a sequence
        that lacks its last byte may be completed by a wildcard, which takes the stand-in of the lost byte or nothing.
        """
        to_byte = _to_byte(encoding)
        data = [to_byte.get(x, 0) if ord(x) > 127 else 0 for x in window]
        out = []
        for i, x in enumerate(window):
            here = [(1, [x])]
            lead = data[i]
            need = 1 if 0xC2 <= lead < 0xE0 else 2 if 0xE0 <= lead < 0xF0 else 3 if 0xF0 <= lead < 0xF5 else 0
            have = 0
            while have < need and i + 1 + have < len(data) and 0x80 <= data[i + 1 + have] < 0xC0:
                have += 1
            if need:
                seq = bytes(data[i : i + 1 + have])
                if have == need:
                    text = seq.decode("utf-8", "ignore")
                    if text:
                        here.append((1 + have, [text]))
                elif have == need - 1:
                    readings = self.completions(encoding, seq)
                    if readings:
                        here.append((1 + have, readings))
                        after = window[i + 1 + have : i + 2 + have]
                        if after and (after == LOST or after in STAND_INS):
                            here.append((2 + have, readings))
            out.append(here)
        return out

    def search(self, window: str, arcs, at_start: bool, at_end: bool) -> tuple[float, str]:
        """The likeliest path through a lattice: a Viterbi search whose states are the last two characters."""
        first = (0, _EDGE) if at_start else (0, 0)
        states: list[dict[tuple[int, int], tuple[float, str]]] = [{} for _ in range(len(window) + 1)]
        states[0][first] = (0.0, "")
        for i in range(len(window)):
            for (a, b), (s, text) in states[i].items():
                for taken, readings in arcs[i]:
                    nxt = states[i + taken]
                    for r in readings:
                        x, y, gain = a, b, s
                        for c in r:
                            code = 48 if "0" <= c <= "9" else ord(c)
                            gain += self.step(x, y, code) if y else 0.0
                            x, y = y, code
                        old = nxt.get((x, y))
                        if old is None or (gain, text + r) > old:
                            nxt[x, y] = (gain, text + r)
        ends = [(s + (self.step(x, y, _EDGE) if at_end and y else 0.0), text) for (x, y), (s, text) in states[-1].items()]
        return max(ends)

    def completed(self, window: str, at_start: bool, at_end: bool, more: str = "", ends: bool = False) -> tuple[float, str]:
        """(gain, reading) of the likeliest reading of a window that has incomplete UTF-8 sequences; gain 0 if there is none.

        ``more`` is a stand-in behind the window that the reading may take; ``ends``: whether a word ends behind that.
        """
        key = (window, at_start, at_end, more, ends)
        known = self.losses.get(key)
        if known is not None:
            return known
        if len(self.losses) > MEMORY:
            self.losses.clear()
        score, best = self.score(window, at_start, at_end), (0.0, window)
        for d in self.incomplete(window, at_start, at_end):
            arcs = self.arcs(window + more, d)
            if not any(len(readings) > 1 for a in arcs for _, readings in a):
                continue
            s, text = self.search(window + more, arcs, at_start, ends if more else at_end)
            if not (more and text.endswith(more)):  # the stand-in was taken
                best = max(best, (s - score, text))
        self.losses[key] = best
        return best

    @staticmethod
    def around(text: str, i: int, j: int) -> tuple[str, str]:
        """The letters before and after a span, which belong to its words."""
        return _LETTERS_BEFORE.search(text[max(0, i - 40) : i]).group(), _LETTERS_AFTER.match(text[j : j + 40]).group()

    def lossy(self, text: str, i: int, j: int, window: str, at_start: bool, at_end: bool) -> tuple[str, int] | None:
        """The reading of a window with lost bytes and how many characters behind it that takes.

        None unless it is likelier and its words are known and more frequent than those that are there.
        """
        if not self.incomplete(window, at_start, at_end):
            return None
        # a byte that became a blank lies behind the window
        tail = text[j : j + 1] if text[j : j + 1] and text[j : j + 1] in STAND_INS else ""
        best = None
        for more in ("", tail) if tail else ("",):
            ends = j + len(more) == len(text) or text[j + len(more)].isspace()
            gain, reading = self.completed(window, at_start, at_end, more, bool(more) and ends)
            if gain <= UTF8_GAIN:
                continue
            before, after = self.around(text, i, j + len(more))
            new, old = WORD.findall(before + reading + after), WORD.findall(before + window + more + after)
            if not new:
                continue
            rare = min(map(self.words, new))
            was = max(map(self.words, old), default=0.0)
            gain += WORD_WEIGHT * (math.log(rare + 0.5) - math.log(was + 0.5))
            # a question mark, or one of two blanks, stands for the byte rather than for itself
            stands = bool(more) and (more == "?" or text[j + 1 : j + 2].isspace())
            if gain > LOSS_GAIN and rare >= SEEN_TIMES and rare > was and (best is None or (stands, gain) > best[:2]):
                best = stands, gain, reading, len(more)
        return best and best[2:]

    def fill(self, before: str, window: str, after: str) -> str:
        """The likeliest text with each lost character replaced by one that the corpus has.

        A Viterbi search over characters; ``before`` and ``after`` are the letters around the window, so that a word is
        whole when its frequency is weighed. A state is the last two characters and the word so far: where a
        word ends its frequency counts, and states that end alike become one.
        """
        states: dict[tuple[str, str], tuple[float, str]] = {("", ""): (0.0, "")}
        for x in [*before, *window, *after, ""]:
            if x == LOST and len(states) > BEAM:
                states = dict(sorted(states.items(), key=lambda kv: (-kv[1][0], kv[0]))[:BEAM])
            nxt: dict[tuple[str, str], tuple[float, str]] = {}
            for (tail, word), (s, text) in states.items():
                c = ([0, _EDGE] + self.codes(tail, False, False))[-2:]
                options = [x]
                if x == LOST:
                    options = [g for g in self.guesses() if self.two(c[1], ord(g)) > 0] or self.guesses()
                for o in options:
                    gain = s + self.step(c[0], c[1], _EDGE if not o or o.isspace() else 48 if "0" <= o <= "9" else ord(o))
                    longer = word + o if o.isalpha() else ""
                    if not longer and not word.isascii():
                        gain += WORD_WEIGHT * math.log(self.words(word) + 0.5)
                    key, value = ((text + o)[-2:], longer), (gain, text + o)
                    if key not in nxt or value > nxt[key]:
                        nxt[key] = value
            states = nxt
        found = max(states.values())[1]
        return found[len(before) : len(found) - len(after)]

    # windows and texts

    def examine(self, window: str, at_start: bool, at_end: bool) -> tuple[float, str, str]:
        """(gain, restored text, channel); gain 0 if the window is best as it is."""
        key = (window, at_start, at_end)
        known = self.memory.get(key)
        if known is not None:
            return known
        if len(self.memory) > MEMORY:
            self.memory.clear()
        found = (0.0, window, "")
        score = self.score(window, at_start, at_end)
        utf8 = self.best_utf8(window, at_start, at_end)
        if utf8[0] - score > UTF8_GAIN:
            found = (utf8[0] - score, utf8[1], utf8[2])
        elif self.doubt(window, at_start, at_end) > OTHER_GAIN and window.strip("\xa0 ") and LOST not in window:
            other = self.best_other(window, at_start, at_end)
            if other[0] - score > OTHER_GAIN and self.usual(other[1], at_start, at_end):
                found = (other[0] - score, other[1], other[2])
        self.memory[key] = found
        return found

    def windows(self, text: str):
        for m in WINDOW.finditer(text):
            i, j = m.span()
            # two characters before the first one beyond ASCII: the window starts inside a word
            at_start = i == 0 or text[i - 1] in " \t\n\r\v\f"
            at_end = j == len(text) or text[j] in " \t\n\r\v\f"
            yield i, j, m.group(), at_start, at_end

    def damaged(self, text: str) -> bool:
        if text.isascii():
            return False
        if LOST in text:
            return True
        for i, j, *window in self.windows(text):
            key = tuple(window)
            if key in self.quiet:
                continue
            if self.examine(*key)[0] > 0 or self.lossy(text, i, j, *key):
                return True
            if not self.incomplete(*key):  # such a window is harmless wherever it stands
                if len(self.quiet) > MEMORY:
                    self.quiet.clear()
                self.quiet.add(key)
        return False

    def undone(self, window: str, channel: str, at_start: bool, at_end: bool) -> str | None:
        """The window with the steps of a channel undone, the last one first; None if that can't be."""
        for step in reversed(channel.split(", ")):
            written, read = step.split(" read as ")
            if written == "utf-8" and read not in WIDE:
                nxt = self.as_utf8(window, read, at_start, at_end)
            else:
                to_byte = _to_byte(read) if read not in WIDE else {}
                data = [ord(x) if x < "\x80" else to_byte.get(x) for x in window]
                try:
                    nxt = None if None in data else bytes(data).decode(written)
                except UnicodeDecodeError:
                    nxt = None
            if nxt is None:
                return None
            window = nxt
        return window

    def restore(self, text: str) -> tuple[str, str]:
        """The text with its damaged windows replaced, and the channels found.

        A channel that was found in the text is also undone where a window alone would not have told, if the
        reading is at least as likely.
        """
        spans = [(i, j, w, s, e, *self.examine(w, s, e)) for i, j, w, s, e in self.windows(text)]
        channels = sorted({x[7] for x in spans if x[5] > 0})
        out, last, lost = [], 0, False
        for i, j, w, s, e, gain, fixed, _ in spans:
            i, w = max(i, last), w[max(0, last - i) :]  # a stand-in may have been taken
            if gain <= 0 and w:
                score = self.score(w, s, e)
                other = [(self.score(x, s, e), x) for c in channels if (x := self.undone(w, c, s, e)) is not None]
                fixed = max([o for o in other if o[0] >= score], default=(0, w))[1]
                found = self.lossy(text, i, j, w, s, e) if fixed == w else None
                if found:
                    fixed, j, lost = found[0], j + found[1], True
            elif w:
                more, reading = self.completed(fixed, s, e)
                if more > UTF8_GAIN:
                    fixed, lost = reading, True
            if LOST in fixed:
                fixed, lost = self.fill(self.around(text, i, j)[0], fixed, self.around(text, i, j)[1]), True
            out += [text[last:i], fixed]
            last = j
        return "".join(out) + text[last:], "; ".join(channels + ["lost bytes"] * lost)


@lru_cache(maxsize=2)
def channel_of(counts: bytes) -> Channel:
    return Channel(counts)


def _over(documents: DataFrame, work, schema: str) -> DataFrame:
    """Runs ``work(channel, key, text)`` over all texts under the counts of all texts."""
    counts = documents.sparkSession.sparkContext.broadcast(collected(corpus_counts(documents)))

    def run(batches):
        channel = channel_of(counts.value)
        for b in batches:
            rows = [r for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (r := work(channel, key, text))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=[c.split()[0] for c in schema.split(", ")])

    given = documents.where("doc_id is not null and text is not null and text <> ''").select("doc_id", "text")
    return spread(given).mapInArrow(run, schema)


def damaged_texts(documents: DataFrame) -> DataFrame:
    """(doc_id) of the texts of which a part was decoded wrongly. Null and empty texts are not."""
    return _over(documents, lambda c, key, text: (key,) if c.damaged(text) else None, "doc_id long")


def restored_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, restored, channels) of the damaged texts; what can't be restored stays as it is."""
    return _over(documents, lambda c, key, text: (key, *c.restore(text)) if c.damaged(text) else None, "doc_id long, restored string, channels string")
