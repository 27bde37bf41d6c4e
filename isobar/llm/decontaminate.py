"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit distance.

Items and texts are sequences of words. An item is in a text if some run of
the text's words is within the share `edits` of the item's words in word edit
distance. The CGK walk reads a word per step, emits it and moves on or stays by
a random bit of the word and step, so that close sequences give embeddings of
small Hamming distance. Repeated walks and samples of their positions are
hashed; the buckets of all items are the index, and a window of a text is
verified exactly against the items whose bucket it meets. Which windows are
embedded is a matter of cost alone: by the q-gram lemma a run that is close to
an item keeps a number of the item's q-word grams on nearby diagonals, and
windows of an item's size where no item of that size has so many are passed
over, which loses none.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, keep_rows, map_batches, stretches, texts

WORDS = regex.compile(r"\w+").findall
#: Random walks, hash tables of each, sampled positions of a table.
WALKS, TABLES, SAMPLED = 12, 12, 2
#: Words of benchmark items in one block; each block is one pass over the texts.
BLOCK_WORDS = 2_000_000
#: Words of a text that are gone through at a time, gram matches and windows held at a time.
PART, HITS, WINDOWS = 1 << 15, 1 << 20, 4096
NONE = bytes(4)


def words_of(text: str) -> list[str]:
    return WORDS(text.lower())


def allowed(m: int, edits: float) -> int:
    """Word edits that an item of m words may have."""
    return math.floor(edits * m + 1e-9)


def gram(m: int, edits: float) -> tuple[int, int]:
    """q, and how many of its q-grams an item of m words keeps within allowed(m) edits; q is the largest of 1 to 3 that keeps any."""
    k = allowed(m, edits)
    return max((q, m - q + 1 - k * q) for q in (1, 2, 3) if q <= m and (m - q + 1 - k * q > 0 or q == 1))


def distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least word edit distance of item to any run of text, and the first such run to end (start, end)."""
    n = len(text)
    cols = np.arange(n + 1)
    row, origin = np.zeros(n + 1, np.int64), cols.copy()
    for i, w in enumerate(item, 1):
        swap = np.r_[i, row[:-1] + (text != w)]
        drop = row + 1
        take = drop < swap
        best, source = np.where(take, drop, swap), np.where(take, origin, np.r_[0, origin[:-1]])
        best[0], source[0] = i, 0
        slack = best - cols
        low = np.minimum.accumulate(slack)
        at = np.maximum.accumulate(np.where(slack == low, cols, 0))  # the last place that the running least came from
        row, origin = low + cols, source[at]
    end = int(row.argmin())
    return int(row[end]), int(origin[end]), end


class Index:
    """Items of one block: their grams, and the buckets of their embeddings."""

    def __init__(self, items: list[tuple[int, list[str]]], edits: float):
        self.edits = edits
        self.ids = [i for i, _ in items]
        self.vocab: dict[str, int] = {}
        self.items = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], np.int64) for _, words in items]
        self.grams = [gram(len(x), edits) for x in self.items]
        codes: dict[int, list[tuple[np.ndarray, ...]]] = defaultdict(list)
        sizes: dict[int, list[int]] = defaultdict(list)
        for j, x in enumerate(self.items):
            q = self.grams[j][0]
            own = self.code(x, q)
            codes[q].append((own, np.full(len(own), j), np.arange(len(own))))
            sizes[len(x)].append(j)
        self.seeds = {}
        for q, rows in codes.items():
            code, item, at = (np.concatenate(c) for c in zip(*rows))
            order = np.lexsort((at, item, code))
            self.seeds[q] = code[order], item[order], at[order]
        self.longest = max(sizes, default=0)
        rng = np.random.default_rng(5)
        self.moves = rng.integers(1 << 20, 1 << 62, (2 * self.longest + 1, WALKS, 1)).astype(np.uint64) | np.uint64(1)
        self.picks = rng.random((WALKS, TABLES, SAMPLED))
        #: By size: the buckets of all items of it, ascending, and whose they are.
        self.index = {}
        for m, own in sizes.items():
            keys = np.concatenate([self.buckets(self.items[j], np.zeros(1, np.int64), m) for j in own]).ravel()
            order = np.argsort(keys, kind="stable")
            self.index[m] = keys[order], np.repeat(own, WALKS * TABLES)[order]
        self.spelled = {w: np.array([i], "<u4").tobytes() for w, i in self.vocab.items()}
        self.known = Store()

    def code(self, x: np.ndarray, q: int) -> np.ndarray:
        """Each q-gram as a number, exact for q = 1 and a 64-bit hash beyond; only grams of known words are looked up."""
        out = np.zeros(max(0, len(x) - q + 1), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(q):
                out = (out ^ x[j : len(x) - q + 1 + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
        return out.view(np.int64)

    def buckets(self, x: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
        """Bucket keys of the windows of m words at starts: a row of WALKS x TABLES keys each.

        All walks step together, reading the text in place; what lies beyond a
        window or the text's end reads as one mark. Places are sampled within
        the first 1.8 m steps, where most walks still read the window. A word
        of number 0, that no item has, moves a walk like any other. Only what
        is emitted at sampled places is kept.
        """
        n, steps = len(starts), max(1, int(1.8 * m))
        padded = np.r_[x, -1].astype(np.uint64)
        mark = np.uint64(2**64 - 1)
        stop = np.minimum(starts + m, len(x))
        at = np.repeat(starts[None, :], WALKS, axis=0)
        places = (self.picks * steps).astype(np.int64).reshape(WALKS, TABLES * SAMPLED)
        emitted = np.empty((WALKS, TABLES * SAMPLED, n), np.uint64)
        due = [np.nonzero(places == s) for s in range(steps)]
        with np.errstate(over="ignore"):
            for s in range(steps):
                word = np.where(at < stop, padded[at], mark)
                walk, slot = due[s]
                emitted[walk, slot] = word[walk]
                at += ((word + np.uint64(1)) * self.moves[s] >> np.uint64(40) & np.uint64(1)).astype(np.int64)
                np.minimum(at, stop, out=at)
            key = np.arange(m * WALKS * TABLES, (m + 1) * WALKS * TABLES, dtype=np.uint64).reshape(WALKS, TABLES, 1) * np.uint64(0x9E3779B97F4A7C15)
            sampled = emitted.reshape(WALKS, TABLES, SAMPLED, n)
            for k in range(SAMPLED):
                key = (key ^ sampled[:, :, k]) * np.uint64(0xBF58476D1CE4E5B9)
                key ^= key >> np.uint64(31)
        return key.reshape(-1, n).T

    def of_chunk(self, chunk: str) -> bytes:
        word = chunk.strip(".,;:!?")
        if word.isascii() and word.isalnum():  # one word, as WORDS has it
            return self.spelled.get(word, NONE)
        return b"".join([self.spelled.get(w, NONE) for w in WORDS(chunk)])

    def rows(self, text: str) -> bytes:
        """A text's words as numbers of 4 bytes, 0 where no item has the word; words are cut as those of items are."""
        known, out = self.known, []
        for part in stretches(text.lower()):
            chunks = part.split()
            known.add_all({c: self.of_chunk(c) for c in set(chunks) if c not in known})
            out.append(b"".join([known[c] for c in chunks]))
            known.settle()
        return b"".join(out)

    def read(self, text: str) -> list[tuple[int, int, int, int]]:
        """find() in a text."""
        return self.find(np.frombuffer(self.rows(text), "<u4").astype(np.int64))

    def hits(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(item, diagonal) of all grams that items have in common with a text, some items at a time so that about HITS are held."""
        found, total = [], 0
        for q, (codes, items, places) in self.seeds.items():
            if len(x) < q:
                continue
            full = x[: len(x) - q + 1] > 0
            for j in range(1, q):
                full &= x[j : len(x) - q + 1 + j] > 0
            at = np.flatnonzero(full)
            if not len(at):
                continue
            own = self.code(x, q)[at]
            low, high = np.searchsorted(codes, own), np.searchsorted(codes, own, "right")
            some = high > low
            if some.any():
                found.append((at[some], low[some], (high - low)[some], items, places))
                total += int((high - low).sum())
        lots = -(-total // HITS)
        for lot in range(lots):
            out = []
            for at, low, count, items, places in found:
                ends = np.cumsum(count)
                for s in range(0, int(ends[-1]), HITS):  # HITS entries of the text's grams at a time
                    e = min(s + HITS, int(ends[-1]))
                    k = np.searchsorted(ends, np.arange(s, e), "right")
                    entry = low[k] + np.arange(s, e) - (ends - count)[k]
                    mine = slice(None) if lots == 1 else items[entry] % lots == lot
                    out.append((items[entry][mine], (at[k] - places[entry])[mine]))
            yield tuple(np.concatenate(c) for c in zip(*out))

    def bands(self, x: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """By size of items: ranges of starts, least and greatest, where the text keeps enough grams of an item on nearby diagonals."""
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item, diagonal in self.hits(x):
            order = np.lexsort((diagonal, item))
            item, diagonal = item[order], diagonal[order]
            cuts = np.flatnonzero(np.r_[True, item[1:] != item[:-1], True])
            for s, e in zip(cuts, cuts[1:]):
                j = int(item[s])
                m = len(self.items[j])
                need, k = max(1, self.grams[j][1]), allowed(m, self.edits)
                if e - s < need:
                    continue
                d = diagonal[s:e]
                good = np.flatnonzero(d[need - 1 :] - d[: e - s - need + 1] <= 2 * k)
                out[m] += zip((d[good + need - 1] - 2 * k).tolist(), (d[good] + 2 * k).tolist())
        return out

    def candidates(self, x: np.ndarray, m: int, ranges: list[tuple[int, int]]) -> dict[int, np.ndarray]:
        """By item of m words: ascending starts of windows that meet one of its buckets."""
        keys, owners = self.index[m]
        near = np.zeros(len(x) + 1, np.int64)
        for a, b in ranges:
            near[min(max(a, 0), len(x))] += 1
            near[min(max(b + 1, 0), len(x))] -= 1
        starts = np.flatnonzero(np.cumsum(near[:-1]) > 0)
        found: dict[int, list[np.ndarray]] = defaultdict(list)
        for at in range(0, len(starts), WINDOWS):
            some = starts[at : at + WINDOWS]
            own = self.buckets(x, some, m)
            low = np.searchsorted(keys, own)
            window, table = np.nonzero(keys[np.minimum(low, len(keys) - 1)] == own)
            low = low[window, table]
            while len(window):  # all items of a bucket, one after the other
                for j in np.unique(owners[low]):
                    found[int(j)].append(some[np.unique(window[owners[low] == j])])
                more = (low + 1 < len(keys)) & (keys[np.minimum(low + 1, len(keys) - 1)] == keys[low])
                window, low = window[more], low[more] + 1
        return {j: np.unique(np.concatenate(s)) for j, s in found.items()}

    def find(self, x: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, edits, start, end) of each item in a text, at its best place; x: the text's words as numbers.

        A long text is gone through in parts that overlap by the longest item
        and its edits.
        """
        best: dict[int, tuple[int, int, int]] = {}
        over = self.longest + 4 * allowed(self.longest, self.edits) + 4
        for first in range(0, max(1, len(x) - over), PART):
            own = x[first : first + PART + over]
            for m, ranges in self.bands(own).items():
                k = allowed(m, self.edits)
                for j, near in self.candidates(own, m, ranges).items():
                    for group in np.split(near, np.flatnonzero(np.diff(near) > m) + 1):
                        if best.get(j, (1,))[0] == 0:
                            break
                        low, high = max(0, int(group[0]) - k), int(group[-1]) + m + k
                        d, s, e = distance(self.items[j], own[low:high])
                        if d <= k and (j not in best or (d, first + low + s) < best[j][:2]):
                            best[j] = (d, first + low + s, first + low + e)
        return [(j, *v) for j, v in sorted(best.items())]


def blocks(benchmark: DataFrame, edits: float, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """Indexes of the items in blocks of about BLOCK_WORDS words; items without words are left out.

    The driver holds one block at a time: what tasks get of it Spark ships as a
    broadcast file once the next is made.
    """
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / (6 * BLOCK_WORDS)))
    for b in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect() if n > 1 else items.collect()
        found = [(r.item_id, words_of(r.text)) for r in sorted(rows, key=lambda r: (r.item_id is not None, r.item_id or 0, r.text))]
        found = [x for x in found if x[1]]
        if found:
            yield Index(found, edits)


def matches(docs: DataFrame, benchmark: DataFrame, edits: float = 0.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, item_id, n_edits, start, n_words) per row of docs and benchmark item in it, at the best place.

    n_edits is the word edit distance, at most the share edits of the item's
    words; start counts the text's words. Case, punctuation and white space
    don't count; words are runs of letters, digits and _ in items and texts
    alike. Null or empty texts have no match, empty items match nothing; very
    long texts are gone through in parts that overlap, very long items take
    memory by their words and few windows. Null ids stay null; repeated rows
    give repeated rows; an empty table on either side gives none. Only the
    named columns are read.
    """
    ddl = "doc_id long, item_id long, n_edits long, start long, n_words long"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], ddl)
    for index in blocks(benchmark, edits):

        def make(index=index):
            def step(batch):
                found = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                    found += [(doc_id, index.ids[j], d, s, e - s) for j, d, s, e in index.read(text)]
                return dict(zip(("doc_id", "item_id", "n_edits", "start", "n_words"), zip(*found) if found else ([],) * 5))

            step.done = index.known.clear
            return step

        out = out.union(map_batches(rows, make, ddl))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, edits: float = 0.2, text_col: str = "text") -> DataFrame:
    """docs that hold no benchmark item, all columns and repeated rows kept; ids don't matter, and null texts stay.

    An empty benchmark keeps all, an empty table of documents stays empty.
    """
    for index in blocks(benchmark, edits):

        def make(index=index):
            def step(batch):
                return [not index.read(t) for t in texts(batch, text_col)]

            step.done = index.known.clear
            return step

        docs = keep_rows(docs, make)
    return docs
