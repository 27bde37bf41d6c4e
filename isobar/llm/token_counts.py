"""Token counts that follow edits: a segment tree over the pre-tokens of a document.

Each pre-token is a leaf: its characters, with the white space after it, and
its number of tokens, as rows of an array. Runs of leaves are blocks, and inner
nodes hold the characters and tokens of the blocks below them. An edit goes
down by characters, encodes only the chunks (what stands between white space)
that it touches and those beside them, puts their leaves in place of the old
ones and updates the sums on the paths of the touched blocks.
"""

from __future__ import annotations

import functools
import re
import struct
import unicodedata
from itertools import zip_longest

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import Store, map_batches, texts

#: Chunks of a new block, and leaves at which a block is cut anew.
BLOCK, MOST = 64, 512
#: Chunks with the white space after them. The tokenizer's white space has not the four separators that Python's has.
CHUNKS = re.compile(r"[\S\x1c-\x1f]+[^\S\x1c-\x1f]*|[^\S\x1c-\x1f]+").findall
CHUNK = re.compile(r"([\S\x1c-\x1f]*)").match
SPACE = re.compile(r"[^\S\x1c-\x1f]").match
REST = re.compile(r"[\S\x1c-\x1f]*[^\S\x1c-\x1f]*").match


class Encoder(bpe.Encoder):
    """The encoder of bpe, with a larger store that lasts as long as the worker."""

    kept = (64 << 20, 400_000)


class Counter:
    """Leaves of chunks, by the encoder of bpe; those of known chunks are kept as bytes, as long as the worker lasts."""

    def __init__(self, path: str):
        self.encoder = Encoder(path)
        self.known = Store(96 << 20)

    def learn(self, chunks: set[str]) -> None:
        """Works out the leaves of the chunks that aren't known yet at once.

        A leaf is (characters, tokens) of a pre-token, the last one's
        characters with the white space after it. A chunk that the tokenizer
        reads in other characters, as NFC and lower case may give, is one leaf.
        """
        known, of = self.known, self.encoder.known
        known.settle()
        of.settle()
        of.update(self.encoder.added)
        new = [c for c in chunks if c not in known]
        split = [self.read(c) for c in new]
        self.encoder.learn_words({w for words, _ in split for w in words})
        pair, found = struct.Struct("<2i").pack, {}
        for c, (words, alike) in zip(new, split):
            if len(words) == 1:
                found[c] = pair(len(c), len(of[words[0]]) >> 2)
            elif words and alike:
                row = [x for w in words for x in (len(w), len(of[w]) >> 2)]
                row[-2] += len(c) - sum(row[::2])
                found[c] = struct.pack(f"<{len(row)}i", *row)
            else:
                found[c] = pair(len(c), sum([len(of[w]) >> 2 for w in words]))
        known.add_all(found)

    def read(self, chunk: str) -> tuple[list[str], bool]:
        """A chunk's pre-tokens, and whether they have its characters one by one."""
        pieces = self.encoder.pieces
        if chunk.isascii() and "<|" not in chunk:
            return pieces.ascii(chunk.lower()), True
        parts = [p for p in pieces.chunks(chunk) if p]
        words = [w for p in parts for w in pieces.of_chunk(p)]
        alike = len(parts) == 1 and parts[0][0] != bpe.MARK and len(parts[0]) == len(CHUNK(chunk)[1]) == sum(map(len, words)) and unicodedata.is_normalized("NFC", chunk)
        return words, alike


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


class TokenTree:
    """A document's blocks of leaves and the sums above them; count knows the leaves of chunks."""

    def __init__(self, text: str, count: Counter, chunks: list[str] | None = None):
        self.count, self.encoded = count, 0
        chunks = CHUNKS(text) if chunks is None else chunks
        self.n_chunks = len(chunks) - bool(chunks and SPACE(chunks[0]))
        blocks, leaves = [], []
        for at in range(0, max(1, len(chunks)), BLOCK):
            some = chunks[at : at + BLOCK]
            blocks.append("".join(some))
            leaves.append(self.leaves(some))
        self.build(blocks, leaves)

    def leaves(self, chunks: list[str]) -> np.ndarray:
        """Rows (characters, tokens) of the pre-tokens of chunks."""
        known = self.count.known
        try:
            return np.frombuffer(b"".join([known[c] for c in chunks]), "<i4").reshape(-1, 2)
        except KeyError:
            self.count.learn(set(chunks))
            return np.frombuffer(b"".join([known[c] for c in chunks]), "<i4").reshape(-1, 2)

    def build(self, blocks: list[str], leaves: list[np.ndarray]) -> None:
        self.blocks, self.of_block = blocks, leaves
        n = len(blocks)
        self.top = 1 << (n - 1).bit_length()
        level = [*((len(b), int(x[:, 1].sum())) for b, x in zip(blocks, leaves)), *[(0, 0)] * (self.top - n)]
        levels = [level]
        while len(level) > 1:
            level = [(a + c, b + d) for (a, b), (c, d) in zip(level[::2], level[1::2])]
            levels.append(level)
        self.sums = [(0, 0), *(x for own in reversed(levels) for x in own)]

    @property
    def n_tokens(self) -> int:
        return self.sums[1][1]

    def text(self) -> str:
        return "".join(self.blocks)

    def find(self, at: int) -> tuple[int, int]:
        """The block that holds character at, or the last that holds any, and its start; the first block of an empty document."""
        k, start = 1, 0
        at = max(0, min(at, self.sums[1][0] - 1))
        if not self.sums[1][0]:
            return 0, 0
        while k < self.top:
            k *= 2
            if at >= start + self.sums[k][0]:
                start += self.sums[k][0]
                k += 1
        return k - self.top, start

    def touched(self, start: int, end: int, new: str) -> tuple[int, int, str, int, int, list[str]]:
        """What an edit touches: first and last block, their text, the stretch of it to encode anew, and that stretch's new chunks."""
        total = self.sums[1][0]
        start = max(0, min(start, total))
        end = max(start, min(end, total))
        first, origin = self.find(start - 1)  # with what stands before
        last, _ = self.find(end)  # and what comes after
        old = "".join(self.blocks[first : last + 1])
        left, right = start - origin, end - origin
        low = max(0, left - 1)  # from here back to the start of a chunk, which a leaf starts too
        while low and SPACE(old, low):
            low -= 1
        while low and not SPACE(old, low - 1):
            low -= 1
        high = REST(old, right).end()
        return first, last, old, low, high, CHUNKS(old[low:left] + new + old[right:high])

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces characters start to end by new; positions beyond the text are its end."""
        self.put(*self.touched(start, end, new))

    def put(self, first: int, last: int, old: str, low: int, high: int, chunks: list[str]) -> None:
        """Puts chunks in place of what an edit touches."""
        self.encoded += len(chunks)
        text = old[:low] + "".join(chunks) + old[high:]
        leaves = self.of_block[first] if first == last else np.concatenate(self.of_block[first : last + 1])
        ends = leaves[:, 0].cumsum()
        i, j = ends.searchsorted((low, high), "right").tolist()
        leaves = np.concatenate([leaves[:i], self.leaves(chunks), leaves[j:]])
        if len(leaves) > MOST:
            self.cut(first, last, text, leaves)
            return
        self.blocks[first : last + 1] = [text, *[""] * (last - first)]
        self.of_block[first : last + 1] = [leaves, *[leaves[:0]] * (last - first)]
        dirty = range(self.top + first, self.top + last + 1)
        for k in dirty:
            self.sums[k] = (0, 0)
        self.sums[self.top + first] = (len(text), int(leaves[:, 1].sum()))
        while dirty := sorted({k // 2 for k in dirty if k > 1}):
            for k in dirty:
                (a, b), (c, d) = self.sums[2 * k], self.sums[2 * k + 1]
                self.sums[k] = (a + c, b + d)

    def cut(self, first: int, last: int, text: str, leaves: np.ndarray) -> None:
        """Puts blocks of BLOCK chunks in place of blocks first to last; no chunk is encoded."""
        chunks = CHUNKS(text)
        texts_ = ["".join(chunks[at : at + BLOCK]) for at in range(0, len(chunks), BLOCK)]
        at = np.searchsorted(np.cumsum(leaves[:, 0]), np.cumsum([*map(len, texts_)]), "right")
        own = [leaves[s:e] for s, e in zip([0, *at], at)]
        self.build(self.blocks[:first] + texts_ + self.blocks[last + 1 :], self.of_block[:first] + own + self.of_block[last + 1 :])


def edits_of(n: int) -> list[tuple[int, int, str]]:
    """Three edits of a text of n characters, each in terms of the text that the ones before left: cut 7 characters at a quarter, put words in at half, add an end."""
    return [(n // 4, n // 4 + 7, ""), (n // 2, n // 2, " some new words, put "), (n + 64, n + 64, " The end.")]


def count_edited(docs: DataFrame, tokenizer: str, edits=edits_of, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, n_edited (tokens after edits(n_chars)), n_chunks, n_encoded (chunks encoded for the edits); with keep the edited text.

    Null text is the empty text, which may be edited too; a very long one is a
    deeper tree; a null doc_id stays null; repeated rows give repeated rows, an
    empty table none. Other columns of docs are not read.
    """

    def make():
        count = counter(tokenizer)

        def step(batch):
            all_texts = texts(batch)
            split = [CHUNKS(t) for t in all_texts]
            count.learn(set().union(*split))
            trees = [TokenTree(t, count, chunks) for t, chunks in zip(all_texts, split)]
            n_tokens = [t.n_tokens for t in trees]
            for turn in zip_longest(*(edits(len(t)) for t in all_texts)):  # a turn's new chunks are learnt together
                some = [(tree, tree.touched(*edit)) for tree, edit in zip(trees, turn) if edit]
                count.learn(set().union(*(x[-1] for _, x in some)))
                for tree, x in some:
                    tree.put(*x)
            return {
                "doc_id": batch.column("doc_id"), "n_tokens": n_tokens, "n_edited": [t.n_tokens for t in trees], "n_chunks": [t.n_chunks for t in trees],
                "n_encoded": [t.encoded for t in trees], "edited": [t.text() for t in trees] if keep else None,
            }

        return step

    ddl = "doc_id long, n_tokens long, n_edited long, n_chunks long, n_encoded long" + ", edited string" * keep
    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), make, ddl)
