"""Word-level BPE by speculation and verification.

Greedy longest match proposes the tokens of a word. The proposal is what BPE
gives if and only if each token is what BPE makes of its own string and each
adjacent pair is compatible: while the merges of both tokens are replayed in
rank order, no merge across their border ever comes first. That check runs for
all distinct pairs of a batch at once in numpy; only words that fail it are
merged exactly. The tokenizer's file is a parameter.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, map_batches, stretches, texts

NEVER = np.int64(1) << 40
#: Starts a chunk that is one pre-token as it stands; no text holds it.
MARK = "\ud800"
#: Characters of texts whose chunks are held at a time.
HELD = 1 << 20


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    letter = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [letter[b] for b in range(256)]


@functools.cache
def settled(letter: str) -> bool:
    """Whether all Unicode versions since 3.2 class the letter alike; those of Python, regex and the library differ."""
    return unicodedata.ucd_3_2_0.category(letter) != "Cn"


def little(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Pieces:
    """A text's pre-tokens under a tokenizer file of this kind: NFC, lower case, a split that keeps matches."""

    def __init__(self, spec: dict):
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if steps != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"] or level["type"] != "ByteLevel" or level["add_prefix_space"]:
            raise ValueError("not a lower-casing word BPE file")
        pattern = split["pattern"]["Regex"]
        self.any = regex.compile(pattern).findall
        lower = pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9").replace(r"\s", r"\x20\x09-\x0d")
        self.ascii = re.compile(lower).findall
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.rules = {k: spec[k] for k in ("version", "normalizer", "pre_tokenizer")}
        self.rare = re.compile("[^\x00-\u024f]").search
        self.marks = {MARK + s for s in self.added}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.added)) + ")").split

    def chunks(self, text: str) -> list[str]:
        """What stands between white space, in lower case; no pre-token crosses it. Added tokens stand alone after MARK."""
        if "<|" in text and len(parts := self.cut(text)) > 1:
            return [c for k, x in enumerate(parts) for c in ([MARK + x] if k % 2 else self.chunks(x))]
        if not text.isascii():  # letter by letter, as the library does: no final sigma
            if self.rare(text) and not all(map(settled, set(text))):
                return self.unsettled(text)
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:  # white space to split() alone
            return regex.split(r"\s+", text)
        return text.split()

    def unsettled(self, text: str) -> list[str]:
        """Pre-tokens as the library's own Unicode tables give them, each a chunk."""
        from tokenizers import Tokenizer

        if not hasattr(self, "library"):
            model = {"type": "BPE", "vocab": {}, "merges": []}
            self.library = Tokenizer.from_str(json.dumps({**self.rules, "added_tokens": [], "model": model}))
            self.bytes = {ord(x): b for b, x in enumerate(byte_letters())}
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [MARK + bytes(self.bytes[ord(x)] for x in piece).decode() for piece, _ in found]

    def of_chunk(self, chunk: str) -> list[str]:
        if chunk[:1] == MARK:
            return [chunk if chunk in self.marks else chunk[1:]]
        return self.ascii(chunk) if chunk.isascii() else self.any(chunk)

    def __call__(self, text: str) -> list[str]:
        """A text's pre-tokens."""
        return [w for c in self.chunks(text) for w in self.of_chunk(c)]


class Merges:
    """Vocabulary and merges of a word BPE, as arrays by token id."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, tail = model["vocab"], model["end_of_word_suffix"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        size = max([*vocab.values(), *(x["id"] for x in spec["added_tokens"])]) + 1
        self.letters = byte_letters()
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.rank = np.full(size, -1, np.int64)
        self.text = [""] * size
        for s, i in [*vocab.items(), *((x["content"], x["id"]) for x in spec["added_tokens"])]:
            self.text[i] = s
        self.by_rank = np.array([vocab[a + b] for a, b in pairs], np.int64)
        x, y, z = np.array([vocab[a] for a, _ in pairs], np.int64), np.array([vocab[b] for _, b in pairs], np.int64), self.by_rank
        if len(np.unique(z)) < len(z) or len(np.unique(x << 32 | y)) < len(z):
            raise ValueError("two merges give one token")
        self.left[z], self.right[z], self.rank[z] = x, y, np.arange(len(z))
        order = np.argsort(x << 32 | y)
        self.codes, self.code_ranks = (x << 32 | y)[order], order
        self.inner = {s: i for s, i in vocab.items() if not s.endswith(tail)}
        self.final = {s[: -len(tail)]: i for s, i in vocab.items() if s.endswith(tail)}
        self.longest = max(map(len, self.inner))
        self.canonical = np.ones(size, bool)
        made = np.flatnonzero(self.rank >= 0)
        order = made[np.argsort(self.rank[made])]
        apart = self.apart(self.left[order], self.right[order], self.rank[order])
        for z, ok in zip(order.tolist(), apart.tolist()):
            self.canonical[z] = ok and self.canonical[self.left[z]] and self.canonical[self.right[z]]

    def ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        code = x << 32 | y
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.code_ranks[at], NEVER)

    def apart(self, x: np.ndarray, y: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether BPE of x's and y's strings, joined, never merges across their border before rank until.

        Replays both tokens' merges backwards: at each state the pair at the
        border must not merge before the next merge that takes up either side.
        Of equal ranks the left one comes first.
        """
        x, y = x.copy(), y.copy()
        ok = np.ones(len(x), bool)
        end_x = np.full(len(x), NEVER) if until is None else until.copy()
        end_y = end_x - 1 if until is not None else end_x.copy()
        live = np.arange(len(x))
        while len(live):
            a, b = x[live], y[live]
            r = self.ranks(a, b)
            bad = (r < end_x[live]) & (r <= end_y[live]) & (r < NEVER)
            ok[live[bad]] = False
            undo_x = self.rank[a] > self.rank[b]
            more = ~bad & ((self.rank[a] >= 0) | (self.rank[b] >= 0))
            left, right = live[more & undo_x], live[more & ~undo_x]
            end_x[left], x[left] = self.rank[x[left]], self.right[x[left]]
            end_y[right], y[right] = self.rank[y[right]], self.left[y[right]]
            live = live[more]
        return ok

    def spell(self, word: str) -> str:
        """The word's bytes as letters."""
        return word if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode()])

    def propose(self, letters: str) -> list[int]:
        """Greedy longest match."""
        out, at, n, inner, final = [], 0, len(letters), self.inner, self.final
        while True:
            if (last := final.get(letters[at:])) is not None:
                out.append(last)
                return out
            for end in range(min(n - 1, at + self.longest), at, -1):
                if (x := inner.get(letters[at:end])) is not None:
                    out.append(x)
                    at = end
                    break

    def exact(self, spelled: list[str]) -> list[list[int]]:
        """Merging by rank, leftmost first, for many words at once."""
        out: list[list[int]] = [[]] * len(spelled)
        for at in range(0, len(order := sorted(range(len(spelled)), key=lambda k: len(spelled[k]))), 4096):
            own = order[at : at + 4096]
            rows = np.full((len(own), len(spelled[own[-1]])), -1, np.int64)
            for j, k in enumerate(own):
                s = spelled[k]
                rows[j, : len(s)] = [*map(self.inner.__getitem__, s[:-1]), self.final[s[-1]]]
            self.merge_rows(rows)
            for k, x, n in zip(own, rows.tolist(), (rows >= 0).sum(axis=1).tolist()):
                out[k] = x[:n]
        return out

    def merge_rows(self, rows: np.ndarray) -> None:
        """Applies all merges to rows of ids, in place; -1 pads them."""
        if rows.shape[1] < 2:
            return
        live, ids = np.arange(len(rows)), rows
        rank = np.where(rows[:, 1:] >= 0, self.ranks(rows[:, :-1], rows[:, 1:]), NEVER)
        cols = np.arange(rows.shape[1])
        while True:
            k = rank.argmin(axis=1)
            best = rank[np.arange(len(k)), k]
            if not (go := best < NEVER).all():
                rows[live[~go]] = ids[~go]
                live, ids, rank, k, best = live[go], ids[go], rank[go], k[go], best[go]
            if not len(live):
                return
            each = np.arange(len(live))
            shift = cols + (cols > k[:, None])
            ids = np.take_along_axis(np.c_[ids, np.full(len(ids), -1)], shift, axis=1)
            rank = np.take_along_axis(np.c_[rank, np.full(len(ids), NEVER)], shift[:, :-1], axis=1)
            ids[each, k] = self.by_rank[best]
            for j in (k - 1, k):
                inside = (j >= 0) & (j < rank.shape[1])
                e, c = each[inside], j[inside]
                x, y = ids[e, c], ids[e, c + 1]
                rank[e, c] = np.where(y >= 0, self.ranks(x, y), NEVER)

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; words are not empty."""
        spelled = [*map(self.spell, words)]
        found = [self.propose(s) for s in spelled]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for x in found for i in x), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(found)), sizes)
        failed = np.zeros(len(found), bool)
        failed[owner[~self.canonical[flat]]] = True
        pair = np.flatnonzero(owner[1:] == owner[:-1])
        codes, back = np.unique(flat[pair] << 32 | flat[pair + 1], return_inverse=True)
        ok = self.apart(codes >> 32, codes & 0xFFFFFFFF)
        failed[owner[pair[~ok[back]]]] = True
        again = np.flatnonzero(failed).tolist()
        for k, ids in zip(again, self.exact([spelled[k] for k in again])):
            found[k] = ids
        return found


class Encoder:
    """Whole texts to ids and back; the ids of words and chunks are kept in a store that is bounded by bytes."""

    #: Bytes and lot of the store.
    kept = (48 << 20, 160_000)

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.pieces, self.merges = Pieces(spec), Merges(spec)
        self.added = {MARK + s: np.array([i], "<u4").tobytes() for s, i in self.pieces.added.items()}
        self.known = Store(*self.kept)
        self.forget()

    def forget(self) -> None:
        """Empties the store."""
        self.known.clear()
        self.known.update(self.added)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        return self.merges.encode(words)

    def learn(self, chunks: set[str]) -> None:
        """Encodes the chunks that aren't known yet; a word is a chunk too."""
        known = self.known
        known.settle()
        known.update(self.added)
        new = [c for c in chunks if c not in known]
        split = [self.pieces.of_chunk(c) for c in new]
        self.learn_words(set().union(*split))
        known.add_all({c: b"".join([known[w] for w in x]) for c, x in zip(new, split) if c not in known})

    def learn_words(self, words: set[str]) -> None:
        """Encodes the pre-tokens that aren't known yet."""
        known = self.known
        new = [w for w in words if w not in known]
        for w, ids in zip(new, self.encode_words(new)):
            known.add(w, little(ids))

    def encode(self, text: str) -> bytes:
        """A text's ids, a stretch at a time."""
        out = []
        for part in stretches(text, HELD):
            chunks = self.pieces.chunks(part)
            self.learn(set(chunks))
            out.append(b"".join([self.known[c] for c in chunks]))
        return b"".join(out)

    def encode_batch(self, batch: list[str]):
        """Each text's ids as little-endian unsigned 32-bit integers; chunks of about HELD characters are held at a time."""
        at = 0
        while at < len(batch):
            if len(batch[at]) > HELD:
                yield self.encode(batch[at])
                at += 1
                continue
            pieces, size = [], 0
            while at < len(batch) and size < HELD and len(batch[at]) <= HELD:
                pieces.append(self.pieces.chunks(batch[at]))
                size += len(batch[at]) + 1
                at += 1
            self.learn(set().union(*pieces))
            known = self.known
            for x in pieces:
                yield b"".join([known[c] for c in x])

    def decode(self, ids: bytes) -> str:
        """The file has no decoder: tokens, special ones too, parted by blanks."""
        return " ".join(map(self.merges.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256; with keep also ids and decoded.

    Null text is the empty text, which has no ids; a very long one is encoded
    a stretch at a time; a null doc_id stays null; repeated rows give repeated
    rows, an empty table none. Other columns of docs are not read. tokenizer is
    a path that every executor has.
    """

    def make():
        own = encoder(tokenizer)

        def step(batch):
            out = {"doc_id": batch.column("doc_id"), "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
            for ids in own.encode_batch(texts(batch)):
                decoded = own.decode(ids)
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if keep:
                    out["ids"].append(np.frombuffer(ids, "<u4").astype(np.int32))
                    out["decoded"].append(decoded)
            return out

        step.done = own.known.trim
        return step

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep
    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), make, ddl)
