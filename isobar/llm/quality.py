"""Quality scores: random-indexing word vectors pooled per document, and a two-layer network.

Each word has a sparse random index vector. A word's own vector is the sum of
the index vectors of the words near it, over all documents; words go by hash
to a fixed number of rows, so that the table of vectors has one size for any
corpus. A document pools the vectors of its words. The network learns from a
bounded sample of labelled rows, and its temperature is set on rows that it
didn't learn from.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, arrow_schema, keep_rows, map_batches, pieces, release, stretches, texts

ROWS, DIM, NONZERO, NEAR = 1 << 14, 64, 4, 2
#: Rows of the vectors' table in one piece of a sum, and tasks whose pieces are summed at first.
PIECE, TASKS = 256, 1024
CLIP = 2.5
CORE = regex.compile(r"\p{L}+|[^\p{L}\s]+").findall
FEATURES = 2 * DIM + 4


def row_of(token: str) -> int:
    return zlib.crc32(token.encode()) % ROWS


CAPITALS = row_of("\0capitals")


@functools.cache
def worker_words() -> Words:
    """The reader of a worker, which keeps what it knows of words, trimmed, between tasks."""
    return Words()


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Columns and signs of each row's index vector: NONZERO of DIM, drawn from a fixed seed."""
    rng = np.random.default_rng(7)
    return rng.random((ROWS, DIM)).argsort(axis=1)[:, :NONZERO].astype(np.int64), rng.choice([-1.0, 1.0], (ROWS, NONZERO))


#: Rows, as bytes, of the marks that a word may end in.
ENDS = {x: struct.pack("<H", row_of(x + "1")) for x in ",.;:!?"}


class Words:
    """Texts as rows of the vectors' table: letter runs in lower case, runs of other signs, and a mark for capitals."""

    def __init__(self):
        self.known = Store(64 << 20)

    def of_chunk(self, chunk: str) -> bytes:
        if chunk.isascii():  # most chunks are a word in small letters, or one and a mark
            word = chunk[:-1] if chunk[-1] in ENDS else chunk
            if word.isalpha() and word.islower():
                row = struct.pack("<H", zlib.crc32(word.encode()) % ROWS)
                return row if word is chunk else row + ENDS[chunk[-1]]
        out = []
        for x in CORE(chunk):
            if x[0].isalpha():
                out.append(row_of(x.lower()))
                if len(x) > 1 and x.isupper():
                    out.append(CAPITALS)
            else:
                out.append(row_of("".join(sorted(set("0" if c.isdigit() else c for c in x))) + str(min(len(x), 4))))
        return struct.pack(f"<{len(out)}H", *out)

    def __call__(self, text: str) -> np.ndarray:
        known, out = self.known, []
        for part in stretches(text):
            chunks = part.split()
            known.add_all({c: self.of_chunk(c) for c in set(chunks) if c not in known})
            out.append(b"".join([known[c] for c in chunks]))
            known.settle()
        return np.frombuffer(b"".join(out), "<u2")


#: Words whose contexts are added at once.
BLOCK = 100_000


def add_texts(total: np.ndarray, held: list[np.ndarray], columns: np.ndarray, signs: np.ndarray) -> None:
    """Adds the contexts of several texts, given as rows, BLOCK words at a time; words NEAR a cut are seen from both sides."""
    rows, owner = np.concatenate(held), np.repeat(np.arange(len(held)), [*map(len, held)])
    for at in range(0, len(rows), BLOCK):
        end = min(at + BLOCK, len(rows))
        add_contexts(total, rows[at:end], columns, signs, owner[at:end])
        low, high = max(at, end - NEAR), min(end + NEAR, len(rows))
        for i in range(low, end):  # pairs across the cut
            for j in range(end, min(i + NEAR + 1, high)):
                if owner[i] == owner[j]:
                    for x, y in ((rows[i], rows[j]), (rows[j], rows[i])):
                        np.add.at(total, int(x) * DIM + columns[y], signs[y])


def add_contexts(total: np.ndarray, rows: np.ndarray, columns: np.ndarray, signs: np.ndarray, kept: np.ndarray | None = None) -> None:
    """Adds to total (flat) what each word sees up to NEAR words away; kept[k]: word k and the next are of one text."""
    rows = rows.astype(np.int64)
    for near in range(1, NEAR + 1):
        a, b = rows[:-near], rows[near:]
        if kept is not None:
            together = kept[: len(rows) - near] == kept[near:]
            a, b = a[together], b[together]
        if not len(a):
            continue
        for x, y in ((a, b), (b, a)):
            at, by = (x[:, None] * DIM + columns[y]).ravel(), signs[y].ravel()
            total += np.bincount(at, by, minlength=ROWS * DIM)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The table of word vectors over all rows of docs, rows of unit length.

    Each task sums its share into one table of fixed size and hands it on in
    pieces. The pieces of TASKS tasks at a time are summed as they stream by,
    and these sums once more, so that a reducer reads a bounded number of
    pieces of a table however many tasks there are. The driver gets ROWS x DIM
    numbers, whatever the corpus.
    """
    ddl = "piece int, tasks int, sums binary"
    schema = arrow_schema(ddl)

    def batch_of(sums: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in sums], pa.int32()), pa.array([t for _, t in sums], pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], schema=schema)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = worker_words(), np.zeros(ROWS * DIM)
        columns, signs = index_vectors()
        for batch in (p for b in batches for p in pieces(b)):
            held, size = [], 0
            for k, text in enumerate(texts(batch)):
                held.append(words(text))
                size += len(held[-1])
                if size > BLOCK or k == batch.num_rows - 1:
                    add_texts(total, held, columns, signs)
                    held, size = [], 0
        found = total.astype(np.int32).reshape(-1, PIECE * DIM)
        group = TaskContext.get().partitionId() // TASKS
        yield batch_of({(k, group): x for k, x in enumerate(found) if x.any()})
        words.known.trim()
        del total, columns, signs, found
        release()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, t, x in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(x, np.int32 if len(x) == PIECE * DIM * 4 else np.int64)
                sums[k, t] = sums.get((k, t), 0) + x.astype(np.int64)
        if sums:
            yield batch_of(sums)
        release()

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(local, ddl).repartition("piece", "tasks").mapInArrow(gather, ddl)
    found = found.withColumn("tasks", F.lit(0)).repartition("piece").mapInArrow(gather, ddl).collect()
    table = np.zeros((ROWS // PIECE, PIECE * DIM))
    for r in found:
        table[r.piece] = np.frombuffer(r.sums, np.int64)
    table = table.reshape(ROWS, DIM)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(rows: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """A document's features: mean vector, mean product of neighbours' vectors, repeats, variety, length."""
    out = np.zeros(FEATURES, np.float32)
    n = len(rows)
    if n:
        for at in range(0, n, 1 << 15):  # neighbours across blocks included
            v = vectors[rows[at : at + (1 << 15) + 1]]
            own = v[: 1 << 15]
            out[:DIM] += own.sum(axis=0)
            if len(v) > 1:
                out[DIM : 2 * DIM] += np.einsum("ij,ij->j", v[:-1], v[1:])
        out[: 2 * DIM] *= 8 / n
        out[DIM : 2 * DIM] *= 4
        out[2 * DIM] = (rows[1:] == rows[:-1]).mean() if n > 1 else 0
        seen = np.bincount(rows, minlength=1)
        out[2 * DIM + 1] = np.count_nonzero(seen) / n
        out[2 * DIM + 2] = np.log1p(n) / 4
        out[2 * DIM + 3] = seen.max() / n
    return out


@dataclass
class Network:
    """Two layers of weights, inputs scaled, logits divided by a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.scaled(x) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """Inputs in deviations from the mean, within CLIP, so that odd documents don't run off the learnt range."""
        return np.clip((x - self.mean) / self.scale, -CLIP, CLIP)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, apart: np.ndarray, hidden: int = 32, updates: int = 4000, decay: float = 1e-4) -> Network:
    """Learns from the rows that aren't apart, by Adam with a fixed seed; the rows apart set the temperature."""
    rng = np.random.default_rng(11)
    own = ~apart if (~apart).any() else np.ones(len(y), bool)
    mean, scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-3
    net = Network(mean, scale, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0)
    z, t = net.scaled(x[own]), y[own].astype(float)
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step, epochs = 0, -(-updates * 128 // len(t))
    for epoch in range(epochs):
        order = rng.permutation(len(t))
        for at in range(0, len(t), 128):
            k = order[at : at + 128]
            h = np.tanh(z[k] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30)))
            d = (p - t[k]) / len(k)
            dh = d[:, None] * params[2] * (1 - h * h)
            grads = [z[k].T @ dh + decay * params[0], dh.sum(axis=0), h.T @ d + decay * params[2], d.sum(keepdims=True)]
            step += 1
            rate = 3e-3 * (1 - epoch / epochs)
            for q, g, (m, v) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.b2 = float(params[3][0])
    if apart.any():
        logits, t = net.logits(x[apart]), y[apart]
        net.temperature = min(np.geomspace(0.25, 8, 41), key=lambda s: np.logaddexp(0, np.where(t == 1, -logits, logits) / s).mean())
    return net


def remainder(doc_id) -> F.Column:
    """crc32 of doc_id as text, mod 5; null counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def features(docs: DataFrame, vectors: np.ndarray, extra: str = "") -> DataFrame:
    """Pooled features as bytes (x) beside doc_id and the columns of extra."""
    def make():
        words = worker_words()

        def step(batch):
            out = {n: batch.column(n) for n in batch.schema.names if n != "text"}
            return out | {"x": [pooled(words(t), vectors).tobytes() for t in texts(batch)]}

        step.done = words.known.trim
        return step

    return map_batches(docs, make, f"doc_id long, {extra}x binary")


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, label: str = "quality", most: int = 20_000) -> Network:
    """A network from at most `most` labelled documents whose remainder isn't 0, the least by hash of doc_id.

    Rows with a null id or label don't count; of several labels of a document
    the least holds, and of several texts that of the least hash, so that
    `most` bounds what reaches the driver. Without any row to learn from every
    score is 0.5.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y is not null").groupBy("doc_id").agg(F.min("y").alias("y"))
    known = known.filter(remainder(F.col("doc_id")) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    found = features(rows, vectors, "y int, ").collect()
    if not found:
        return Network(np.zeros(FEATURES), np.ones(FEATURES), np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), 0.0)
    found.sort(key=lambda r: (r.doc_id, r.x))
    ids = [r.doc_id for r in found]
    apart = np.array([zlib.crc32(b"calibrate%d" % i) % 6 == 0 for i in ids])
    x = np.frombuffer(b"".join(r.x for r in found), np.float32).reshape(len(found), FEATURES)
    return train(x, np.array([r.y for r in found]), apart)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, most: int = 20_000) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted.

    Word vectors come from all documents, the network from labelled rows that
    aren't held out. Null text is the empty text and gets a score too, a very
    long one is read whole, a stretch at a time; a null doc_id stays null;
    repeated rows give repeated rows, an empty table none. Other columns are
    never read.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    vectors = word_vectors(plain)
    net = fit(plain, labels, vectors, most=most)

    def make():
        words = worker_words()

        def step(batch):
            x = np.array([pooled(words(t), vectors) for t in texts(batch)])
            return {"doc_id": batch.column("doc_id"), "score": net(x)}

        step.done = words.known.trim
        return step

    out = map_batches(plain, make, "doc_id long, score double")
    return out.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = 20_000) -> DataFrame:
    """docs without those that score() predicts 0, all columns kept whatever their names.

    Scores are by text alone: ids of any kind may repeat or be null, repeated
    rows stay or go together, a null text is judged as the empty text and a
    very long one as a whole. An empty table gives an empty one.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vectors = word_vectors(plain)
    net = fit(plain, labels, vectors, most=most)

    def make():
        words = worker_words()

        def step(batch):
            return net(np.array([pooled(words(t), vectors) for t in texts(batch)])) >= threshold

        step.done = words.known.trim
        return step

    return keep_rows(docs, make)
