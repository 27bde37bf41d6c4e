"""Token ids in binary shards with Elias-Fano document boundaries.

A shard holds a header, the concatenated ids of its documents (2 bytes each
where the vocabulary allows, else 4), the documents' ends and their doc_ids,
both as Elias-Fano sequences with a sampled select directory. No 64-bit table
of offsets is kept. Shards are written by executors in ascending doc_id order
through pyarrow's file systems (local and mounted folders, S3, GCS, HDFS); a
task that runs again writes the same bytes under the same name.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import claim
from . import bpe
from .common import Store, arrow_schema, map_batches, passing, release, stored, stretches, texts

MAGIC = b"ISOTOK01"
HEADER = struct.Struct("<8sBxxxxxxxQQQqQ")  # magic, id width, documents, ids, documents with null id, least doc_id, bytes of the ends
SAMPLE = 512
#: Ids and documents after which a shard ends; they bound a writer's and a reader's memory.
SHARD_IDS, SHARD_DOCS = 1 << 23, 1 << 18
#: Tasks that read shards; more shards than that share them.
MOST_TASKS = 20_000


class EliasFano:
    """A non-decreasing sequence of unsigned integers: low bits packed, high bits in unary, a sampled select directory."""

    head = struct.Struct("<QQB7x")

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low = max(0, (top // n).bit_length() - 1) if n else 0
        ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        high = np.zeros((top >> low) + n + 1, np.uint8)
        high[ones] = 1
        lows = []
        for at in range(0, n if low else 0, 4096):  # a multiple of 8 values fills whole bytes
            bits = (values[at : at + 4096, None] >> np.arange(low, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
            lows.append(np.packbits(bits.ravel(), bitorder="little").tobytes())
        return cls.head.pack(n, top, low) + b"".join(lows) + np.packbits(high, bitorder="little").tobytes() + ones[::SAMPLE].astype("<u4").tobytes()

    def __init__(self, data: memoryview | bytes):
        self.n, top, self.low = self.head.unpack_from(data)
        at = self.head.size
        size = (self.n * self.low + 7) // 8
        self.lows = np.frombuffer(data, np.uint8, size, at)
        at += size
        size = ((top >> self.low) + self.n + 8) // 8
        self.highs = np.frombuffer(data, np.uint8, size, at)
        self.samples = np.frombuffer(data, "<u4", -(-self.n // SAMPLE), at + size)

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """The i-th value."""
        return int(self.values(i, i + 1)[0])

    def values(self, start: int, stop: int) -> np.ndarray:
        """The values from start to before stop, selected from the nearest sample on; no others are decoded."""
        if not 0 <= start <= stop <= self.n:
            raise IndexError((start, stop))
        if start == stop:
            return np.empty(0, np.uint64)
        at, skip = int(self.samples[start // SAMPLE]), start % SAMPLE
        need, have, found = skip + stop - start, 0, []
        byte, first = at // 8, at % 8
        while have < need:
            size = max(256, (need - have) // 2)
            ones = np.flatnonzero(np.unpackbits(self.highs[byte : byte + size], bitorder="little")[first:]) + (byte * 8 + first)
            found.append(ones)
            have, byte, first = have + len(ones), byte + size, 0
        high = (np.concatenate(found)[skip:need] - np.arange(start, stop)).astype(np.uint64) << np.uint64(self.low)
        k, n = start * self.low, stop - start
        bits = np.unpackbits(self.lows[k // 8 : (k + n * self.low + 7) // 8], bitorder="little")[k % 8 : k % 8 + n * self.low].reshape(n, self.low)
        for b in range(self.low):
            high |= bits[:, b].astype(np.uint64) << np.uint64(b)
        return high

    def all(self) -> np.ndarray:
        return self.values(0, self.n)


def pack_shard(doc_ids: list, ends: list[int], ids: bytes, width: int) -> bytes:
    """One shard: documents in order, the ids that end at each, all ids as width bytes."""
    nulls = sum(x is None for x in doc_ids)
    real = np.array([x for x in doc_ids if x is not None], np.int64)
    least = int(real[0]) if len(real) else 0
    bounds = EliasFano.encode(np.array(ends, np.uint64))
    return HEADER.pack(MAGIC, width, len(doc_ids), ends[-1], nulls, least, len(bounds)) + ids + bounds + EliasFano.encode(real.view(np.uint64) - np.uint64(least % 2**64))


class Shard:
    """A shard's documents; ends.select(i) gives a boundary without reading the others."""

    def __init__(self, data: bytes):
        magic, self.width, self.n, total, self.nulls, self.least, size = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEADER.size
        self.ids = np.frombuffer(data, f"<u{self.width}", total, at)
        at += total * self.width
        self.ends, self.doc_ids = EliasFano(memoryview(data)[at : at + size]), EliasFano(memoryview(data)[at + size :])

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def bounds(self, start: int, stop: int) -> np.ndarray:
        """Where documents start to before stop begin, and where the last of them ends."""
        ends = self.ends.values(max(0, start - 1), stop).astype(np.int64)
        return ends if start else np.r_[0, ends]

    def ids_of_documents(self, start: int = 0, stop: int | None = None) -> list:
        stop = self.n if stop is None else stop
        real = self.doc_ids.values(max(0, start - self.nulls), max(0, stop - self.nulls)) + np.uint64(self.least % 2**64)
        return [None] * (min(stop, self.nulls) - min(start, self.nulls)) + real.view(np.int64).tolist()


class Known(Store):
    """A Store that works out what it hasn't."""

    def __init__(self, most: int, work_out):
        super().__init__(most)
        self.work_out = work_out

    def __missing__(self, chunk: str) -> bytes:
        self[chunk] = found = self.work_out(chunk)
        self.bytes += len(chunk) + 160
        return found


class LibraryEncoder:
    """Whole texts to ids by the tokenizers library, chunk by chunk; ids of chunks are kept, within bounds, as long as the worker lasts.

    Ids take `width` bytes: 2 where the vocabulary allows, else 4.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        own = bpe.encoder(path)
        self.pieces, self.merges = own.pieces, own.merges
        self.model = Tokenizer.from_file(path).model
        self.width = 2 if len(self.merges.text) <= 1 << 16 else 4
        self.kind = "H" if self.width == 2 else "I"
        self.known = Known(128 << 20, self.of_chunk)

    def pack(self, *ids: int) -> bytes:
        return struct.pack(f"<{len(ids)}{self.kind}", *ids)

    def of_word(self, word: str) -> bytes:
        """A pre-token's ids; one that is a token by the merges needs no more."""
        letters = self.merges.spell(word)
        whole = self.merges.final.get(letters)
        if whole is not None and self.merges.canonical[whole]:
            return self.pack(whole)
        return self.pack(*[t.id for t in self.model.tokenize(letters)])

    def of_chunk(self, chunk: str) -> bytes:
        words = self.pieces.of_chunk(chunk)
        if chunk in self.pieces.marks:
            return self.pack(self.pieces.added[chunk[1:]])
        if len(words) == 1:
            return self.of_word(words[0])
        return b"".join([self.known[w] for w in words])

    def encode_batch(self, batch: list[str]) -> Iterator[bytes]:
        """Each text's ids, a stretch at a time."""
        of = self.known.__getitem__
        for text in batch:
            out = []
            for part in stretches(text):
                out.append(b"".join(map(of, self.pieces.chunks(part))))
                self.known.settle()
            yield out[0] if len(out) == 1 else b"".join(out)


@functools.lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def open_dir(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text, ends each document with end_id and writes shards to folder in ascending doc_id order.

    Returns the manifest, one row (part, seq, name, n_docs, n_ids) per shard.
    Null text is the empty text (its ids are the end id alone), a very long one
    a shard of its own size. Documents with a null doc_id come first; rows that
    share a doc_id stand in order of their texts, and their texts alone travel
    with the ids: texts are encoded where they are read, and ids are dealt into
    ranges. An empty table writes no shard. Only the two named columns are read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    def encode():
        own = library_encoder(tokenizer)
        end = own.pack(end_id)

        def step(batch):
            ids = [x + end for x in own.encode_batch(texts(batch))]
            return {"doc_id": batch.column("doc_id"), "tie": batch.column("tie"), "ids": ids}

        return step

    ddl = "part long, seq long, name string, n_docs long, n_ids long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = library_encoder(tokenizer).width
        store, base = open_dir(folder)
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids, ends, parts, total = [], [], [], 0

        def close():
            name = f"{part:06d}-{seq:06d}.tok"
            draft = f"{base}/{name}.{TaskContext.get().taskAttemptId()}"
            with store.open_output_stream(draft) as f:
                f.write(pack_shard(doc_ids, ends, b"".join(parts), width))
            if store.get_file_info(f"{base}/{name}").type:  # of an attempt that was lost; it has the same bytes
                store.delete_file(f"{base}/{name}")
            store.move(draft, f"{base}/{name}")
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "name": name, "n_docs": len(doc_ids), "n_ids": total}], schema=schema)

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                total += len(ids) // width
                parts.append(ids)
                doc_ids.append(doc_id)
                ends.append(total)
                if total >= SHARD_IDS or len(ends) >= SHARD_DOCS:
                    yield close()
                    doc_ids, ends, parts, total, seq = [], [], [], 0, seq + 1
        if doc_ids:
            yield close()

    open_dir(folder)[0].create_dir(open_dir(folder)[1], recursive=True)
    with passing() as keep:
        repeated = stored(rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("again"), F.lit(True).alias("tied")), "token-ties")
        if repeated.isEmpty():
            rows = rows.withColumn("tie", F.lit(None).cast("string"))
        else:
            rows = rows.join(repeated, F.col("doc_id").eqNullSafe(F.col("again")), "left").select("doc_id", "text", F.when(F.col("tied"), F.coalesce("text", F.lit(""))).alias("tie"))
        encoded = stored(map_batches(rows, encode, "doc_id long, tie string, ids binary"), "token-ids", "zstd")
        dealt = encoded.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "ids")
        return keep(stored(dealt.mapInArrow(run, ddl), "token-manifest"))


def read(spark: SparkSession, folder: str, manifest: DataFrame, keep: bool = False) -> DataFrame:
    """Per document of the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32; with keep its ids.

    Documents' bounds are selected in blocks from the shards' boundaries. The
    driver sums the shards' sizes per writing task; a window gives each shard
    its start within the task.
    """
    totals, base = [], 0
    for part, n, shards in sorted(map(tuple, manifest.groupBy("part").agg(F.sum("n_ids"), F.count("*")).collect())):
        totals.append((part, base, shards))
        base += n
    n_shards = sum(x[2] for x in totals)
    own = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    before = F.broadcast(spark.createDataFrame([x[:2] for x in totals], "part long, base long"))  # a row per task that wrote
    shards = manifest.join(before, "part").select("name", (F.col("base") + F.coalesce(F.sum("n_ids").over(own), F.lit(0))).alias("start"))
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_dir(folder)
        for name, start in (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))):
            with store.open_input_file(f"{base}/{name}") as f:
                shard = Shard(f.read())
            for at in range(0, shard.n, 1024):
                stop = min(at + 1024, shard.n)
                cuts = shard.bounds(at, stop).tolist()
                wide = shard.ids[cuts[0] : cuts[-1]].astype("<u4")
                own = [wide[a - cuts[0] : b - cuts[0]] for a, b in zip(cuts, cuts[1:])]
                columns = [shard.ids_of_documents(at, stop), [start + a for a in cuts[:-1]], [len(x) for x in own], [zlib.crc32(x.tobytes()) for x in own]]
                columns += [[x.astype(np.int32) for x in own]] * keep
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        release()

    return shards.repartitionByRange(max(1, min(n_shards, MOST_TASKS)), "name").mapInArrow(run, ddl)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """write() to a new folder in the shared one, then read()."""
    spark = docs.sparkSession
    folder = claim(spark, "tokens")
    return read(spark, folder, write(docs, folder, tokenizer, end_id, id_col, text_col))
