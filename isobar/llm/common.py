"""What the corpus operators share: tables in the shared folder, batch maps, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import sys
import threading
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import claim, discard

#: Bytes of a batch that a worker turns into Python objects at a time.
PIECE_BYTES = 2 << 20
#: Bytes that stay in a worker's Store, entries met once that it may hold besides, and slots that tell which were met before.
STORE_BYTES, ONCE, SLOTS = 32 << 20, 60_000, 1 << 20
#: Bytes that stay in a Store between tasks.
TRIMMED = 24 << 20
#: Characters of a stretch of a long text.
STRETCH = 1 << 20

_open = threading.local()


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df, written once to the shared folder and read back: its lineage ends there.

    The table goes by forget(), at the end of a passing() block, or with the
    driver.
    """
    spark = df.sparkSession
    path = claim(spark, name)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    for own in getattr(_open, "blocks", [])[-1:]:
        own.append(out)
    return out


def forget(df: DataFrame) -> None:
    """Deletes the table behind a stored() frame that nothing reads any more."""
    discard(df._stored_at)


@contextlib.contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block whose stored() tables go at its end, but for those given to the function that it yields."""
    blocks = _open.__dict__.setdefault("blocks", [])
    own: list[DataFrame] = []
    kept: list[DataFrame] = []
    blocks.append(own)
    try:
        yield lambda df: kept.append(df) or df
    finally:
        blocks.pop()
        for df in own:
            if not any(df is k for k in kept):
                forget(df)
        for outer in blocks[-1:]:
            outer += [k for k in kept if any(df is k for df in own)]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl)) if isinstance(ddl, str) else to_arrow_schema(ddl)


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about PIECE_BYTES; a single row may be longer."""
    if batch.nbytes <= PIECE_BYTES:
        if batch.num_rows:
            yield batch
        return
    sizes = pa.array([0] * batch.num_rows, pa.int64())
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            sizes = pc.add(sizes, pc.fill_null(pc.binary_length(column), 0).cast(pa.int64()))
    runs = pc.divide(pc.cumulative_sum(sizes), PIECE_BYTES).to_numpy()
    cuts = [0, *((runs[1:] != runs[:-1]).nonzero()[0] + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:]):
        yield batch.slice(start, end - start)


def release() -> None:
    """Gives a worker's freed memory back to the system, as workers live on and serve other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], ddl: str) -> DataFrame:
    """Each piece of each Arrow batch through make()(piece), which gives columns by name; make runs once per task.

    What make() returns may have an attribute done, called at the task's end.
    """
    schema = T.StructType.fromDDL(ddl)
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        try:
            for batch in batches:
                for piece in pieces(batch):
                    columns = step(piece)
                    arrays = [x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for f in arrow for x in [columns[f.name]]]
                    yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        finally:
            getattr(step, "done", lambda: None)()
            del step
            release()

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """The rows of df, all columns, for which make()(piece) says true; make runs once per task, and done as in map_batches."""
    schema = df.schema
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        try:
            for batch in batches:
                for piece in pieces(batch):
                    kept = piece.filter(pa.array(step(piece), pa.bool_()))
                    if kept.num_rows:
                        yield pa.RecordBatch.from_arrays(kept.columns, schema=arrow)
        finally:
            getattr(step, "done", lambda: None)()
            del step
            release()

    return df.mapInArrow(run, schema)


class Store(dict):
    """What a worker has worked out for strings, bounded by bytes.

    Of entries given to add(), which are dear, one stays once its string comes
    a second time; those met once go in lots of `lot`, as most of a corpus's
    distinct words are rare. Entries given to add_all(), which are cheap, stay
    as they come. When what stays is over `most` bytes its later half goes, as
    frequent words come early, and each eighth time all of it, as texts change.
    Entries go in settle() alone, which the owner calls between pieces of work.
    """

    def __init__(self, most: int | None = None, lot: int | None = None):
        super().__init__()
        self.most, self.lot = most or STORE_BYTES, lot or ONCE
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.bytes, self.turns, self.marks, self.once, self.seen = 0, 0, 0, [], bytearray(SLOTS)

    def add(self, key: str, value) -> None:
        self[key] = value
        at = hash(key) % SLOTS
        if self.seen[at]:
            self.bytes += sys.getsizeof(key) + sys.getsizeof(value) + 100
        else:
            self.seen[at] = 1
            self.marks += 1
            self.once.append(key)

    def add_all(self, found: dict[str, bytes]) -> None:
        self.update(found)
        self.bytes += sum(map(len, found)) + 160 * len(found)

    def forget_once(self) -> None:
        for key in self.once:
            del self[key]
        self.once = []
        if self.marks > SLOTS // 2:
            self.seen, self.marks = bytearray(SLOTS), 0

    def trim(self) -> None:
        """What a worker keeps between tasks: the first entries that stay, up to TRIMMED bytes."""
        self.forget_once()
        if self.bytes > TRIMMED:
            n = len(self) * TRIMMED // self.bytes
            stay, seen, marks = [x for _, x in zip(range(n), self.items())], self.seen, self.marks
            self.clear()
            self.update(stay)
            self.bytes, self.seen, self.marks = TRIMMED, seen, marks

    def settle(self) -> None:
        if len(self.once) > self.lot:
            self.forget_once()
        if self.bytes > self.most:
            met = set(self.once)
            stay = [x for x in self.items() if x[0] not in met]
            stay = stay[: len(stay) // 2] if (self.turns + 1) % 8 else []
            size, turns = self.bytes // 2 if stay else 0, self.turns + 1
            self.clear()
            self.update(stay)
            self.bytes, self.turns = size, turns


BLANK = re.compile(r"[ \t\r\n]").search


def stretches(text: str, most: int | None = None) -> Iterator[str]:
    """A text in stretches of about `most` characters, each but the last ending in white space."""
    most, at = most or STRETCH, 0
    while len(text) - at > most and (m := BLANK(text, at + most)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:] if at else text


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column as strings; null is the empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def digest(df: DataFrame) -> tuple:
    """Count and order-free checksum of the rows, to see whether two frames hold the same."""
    x = F.xxhash64(*df.columns)
    return tuple(df.agg(F.count("*"), F.bit_xor(x), F.sum(x.bitwiseAND(0xFFFFFFFF))).first())


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """Connected components of edges (a, b): one row (node, root) per node of an edge, root the least node.

    Alternates large-star and small-star steps until the edges are a star
    forest. Every step is an aggregation with map-side minima, written to the
    shared folder, and a join of the edges with it on nodes. Both sides of
    that join come straight from tables, so that adaptive execution can split
    the edges of a hub; nothing is collected but a checksum. The result is one
    table. An empty table of edges gives no rows.
    """
    with passing() as keep:
        now = stored(edges.select("a", "b").filter("a <> b").distinct(), name)
        was = None
        while (seen := digest(now)) != was:
            was = seen
            with passing() as on:
                both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
                least = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), f"{name}-least")
                large = stored(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), f"{name}-large")
                least = stored(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-least")
                moved = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
                after = on(stored(moved.select("e.a", "e.b").filter("a <> b").distinct(), name))
            forget(now)
            now = after
        roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
        return keep(stored(now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots), f"{name}-roots"))
