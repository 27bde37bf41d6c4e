"""Line dedup by a deletion-neighbourhood join.

Two lines within one edit have a variant in common: the line itself, or the
line with one character deleted. Variants are emitted as hashed keys and equal
ones joined; pairs are verified by edit distance and the earliest line stays.
Only variants that can meet are emitted: a line first gives keys with a whole
block cut out (halves, then sixteenths), and characters are deleted only in
blocks whose key another line shares. Lines within one edit agree on the key
that cuts out the block of the edit, so that nothing is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, fresh, passing, pieces, release, stored, texts

#: Lines of fewer characters are not removed, by default, nor ever for an edit: one edit makes another word of a short line.
LEAST = 20
BLOCKS = 16
#: Two primes and bases of the polynomial hashes.
PRIMES, BASES = (2147483647, 2147483629), (1103515245, 69069069)


class Prefixes:
    """Polynomial hashes of a line with any range of its characters cut out, two residues packed in 62 bits."""

    powers: list[list[np.ndarray]] = [[np.ones(1, np.int64)] * 2, [np.ones(1, np.int64)] * 2]

    @classmethod
    def power(cls, n: int) -> None:
        for k, (p, b) in enumerate(zip(PRIMES, BASES)):
            for j, base in enumerate((b, pow(b, -1, p))):
                old = cls.powers[k][j]
                if len(old) <= n:
                    size = max(n + 1, 2 * len(old), 1024)
                    out = np.ones(1, np.int64)
                    while len(out) < size:
                        out = np.r_[out, out * pow(base, len(out), p) % p]
                    cls.powers[k][j] = out

    def __init__(self, line: str):
        codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
        self.n = len(codes)
        self.power(self.n + 1)
        self.sums = []
        for k, p in enumerate(PRIMES):
            sums = np.r_[0, np.cumsum(codes * self.powers[k][0][: self.n] % p)]
            self.sums.append(sums % p)

    def without(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the line without the characters start to end, for arrays of ranges."""
        parts = []
        for k, p in enumerate(PRIMES):
            s = self.sums[k]
            parts.append((s[start] + (s[-1] - s[end]) % p * self.powers[k][1][end - start]) % p)
        return parts[0] << 31 | parts[1]


def block_ranges(n: int, blocks: int = BLOCKS) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(block size, starts, ends) of the blocks to cut out of a line of n characters, so that lines of n and n + 1 agree on one cut."""
    out = []
    for least in (n, n - 1):
        w = least // blocks
        if not out or out[0][0] != w:
            q = np.arange(blocks)
            out.append((w, q * w, n - (blocks - 1 - q) * w))
    return out


def half_keys(line: Column, n: Column) -> Column:
    """Keys of a line with either half cut out, halves rounded so that lines of n and n + 1 characters agree."""
    keys = []
    for least in (n, n - 1):
        w = (F.floor(least / 16) * 8).cast("int")
        keys += [F.xxhash64(F.lit(1), w, line.substr(F.lit(1), w)), F.xxhash64(F.lit(2), w, line.substr(n - w + 1, w))]
    return F.array_distinct(F.array(*keys))


def lines_of(docs: DataFrame) -> DataFrame:
    """One row (doc_id, doc, line_no, line) per line of docs (doc_id, doc, text), lines parted by line feeds."""
    return docs.select("doc_id", "doc", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def first_seen(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Occurrences (doc_id, doc, line_no, h1, h2) of lines of `least` characters or more, and distinct lines with their first place and keys."""
    rows = lines_of(docs).withColumn("n", F.char_length("line")).filter(F.col("n") >= least)
    rows = rows.select("doc_id", "doc", "line_no", "n", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))
    keys = half_keys(F.col("line"), F.col("n"))
    if least < LEAST:
        keys = F.when(F.col("n") >= LEAST, keys).otherwise(F.array().cast("array<bigint>"))
    places = rows.select("h1", "h2", "n", place().alias("place"), keys.alias("keys"))
    firsts = places.groupBy("h1", "h2", "n", "keys").agg(F.min("place").alias("first"), F.count("*").alias("copies"))
    return rows.select("doc_id", "doc", "line_no", "h1", "h2"), firsts


def place() -> Column:
    """Where a line is, the earliest least: by doc_id, null last, then line number; doc tells rows of one doc_id apart."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("line_no").alias("line_no"), F.col("doc").alias("doc"))


def shared(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key another row has too; keys are counted with map-side sums into a table, so that adaptive execution can split a hot one's rows in the join."""
    often = stored(rows.groupBy(*key).agg(F.count("*").alias("n_")).filter("n_ > 1").select(*key), "line-keys")
    return rows.join(often, key, "left_semi")


FIRST = "first struct<none: boolean, doc_id: bigint, line_no: int, doc: bigint>"


def near_links(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """One row (first, earliest) per distinct line with an earlier line within one edit: the earliest of these.

    A line is known by its first place; (doc_id, doc) there tells one text, so
    that rows of one doc_id, or of none, are not gathered.
    """
    halves = firsts.select("first", F.explode("keys").alias("key"))
    wanted = shared(halves, ["key"]).select("first").distinct()
    per_doc = wanted.groupBy(F.col("first.doc_id").alias("id"), F.col("first.doc").alias("of")).agg(F.collect_list("first.line_no").alias("nos"))
    per_doc = stored(per_doc, "near-wanted")  # a table, so that rows that repeat a text can be split in the join
    rows = docs.join(per_doc.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("doc") == F.col("of")))
    rows = rows.select("doc_id", "doc", F.explode("nos").alias("line_no"), F.split("text", "\n").alias("all"))
    lines = stored(rows.select(place().alias("first"), F.get("all", F.col("line_no")).alias("line")).dropDuplicates(["first"]), "near-lines")

    def cut_blocks(batches):
        for batch in (p for b in batches for p in pieces(b)):
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                out = [[], [], [], []]
                for k, line in enumerate(texts(some, "line")):
                    own = Prefixes(line)
                    for w, s, e in block_ranges(own.n):
                        for col, x in zip(out, (np.full(BLOCKS, k), np.arange(BLOCKS), np.full(BLOCKS, w), own.without(s, e))):
                            col.append(x)
                k, block, w, key = map(np.concatenate, out)
                yield pa.RecordBatch.from_arrays([some.column("first").take(pa.array(k)), pa.array(block, pa.int32()), pa.array(w, pa.int32()), pa.array(key, pa.int64())], schema=block_schema)
        release()

    def delete(batches):
        for batch in (p for b in batches for p in pieces(b)):
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                out = [[], [], [], []]
                for k, (line, blocks) in enumerate(zip(texts(some, "line"), some.column("blocks").to_pylist())):
                    own = Prefixes(line)
                    ranges = {w: (s, e) for w, s, e in block_ranges(own.n)}
                    spots = np.unique(np.concatenate([np.arange(ranges[b["w"]][0][b["block"]], ranges[b["w"]][1][b["block"]]) for b in blocks]))
                    zero = np.zeros(1, np.int64)
                    out[0].append(np.full(len(spots) + 1, k))
                    out[1].append(np.r_[own.without(zero, zero), own.without(spots, spots + 1)])
                    out[2].append(np.r_[-1, spots])
                    out[3].append(np.r_[own.n, np.full(len(spots), own.n - 1)])
                k, key, at_, n = map(np.concatenate, out)
                yield pa.RecordBatch.from_arrays([some.column("first").take(pa.array(k)), pa.array(key, pa.int64()), pa.array(at_, pa.int32()), pa.array(n, pa.int32())], schema=variant_schema)
        release()

    block_ddl, variant_ddl = f"{FIRST}, block int, w int, key long", f"{FIRST}, key long, place int, n int"
    block_schema, variant_schema = arrow_schema(block_ddl), arrow_schema(variant_ddl)
    cut = shared(lines.mapInArrow(cut_blocks, block_ddl), ["block", "w", "key"])
    open_blocks = cut.groupBy("first").agg(F.collect_set(F.struct("block", "w")).alias("blocks"))
    variants = stored(lines.join(open_blocks, "first").select("first", "line", "blocks").mapInArrow(delete, variant_ddl), "line-variants")
    # a character swapped: the same variant with the same place deleted; one more or less: the variant is the other line
    swapped = variants.filter("place >= 0").groupBy("key", "place", "n").agg(F.min("first").alias("earliest"), F.count("*").alias("c")).filter("c > 1")
    swaps = variants.join(swapped, ["key", "place", "n"]).select("first", "earliest")
    sides = variants.groupBy("key", "n").agg(F.min(F.when(F.col("place") < 0, F.col("first"))).alias("whole"), F.min(F.when(F.col("place") >= 0, F.col("first"))).alias("cut")).filter("whole is not null and cut is not null")
    grown = variants.join(sides, ["key", "n"]).select("first", F.when(F.col("place") < 0, F.col("cut")).otherwise(F.col("whole")).alias("earliest"))
    before = lambda c: F.struct(F.col(c)["none"], F.col(c)["doc_id"], F.col(c)["line_no"])
    pairs = swaps.union(grown).filter(before("earliest") < before("first")).distinct()
    a = lines.select("first", F.col("line").alias("line_a"))
    b = lines.select(F.col("first").alias("earliest"), F.col("line").alias("line_b"))
    # places compare by columns, as a null doc_id is a value here
    keyed = lambda df, c: df.withColumn(f"k_{c}", F.concat_ws(":", F.coalesce(F.col(c)["doc_id"].cast("string"), F.lit("")), F.col(c)["line_no"].cast("string"), F.col(c)["doc"].cast("string")))
    found = keyed(keyed(pairs, "first"), "earliest").join(keyed(a, "first").drop("first"), "k_first").join(keyed(b, "earliest").drop("earliest"), "k_earliest")
    found = found.filter((F.levenshtein("line_a", "line_b", 1) >= 0) & (F.levenshtein("line_a", "line_b", 1) <= 1))
    return found.groupBy("first").agg(F.min("earliest").alias("earliest"))


def dropped_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """A table with one row (doc_id, doc, gone) per text of docs (doc_id, doc, text) that loses lines: the numbers of these.

    A line goes if an earlier place, by (doc_id, line number), has the same
    line, or if the line's first place has an earlier line within one edit.
    """
    with passing() as keep:
        rows, firsts = first_seen(docs, least)
        firsts = stored(firsts, "line-firsts")
        with passing() as on:
            near = on(stored(near_links(docs, firsts), "line-near"))
        near = near.select(F.col("first").alias("f"), F.lit(True).alias("near"))
        same = (F.col("first.doc") == F.col("f.doc")) & F.col("first.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("first.line_no") == F.col("f.line_no"))
        bad = firsts.select("h1", "h2", "copies", "first").join(near, same, "left").filter("copies > 1 or near")
        bad = stored(bad.select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near")), "line-bad")
        later = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line_no") == F.col("first.line_no")))
        gone = rows.join(bad, ["h1", "h2"]).filter(F.col("near") | later)
        return keep(stored(gone.groupBy("doc_id", "doc").agg(F.collect_set("line_no").alias("gone")), "line-gone"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """docs with near-repeated lines removed from text; n_lines and n_dropped are added, other columns stay.

    Of lines of `least` characters or more that are equal, and of those of
    LEAST or more within one edit, the earliest by (doc_id, line number) stays;
    a line also goes if the earlier one that it resembles goes. Null text stays
    null and has no lines; a text may become empty; very long texts and lines
    are read whole. A null doc_id comes after all others. Rows that share
    doc_id and text keep the same lines; the first of equal lines under one
    doc_id and line number stays in each. An empty table gives none. Columns of
    docs that are called n_lines or n_dropped are replaced, others of any name
    are kept.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("doc"), text.alias("text"))
    own_id, own_doc, gone, all_lines, left = fresh(docs, "id", "doc", "gone", "lines", "left")
    found = dropped_lines(plain, least).toDF(own_id, own_doc, gone).hint("merge")  # as large as docs in the end: one plan at every size
    df = docs.join(found, F.col(id_col).cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(text) == F.col(own_doc)), "left").drop(own_id, own_doc)
    df = df.withColumn(all_lines, F.split(text, "\n"))
    numbers = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col(gone))
    df = df.withColumn(left, F.when(F.col(gone).isNotNull(), numbers))
    lines = F.col(all_lines)
    kept = F.array_join(F.transform(left, lambda k: F.get(lines, k)), "\n")
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(all_lines)).cast("long")
    n_dropped = F.when(F.col(gone).isNull(), 0).otherwise(F.size(all_lines) - F.size(left)).cast("long")
    df = df.withColumns({"n_lines": n_lines, "n_dropped": n_dropped})
    return df.withColumn(text_col, F.when(F.col("n_dropped") > 0, kept).otherwise(F.col(text_col))).drop(gone, all_lines, left)
