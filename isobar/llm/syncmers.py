"""Document fingerprints from closed syncmers of words, in DataFrame functions alone.

A run of k words is an anchor if the least hash among its inner runs of s
words is that of the first or the last one. The choice depends on the run
itself, not on what surrounds it, so that texts which share a passage share
its anchors. A text of fewer than k words, as one of a script without blanks,
goes by characters instead. A fingerprint is the bottom of the sorted distinct anchor hashes;
anchors() gives all of them with their positions for positional matching.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import passing, stored, whole_text

#: Anchor hashes kept in a fingerprint.
BOTTOM = 64
#: Documents of one bucket of the doc_id order, most buckets (as many ranges as a sort of 100 TB has), and keys looked at for each.
BUCKET, MOST_BUCKETS, LOOKED_AT = 512, 1 << 18, 4
#: Copies of a row made in one task.
COPIES = 1 << 12


def with_anchors(df: DataFrame, text: str, out: str, k: int = 5, s: int = 2) -> DataFrame:
    """Adds out: the hashes of text's anchors in order, null where a run of k words is no anchor.

    Words stand between white space. A text of fewer than k words goes by its
    characters, with one blank between words; one of fewer than k of these too
    has one anchor, its whole sequence, and one without words none.
    """
    inner = k - s + 1
    words = F.array_remove(F.split(F.col(text), r"\s+"), "")
    df = df.withColumn("_w", words)
    units = F.when(F.size("_w") >= k, F.col("_w")).otherwise(F.array_remove(F.split(F.array_join("_w", " "), ""), ""))
    df = df.withColumn("_h", F.transform(units, lambda w: F.xxhash64(w)))
    h, n = F.col("_h"), F.size("_h")
    df = df.withColumn("_b", F.when(n >= k, F.transform(F.sequence(F.lit(0), n - s), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(s))))))
    b = F.col("_b")

    def anchor(i: Column) -> Column:
        least = F.least(*(F.get(b, i + j) for j in range(inner)))
        return F.when((least == F.get(b, i)) | (least == F.get(b, i + inner - 1)), F.xxhash64(*(F.get(h, i + j) for j in range(k))))

    short = F.when(n > 0, F.array(F.xxhash64(F.array_join(F.transform(h, lambda x: x.cast("string")), " ")))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(out, F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), anchor)).otherwise(short)).drop("_w", "_h", "_b")


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds out: up to BOTTOM least distinct anchor hashes of text, 32 bits each, ascending."""
    df = with_anchors(df, text, "_a")
    small = F.transform(F.array_compact("_a"), lambda x: F.shiftright(x, 32).cast("int"))
    return df.withColumn(out, F.slice(F.sort_array(F.array_distinct(small)), 1, BOTTOM)).drop("_a")


def shown(fingerprint: str) -> Column:
    """A fingerprint as hex digits, 8 for each hash."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Share of the bottom hashes of both texts together that both have; 1 for two texts without words."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, BOTTOM)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.greatest(F.size(union), F.lit(1)))


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, position, anchor) per anchor; position counts words, or characters in texts that go by them."""
    df = with_anchors(docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")), "text", "a")
    return df.select("doc_id", F.posexplode("a").alias("position", "anchor")).filter("anchor is not null")


def constant(values) -> Column:
    """Numbers as one constant of the plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if len(values) else F.array().cast("array<bigint>")


def bucket_of(cuts: list[tuple[int | None, int]]) -> Column:
    """How many of the ascending cuts (doc_id, hash) are below a row's, null ids before all others, by binary search."""
    nulls = sum(c[0] is None for c in cuts)
    ids, hashes = constant([c[0] or 0 for c in cuts]), constant([c[1] for c in cuts])
    steps = F.array(*(F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1))) if cuts else F.array().cast("array<int>")

    def below(i: Column) -> Column:
        own, at = F.get(ids, i), F.get(hashes, i) < F.col("_t")
        return F.when(F.col("doc_id").isNull(), (i < nulls) & at).otherwise((i < nulls) | (own < F.col("doc_id")) | ((own == F.col("doc_id")) & at))

    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & below(at + step - 1), at + step).otherwise(at))


def with_next(docs: DataFrame, prepare, columns: list[str]) -> tuple[DataFrame, bool]:
    """prepare(docs) with next, a struct of columns of the next row by descending (doc_id, hash of text), and n, how often; after the last comes the first.

    Rows go to buckets that are contiguous in this order, cut at keys that a
    sample by hash gives, so that rows of one doc_id, or of none, are dealt
    over many. Each bucket also gets a copy of the row that follows it. What
    the driver holds are a few numbers per bucket. Of a row that repeats so
    often that it would fill buckets one is dealt, and says twice what comes
    next: once the next key, else itself (the second result tells if there
    are such rows).
    """
    docs = docs.withColumn("_t", F.xxhash64("text"))
    with passing():
        keys = stored(docs.groupBy("doc_id", "_t").agg(F.count("*").alias("c")), "next-keys")
        rows = keys.agg(F.sum("c")).first()[0] or 0
        parts = min(MOST_BUCKETS, max(1, math.ceil(rows / BUCKET)))
        some = keys.filter(F.pmod(F.xxhash64("doc_id", "_t", F.lit("cut")), F.lit(max(1, rows // (LOOKED_AT * parts)))) == 0)
        found = some.select("doc_id", "_t").toArrow().to_pydict() if parts > 1 else {"doc_id": [], "_t": []}
        order = sorted(zip(found["doc_id"], found["_t"]), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        cuts = order[LOOKED_AT - 1 :: LOOKED_AT]
        place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "_t")
        tops = keys.groupBy(bucket_of(cuts).alias("b")).agg(F.max(place).alias("top")).select("b", "top.doc_id", "top._t").toArrow().to_pylist()
        often = keys.filter(F.col("c") > 4 * math.ceil(rows / parts)).select(F.col("doc_id").alias("id"), F.col("_t").alias("h")).collect()
    tops.sort(key=lambda r: -r["b"])
    top = {r["b"]: (r["doc_id"], r["_t"], tops[k - 1]["b"]) for k, r in enumerate(tops)}
    own = [top.get(b, (None, 0, 0)) for b in range(len(cuts) + 1)]
    docs = docs.withColumn("c", F.lit(1).cast("long"))
    if often:  # at most a quarter as many as buckets
        hot = F.broadcast(docs.sparkSession.createDataFrame(often, "id long, h long"))
        same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("_t") == F.col("h"))
        one = docs.join(hot, same, "left_semi").groupBy("doc_id", "_t").agg(F.first("text").alias("text"), F.count("*").alias("c"))
        docs = docs.join(hot, same, "left_anti").unionByName(one.select(docs.columns))
    docs = docs.withColumn("_bucket", bucket_of(cuts))
    ids, hashes, before, nulls = (constant(x) for x in ([x[0] or 0 for x in own], [x[1] for x in own], [x[2] for x in own], [int(x[0] is None) for x in own]))
    of = lambda values: F.get(values, F.col("_bucket"))
    is_top = (F.col("doc_id").isNull() == (of(nulls) == 1)) & (F.coalesce("doc_id", F.lit(0)) == of(ids)) & (F.col("_t") == of(hashes))
    here = F.struct(F.col("_bucket").cast("long").alias("b"), F.lit(0).alias("extra"))
    copy = F.struct(of(before).alias("b"), F.lit(1).alias("extra"))
    dealt = prepare(docs).withColumn("_at", F.explode(F.when(is_top, F.array(here, copy)).otherwise(F.array(here))))
    order = W.partitionBy("_at.b").orderBy("_at.extra", F.col("doc_id").desc_nulls_last(), F.col("_t").desc())
    out = dealt.withColumn("next", F.lead(F.struct(*columns)).over(order)).filter("_at.extra = 0").drop("_t", "_bucket", "_at")
    if not often:
        return out.withColumn("n", F.col("c")).drop("c"), False
    first, again = F.struct("next", F.lit(1).cast("long").alias("n")), F.struct(F.struct(*columns).alias("next"), (F.col("c") - 1).alias("n"))
    out = out.withColumn("_v", F.explode(F.when(F.col("c") > 1, F.array(first, again)).otherwise(F.array(first)))).withColumn("next", F.col("_v.next"))
    return out.withColumn("n", F.col("_v.n")).drop("_v", "c"), True


def repeated(df: DataFrame) -> DataFrame:
    """Each row n times, without n; copies of one row are made by many tasks."""
    lots = df.withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    lots = lots.repartition(F.xxhash64(*df.columns, "_lot"))
    size = F.least(F.lit(COPIES).cast("long"), F.col("n") - F.col("_lot") * COPIES)
    return lots.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), size))).drop("n", "_lot", "_k")


def fingerprint_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit: its last third, in code points, replaced by as many of the next document's first.

    One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. The next document is the next
    lower doc_id, after the last the first; rows of one doc_id stand by the
    hash of their text, null ids last; a row that repeats id and text is
    followed by its repeat. Null text is the empty text; a very long one is
    read whole. An empty table gives no rows; a single row is its own next.
    Only the two named columns are read.
    """
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    df, hot = with_next(df, lambda rows: with_fingerprint(rows, "text", "fp"), ["text", "fp"])
    n = F.char_length("text").cast("long")
    df = df.withColumn("n_chars", n).withColumn("_m", F.floor(F.col("n_chars") / 3).cast("int"))
    df = df.withColumn("edited", F.concat(F.expr("substring(text, 1, int(n_chars) - _m)"), F.expr("substring(next.text, 1, _m)")))
    df = df.select("doc_id", "n_chars", "edited", "fp", F.col("next.fp").alias("next_fp"), "n")
    df = with_fingerprint(df, "edited", "edited_fp")
    df = df.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), shown("fp").alias("fingerprint"), shown("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"), "n",
    )
    return repeated(df) if hot else df.drop("n")
