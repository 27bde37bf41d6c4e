"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints of 64 bits come from word shingles. Two fingerprints within the
radius r agree on at least c of r + c bit blocks, so each distinct fingerprint
goes to one bucket per choice of c blocks, c by their number. Within a bucket the
fingerprints stand as bit planes (64 lanes a word); the distances of all lanes
are counted at once by a carry-save counter, plane after plane, and a block of
lanes is abandoned once every lane has passed the radius. Buckets report a
spanning forest, never all pairs, and components() joins the forests. A crowded
bucket is first compared with its leaders; what these don't join is then
compared with all of it.

For groups by a similarity of shingle sets, where fingerprints lie further
apart than blocks of bits can find, candidates come from buckets of pairs of
least hashes instead; the same comparison keeps those within a wide radius, and
sketches of least hashes those that may be alike. The sets themselves judge:
each group of such links is gone through once more with its texts' shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, components, fresh, map_batches, passing, stored, whole_text

BITS = 64
SEED = 42
#: Fingerprints of one tile, and about as many leaders of a larger bucket.
TILE, LEADERS = 2048, 64
#: Least hashes of a sketch, one byte of each; buckets by two of them.
LEAST, BANDS = 128, 12
#: A candidate's share of equal bytes may fall short of the similarity by over 4 deviations, as sets are judged after it.
SLACK = 0.15
#: Radius within which sketches are looked at: at a similarity of 0.8 fingerprints of sets differ by 10 bits, with a deviation of 3.
WIDE = 24
#: Buckets of up to so many fingerprints are compared together, lag by lag.
SMALL = 48


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """Hashes of a text's shingles: A-Z lowered, words between ASCII white space, width words each, repeats kept.

    Fewer words than width: their whole sequence is the one shingle.
    """
    words = text.lower().split()
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] * bool(words), np.uint64)
    ends = [x - 1 for x in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends)]
    of = xxhash.xxh64_intdigest
    return np.fromiter((of(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :])), np.uint64, len(words) - width + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half the hashes have; zero without hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, width: int = 4) -> int:
    """SimHash of a text's bytes; a text without words has zero."""
    return majority(shingle_hashes(text, width))


FACTORS = np.random.default_rng(3).integers(1 << 32, 1 << 63, LEAST).astype(np.uint64) | np.uint64(1)


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """The least of the hashes under each of LEAST multipliers; all ones without hashes."""
    out = np.full(LEAST, ~np.uint64(0))
    for at in range(0, len(hashes), 2048):
        part = hashes[at : at + 2048, None] * FACTORS
        np.minimum(out, part.min(axis=0), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """A bucket for each of BANDS pairs of least hashes."""
    a, b = least[: 2 * BANDS : 2], least[1 : 2 * BANDS : 2]
    key = (a ^ (b * FACTORS[0] >> np.uint64(7))) * FACTORS[1 : BANDS + 1]
    return (key ^ key >> np.uint64(29)).view(np.int64)


def planes(prints: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints: row b has bit b of all, 64 lanes a word."""
    lanes = -(-len(prints) // 64) * 64
    bits = np.zeros((lanes, BITS), np.uint8)
    bits[: len(prints)] = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within(difference, live: np.ndarray, radius: int) -> np.ndarray:
    """Lanes of live whose count of set difference bits stays within radius.

    difference(b) gives plane b of the exclusive or, shaped as live. The count
    is held in bit-sliced digits, started so that passing the radius overflows.
    """
    digits = (radius + 1).bit_length()
    start = (1 << digits) - 1 - radius
    ones = ~np.zeros_like(live)
    count = [ones.copy() if start >> k & 1 else np.zeros_like(live) for k in range(digits)]
    for b in range(BITS):
        carry = difference(b) & live
        for k in range(digits):
            carry, count[k] = carry & count[k], carry ^ count[k]
        live = live & ~carry  # overflow: beyond the radius
        if b >= radius and b % 4 == 3 and not live.any():
            break
    return live


def lanes(words: np.ndarray) -> np.ndarray:
    """Set lanes along the last axis, as 0/1."""
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=-1, bitorder="little")


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index reachable from each of n nodes by the links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if np.array_equal(root, before):
            break
    return root


def links_of_large(prints: np.ndarray, side: np.ndarray, radius: int, alike=None) -> np.ndarray:
    """Roots within one bucket or pair of tiles: with two sides, only links between them count; alike(i, j) judges links further."""
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(right) or not len(left):
        left = right = np.arange(len(prints))
    low, root = planes(prints[right]), np.arange(len(prints))
    alive = np.zeros(low.shape[1] * 64, np.uint8)
    alive[: len(right)] = 1
    alive = np.packbits(alive, bitorder="little").view(np.uint64)
    for at in range(0, len(left), 64):
        own = prints[left[at : at + 64]]
        masks = [(np.uint64(0) - (own >> np.uint64(b) & np.uint64(1)))[:, None] for b in range(BITS)]
        for w in range(0, low.shape[1], 16):  # blocks of 64 x 1024 pairs
            found = within(lambda b, w=w: low[b, w : w + 16] ^ masks[b], np.broadcast_to(alive[w : w + 16], (len(own), len(alive[w : w + 16]))), radius)
            if found.any():
                i, j = np.nonzero(lanes(found))
                i, j = left[at + i], right[w * 64 + j]
                if alike:
                    ok = alike(i, j)
                    i, j = i[ok], j[ok]
                root = spanning(len(prints), np.r_[i, np.arange(len(prints))], np.r_[j, root])
    return root


def links_of_small(prints: np.ndarray, ends: np.ndarray, radius: int, alike=None) -> np.ndarray:
    """Roots of many small buckets at once; ends: for each fingerprint where its bucket ends."""
    n, found = len(prints), []
    own = planes(prints)
    reach = ends - np.arange(n)
    for lag in range(1, int(reach.max(initial=1))):
        if not (some := np.flatnonzero(reach > lag)).size:
            break
        low = own if len(some) * 2 > n and lag == 1 else planes(prints[some])
        if low is own:
            some = np.arange(n - lag)
            low = planes(prints[some])
        other = planes(prints[some + lag])
        live = np.zeros(low.shape[1] * 64, np.uint8)
        live[: len(some)] = reach[some] > lag
        live = np.packbits(live, bitorder="little").view(np.uint64)
        for w in range(0, len(live), 64):
            hit = within(lambda b, w=w: low[b, w : w + 64] ^ other[b, w : w + 64], live[w : w + 64], radius)
            if hit.any():
                i = some[w * 64 + np.flatnonzero(lanes(hit))]
                i = i[alike(i, i + lag)] if alike else i
                found.append((i, i + lag))
    a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, int),) * 2
    return spanning(n, a, b)


def compare_runs(radius: int, share: float | None = None):
    """For sorted batches of (bucket, side, fp and, with a share, node, sketch): batches of links (a, b), runs never cut.

    share: what part of their sketches' bytes linked rows have in common at
    least; links are then between nodes, and otherwise between fingerprints.
    """
    out = arrow_schema("a long, b long")

    def judge(sketch: np.ndarray | None):
        return None if share is None else lambda i, j: np.concatenate([np.empty(0, bool), *((sketch[i[at : at + 4096]] == sketch[j[at : at + 4096]]).mean(axis=1) >= share for at in range(0, len(i), 4096))])

    def forest(bucket: np.ndarray, side: np.ndarray, prints: np.ndarray, nodes: np.ndarray | None = None, sketch: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        nodes = prints if nodes is None else nodes
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        sizes = np.diff(np.r_[starts, len(bucket)])
        pairs = []
        small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
        if small.any():
            ends = np.repeat(np.cumsum(np.where((sizes > 1) & (sizes <= SMALL), sizes, 0)), sizes)[small]
            own = prints[small]
            root = links_of_small(own, ends, radius, judge(sketch if sketch is None else sketch[small]))
            m = np.flatnonzero(root != np.arange(len(own)))
            pairs.append((nodes[small][m], nodes[small][root[m]]))
        for s, k in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
            own = prints[s : s + k]
            root = links_of_large(own, side[s : s + k], radius, judge(sketch if sketch is None else sketch[s : s + k]))
            m = np.flatnonzero(root != np.arange(k))
            pairs.append((nodes[s + m], nodes[s + root[m]]))
        for a, b in pairs:
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("bucket", "side", "fp")]
            if share is not None:
                new.append(batch.column("node").to_numpy(zero_copy_only=False))
                new.append(np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, LEAST))
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            if not len(held[0]):
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last run may go on
            if cut:
                yield from forest(held[0][:cut], held[1][:cut], held[2][:cut].view(np.uint64), *(x[:cut] for x in held[3:]))
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield from forest(held[0], held[1], held[2].view(np.uint64), *held[3:])

    return run


def agreeing(n: int) -> int:
    """On how many blocks fingerprints of a bucket agree: so many that buckets of n stay small; each step takes more buckets a fingerprint."""
    return 2 if n < 1 << 26 else 3 if n < 1 << 32 else 4


def block_masks(radius: int, agree: int = 2) -> list[int]:
    """Masks of every `agree` of radius + agree blocks: any two fingerprints within the radius agree under one of them."""
    cuts = np.linspace(0, BITS, radius + agree + 1).round().astype(int)
    blocks = [sum(1 << b for b in range(s, e)) for s, e in zip(cuts, cuts[1:])]
    masks = [sum(some) for some in combinations(blocks, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """One row (doc_id, text_hash, fp) for each row of docs; null text is empty, and empty texts have fingerprint zero."""

    def make():
        def step(batch):
            found = (fingerprint(x or b"", width) for x in batch.column("text").to_pylist())
            return {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "fp": pa.array(np.fromiter(found, np.uint64, batch.num_rows).view(np.int64))}

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text_col).alias("text_hash"), F.col(text_col).cast("binary").alias("text"))
    return map_batches(rows, make, "doc_id long, text_hash long, fp long")


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """fingerprints() of the sets of shingles, with node (hash of the set), sketch (a byte of each least hash) and bands (buckets)."""

    def make():
        def step(batch):
            fp, node, sketch, bands = [], [], [], []
            for text in batch.column("text").to_pylist():
                distinct = np.unique(shingle_hashes(text or b"", width))
                least = least_hashes(distinct)
                fp.append(majority(distinct))
                node.append(xxhash.xxh64_intdigest(distinct.tobytes(), SEED))
                sketch.append((least >> np.uint64(24)).astype(np.uint8).tobytes())
                bands.append(band_keys(least))
            return {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "fp": pa.array(np.array(fp, np.uint64).view(np.int64)), "node": pa.array(np.array(node, np.uint64).view(np.int64)), "sketch": sketch, "bands": bands}

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text_col).alias("text_hash"), F.col(text_col).cast("binary").alias("text"))
    return map_batches(rows, make, "doc_id long, text_hash long, fp long, node long, sketch binary, bands array<long>")


def text_hash(text_col: str) -> Column:
    return F.xxhash64(whole_text(text_col))


def near_links(prints: DataFrame, radius: int = 4, agree: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints of prints (fp) within radius bits, that span their groups."""
    masks = block_masks(radius, agree)
    rows = prints.select("fp", F.explode(F.array(*(F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(masks)))).alias("bucket"))
    return bucket_links(rows, "fp", compare_runs(radius))


def bucket_links(rows: DataFrame, node: str, compare, of_node: DataFrame | None = None, tile: int | None = None) -> DataFrame:
    """Links (a, b) that span what compare links within the buckets of rows (bucket, node).

    compare takes batches sorted by bucket, with a side for each row, and
    of_node has more columns for it by node. Buckets of up to `tile` rows (TILE)
    are compared whole. Of a larger one each tile is compared with the bucket's
    leaders, about LEADERS rows by hash. What then is not of the bucket's
    largest component is compared with all of it, in pairs of tiles; pairs
    within that component are joined already. So a crowd around one text takes
    work in proportion to its size, no link between components is lost, and no
    task holds more than two tiles of a bucket.
    """
    tile = tile or TILE

    def linked(dealt: DataFrame) -> DataFrame:
        dealt = dealt if of_node is None else dealt.join(of_node, node)
        return dealt.repartition("bucket").sortWithinPartitions("bucket", "side").mapInArrow(compare, "a long, b long")

    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    crowded = stored(sizes.filter(F.col("n") > tile), "crowded")
    roomy = rows if crowded.isEmpty() else rows.join(crowded.select("bucket"), "bucket", "left_anti")
    if of_node is not None:  # rows get more columns only where there is something to compare
        roomy = roomy.join(sizes.filter(F.col("n").between(2, tile)), "bucket")
    roomy = roomy.select("bucket", node, F.lit(0).alias("side"))
    if crowded.isEmpty():
        return linked(roomy)
    mix = F.xxhash64(F.col(node), F.col("bucket"))
    members = rows.join(crowded, "bucket").withColumn("tiles", F.ceil(F.col("n") / tile).cast("int")).withColumn("own", F.pmod(mix, F.col("tiles")).cast("int"))
    members = stored(members.select("bucket", node, "n", "tiles", "own"), "crowd")
    leads = F.pmod(F.xxhash64(mix), F.ceil(F.col("n") / LEADERS)) == 0
    dealt = members.withColumn("at", F.explode(F.when(leads, F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array("own"))))
    dealt = dealt.select(F.xxhash64("bucket", "at").alias("bucket"), node, F.lit(0).alias("side"))
    first = stored(linked(roomy).union(linked(dealt)), "crowd-links")
    roots = components(first, "crowd-roots").withColumnRenamed("node", "of")
    members = stored(members.join(roots, F.col(node) == F.col("of"), "left").withColumn("root", F.coalesce("root", node)).drop("of"), "crowd-members")
    shares = members.groupBy("bucket", "root").agg(F.count("*").alias("c"))
    most = stored(shares.groupBy("bucket").agg(F.max_by("root", F.struct("c", "root")).alias("most"), F.max("c").alias("c")), "crowd-most")
    named = members.join(most, "bucket").withColumn("lots", F.ceil((F.col("n") - F.col("c")) / tile).cast("int")).filter("lots > 0")
    # pairs of a lot of what is apart (side 0) and a tile of all (side 1)
    left = named.filter("root <> most").withColumn("lot", F.pmod(mix, F.col("lots")).cast("int")).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    right = named.withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).withColumn("at", F.col("own"))
    pairs = [x.select(F.xxhash64("bucket", "lot", "at").alias("bucket"), node, F.lit(side).alias("side")) for side, x in enumerate((left, right))]
    return first.union(linked(pairs[0].union(pairs[1])))


def similar_links(prints: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between distinct nodes of prints (node, fp, sketch, bands) whose shingle sets may be alike, that span their groups.

    Nodes that share a pair of least hashes are compared within WIDE bits and
    then by sketch; rows carry sketches only once their bucket is known to hold
    two of them.
    """
    rows = prints.select("node", F.explode("bands").alias("bucket"))
    return bucket_links(rows, "node", compare_runs(WIDE, similarity - SLACK), prints.select("node", "fp", "sketch"))


def reached(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links i-j that span the groups of sets (distinct numbers each) by Jaccard similarity; only sets not yet reached are compared."""
    sizes = np.array([len(x) for x in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.split(codes, np.cumsum(sizes)[:-1])
    mark = np.zeros(len(codes), bool)
    rest, a, b = np.arange(len(sets)), [], []
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            near = rest[np.minimum(sizes[rest], sizes[i]) >= similarity * np.maximum(sizes[rest], sizes[i])]
            if not len(near):
                continue
            mark[own[i]] = True
            common = np.add.reduceat(mark[np.concatenate([own[j] for j in near])], np.r_[0, np.cumsum(sizes[near])[:-1]], dtype=np.int64)
            mark[own[i]] = False
            hit = near[common >= similarity * (sizes[near] + sizes[i] - common)]
            rest = np.setdiff1d(rest, hit, assume_unique=True)
            a += [i] * len(hit)
            b += hit.tolist()
            queue += hit.tolist()
    return a, b


def judge_runs(similarity: float):
    """For sorted batches of (bucket, node, shingles): batches of links (a, b) between nodes of a bucket by exact similarity."""
    out = arrow_schema("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, nodes, sets, found = None, [], [], ([], [])

        def close():
            for side, x in zip(found, reached(sets, similarity) if len(sets) > 1 else ((), ())):
                side.extend(nodes[i] for i in x)

        def links():
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], schema=out)

        for batch in batches:
            for b, node, shingles in zip(*(batch.column(c).to_pylist() for c in ("bucket", "node", "shingles"))):
                if b != bucket:
                    close()
                    bucket, nodes, sets = b, [], []
                nodes.append(node)
                sets.append(np.frombuffer(shingles, np.uint64))
            if found[0]:
                yield links()
                found = ([], [])
        close()
        if found[0]:
            yield links()

    return run


def exact_links(distinct: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float) -> DataFrame:
    """Links (a, b) that span the groups of nodes of distinct by the exact similarity of their shingle sets.

    similar_links() give groups that hold these; within each, the sets of one
    text a node are compared.
    """

    def make():
        def step(batch):
            sets = [np.unique(shingle_hashes(x or b"", width)).tobytes() for x in batch.column("text").to_pylist()]
            return {"node": batch.column("node"), "shingles": sets}

        return step

    with passing() as keep:
        loose = components(similar_links(distinct, similarity), "simhash-loose")
        wanted = stored(loose.join(distinct.select("node", "first.doc_id", "first.text_hash"), "node").select("node", "doc_id", "text_hash"), "simhash-wanted")
        rows = docs.select(F.col(id_col).cast("long").alias("id"), text_hash(text_col).alias("hash"), F.col(text_col).cast("binary").alias("text"))
        rows = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))).select("node", "text")
        sets = stored(map_batches(rows, make, "node long, shingles binary").dropDuplicates(["node"]), "simhash-sets")
        links = bucket_links(loose.select(F.col("root").alias("bucket"), "node"), "node", judge_runs(similarity), sets, max(2, TILE // 4))
        return keep(stored(links, "simhash-exact"))


def least_of_groups(distinct: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """(key, least): the least `first` of each key's group, for the keys of the table distinct (key, first); links join keys.

    What groups share is a table, so that adaptive execution can split the
    keys of a large group when they are joined with it.
    """
    with passing() as keep:
        roots = components(links, "simhash-links").withColumnRenamed("node", key)
        linked = stored(distinct.select(key, "first").join(roots, key), "simhash-linked")
        least = stored(linked.groupBy("root").agg(F.min("first").alias("least")), "simhash-least")
        alone = distinct.join(roots, key, "left_anti").select(key, F.col("first").alias("least"))
        return keep(stored(linked.join(least, "root").select(key, "least").union(alone), "simhash-known"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """One row (doc_id, fp, component_id) per row of docs; component_id is the least doc_id of the linked group.

    Rows with a null doc_id are linked like any other and get the least
    non-null id of their group, or null. A null text is the empty text, whose
    fingerprint is zero; a very long one is read whole. Repeated rows give
    repeated rows; an empty table gives none. Only the two named columns of
    docs are read.
    """
    with passing() as keep:
        prints = keep(stored(fingerprints(docs, id_col, text_col, width), "simhash"))
        distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
        links = near_links(distinct.select("fp"), radius, agreeing(distinct.count()))
        known = keep(least_of_groups(distinct, links, "fp"))
        return prints.join(known, "fp").select("doc_id", "fp", F.col("least").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without near-duplicates: of each group of texts of like shingle sets the row with the least id stays, with all its columns.

    Links are pairs whose sets of width-word shingles have a Jaccard
    similarity of `similarity` or more; sketches only choose what is compared.
    Rows are told apart by id and text: of rows that share an id, each text is
    judged by itself. Null ids come after all others; among rows of one id, and
    of none, that of the least text hash stays. Of rows that share id and text
    one stays, that of the least hash of the other columns (maps aside). Null
    texts and texts without words are one group; very long ones are read whole.
    An empty table gives an empty one; columns of any names are kept.
    """
    with passing() as keep:
        prints = stored(sketches(docs, id_col, text_col, width), "simhash")
        place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
        distinct = prints.groupBy("node").agg(F.min(F.struct(place.alias("first"), "fp", "sketch", "bands")).alias("m"))
        distinct = stored(distinct.select("node", "m.*"), "simhash-distinct")
        known = least_of_groups(distinct, exact_links(distinct, docs, id_col, text_col, width, similarity), "node")
        kept = keep(stored(known.select("least.none", F.coalesce("least.doc_id", F.lit(0)).alias("id"), F.col("least.text_hash").alias("hash")).distinct(), "simhash-kept"))
        repeats = prints.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1")
        repeats = keep(stored(repeats.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_hash").alias("hash")), "simhash-repeats"))
    own = fresh(docs, "none", "id", "hash")
    key = dict(zip(own, (F.col(id_col).isNull(), F.coalesce(F.col(id_col).cast("long"), F.lit(0)), text_hash(text_col))))
    found = docs.withColumns(key).join(kept.toDF(*own), own, "left_semi")
    if repeats.isEmpty():
        return found.drop(*own)
    once = found.join(repeats.toDF(*own), own, "left_anti").drop(*own)
    more = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    again = found.join(repeats.toDF(*own), own, "left_semi").groupBy(*own).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.xxhash64(*more)).alias(own[0] + "_row"))
    return once.unionByName(again.select(own[0] + "_row.*"))
