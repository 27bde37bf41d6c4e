"""URL rules by an exact Bloom filter cascade, in DataFrame functions alone.

Listed keys are the rules, each a host and a path prefix. The key universe of
a table is every (host suffix, path prefix) of its urls in a shape that some
rule has. Level 0 is a Bloom filter of the listed keys; level 1 holds the keys
of the universe that pass level 0 unlisted, level 2 the listed keys that pass
level 1, and so on until a level has no false positives. The first level that
a key fails decides it, exactly for every key of the universe, without a join.
Level 0 is sized by the universe, so that the false positives and with them
all further levels stay of the order of the list. The words of a level stand
in the plan as one constant; a list too long for that is joined instead.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bits of a cascade that may stand in a plan (2 MB of words); a list that needs more is joined by its keys.
MOST_BITS = 1 << 24


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    """A Bloom filter: 64-bit words, a number of probes and a seed."""

    words: tuple[int, ...]
    probes: int
    seed: int

    def has(self, key: Column) -> Column:
        bits = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # folded to a constant
        hit = F.lit(True)
        for i in range(self.probes):
            at = position(key, self.seed, i, len(self.words))
            hit &= F.getbit(F.get(bits, F.shiftright(at, 6).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1
        return hit


def position(key: Column, seed: int, i: int, words: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed * 64 + i), key), F.lit(words * 64).cast("long"))


def host_of(url: Column) -> Column:
    """After the first ://, up to /, ?, # or the end, A-Z lowered; empty without one."""
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(after(url), r"^[^/?#]*", 0), UPPER, UPPER.lower())).otherwise("")


def path_of(url: Column) -> Column:
    """After the host, up to ?, # or the end."""
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(after(url), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def after(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def shapes(rules: list[Rule]) -> list[tuple[int, int]]:
    """Labels of the host and characters of the path of each rule, without repeats; longest rules first.

    Of rules that fit, the one of the longest key wins; of equal lengths the
    one of the longer host.
    """
    return sorted({(r.host.count(".") + 1, len(r.path)) for r in rules})


def candidate(shape: tuple[int, int], host: Column, path: Column) -> Column:
    """The key that a url has in a shape, or null if it is too short for it."""
    labels, size = shape
    suffix = F.substring_index(host, ".", -labels)
    return F.when((F.length(path) >= size) & (host != ""), F.concat(suffix, F.substring(path, 1, size)))


def probes_and_words(count: int, rate: float) -> tuple[int, int]:
    return max(1, round(-math.log2(rate))), max(1, math.ceil(count * -math.log(rate) / math.log(2) ** 2 / 64))


def build_level(keys: DataFrame, count: int, rate: float, seed: int) -> Level:
    """A Bloom filter of keys (key), of a false positive rate; one bit_or per word, of the order of count words."""
    probes, words = probes_and_words(count, rate)
    at = keys.select(F.explode(F.array(*(position(F.col("key"), seed, i, words) for i in range(probes)))).alias("at"))
    rows = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(at, 64) as int)))").alias("bits")).collect()
    bits = [0] * words
    for r in rows:
        bits[r.word] = r.bits
    return Level(tuple(bits), probes, seed)


def cascade(listed: DataFrame, universe: DataFrame) -> list[Level] | None:
    """Levels that tell listed keys from all other keys of the universe (both: key); None if they'd take more than MOST_BITS.

    What reaches the driver are the words of the filters: of the order of the
    list, whatever the size of the universe.
    """
    listed = listed.filter("key is not null").distinct()
    n = listed.count()
    if not n:
        return []
    others = universe.filter("key is not null").join(F.broadcast(listed) if n < 100_000 else listed, "key", "left_anti")
    rate = min(0.5, n * 0.7 / max(others.agg(F.approx_count_distinct("key", 0.02)).first()[0], 1))
    if probes_and_words(n, rate)[1] * 64 > MOST_BITS:
        return None
    levels = [build_level(listed, n, rate, 0)]
    holds, against = listed, others
    while True:
        passed = against.filter(levels[-1].has(F.col("key"))).distinct()
        count = passed.count()
        if not count:
            return levels
        levels.append(build_level(passed, count, 0.5, len(levels)))
        holds, against = passed, holds


def member(levels: list[Level], key: Column) -> Column:
    """Whether a key of the universe is listed."""
    out = F.lit(len(levels) % 2 == 1)
    for k in range(len(levels) - 1, -1, -1):
        out = F.when(~levels[k].has(key), F.lit(k % 2 == 1)).otherwise(out)
    return F.coalesce(key.isNotNull() & out, F.lit(False))


def apply_rules(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule (the longest that fits, as host + path, or null), verdict.

    A rule fits its host and all subdomains where the path starts with the
    rule's. Urls that no rule fits get default. A null url, or one without
    ://, has an empty host and path and fits no rule; a very long one is read
    whole. Repeated rows and null ids stay; an empty table gives no rows. Only
    the two named columns are read. No rules: default for all. A list too long
    for a cascade in the plan (MOST_BITS) is joined; the rows are the same.
    """
    spark = pages.sparkSession
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    urls = urls.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    forms = shapes(rules)
    if not forms:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keys = F.array_compact(F.array(*(candidate(x, F.col("host"), F.col("path")) for x in forms)))
    verdicts = {r.key: r.verdict for r in rules}
    listed = spark.createDataFrame([*verdicts.items()], "key string, verdict string")
    levels = cascade(listed.select("key"), urls.select(F.explode(keys).alias("key")))
    if levels is None:
        return joined(urls.withColumn("keys", keys), listed, default)
    # of the listed keys, those that block: a second cascade, whose universe is the list
    block = cascade(listed.filter("verdict = 'block'").select("key"), listed.select("key"))
    hits = F.filter(keys, lambda k: member(levels, k))
    best = F.element_at(F.array_sort(hits, lambda a, b: F.length(a) - F.length(b)), -1)
    ruled = urls.withColumn("rule", F.when(F.size(hits) > 0, best))
    verdict = F.when(F.col("rule").isNull(), default).when(member(block, F.col("rule")), "block").otherwise("allow")
    return ruled.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def joined(urls: DataFrame, listed: DataFrame, default: str) -> DataFrame:
    """apply_rules() by a join of the distinct keys of urls (page_id, host, path, keys) with the list, for long lists.

    Urls that have the same host and path are one row of it, so that a hot url
    meets its keys once; what is found is a table, so that adaptive execution
    can split the rows of a hot url when they are joined with it.
    """
    pairs = urls.groupBy("host", "path").agg(F.first("keys").alias("keys"))
    found = pairs.select("host", "path", F.posexplode("keys").alias("k", "key")).join(listed, "key")
    best = stored(found.groupBy("host", "path").agg(F.max_by(F.struct("key", "verdict"), F.struct(F.length("key"), "k")).alias("best")), "url-rules")
    out = urls.select("page_id", "host", "path").join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
