"""The corpus operators as queries, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, line_dedup, quality, secrets, simhash, syncmers, token_counts, token_files, url_filter


def word_bpe() -> str:
    """The tokenizer file of these queries; executors have it at the same path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(text.cast("binary"), 256).alias("text_sha256"))


#: The earlier line within one edit is found through either half, which such lines share.
OP2_SQL = """
with lines as (
  select doc_id, cast(u.i - 1 as integer) as line_no, l[u.i] as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents), lateral (select unnest(range(1, len(l) + 1)) as i) u),
firsts as (select line, length(line) as n, min({'d': doc_id, 'i': line_no}) as first from lines where length(line) >= 20 group by line),
halves as (
  select distinct line, n, first, k.key from firsts, lateral (
    select unnest([left(line, n // 2), left(line, (n - 1) // 2)]) || chr(1) as key
    union all select chr(1) || unnest([right(line, n // 2), right(line, (n - 1) // 2)])) k),
near as (
  select distinct a.line from halves a join halves b on a.key = b.key and b.first < a.first and abs(a.n - b.n) <= 1
  where levenshtein(a.line, b.line) <= 1),
judged as (
  select l.doc_id, l.line_no, l.line, length(l.line) >= 20 and (n.line is not null or f.first <> {'d': l.doc_id, 'i': l.line_no}) as gone
  from lines l left join firsts f using (line) left join near n using (line))
select doc_id, count(*) as n_lines, cast(count(*) filter (gone) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by line_no) filter (not gone), '')) as text_sha256
from judged group by doc_id
"""

RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.apply_rules(table(spark, sf_dir, "pages"), RULES)


OP3_SQL = r"""
with parsed as (
  select page_id,
    case when contains(url, '://') then translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*', 0),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
    case when contains(url, '://') then regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path
  from pages),
rules(verdict, h, p) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/'))
select page_id, coalesce(host, '') as host, coalesce(path, '') as path,
  (select h || p from rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) order by length(h || p) desc limit 1) as rule,
  coalesce((select verdict from rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
    order by length(h || p) desc limit 1), 'allow') as verdict
from parsed
"""


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), word_bpe(), end_id=1)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_edited(table(spark, sf_dir, "documents"), word_bpe())


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), word_bpe())


def op10_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_edited(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_line_dedup": op2_line_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_token_files": op4_token_files,
    "op5_token_counts": op5_token_counts,
    "op6_secrets": op6_secrets,
    "op7_quality": op7_quality,
    "op8_decontaminate": op8_decontaminate,
    "op9_bpe": op9_bpe,
    "op10_syncmers": op10_syncmers,
}

SQL: dict[str, str] = {
    "op2_line_dedup": OP2_SQL,
    "op3_url_filter": OP3_SQL,
}
