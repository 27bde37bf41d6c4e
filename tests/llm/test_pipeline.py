import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from isobar.llm import decontaminate, quality
from isobar.llm.queries import word_bpe

from .test_corpus import brute_distance, brute_lines
from .test_simhash import similar_kept


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """The smallest tables' documents and some odd rows, with all labels and benchmark items."""
    folder = tmp_path_factory.mktemp("tables")
    source = "/root/testdata/sf0.001"
    odd = spark.createDataFrame([(9000, None, None, None, None), (9001, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.read.parquet(f"{source}/documents.parquet").union(odd).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{source}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def rows(df):
    return sorted([(r.doc_id, r.text) for r in df.collect()], key=lambda r: r[0])


def test_stages_as_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = rows(docs)
    kept = corpus_pipeline.quality_stage(spark, docs, small)
    scores = {r.doc_id: r.score for r in quality.score(docs, spark.read.parquet(f"{small}/labels.parquet")).collect()}
    now = rows(kept)
    assert now == [r for r in before if scores[r[0]] >= 0.3] and 0 < len(now) < len(before)

    lines = corpus_pipeline.line_stage(spark, kept, small)
    want = [(d, t) for d, t, _, _ in brute_lines(now)]
    assert rows(lines) == sorted(want, key=lambda r: r[0])
    assert all(r.n_chars == len(r.text) for r in lines.collect() if r.text is not None and r.doc_id < 9000)
    now = rows(lines)

    near = corpus_pipeline.near_stage(spark, lines, small)
    assert rows(near) == [r for r in now if r[0] in set(similar_kept(now))]
    now = rows(near)

    clean = corpus_pipeline.benchmark_stage(spark, near, small)
    items = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    leaks = {d for d, t in now for x in items if brute_distance_at_most(x, decontaminate.words_of(t or ""))}
    assert rows(clean) == [r for r in now if r[0] not in leaks]

    library = Tokenizer.from_file(word_bpe())
    found = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.token_stage(spark, clean, small).collect()}
    assert found == {d: hashlib.sha256(np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for d, t in rows(clean)}
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, small).collect()} == found


def brute_distance_at_most(item, words):
    """Whether item is in words within the allowed edits; texts that share too few words with it are passed over."""
    k = decontaminate.allowed(len(item), 0.2)
    if len(set(item) & set(words)) < len(set(item)) - k:
        return False
    return brute_distance(item, words) <= k


def test_empty_table(spark, small, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{small}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    found = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and found.count() == 0


def test_repeated_and_null_ids(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(40)
    twice = docs.unionByName(docs.limit(15)).unionByName(docs.limit(25).selectExpr("cast(null as bigint) as doc_id", "concat(text, ' and ', reverse(text)) as text", "lang", "source", "n_chars"))
    twice.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    kept = [r.doc_id for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()]
    assert len(kept) > 10 and len({x for x in kept if x is not None}) == sum(x is not None for x in kept)
