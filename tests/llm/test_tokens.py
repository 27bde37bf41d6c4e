import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from isobar.llm import bpe, token_counts, token_files
from isobar.llm.queries import word_bpe

LETTERS = "abtheinΣσçéßİKſ'sdtrevml019 ٣½!.?<|>ŕ​\x85\x1c\x01\n中字😀ῼ"
ROWS = [(4, "Hello, it's the World's END!"), (2, None), (9, ""), (1, "a<|endoftext|>b <|ENDOFTEXT|> é́"), (1, "second row of one id"), (None, "no id"), (3, "naïve ΣΑΣ 12½ " * 900), (7, "\x1f x\x1fy")]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(word_bpe())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def little(ids):
    return np.array(ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=30), st.text(alphabet=LETTERS, max_size=30)))
def test_any_text_as_the_library(text):
    library = Tokenizer.from_file(word_bpe()) if not hasattr(test_any_text_as_the_library, "t") else test_any_text_as_the_library.t
    test_any_text_as_the_library.t = library
    ids = next(iter(bpe.encoder(word_bpe()).encode_batch([text])))
    assert ids == little(ids_of(library, text))
    assert bpe.encoder(word_bpe()).decode(ids) == library.decode(ids_of(library, text), skip_special_tokens=False)


def test_check_finds_every_bad_proposal():
    merges = bpe.encoder(word_bpe()).merges
    random.seed(2)
    words = ["".join(random.choices("etaoinsrhld", k=random.randint(1, 9))) for _ in range(3000)]
    assert merges.encode(words) == merges.exact(words)
    assert any(merges.propose(w) != x for w, x in zip(words, merges.exact(words)))


def test_encode_decode(spark, library):
    docs = spark.createDataFrame([(i, t, 7) for i, t in ROWS], "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, bpe.encode_decode(docs, word_bpe()).collect()), key=str)
    want = []
    for i, t in ROWS:
        ids = ids_of(library, t)
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(little(ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.encode_decode(docs.limit(0), word_bpe()).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**63), max_size=1500), st.sampled_from([1, 2**20, 2**62]))
def test_elias_fano(values, scale):
    values = sorted(v // scale for v in values)
    found = token_files.EliasFano(token_files.EliasFano.encode(np.array(values, np.uint64)))
    assert found.all().tolist() == values
    assert [found.select(i) for i in range(0, len(values), 97)] == values[::97]


@pytest.mark.parametrize("shard", [50, 1 << 23])
def test_token_files(spark, library, monkeypatch, shard):
    monkeypatch.setattr(token_files, "SHARD_IDS", shard)
    docs = spark.createDataFrame([(i, t, 7) for i, t in ROWS], "doc_id long, text string, start int").repartition(3)
    got = token_files.round_trip(docs, word_bpe()).collect()
    want, start = [], 0
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*ids_of(library, t), 1]
        want.append((i, start, len(ids), zlib.crc32(little(ids))))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files.round_trip(docs.limit(0), word_bpe()).count() == 0


def test_shard_select():
    data = token_files.pack_shard([None, -5, -5, 8], [2, 3, 3, 7], np.arange(7, dtype="<u2").tobytes(), 2)
    shard = token_files.Shard(data)
    assert shard.ids_of_documents() == [None, -5, -5, 8]
    assert [shard.document(i).tolist() for i in range(4)] == [[0, 1], [2], [], [3, 4, 5, 6]]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=LETTERS, max_size=300), st.lists(st.tuples(st.integers(0, 310), st.integers(0, 310), st.text(alphabet=LETTERS, max_size=20)), max_size=6))
def test_edits_as_encoding_anew(text, edits):
    count = token_counts.Counter(word_bpe())
    tree = token_counts.TokenTree(text, count)
    for a, b, new in edits:
        a = min(a, len(text))
        b = max(a, min(b, len(text)))
        text = text[:a] + new + text[b:]
        tree.edit(a, b, new)
        assert tree.text() == text
        assert tree.n_tokens == len(next(iter(count.encoder.encode_batch([text])))) // 4


def test_count_edited(spark, library):
    docs = spark.createDataFrame([(i, t, 7) for i, t in ROWS], "doc_id long, text string, n_edited int")
    got = token_counts.count_edited(docs, word_bpe(), keep=True).collect()
    want = sorted((str(i), len(ids_of(library, t))) for i, t in ROWS)
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want
    assert all(r.n_edited == len(ids_of(library, r.edited)) for r in got)
    long = next(r for r in got if r.doc_id == 3)
    assert long.n_encoded < 30 < long.n_chunks


def test_long_edit_chains(library):
    """Texts of up to 1000 words, emptied and edited again, with blocks cut anew."""
    rng, count = random.Random(4), token_counts.Counter(word_bpe())
    for trial in range(60):
        some = lambda k: "".join(rng.choices(LETTERS if trial % 2 else "abc def's, 12\n", k=k))
        text = " ".join(some(rng.randint(0, 9)) for _ in range(rng.choice([0, 200, 600, 1000])))
        tree = token_counts.TokenTree(text, count)
        for _ in range(8):
            a, b = rng.choice([(0, len(text)), (rng.randint(0, len(text)), len(text) + 3), (k := rng.randint(0, len(text)), k + rng.choice([0, 1, 5, 3000]))])
            new = rng.choice(["", some(4), " ", "\n", " ".join(some(6) for _ in range(600))])
            a, b = min(a, len(text)), max(min(a, len(text)), min(b, len(text)))
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            assert tree.text() == text and tree.n_tokens == len(ids_of(library, text))


def test_leaves_are_pre_tokens(library):
    tree = token_counts.TokenTree("Hello, it's 12 naïve\u0301 worlds!", token_counts.Counter(word_bpe()))
    assert tree.of_block[0][:, 0].tolist() == [5, 2, 2, 3, 1, 2, 7, 6, 1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**63), min_size=1, max_size=2500), st.sampled_from([1, 2**20, 2**62]), st.data())
def test_elias_fano_ranges(values, scale, data):
    values = sorted(v // scale for v in values)
    found = token_files.EliasFano(token_files.EliasFano.encode(np.array(values, np.uint64)))
    start = data.draw(st.integers(0, len(values)))
    stop = data.draw(st.integers(start, len(values)))
    assert found.values(start, stop).tolist() == values[start:stop]


def test_many_rows_of_one_id(spark, library, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_DOCS", 7)
    rows = [(None, f"text {k % 11}") for k in range(60)] + [(5, f"t{k}") for k in range(40)]
    got = sorted(token_files.round_trip(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), word_bpe()).collect(), key=lambda r: r.start)
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[1])):
        n = len(ids_of(library, t)) + 1
        want.append((i, start, n))
        start += n
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == want


def test_store_is_bounded(monkeypatch):
    from isobar.llm import common

    store = common.Store(60_000, 100)
    for k in range(5000):
        store.settle()
        store.add(f"w{k % 1500}", b"1234")
        assert len(store) <= 600
    store.trim()
    assert not store.once
    plain = common.Store(60_000)
    for k in range(5000):
        plain.add_all({f"w{k}": b"12"})
        plain.settle()
        assert len(plain) < 500
    monkeypatch.setattr(common, "TRIMMED", 20_000)
    plain.trim()
    assert 0 < len(plain) < 200


def test_pieces_and_stretches(monkeypatch):
    import pyarrow as pa

    from isobar.llm import common

    monkeypatch.setattr(common, "PIECE_BYTES", 100)
    batch = pa.RecordBatch.from_pydict({"i": list(range(40)), "text": ["x" * (k * 7 % 90) if k % 5 else None for k in range(40)]})
    found = [*common.pieces(batch)]
    assert len(found) > 5 and [x for p in found for x in p.column("i").to_pylist()] == list(range(40))
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column("text").to_pylist()) <= 200 for p in found)
    text = "".join(random.choices("ab \n", k=3000))
    parts = [*common.stretches(text, 64)]
    assert "".join(parts) == text and all(p[-1].isspace() for p in parts[:-1]) and max(map(len, parts)) < 120
