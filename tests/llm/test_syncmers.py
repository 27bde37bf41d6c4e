import hashlib
import random

import xxhash

from isobar.llm import syncmers


def chain(*hashes):
    out = 42
    for h in hashes:  # each seeds the next, as Spark's function does over several columns
        out = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), out)
    return out


def signed(x):
    return x - 2**64 if x >> 63 else x


def bottom(text):
    words = [b.decode() for b in text.encode().split()]
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in (words if len(words) >= 5 else " ".join(words))]
    if len(h) < 5:
        found = [xxhash.xxh64_intdigest(" ".join(str(signed(x)) for x in h).encode(), 42)] if h else []
    else:
        b = [signed(chain(h[i], h[i + 1])) for i in range(len(h) - 1)]
        found = [chain(*h[i : i + 5]) for i in range(len(h) - 4) if min(b[i : i + 4]) in (b[i], b[i + 3])]
    return sorted({signed(x) >> 32 for x in found})[:64]


def likeness(a, b):
    union = sorted(set(a) | set(b))[:64]
    return len(set(union) & set(a) & set(b)) / len(union) if union else 1.0


def brute(rows):
    full = [(i, t or "") for i, t in rows]
    order = sorted(full, key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest(r[1].encode(), 42))), reverse=True)
    out = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        m = len(t) // 3
        edited = t[: len(t) - m] + after[:m]
        a, e, x = bottom(t), bottom(edited), bottom(after)
        hexed = lambda f: "".join(f"{v & 0xFFFFFFFF:08x}" for v in f)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(e), round(likeness(a, e), 9), round(likeness(a, x), 9)))
    return sorted(out, key=str)


def rows_of(found):
    return sorted([(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in found.collect()], key=str)


def sample():
    random.seed(5)
    word = lambda: "".join(random.choices("abcéß", k=random.randint(1, 5)))
    rows = [(i * 3, " ".join(word() for _ in range(random.choice([0, 1, 4, 5, 30, 200])))) for i in range(60)]
    rows += [(500, "一二三四五六七八九十" * 9), (501, "一二三四五六七八九十" * 9 + "百"), (502, "😀 ab"), (503, "four"), (504, "a b  c d")]
    return rows + [(7, None), (9, rows[5][1]), (9, rows[5][1]), (9, "other text of the same id"), (None, "no id at all here I think"), (None, None), (400, "\n x\ty " * 3000)]


def test_as_brute_force_over_buckets(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, 1) for i, t in sample()], "doc_id long, text string, next int")
    want = brute(sample())
    assert rows_of(syncmers.fingerprint_edited(docs)) == want
    monkeypatch.setattr(syncmers, "BUCKET", 10)
    assert rows_of(syncmers.fingerprint_edited(docs)) == want


def test_empty_and_single(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert syncmers.fingerprint_edited(docs).count() == 0
    docs = spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string")
    assert rows_of(syncmers.fingerprint_edited(docs)) == brute([(1, "one two three four five six")])


def test_anchors_do_not_depend_on_context(spark):
    passage = " ".join(f"p{i * i % 97}" for i in range(40))
    docs = spark.createDataFrame([(1, "a b c " + passage + " d e"), (2, "x " + passage)], "doc_id long, text string")
    found = {(r.doc_id, r.position): r.anchor for r in syncmers.anchors(docs).collect()}
    assert {p - 3: a for (d, p), a in found.items() if d == 1 and 3 <= p <= 38} == {p - 1: a for (d, p), a in found.items() if d == 2 and 1 <= p <= 36}


def test_rows_that_repeat_very_often(spark, monkeypatch):
    rows = [(None, None)] * 70 + [(k, f"text {k} of a few words {k}") for k in range(30)] + [(None, f"no id {k % 3}") for k in range(40)] + [(12, "again and again and again")] * 45
    monkeypatch.setattr(syncmers, "BUCKET", 5)
    monkeypatch.setattr(syncmers, "COPIES", 16)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(syncmers.fingerprint_edited(docs)) == brute(rows)


def test_texts_without_blanks_go_by_characters(spark):
    text = "".join(chr(0x4E00 + i * i % 997) for i in range(300))
    docs = spark.createDataFrame([(2, text), (1, text[150:])], "doc_id long, text string")
    found = {r.doc_id: r for r in syncmers.fingerprint_edited(docs).collect()}
    assert 0.2 < found[2].near_edited < 1 and 0.2 < found[2].near_next < 1
