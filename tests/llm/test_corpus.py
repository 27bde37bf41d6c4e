import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar.llm import decontaminate, line_dedup, quality, secrets

random.seed(8)


def within_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def brute_lines(rows):
    place = lambda d, i: (d is None, d or 0, i)
    split = [(d, (t or "").split("\n")) for d, t in rows]
    first = {}
    for d, lines in split:
        for i, x in enumerate(lines):
            if len(x) >= line_dedup.LEAST:
                first[x] = min(first.get(x, (True, 1 << 62, 0)), place(d, i))
    near = {x for x in first for y in first if x != y and first[y] < first[x] and within_one(x, y)}
    out = []
    for (d, t), (_, lines) in zip(rows, split):
        kept = [x for i, x in enumerate(lines) if len(x) < line_dedup.LEAST or (x not in near and first[x] == place(d, i))]
        out.append((d, None if t is None else "\n".join(kept), 0 if t is None else len(lines), 0 if t is None else len(lines) - len(kept)))
    return sorted(out, key=str)


def edit(x):
    k = random.randrange(len(x))
    return random.choice([x[:k] + x[k + 1 :], x[:k] + "é" + x[k:], x[:k] + "#" + x[k + 1 :]])


def line_rows():
    base = ["".join(random.choices("abc é", k=random.choice([19, 20, 21, 31, 32, 33, 48, 64, 200]))) for _ in range(40)]
    base += [x for b in base for x in (edit(b), edit(edit(b)))] + ["a" * 40, "a" * 41, "ab" * 20, "ab" * 20 + "a", "short", ""]
    rows = [(k * 2, "\n".join(random.choices(base, k=random.randint(0, 12)))) for k in range(40)]
    return rows + [(4, rows[2][1]), (4, rows[2][1]), (3, None), (5, ""), (None, rows[7][1]), (None, base[41] + "\n" + "z" * 30), (77, ("long line " * 3000) + "\n" + ("long line " * 3000) + "x")]


def test_lines_as_brute_force(spark):
    rows = line_rows()
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, first int, key string")
    got = line_dedup.dedup(docs)
    assert got.columns == ["doc_id", "text", "first", "key", "n_lines", "n_dropped"]
    assert sorted([(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()], key=str) == brute_lines(rows)


def test_lines_empty_table(spark):
    assert line_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cut_hashes():
    line = "".join(random.choices("abcé中", k=100))
    own = line_dedup.Prefixes(line)
    s = np.arange(99)
    assert own.without(s, s + 1).tolist() == [int(line_dedup.Prefixes(line[:k] + line[k + 1 :]).without(np.zeros(1, int), np.zeros(1, int))[0]) for k in s]


SECRETS = [
    (1, 'password = "hunter2hunter2"\nTOKEN: abcdef12\n'), (2, None), (3, ""), (4, "AKIA" + "A1" * 8 + " AKIA123"), (5, "x" + "0123456789abcdef" * 2), (6, "secret=abc secret = a.b-c/d=="),
    (7, 'k = "Zx81mQpT0vLw77"\nclient_secret = k\nother = k'), (8, "é apiKey' : 'ΣΣ token=ſecret api_KEY:=x1y2z3"), (9, "token " * 3000 + "token=123456"), (1, "same id again"), (None, "passwd:qwerty99"),
    (10, "we said: password is a word; see http://x.org and time 12:30"),
]


def brute_secrets(text):
    text, found = text or "", []
    key = r"(password|passwd|secret|token|api_?key)"
    either = re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", key)
    for m in re.finditer(either + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        found += [(m.start(), 0, m.end())] * (len(m[2]) >= 6)
    for kind, pattern, least in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    found.sort()
    n = [sum(k == x for _, k, _ in found) for x in range(3)]
    return (*n, hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in found).encode()).hexdigest())


def test_secrets(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in SECRETS], "doc_id long, text string, spans int")
    got = secrets.scan(docs, keep=True).collect()
    assert sorted([(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got], key=str) == sorted([(i, *brute_secrets(t)) for i, t in SECRETS], key=str)
    by_id = {r.doc_id: r for r in got}
    assert "Zx81mQpT0vLw77" in by_id[7].found and by_id[10].spans == ""
    assert secrets.scan(docs.limit(0)).count() == 0


def test_lexer_propagates_constants():
    text = 'A = "q8Zr41LmNx"\nB = A\nconfig = {"db_password": B, "colour": "q8q8q8q8Zr"}\nif password == "Qw12345678": pass'
    assert [text[s:e] for s, e, _ in secrets.literals(text)] == ["q8Zr41LmNx"]


@pytest.mark.parametrize("text, want", [
    ("env: DB_PWD=q8Zr41LmNx9k", ["q8Zr41LmNx9k"]), ("INFO:auth=Zx81mQpT0vLw77 done", ["Zx81mQpT0vLw77"]), ("a: b:c:pwd=q8Zr41LmNx9k", ["q8Zr41LmNx9k"]),
    ("note: x=q8Zr41LmNx9k", []), ("k: pwd= q8Zr41LmNx9k", ["q8Zr41LmNx9k"]), ("x: YWJjZGVmZ2g= q8Zr41LmNx9k", []), ("at 12:30:pin=1", []),
])
def test_lexer_reads_assignments_in_bare_values(text, want):
    assert [text[s:e] for s, e, _ in secrets.literals(text)] == want


def quality_tables(spark, n=400):
    random.seed(3)
    word = lambda: "".join(random.choices("etaoinshr", k=random.randint(2, 7)))
    good = lambda: " ".join(word() for _ in range(40)).capitalize() + "."
    bad = lambda: random.choice([" ".join([word()] * 30), " ".join(word() + "###" for _ in range(30)), " ".join(word().upper() + "!!" for _ in range(30))])
    rows = [(i, good() if i % 2 else bad()) for i in range(n)]
    docs = rows + [(n, None), (n + 1, ""), (None, "no id"), (3, rows[3][1])]
    return docs, spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, score double"), spark.createDataFrame([(i, i % 2) for i in range(n)] + [(None, 1), (5, None)], "doc_id long, quality int")


def test_quality(spark):
    rows, docs, labels = quality_tables(spark)
    got = quality.score(docs, labels).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert {r.doc_id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == r.doc_id % 2 for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert quality.score(docs.limit(0), labels).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}


def test_quality_vectors_sum_over_partitions(spark):
    rows, docs, _ = quality_tables(spark, 60)
    a, b = quality.word_vectors(docs.repartition(1)), quality.word_vectors(docs.repartition(7))
    assert np.array_equal(a, b)
    words, total = quality.Words(), np.zeros((quality.ROWS, quality.DIM))
    columns, signs = quality.index_vectors()
    dense = np.zeros((quality.ROWS, quality.DIM))
    np.put_along_axis(dense, columns, signs, axis=1)
    for _, t in rows:
        x = words(t or "")
        for i in range(len(x)):
            for j in range(max(0, i - quality.NEAR), min(len(x), i + quality.NEAR + 1)):
                total[x[i]] += dense[x[j]] * (i != j)
    norm = np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    assert np.allclose(a, total / norm, atol=1e-5)


def test_quality_without_labels(spark):
    _, docs, labels = quality_tables(spark, 20)
    assert {r.score for r in quality.score(docs, labels.limit(0)).collect()} == {0.5}


def brute_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != v)))
        row = new
    return min(row)


def leak_rows():
    random.seed(6)
    word = lambda: "".join(random.choices("etaoinshr", k=random.randint(1, 4)))
    items = [(i, [word() for _ in range(random.choice([1, 3, 5, 8, 15, 30, 60]))]) for i in range(25)]
    docs = []
    for k in range(150):
        i, words = random.choice(items)
        words = list(words)
        for _ in range(random.randint(0, max(1, int(0.3 * len(words))))):
            p = random.randrange(len(words)) if words else 0
            words[p : p + random.randint(0, 1)] = [word()] * random.randint(0, 1)
        docs.append((k, [word() for _ in range(random.randint(0, 50))] + words * random.randint(0, 1) + [word() for _ in range(random.randint(0, 50))]))
    return docs, items


def test_leaks_as_brute_force(spark):
    docs, items = leak_rows()
    rows = [(k, " ".join(w).upper().replace(" ", ",\n ", 3), 1) for k, w in docs] + [(500, None, 1), (501, "", 1), (None, " ".join(items[3][1]), 1), (502, "!!! ...", 1)]
    bench = [(i, " ".join(w)) for i, w in items] + [(90, None), (91, " .. ")]
    df, b = spark.createDataFrame(rows, "doc_id long, text string, item_id int"), spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_edits for r in decontaminate.matches(df, b).collect()}
    want = {}
    for k, words in [*docs, (None, items[3][1])]:
        for i, item in items:
            if (d := brute_distance(item, words)) <= decontaminate.allowed(len(item), 0.2):
                want[k, i] = d
    assert set(got) <= set(want)
    assert all(got[k] >= want[k] for k in got)
    assert len(got) >= 0.97 * len(want) > 60
    assert {k for k in want if want[k] == 0} <= set(got)
    assert decontaminate.matches(df.limit(0), b).count() == 0 and decontaminate.matches(df, b.limit(0)).count() == 0
    kept = decontaminate.keep_clean(df, b)
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {k for k, _ in got} and kept.columns == df.columns


def test_leaks_in_blocks(spark, monkeypatch):
    docs, items = leak_rows()
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    whole = {(r.doc_id, r.item_id) for r in decontaminate.matches(df, b).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 100)
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(df, b).collect()} >= whole


@pytest.mark.parametrize("n", [20, 32, 33, 100])
def test_distance(n):
    rng = np.random.default_rng(n)
    item, text = rng.integers(0, 4, n // 3), rng.integers(0, 4, n)
    d, s, e = decontaminate.distance(item, text)
    assert d == brute_distance(item.tolist(), text.tolist())
    assert d == brute_distance(item.tolist(), text[s:e].tolist()) if e > s else True


def foreign_edits(rng, words):
    """As many edits as the bound of 20 % allows, all with words of their own."""
    words, places = list(words), rng.sample(range(len(words)), decontaminate.allowed(len(words), 0.2))
    for p in sorted(places, reverse=True):
        new = f"x{rng.getrandbits(60)}"
        words[p : p + 1] = rng.choice([[new], [new], [], [words[p], new]])
    return words


@pytest.mark.parametrize("m", [10, 40, 59, 150])
def test_leaks_with_foreign_words(m):
    rng = random.Random(m)
    items = [(i, rng.choices([f"v{k}" for k in range(3000)], k=m)) for i in range(40)]
    index, found = decontaminate.Index(items, 0.2), 0
    for i, words in items:
        text = " ".join([f"y{k}" for k in range(50)] + foreign_edits(rng, words) + [f"z{k}" for k in range(50)])
        found += i in [j for j, *_ in index.find(np.frombuffer(index.rows(text), "<u4").astype(np.int64))]
    assert found >= 0.9 * len(items)


def test_leaks_with_letters_that_are_no_words(spark):
    """Items and texts are cut into words alike: signs like ² and ½ part words in both."""
    bench = spark.createDataFrame([(1, "E = m² c²"), (2, "add 1½ cups of flour and stir for x³ minutes")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "E = m² c²"), (2, "so, add 1½ cups of flour and stir for x³ minutes."), (3, "nothing of it")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.n_edits) for r in decontaminate.matches(docs, bench).collect()) == [(1, 1, 0), (2, 2, 0)]


def test_leaks_in_long_texts_and_items(monkeypatch):
    """Parts of a text, lots of gram matches and few windows at a time give what one go gives."""
    rng = random.Random(2)
    words = [f"v{k}" for k in range(60)]
    items = [(i, rng.choices(words, k=rng.choice([4, 9, 30]))) for i in range(30)]
    index = decontaminate.Index(items, 0.2)
    texts_ = []
    for _ in range(6):
        text = rng.choices(words, k=400)
        for _, x in rng.sample(items, 4):
            at = rng.randrange(len(text))
            text[at:at] = x
        texts_.append(" ".join(text))
    whole = [index.read(t) for t in texts_]
    monkeypatch.setattr(decontaminate, "HITS", 64)
    monkeypatch.setattr(decontaminate, "WINDOWS", 16)
    assert [index.read(t) for t in texts_] == whole
    monkeypatch.setattr(decontaminate, "PART", 100)
    assert [[(j, d) for j, d, *_ in index.read(t)] for t in texts_] == [[(j, d) for j, d, *_ in x] for x in whole]


def test_clean_tables_that_are_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e", 2), (None, None, 3)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()] == [None]
    assert decontaminate.keep_clean(docs, bench.limit(0)).count() == 2 and decontaminate.keep_clean(docs.limit(0), bench).count() == 0


def test_kept_by_quality(spark):
    """Null and empty texts are judged alike, ids may repeat, columns keep their names, and an empty table stays empty."""
    _, docs, labels = quality_tables(spark, 60)
    docs = docs.withColumnsRenamed({"score": "x"}).withColumn("predicted", F.lit("p"))
    kept = quality.keep_good(docs, labels)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and (60 in ids) == (61 in ids) and ids.count(3) in (0, 2)
    assert quality.keep_good(docs.limit(0), labels).count() == 0 and quality.keep_good(docs, labels.limit(0)).count() == docs.count()


def test_quality_vectors_of_long_texts(spark, monkeypatch):
    _, docs, _ = quality_tables(spark, 40)
    whole = quality.word_vectors(docs.repartition(3))
    monkeypatch.setattr(quality, "BLOCK", 7)
    rows, total = [quality.Words()(r.text or "") for r in docs.collect()], np.zeros(quality.ROWS * quality.DIM)
    quality.add_texts(total, rows, *quality.index_vectors())
    table = total.reshape(quality.ROWS, -1)
    assert np.allclose(whole, table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9), atol=1e-5)


def test_lines_by_least_and_names(spark):
    """Shorter lines go too where least says so, by exact repeats alone; columns may have any names."""
    rows = [(1, "yes\nno\n" + "long line " * 3, 1, 2, 3), (2, "yes\nnop\n" + "long line " * 3 + "!", 1, 2, 3), (2, "yes\nyes", 1, 2, 3), (None, None, 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int, _gone int, n_lines int")
    got = line_dedup.dedup(docs, least=1)
    assert got.columns == [*docs.columns, "n_dropped"]
    assert sorted([(r.doc_id, r.text, r.n_lines, r.n_dropped, r._id, r._gone) for r in got.collect()], key=str) == sorted([(1, rows[0][1], 3, 0, 1, 2), (2, "nop", 3, 2, 1, 2), (2, "", 2, 2, 1, 2), (None, None, 0, 0, 1, 2)], key=str)


def test_lines_of_many_null_ids(spark):
    base = [f"line number {k} of some length" for k in range(8)]
    random.seed(1)
    rows = [(None, "\n".join(random.choices(base + [x + "s" for x in base], k=4))) for _ in range(60)]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted([(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()], key=str) == brute_lines(rows)


def test_names_of_any_length():
    long = "x" * 300
    assert [text[s:e] for text in (f"password_{long} = q8Zr41LmNx9k", f"{long}.password = q8Zr41LmNx9k", f'"{long}_secret": "q8Zr41LmNx9k"') for s, e, _ in secrets.literals(text)] == ["q8Zr41LmNx9k"] * 3
    assert [secrets.target(x[::-1], len(x)) for x in ('a.b["c"] ', "`name`", "x `y z`", '"ab" ', "9ab", "$v", "12", "")] == ['a.b["c"]', "name", None, "ab", "ab", "$v", None, None]
