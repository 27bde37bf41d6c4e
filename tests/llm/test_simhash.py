import xxhash

from isobar.llm import simhash
from isobar.llm.common import components

BASE = " ".join(f"word{i} other{i * 7 % 13}" for i in range(40))


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [words] if len(words) < 4 else [words[i : i + 4] for i in range(len(words) - 3)]
    h = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    prints = [brute_print(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    ids = [min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in group]
    return sorted(zip([r[0] for r in rows], prints, ids), key=str)


ROWS = [
    (5, BASE), (3, BASE + " tail"), (9, BASE.replace("word3 ", "WORD3 ")), (2, None), (7, ""), (8, " \t "), (1, "alone"), (1, "alone"),
    (None, BASE), (None, "nobody else has this text at all"), (11, "x y"), (12, "X  y"), (13, "Ünïcode text Ü"), (14, "w " * 5000),
]


def test_matches_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 1, "a") for i, t in ROWS], "doc_id long, text string, fp int, bucket string")
    got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == brute(ROWS)


def test_tiles_lose_no_link(spark, monkeypatch):
    import random

    random.seed(1)
    prints, p = set(), 12345678901234567
    for _ in range(300):
        p ^= 1 << random.randrange(63)
        prints.add(p)
    monkeypatch.setattr(simhash, "TILE", 16)
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    got = {r.node: r.root for r in components(simhash.near_links(df, 4)).collect()}
    root = {x: x for x in prints}
    for _ in range(len(prints)):
        for x in prints:
            for y in prints:
                if bin((x ^ y) & (2**64 - 1)).count("1") <= 4:
                    root[x] = root[y] = min(root[x], root[y])
        if all(root[x] == root[y] for x in prints for y in prints if bin((x ^ y) & (2**64 - 1)).count("1") <= 4):
            break
    assert {x: got.get(x, x) for x in prints} == root


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similar_kept(rows, least=0.8):
    """Ids of the first documents of groups by exact similarity."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sorted({min(r[0] for r, h in zip(rows, group) if h == g and r[0] is not None) for g in group})


def test_similar_texts_of_all_degrees(spark, monkeypatch):
    import random

    random.seed(9)
    rows, pairs = [], {}
    word = lambda: "".join(random.choices("abcdefgh", k=4))
    for k in range(0, 400, 2):
        base = [word() for _ in range(random.choice([40, 150, 400]))]
        other = list(base)
        for _ in range(random.choice([0, 1, 2, 4, 8]) * len(base) // 150 + random.randint(0, 1)):
            other[random.randrange(len(other))] = word()
        rows += [(k, " ".join(base)), (k + 1, " ".join(other))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        pairs[k + 1] = len(a & b) / len(a | b)
    rows += [(1000 + k, " ".join(rows[0][1].split()[:-1] + [word()])) for k in range(150)]  # a crowd around one text
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(simhash, "TILE", 32)
    kept = {r.doc_id for r in simhash.keep_first(docs).collect()}
    assert all(k in kept for k in range(0, 400, 2)) and not kept & set(range(1000, 1150))
    assert all(k in kept for k, j in pairs.items() if j < 0.6)
    assert not any(k in kept for k, j in pairs.items() if j > 0.92)
    close = [k for k, j in pairs.items() if j >= 0.8]
    assert len(close) > 50 and sum(k in kept for k in close) <= 0.05 * len(close)


def test_empty_table_and_stage(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    docs = spark.createDataFrame([(i, t, 3) for i, t in [*ROWS, (None, "nobody else has this text at all")]], "doc_id long, text string, text_hash int")
    got = simhash.keep_first(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == similar_kept([r for r in ROWS if r[0] is not None or r[1] == BASE])
    assert [r.text for r in got.collect() if r.doc_id is None] == ["nobody else has this text at all"]


def test_texts_of_one_fingerprint_are_compared(spark):
    """Texts of own words and a much repeated run: equal fingerprints, hardly a shingle in common."""
    import random

    random.seed(2)
    word = lambda: "".join(random.choices("abcdefgh", k=5))
    run = [word() for _ in range(5)]
    rows = [(k, " ".join([word() for _ in range(60)] + run * 50)) for k in range(8)]
    rows.append((20, rows[3][1].rsplit(" ", 5)[0]))  # the set of text 3
    prints = {simhash.majority(simhash.shingle_hashes(t.encode(), 5)) for _, t in rows}
    assert len(prints) == 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_first(docs).collect()) == similar_kept(rows) == list(range(8))


def test_links_below_the_similarity_are_none(spark, monkeypatch):
    """Pairs just below and just above 0.8, and groups that only a pair below it would join."""
    import random

    random.seed(4)
    rows = []
    word = lambda: "".join(random.choices("abcdefgh", k=5))
    for k in range(0, 600, 3):
        base = [word() for _ in range(204)]
        tail = base[: 204 - random.choice([36, 39, 42, 44, 46, 48, 52])]
        rows += [(k, " ".join(base)), (k + 1, " ".join(tail)), (k + 2, " ".join(tail[:-30] + [word()]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(simhash, "TILE", 2)
    kept, want = {r.doc_id for r in simhash.keep_first(docs).collect()}, set(similar_kept_of_three(rows))
    assert not want - kept  # nothing goes that is not alike
    assert len(kept - want) <= 0.1 * (len(rows) - len(want)) and len(rows) - len(want) > 50


def similar_kept_of_three(rows):
    return [k for at in range(0, len(rows), 3) for k in similar_kept(rows[at : at + 3])]


def test_reached_as_brute_force():
    import random

    import numpy as np

    random.seed(7)
    for n in (1, 2, 40):
        sets = [np.array(sorted(random.sample(range(14), random.randint(8, 13))), np.uint64) for _ in range(n)]
        a, b = simhash.reached(sets, 0.8)
        of = lambda i, j: len({*sets[i].tolist()} & {*sets[j].tolist()}) / len({*sets[i].tolist()} | {*sets[j].tolist()})
        assert all(of(i, j) >= 0.8 for i, j in zip(a, b))
        root = simhash.spanning(n, np.array(a, int), np.array(b, int))
        assert all(root[i] == root[j] for i in range(n) for j in range(n) if of(i, j) >= 0.8) and len(a) == n - len(set(root.tolist()))


def test_similar_sets_with_other_repeats_are_found(spark):
    """Texts of nearly one set of shingles, a run of 8 words repeated twice in one and 62 times in the other; and pairs from 0.8 on."""
    import random

    random.seed(5)
    rows = []
    word = lambda: "".join(random.choices("abcdefgh", k=5))
    for k in range(0, 300, 3):
        base, run = [word() for _ in range(200)], [word() for _ in range(8)]
        rows += [(k, " ".join(base + run * 2)), (k + 1, " ".join(base + run * 62 + [word()])), (k + 2, " ".join([word() for _ in range(24)] + base))]
    more = []
    for k in range(1000, 1400, 2):
        text = " ".join(word() for _ in range(164))
        more += [(k, text), (k + 1, text + " " + " ".join(word() for _ in range(38)))]
    kept = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows + more, "doc_id long, text string")).collect()}
    assert not [k for k in kept if k < 1000 and k % 3 == 1]
    assert not [k for k in kept if k >= 1000 and k % 2]


def test_rows_of_one_id_are_told_apart_by_text(spark):
    """Each text of a shared id is judged by itself, however rows are dealt and whatever columns are called."""
    text = {x: " ".join(f"{x}{i}" for i in range(30)) for x in "abc"}
    rows = [(1, text["a"], 5, "x"), (2, text["a"], 6, "x"), (2, text["b"], 7, "y"), (2, text["b"], 3, "z"), (None, text["c"], 1, "n"), (None, text["c"] + " more", 2, "n"), (None, text["b"], 9, "n")]
    layouts = []
    for parts in (1, 2, 5):
        docs = spark.createDataFrame(rows if parts < 5 else rows[::-1], "doc_id long, text string, hash int, _hash string").repartition(parts)
        got = simhash.keep_first(docs)
        assert got.columns == docs.columns
        layouts.append(sorted(map(tuple, got.collect()), key=str))
    assert layouts[0] == layouts[1] == layouts[2]
    assert [(r[0], r[1]) for r in layouts[0] if r[0]] == [(1, text["a"]), (2, text["b"])]
    assert len(layouts[0]) == 3 and layouts[0][-1][0] is None and layouts[0][-1][1].startswith(text["c"])


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    """A crowd around one print, a chain and loners, in buckets of many tiles with few leaders."""
    import random

    random.seed(3)
    centre, far = 0x1234567812345678, 0x7234567812345678 ^ 0xFF00
    prints = {centre ^ (1 << random.randrange(40)) ^ (1 << random.randrange(40)) for _ in range(250)}
    at = far
    for _ in range(60):
        at ^= (1 << random.randrange(40)) | (1 << random.randrange(40))
        prints.add(at)
    prints |= {centre ^ random.getrandbits(24) for _ in range(80)}
    monkeypatch.setattr(simhash, "TILE", 8)
    monkeypatch.setattr(simhash, "LEADERS", 2)
    rows = sorted(prints)
    want = list(range(len(rows)))
    close = [(i, j) for i in range(len(rows)) for j in range(i) if bin(rows[i] ^ rows[j]).count("1") <= 4]
    for _ in rows:
        before = list(want)
        for i, j in close:
            want[i] = want[j] = min(want[i], want[j])
        if want == before:
            break
    for agree in (2, 3):
        got = {r.node: r.root for r in components(simhash.near_links(spark.createDataFrame([(x,) for x in rows], "fp long"), 4, agree)).collect()}
        assert [got.get(x, x) for x in rows] == [rows[k] for k in want]


def test_blocks_by_number():
    assert [len(simhash.block_masks(4, simhash.agreeing(n))) for n in (10, 1 << 30, 1 << 40)] == [15, 35, 70]
    for agree in (2, 3, 4):
        masks = [m & (2**64 - 1) for m in simhash.block_masks(4, agree)]
        assert all(any(not difference & m for m in masks) for difference in (0, 0xF, 0x8000400020001000, 1 | 1 << 63, 0x8000000100010001))
