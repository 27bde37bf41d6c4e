import random

from isobar.llm.queries import RULES
from isobar.llm.url_filter import Rule, apply_rules, cascade, member
from pyspark.sql import functions as F


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def brute(rows, rules):
    out = []
    for i, url in rows:
        host, path = parse(url)
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: (len(r.key), len(r.host)), default=None)
        out.append((i, host, path, best and best.key, best.verdict if best else "allow"))
    return sorted(out, key=str)


URLS = [
    "http://A.Example.ORG/es/1?x", "https://example.org/en/12#t", "https://example.org/en/2", "http://org/", "http://notexample.org/es/", "http://x.com/fr/a",
    "x.com/fr/a", None, "", "http://", "http://x.com", "http://x.com?/fr/", "http://COM/de/", "a://b://c.org/", "http://ex\nample.org/es/\n?", "http://x.com/de/" + "y" * 9000, "http://.org/", "ftp://é.org/É",
]


def test_rules_as_brute_force(spark):
    rows = [(k % 15 if k else None, u) for k, u in enumerate(URLS)] + [(3, URLS[0])] * 2
    pages = spark.createDataFrame([(i, u, 1, "z") for i, u in rows], "page_id long, url string, host int, key string")
    assert sorted(map(tuple, apply_rules(pages, RULES).collect()), key=str) == brute(rows, RULES)
    assert apply_rules(pages.limit(0), RULES).count() == 0
    assert {r.verdict for r in apply_rules(pages, []).collect()} == {"allow"}


def test_many_rules_random(spark):
    random.seed(4)
    name = lambda: ".".join(random.choices("ab", k=random.randint(1, 3)))
    path = lambda: "/" + "".join(random.choices("xy/", k=random.randint(0, 4)))
    rules = list({r.key: r for r in (Rule(random.choice(["allow", "block"]), name(), path()) for _ in range(40))}.values())
    rows = [(k, f"http://{name()}{path()}") for k in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    assert sorted(map(tuple, apply_rules(pages, rules).collect()), key=str) == brute(rows, rules)


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = keys.filter("xxhash64(key) % 9 = 0")
    levels = cascade(listed, keys.union(keys))
    assert len(levels) > 2
    wrong = keys.filter(member(levels, F.col("key")) != F.expr("xxhash64(key) % 9 = 0"))
    assert wrong.count() == 0


def test_long_lists_are_joined(spark, monkeypatch):
    from isobar.llm import url_filter

    rows = [(k % 15 if k else None, u) for k, u in enumerate(URLS)] + [(3, URLS[0])] * 2
    pages = spark.createDataFrame([(i, u, 1, "z") for i, u in rows], "page_id long, url string, keys int, verdict string")
    monkeypatch.setattr(url_filter, "MOST_BITS", 1)
    got = apply_rules(pages, RULES)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, RULES)
    assert apply_rules(pages.limit(0), RULES).count() == 0


def test_thousands_of_rules(spark):
    random.seed(6)
    rules = [Rule(random.choice(["allow", "block"]), f"h{k % 977}.example.org", f"/{k}/") for k in range(3000)]
    rows = [(k, f"http://www.h{k % 977}.example.org/{k + random.randint(0, 1)}/x") for k in range(0, 3000, 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    assert sorted(map(tuple, apply_rules(pages, rules).collect()), key=str) == brute(rows, rules)
