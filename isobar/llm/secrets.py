"""Secret scans: fixed patterns, and assignment-aware lexing.

The lexer reads source and configuration syntax around each = and : into pairs
of a name and a literal, follows names that stand for earlier literals, and
scores a literal by how sensitive its target names are and how random it looks.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts

#: Fixed patterns; kinds in the order that breaks ties.
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: How sensitive a name's part is.
WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "auth": 0.7, "bearer": 0.9, "privatekey": 1.0, "accesskey": 1.0, "signingkey": 0.9, "encryptionkey": 0.9, "secretkey": 1.0, "key": 0.6, "pin": 0.5,
}
THRESHOLD = 0.5
PLACEHOLDERS = {"none", "null", "true", "false", "undefined", "changeme", "example", "redacted"}

OPERATOR = re.compile(r"=>|:=|[:=]")
#: What may stand before an operator, read backwards: blanks, then a run of a name's characters or a name in backticks.
BEFORE = re.compile(r"""[ \t]*(?:`([\w.\-]*)`|([\w.\-\[\]"']*\$?))""")
QUOTED = re.compile(r"[A-Za-z_][\w.\-]*")
VALUE = re.compile(r"""[ \t]*(?:[rbuf]{0,2}"((?:[^"\\\n]|\\.)*)"|[rbuf]{0,2}'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`|([^\s"'`,;{}()\[\]<>]+))""")
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
BARE = re.compile(r"[A-Za-z_$][\w.]*\Z")


def sensitivity(name: str) -> float:
    """The greatest weight of a part of a name, or of two parts together, under camel or snake case."""
    parts = [p.lower() for p in PART.findall(name)]
    return max((WEIGHTS.get(p, 0.0) for p in [*parts, *(a + b for a, b in zip(parts, parts[1:])), name.lower()]), default=0.0)


def strength(literal: str) -> float:
    """0 to 1: bits of a literal by its own letter frequencies, 24 of them or more being 1; 0 for placeholders and prose."""
    if len(literal) < 6 or literal.lower() in PLACEHOLDERS or any(c.isspace() for c in literal) or literal[:1] in "<$" or "{{" in literal or "://" in literal and "@" not in literal:
        return 0.0
    n = len(literal)
    bits = -sum(k * math.log2(k / n) for k in Counter(literal).values())
    return min(1.0, bits / 24)


def target(turned: str, at: int) -> str | None:
    """The name that ends before the operator at a place of the text; turned: the text backwards.

    Of the run of characters that a name may have, the name starts at the
    first letter, _ or $; a name within one pair of quotes stands for itself.
    Runs end at operators, so that all of a text's are read once.
    """
    found = BEFORE.match(turned, len(turned) - at)
    if found[1] is not None:
        name = found[1][::-1]
        return name if QUOTED.fullmatch(name) else None
    run = found[2][::-1]
    for k, c in enumerate(run):
        if c in "\"'" and len(run) > k + 2 and run[-1] == c and QUOTED.fullmatch(run, k + 1, len(run) - 1):
            return run[k + 1 : -1]
        if c.isascii() and c.isalpha() or c in "_$":
            return run[k:]
    return None


def pairs(text: str):
    """(name, literal or bare word, start, end, quoted) of each assignment, in order; those inside a bare value follow it."""
    done, turned = 0, text[::-1]
    for op in OPERATOR.finditer(text):
        if op.start() < done:
            continue
        name = target(turned, op.start())
        right = name and VALUE.match(text, op.end())
        if not right or text[op.end() : op.end() + 1] == "=" or text[op.start() - 1 : op.start()] in ("=", "!", "<", ">"):
            continue
        k = next(k for k in (1, 2, 3, 4) if right[k] is not None)
        if k == 4 and op[0] == ":" and text[op.end() : op.end() + 2] == "//":
            continue
        yield name, right[k], right.start(k), right.end(k), k != 4
        done = right.start(k) if k == 4 else right.end()


def literals(text: str) -> list[tuple[int, int, float]]:
    """Spans of literals whose score reaches THRESHOLD, with their scores.

    A bare word that an earlier assignment of the text defines stands for that
    literal, through chains of names; its own target's name then counts too.
    """
    if "=" not in text and ":" not in text:
        return []
    defined: dict[str, tuple[str, int, int]] = {}
    best: dict[tuple[int, int], float] = {}
    for name, value, start, end, quoted in pairs(text):
        if not quoted and BARE.match(value) and value in defined:
            literal = defined[value]  # propagated
        else:
            literal = (value, start, end)
        defined[name] = literal
        weight = sensitivity(name)
        score = weight and weight * strength(literal[0])
        if score >= THRESHOLD:
            best[literal[1:]] = max(score, best.get(literal[1:], 0.0))
    return [(s, e, score) for (s, e), score in best.items()]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the fixed patterns, failing matches dropped."""
    found = []
    lower = text.lower()
    if any(n in lower for n in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans; with keep also found, the texts of the spans.

    spans has those of the patterns and, as kind literal, those of the lexer;
    code points, end exclusive. Null text is the empty text, without spans; a
    very long one, of one line too, takes time in proportion; names are read
    whole, however long. A null doc_id stays null; repeated rows give repeated
    rows, an empty table none. Other columns of docs are not read.
    """

    def make():
        def step(batch):
            rows = []
            for text in texts(batch):
                base = base_spans(text)
                counts = Counter(k for _, k, _ in base)
                every = sorted(base + [(s, 3, e) for s, e, _ in literals(text)])
                rows.append((counts[0], counts[1], counts[2], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), [text[s:e] for s, _, e in every] if keep else None))
            return {"doc_id": batch.column("doc_id")} | dict(zip(("n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"), map(list, zip(*rows))))

        return step

    ddl = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string" + ", found array<string>" * keep
    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), make, ddl)
