"""Tables with awkward rows, and plain versions of the operators."""

import hashlib
import re
from collections import defaultdict

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns under names that the operators use themselves.
CLASHES = ["size", "key", "n", "kept", "segment", "anchor", "token", "set_key", "text_key", "spans", "shard", "order", "target", "taken", "grade", "id",
           "_id", "_key", "_size", "_rounds", "_runs", "_pieces", "_piece", "_h", "_start", "_part", "_row", "_text", "_own", "weight"]


def frame(spark, rows, extra=True):
    """rows of (doc_id, text, source)."""
    names = CLASHES if extra else []
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
                           *[T.StructField(c, T.StringType()) for c in names]])
    return spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], schema)


def awkward():
    """Nulls, empty and long texts, ties, repeated rows, odd characters."""
    prose = " ".join(f"word{i * 7 % 97} thing{i % 53} of" for i in range(60))
    long = " ".join(f"w{i * i % 9973}" for i in range(40_000))
    one = "x" * 30_000
    rows = [
        (1, prose, "a"), (2, prose, "a"), (3, prose.upper(), "b"), (4, prose.replace("of", "by", 1), None), (5, None, "a"), (6, "", None), (7, " \t\n ", "b"),
        (8, "one two three", "c"), (9, "One  two\nthree", "c"), (9, "One  two\nthree", "c"), (10, long, "a"), (11, long + " end", "d"), (12, one, "d"),
        (13, "\x00é漢字 \U0001f600 ça va " * 40, "a"), (None, prose, "a"), (14, "start " + prose + " end", "é"), (15, one + " " + one, "d"), (16, "a b c d", None),
        (17, "mail me at a.b@c.org or +1 (212) 555-0199, ip 10.0.0.1 card 4111 1111 1111 1111", "b"), (18, prose[:200] + " " + prose[200:], "b"),
    ]
    return rows


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def shingles(text):
    w = WORD.findall(lower(text or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near(rows, percent=75):
    """(doc_id, n_shingles, component_id) of every row; all pairs that share a shingle are compared."""
    sets, by, parent = [shingles(t) for _, t, *_ in rows], defaultdict(list), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for t in s:
            by[t].append(i)
    for a, b in {(x, y) for rows_ in by.values() for x in rows_ for y in rows_ if x < y}:
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            parent[root(a)] = root(b)
    least = defaultdict(list)
    for i, (d, *_) in enumerate(rows):
        least[root(i)].append(d)
    return [(d, len(sets[i]), min((x for x in least[root(i)] if x is not None), default=None)) for i, (d, *_) in enumerate(rows)]


def rest_of_bytes(rows, length):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    texts, seen = [(t or "").encode() for _, t, *_ in rows], defaultdict(int)
    for b in texts:
        for p in range(len(b) - length + 1):
            seen[b[p:p + length]] += 1
    out = []
    for (d, *_), b in zip(rows, texts):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                gone[p:p + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def rest_of_words(rows, length=13):
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    texts, least = [WORD.findall(t or "") for _, t, *_ in rows], {}
    for (d, *_), w in zip(rows, texts):
        for i in range(len(w) - length + 1):
            if d is not None:
                least[tuple(w[i:i + length])] = min(d, least.get(tuple(w[i:i + length]), d))
    out = []
    for (d, *_), w in zip(rows, texts):
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if d is not None and least[tuple(w[i:i + length])] < d:
                gone[i:i + length] = [True] * length
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def same(got, want):
    """Equal as multisets, nulls included."""
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    return sorted(map(tuple, got), key=key) == sorted(want, key=key)
