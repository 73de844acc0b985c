"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere.

Sparse suffix array: only suffixes that start at anchors are kept (see ``segments``), each with the bytes before it that a repeated
string could begin with. Sampled splitters range-partition them by anchor; in a bucket the suffixes, and the
reversed prefixes, are sorted by multikey quicksort over 8-byte keys, common prefixes are taken between neighbours,
and a string of l bytes before and the rest after the anchor repeats where two suffixes fall into one group of
either order. A range never cuts through the suffixes of one anchor, so no repeat crosses a boundary; anchors with too many
different surroundings for one task are decided string by string.

Defined cases: a null text is empty; a shorter text than ``length`` bytes loses nothing; repeated rows are copies
and lose every byte they share; strings never cross documents; a null doc_id is kept as it is.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from ringfence.llm.segments import Units, covered, keyed, rebuilt, repeated_spans

GRAM, BLOCK, SMALL = 64, 256, 64


def multikey_quicksort(keys: np.ndarray) -> np.ndarray:
    """Order of the rows of a key matrix: three-way partition on one column, the equal part goes on with the next."""
    order, todo = np.arange(len(keys)), [(0, len(keys), 0)]
    while todo:
        lo, hi, d = todo.pop()
        if hi - lo < 2 or d == keys.shape[1]:
            continue
        part = order[lo:hi]
        if hi - lo <= SMALL:
            order[lo:hi] = part[np.lexsort(keys[part, d:].T[::-1])]
            continue
        column = keys[part, d]
        some = np.sort(column[::max(1, len(column) // 31)])
        pivot = some[len(some) // 2]
        less, more = part[column < pivot], part[column > pivot]
        order[lo:hi] = np.concatenate([less, part[column == pivot], more])
        todo += [(lo, lo + len(less), d), (lo + len(less), hi - len(more), d + 1), (hi - len(more), hi, d)]
    return order


def padded(strings: list[bytes], width: int) -> np.ndarray:
    width += -width % 8
    out = np.zeros((len(strings), width), np.uint8)
    for row, s in zip(out, strings):
        row[:len(s)] = np.frombuffer(s, np.uint8)
    return out


def common(rows: np.ndarray) -> np.ndarray:
    """Length of the common prefix of every row with the one before; 0 for the first."""
    differ = rows[1:] != rows[:-1]
    return np.concatenate([[0], np.where(differ.any(1), differ.argmax(1), rows.shape[1])]).astype(np.int64)


def sorted_rows(rows: np.ndarray):
    order = multikey_quicksort(rows.view(">u8"))
    return order, common(rows[order])


def bucket_judge(length: int, gram: int = GRAM):
    """Windows of a bucket's segments that are equal to a window of another one, or have copies.

    Padding never decides: a string of l and length - l bytes lies inside its segment on both sides.
    """

    def judge(classes, lead, n, docs, bodies):
        before = padded([b[:k][::-1] for b, k in zip(bodies, lead.tolist())], length - gram)
        after = padded([b[k:k + length] for b, k in zip(bodies, lead.tolist())], length)
        reach = np.zeros((2, len(bodies)), np.int64)
        for side, rows in enumerate((before, after)):
            order, same = sorted_rows(rows)
            reach[side, order] = np.maximum(same, np.append(same[1:], 0))
        rows = np.flatnonzero(reach.sum(0) >= length)
        hits = [[] for _ in bodies]
        if len(rows) > 1:
            groups = [sorted_rows(side[rows]) for side in (before, after)]
            first, windows = lead[rows], n[rows]
            for l in range(length - gram + 1):
                w = first - l
                live = np.flatnonzero((w >= 0) & (w < windows))
                if len(live) < 2:
                    continue
                key = np.zeros(len(rows), np.int64)
                for (order, same), least in zip(groups, (l, length - l)):
                    part = np.empty(len(rows), np.int64)
                    part[order] = np.cumsum(same < least)
                    key = key * (len(rows) + 1) + part
                order = live[np.argsort(key[live], kind="stable")]
                equal = key[order][1:] == key[order][:-1]
                twice = np.concatenate([[False], equal]) | np.concatenate([equal, [False]])
                for i in order[twice].tolist():
                    hits[rows[i]].append(int(w[i]))
        return hits

    return judge


def _rest(batches):
    import pyarrow as pa

    for batch in batches:
        out = []
        spans_of = batch.column("spans")
        for i, text in enumerate(batch.column("text")):
            text, spans = text.as_py(), spans_of[i].as_py()
            raw = text.encode()
            gone = covered(spans, len(raw))
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if spans else raw
            out.append((len(raw), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
        columns = [list(c) for c in zip(*out)] or [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())],
                                         ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def byte_spans(docs: DataFrame, length: int = 400, class_limit: int = 100_000, bits: int = 26) -> DataFrame:
    """doc_id, text_key, spans: byte ranges covered by a ``length``-byte string that starts anywhere else as well."""
    units = Units(False, length, min(GRAM, length // 2), min(BLOCK, length // 2))
    return repeated_spans(docs, units, bucket_judge(length, units.gram), False, class_limit, bits)


def remove_repeated_bytes(docs: DataFrame, length: int = 400, class_limit: int = 100_000, bits: int = 26) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    rows = keyed(docs)
    return rebuilt(rows, byte_spans(rows, length, class_limit, bits), _rest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
