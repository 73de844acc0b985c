"""Packing token sequences by the sum-of-squares rule.

A task tokenizes its documents and cuts each into whole windows and a rest; a rest is an item. Items are dealt by
a hash into shards of bounded size. In a shard an item goes to the fill level at which the sum of squares of the
numbers of open windows per level becomes least (a full window no longer counts); an array over the levels
holds those numbers. Windows still open at the end are merged by best fit, largest first.

Defined cases: a null text is empty, an empty text has the end id alone; rows that repeat are packed each; a
text of any length is cut; an empty table gives no piece. Other columns are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ringfence.session import cut

WINDOW = 2048
#: The one added token of byte_bpe_50k.json: cut out of a text before the pattern and the merges see it.
ADDED, ADDED_ID = "<|endoftext|>", 50256
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, deal long"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_encoders: dict = {}


def encoder(ranks_path: str | None = None):
    """Ids as the byte_bpe_50k tokenizer gives them to a text without :data:`ADDED`, once per worker."""
    import base64

    import public_tokenizers
    import tiktoken

    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _encoders:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_ids(text: str, encode) -> list[int]:
    """Ids as the byte_bpe_50k tokenizer gives them by default; ``encode`` is for the texts between added tokens."""
    first, *rest = text.split(ADDED)
    ids = encode(first)
    for part in rest:
        ids.append(ADDED_ID)
        ids += encode(part)
    return ids


def token_pieces(window: int, end_id: int, ranks_path: str | None):
    """doc_id, text -> the pieces of every document, with the checksum of their ids."""

    def pieces(batches):
        import pyarrow as pa

        encode = encoder(ranks_path).encode_ordinary
        for batch in batches:
            columns = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                ids = np.array([*token_ids(text.as_py() or "", encode), end_id], "<u4")
                whole = zlib.crc32(ids.tobytes())
                for start in range(0, len(ids), window):
                    part = ids[start:start + window]
                    crc = zlib.crc32(part.tobytes())
                    for column, value in zip(columns, (doc_id.as_py(), start, len(part), crc, len(ids), whole)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [f.split()[0] for f in PIECES.split(", ")])

    return pieces


def sum_of_squares(sizes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The window of each item, in order of arrival."""
    count = np.zeros(window + 1)
    count[window] = -0.5  # a window that fills up leaves the sum and adds nothing
    open_: list[list[int]] = [[] for _ in range(window)]
    where, made = np.empty(len(sizes), np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        if s == window:
            where[i], made = made, made + 1
            continue
        # half the change of the sum for a window of level h = 1 ... window - s; a new window is level 0
        change = np.where(count[1:window - s + 1] > 0, count[s + 1:] - count[1:window - s + 1] + 1, np.inf)
        h = window - s - int(np.argmin(change[::-1]))
        if change[h - 1] <= count[s] + 0.5:
            where[i] = open_[h].pop()
            count[h] -= 1
        else:
            where[i], made, h = made, made + 1, 0
        if h + s < window:
            open_[h + s].append(where[i])
            count[h + s] += 1
    return where


def merge_open(where: np.ndarray, sizes: np.ndarray, window: int) -> np.ndarray:
    """Windows that fit together become one: best fit, largest first."""
    fill = np.bincount(where, sizes, minlength=int(where.max(initial=-1)) + 1).astype(np.int64)
    goes, room = np.arange(len(fill)), [[] for _ in range(window + 1)]
    free = np.zeros(window + 1, bool)
    for w in np.argsort(-fill, kind="stable").tolist():
        if fill[w] == window:
            continue
        fits = np.flatnonzero(free[fill[w]:])
        if len(fits):
            r = int(fits[0]) + int(fill[w])
            target = room[r].pop()
            free[r] = bool(room[r])
            goes[w], r = target, r - int(fill[w])
        else:
            target, r = w, window - int(fill[w])
        room[r].append(target)
        free[r] = True
    return goes[where]


def place(window: int):
    def shard(key, pdf):
        pdf = pdf.sort_values(["order", "doc_id", "start"], kind="stable", ignore_index=True)
        sizes = pdf["length"].to_numpy()
        where = np.unique(merge_open(sum_of_squares(sizes, window), sizes, window), return_inverse=True)[1]
        rank = np.argsort(where, kind="stable")
        before = np.cumsum(sizes[rank]) - sizes[rank]
        head = np.concatenate([[True], where[rank][1:] != where[rank][:-1]])
        offset = np.empty(len(sizes), np.int64)
        offset[rank] = before - np.maximum.accumulate(np.where(head, before, 0))
        pdf["sequence_id"], pdf["offset"] = int(key[0]) * 2**32 + where, offset
        return pdf[[f.split()[0] for f in PLACED.split(", ")]]

    return shard


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = 1, shard_items: int = 50_000, ranks_path: str | None = None) -> DataFrame:
    """The pieces of all documents with their sequence and place in it; ``padded`` is the length of the sequence as stored.

    A sequence is padded to ``window`` unless its length is a power of two.
    """
    pieces = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(token_pieces(window, end_id, ranks_path), PIECES), "pieces")
    shards = max(1, -(-pieces.count() // shard_items))
    order = F.xxhash64("deal", "doc_id", "start")
    dealt = pieces.withColumn("order", order).withColumn("shard", F.pmod("order", F.lit(shards)))
    placed = cut(dealt.groupBy("shard").applyInPandas(place(window), PLACED), "placed")
    fill = placed.groupBy("sequence_id").agg(F.sum("length").alias("_fill"))
    power = F.col("_fill").bitwiseAND(F.col("_fill") - 1) == 0
    return placed.join(fill.select("sequence_id", F.when(power, F.col("_fill")).otherwise(window).alias("padded")), "sequence_id").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded")
