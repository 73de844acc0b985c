"""Windows of documents that occur elsewhere, found without sending every window.

A document is a sequence of units (bytes, or words as hashes); a window is ``window`` consecutive ones. The anchor of a window
is its gram of ``gram`` units with the least hash, the first of equals. That depends on the window's content alone, so equal
windows have equal anchors at equal places. Consecutive windows with one anchor form a *segment*; every window
lies in exactly one. Segments with equal anchors are a *class*: only inside a class can windows be equal.

1. Anchors are counted (combined per task first). A class that can't hold a repeat is done with.
2. The others leave two bit arrays of fixed size, of classes to look at and of those with different segments. They
   go to every task; a false hit costs time only.
3. Occurrences of the remaining segments are written with their place. Where a class has one segment only, its count
   decides. Of the others a window may be shared only where the units on one side of the anchor are, so those are compared as
   hashes first; the text of a segment left is sent by the first document that has it. Two bit arrays tell which.
4. A judge decides, class by class, which windows of different segments repeat. Classes with more than
   ``class_limit`` distinct segments are decided window by window in a grouped count of 128-bit hashes instead.
5. Occurrences meet the verdict of their class or segment, those of the most frequent ones (fewer than ``HOT_SHARE``, a hit a
   window at most) by broadcast; spans are collected per document.

Rows are known by doc_id and a hash of the text, so that repeated ids do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ringfence.llm.kernels import grams, inside, mix, pieces, word_hashes, words
from ringfence.llm.rows import join_groups
from ringfence.session import cut, join_small

BYTE = mix(np.arange(256, dtype=np.uint64), 3)
PLACE = np.uint64(2**31 - 1)
OCCURRENCES = "doc_id long, text_key long, start long, n_windows int, anchor long, segment long, before long, after long"
BODIES = "anchor long, segment long, lead int, n_windows int, doc long, body binary"


@dataclass(frozen=True)
class Units:
    words: bool
    window: int
    gram: int
    block: int

    def sequence(self, buf, at):
        if self.words:
            starts, ends, first = words(buf, at)
            return word_hashes(buf, starts, ends), first
        return BYTE[buf], at

    def of_body(self, body: bytes) -> np.ndarray:
        """The units of a body, the text of a segment, as hashes."""
        return self.sequence(np.frombuffer(body, np.uint8), np.array([0, len(body)]))[0]

    def extent(self, buf, at, a: np.ndarray, b: np.ndarray):
        """Bytes of the units from a to b."""
        if not self.words:
            return a, b
        starts, ends, _ = words(buf, at)
        return starts[a], ends[b - 1]


def least(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive entries."""
    n, out, have = len(keys) - width + 1, keys, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[:n], out[width - have:width - have + n])


def cut_segments(units: Units, buf: np.ndarray, at: np.ndarray):
    """Segments of a piece: document, start in the piece and in the document, windows, lead to the anchor, two keys."""
    h, first = units.sequence(buf, at)
    starts = inside(first, units.window)
    if not len(starts):
        return h, None
    g = grams(h, units.gram)
    keys = (g & ~PLACE) | np.arange(len(g), dtype=np.uint64)
    anchor = (least(keys, units.window - units.gram + 1)[starts] & PLACE).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    s, n, a = starts[new], np.diff(np.append(new, len(starts))), anchor[new]
    size = n + units.window - 1
    b, points = grams(h, units.block), -(-(2 * units.window - units.gram) // units.block)
    key = size.astype(np.uint64) * np.uint64(1 << 32) + (a - s).astype(np.uint64)
    for j in range(points + 1):  # overlapping blocks cover the segment
        key = mix(key ^ b[s + (size - units.block) * j // points], j)
    doc = np.searchsorted(first, s, "right") - 1
    return h, (doc, s, s - first[doc], n, a - s, g[a].view(np.int64), key.view(np.int64))


def half_keys(units: Units, h: np.ndarray, found):
    """Keys of the units next to each segment's anchor, before and after it, half of what a window has beside its anchor.

    A window has that many on one side at least. Segments that share a window share that key, so one whose keys no other has
    holds no repeat. Also where a segment is long enough to have them.
    """
    _, s, _, n, lead, anchor, _ = found
    half = -(-(units.window - units.gram) // 2)
    g, at = grams(h, half), s + lead
    rooms = (lead, n + units.window - 1 - lead - units.gram)
    for side, (place, room) in enumerate(zip((at - half, at + units.gram), rooms)):
        enough = room >= half
        yield mix(g[np.where(enough, place, 0)] ^ anchor.view(np.uint64), 12 + side), enough


def count_schema(smaller_doc: bool) -> str:
    return f"anchor long, n long, {'d_min long, d_max long, ' if smaller_doc else ''}s_min long, s_max long"


def _count(units: Units, smaller_doc: bool):
    names = [f.split()[0] for f in count_schema(smaller_doc).split(", ")]

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            for a, b, buf, at in pieces(batch.column("text")):
                _, found = cut_segments(units, buf, at)
                if found is None:
                    continue
                order = np.argsort(found[5], kind="stable")
                doc, anchor, key = ids[a:b][found[0]][order], found[5][order], found[6][order]
                at_ = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
                of = [np.diff(np.append(at_, len(anchor)))]
                of += [np.minimum.reduceat(doc, at_), np.maximum.reduceat(doc, at_)] if smaller_doc else []
                columns = [anchor[at_], *of, np.minimum.reduceat(key, at_), np.maximum.reduceat(key, at_)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return count


CHUNK = 1 << 16


def class_key(anchor: np.ndarray) -> np.ndarray:
    """Spread evenly: an anchor is the least of many hashes, so most anchors have the same leading bits."""
    return mix(anchor.view(np.uint64), 8)


def class_keys(batch):
    """Keys of the classes to look at, and of those with several different segments."""
    keys = class_key(batch.column("anchor").to_numpy())
    return keys, keys[batch.column("several").to_numpy(zero_copy_only=False)]


def sender_key(anchor: np.ndarray, segment: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(mix(anchor.view(np.uint64) ^ mix(segment.view(np.uint64), 5), 6) ^ doc.view(np.uint64), 7)


def sender_keys(batch):
    """Keys of the segments with the first document of each."""
    return [sender_key(*(batch.column(c).fill_null(0).to_numpy() for c in ("anchor", "segment", "doc")))]


def shared_halves(batch):
    return [batch.column("half").to_numpy().view(np.uint64)]


def _bits(bits: int, keys_of, arrays: int):
    def fill(batches):
        import pyarrow as pa

        flags = np.zeros((arrays, 1 << bits), bool)
        for batch in batches:
            for flag, keys in zip(flags, keys_of(batch)):
                flag[keys >> np.uint64(64 - bits)] = True
        packed = np.packbits(flags, axis=1)
        for which in range(arrays):
            for chunk in range(0, packed.shape[1], CHUNK):
                part = packed[which, chunk:chunk + CHUNK]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([which]), pa.array([chunk]), pa.array([part.tobytes()], pa.binary())], ["which", "chunk", "bits"])

    return fill


def is_set(known: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    p = keys >> np.uint64(64 - bits)
    return (known[p >> np.uint64(3)] >> (np.uint64(7) - (p & np.uint64(7))).astype(np.uint8)) & 1 > 0


def _united(key, pdf):
    import pandas as pd

    out = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pdf["bits"]])
    return pd.DataFrame({"which": [key[0]], "chunk": [key[1]], "bits": [out.tobytes()]})


def bit_arrays(rows: DataFrame, keys_of, arrays: int, bits: int) -> np.ndarray:
    """Arrays of 2^bits bits for the keys that ``keys_of`` takes from the batches of ``rows``. Their size is fixed."""
    schema = "which long, chunk long, bits binary"
    parts = rows.mapInArrow(_bits(bits, keys_of, arrays), schema).groupBy("which", "chunk").applyInPandas(_united, schema)
    out = np.zeros((arrays, max(1, (1 << bits) // 8)), np.uint8)
    for which, chunk, part in parts.collect():
        out[which, chunk:chunk + len(part)] = np.frombuffer(bytes(part), np.uint8)
    return out


def _hit_segments(units: Units, known, bits: int, batches):
    """Per piece: its batch and first row, bytes, offsets, units, the segments of classes to look at, which have several."""
    for batch in batches:
        for a, b, buf, at in pieces(batch.column("text")):
            h, found = cut_segments(units, buf, at)
            if found is not None:
                hit = is_set(known[0], class_key(found[5]), bits)
                found = [x[hit] for x in found]
                if hit.any():
                    yield batch, a, buf, at, h, found, is_set(known[1], class_key(found[5]), bits)


def _occurrences(units: Units, sent, bits: int):
    names = [f.split()[0] for f in OCCURRENCES.split(", ")]

    def occurrences(batches):
        import pyarrow as pa

        for batch, a, _, _, h, found, several in _hit_segments(units, sent.value, bits, batches):
            doc, _, start, n, _, anchor, key = found
            rows = pa.array(a + doc)
            halves = [pa.array(x.view(np.int64), mask=~(several & enough)) for x, enough in half_keys(units, h, found)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), batch.column("text_key").take(rows), pa.array(start), pa.array(n.astype(np.int32)), pa.array(anchor), pa.array(key, mask=~several), *halves], names)

    return occurrences


def _bodies(units: Units, sent, senders, halves, bits: int):
    """The texts of segments that share a half with another one of their class, from their first documents."""
    names = [f.split()[0] for f in BODIES.split(", ")]

    def bodies(batches):
        import pyarrow as pa

        for batch, a, buf, at, h, found, several in _hit_segments(units, sent.value, bits, batches):
            met = np.zeros(len(several), bool)
            for key, enough in half_keys(units, h, found):
                met |= enough & is_set(halves.value[0], key, bits)
            several = several & met
            ids = batch.column("doc_id").fill_null(0).to_numpy()[a + found[0]]
            own = np.flatnonzero(several)
            own = own[is_set(senders.value[0], sender_key(found[5][own], found[6][own], ids[own]), bits)]
            own = own[np.unique(np.stack([found[6][own], ids[own]]), axis=1, return_index=True)[1]]
            if len(own):
                _, s, _, n, lead, anchor, key = (x[own] for x in found)
                lo, hi = units.extent(buf, at, s, s + n + units.window - 1)
                texts = [buf[x:y].tobytes() for x, y in zip(lo.tolist(), hi.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(key), pa.array(lead.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(ids[own]), pa.array(texts, pa.binary())], names)

    return bodies


JUDGED = "anchor long, segment long, hits array<int>"
BLOCK_BYTES = 16 << 20


def _by_class(judge):
    """Rows in order of class; whole classes are gathered to blocks of ``BLOCK_BYTES`` for the judge.

    The judge gets (class number, lead, n_windows, least doc_id, text) and gives per segment the windows that repeat.
    """

    def run(batches):
        import pyarrow as pa

        def decided(rows):
            anchor, segment, lead, n, doc, body = (list(x) for x in zip(*rows))
            classes = np.unique(np.array(anchor), return_inverse=True)[1]
            hits = judge(classes, np.array(lead), np.array(n), np.array(doc), body)
            return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(segment), pa.array(hits, pa.list_(pa.int32()))], ["anchor", "segment", "hits"])

        held, size, last, met = [], 0, None, set()
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[0] != last:
                    last, met = row[0], set()
                    if size >= BLOCK_BYTES:
                        yield decided(held)
                        held, size = [], 0
                if row[1] not in met:  # sent twice; the first row has the least doc_id
                    met.add(row[1])
                    held.append(row)
                    size += len(row[-1])
        if held:
            yield decided(held)

    return run


def _windows(units: Units):
    """Every window of a segment with two hashes, for classes too large for one task."""

    def windows(batches):
        import pyarrow as pa

        names = ["anchor", "segment", "copies", "doc", "w", "h1", "h2"]
        for batch in batches:
            for anchor, segment, n, copies, doc, body in zip(*[c.to_pylist() for c in batch.columns]):
                h = units.of_body(body)
                one, two = grams(h, units.window), grams(mix(h, 11), units.window)
                same = [pa.array([v] * n, pa.int64()) for v in (anchor, segment, copies, doc)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(n, dtype=np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names)

    return windows


def _spans(units: Units):
    def spans(batches):
        import pyarrow as pa

        for batch in batches:
            whole, start, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("whole", "start", "n_windows"))
            hits = batch.column("hits")
            row, a, b = [np.flatnonzero(whole)], [start[whole]], [start[whole] + n[whole]]
            for i in np.flatnonzero(~whole & ~hits.is_null().to_numpy(zero_copy_only=False)).tolist():
                w = np.unique(np.array(hits[i].as_py(), np.int64))
                if len(w):
                    gap = np.flatnonzero(np.diff(w) > 1)
                    lo, hi = w[np.concatenate([[0], gap + 1])], w[np.concatenate([gap, [len(w) - 1]])] + 1
                    row.append(np.full(len(lo), i))
                    a.append(start[i] + lo)
                    b.append(start[i] + hi)
            rows = pa.array(np.concatenate(row))
            ends = np.concatenate(b) + units.window - 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("text_key").take(rows), pa.array(np.concatenate(a)), pa.array(ends)],
                                             ["doc_id", "text_key", "a", "b"])

    return spans


def repeated_spans(docs: DataFrame, units: Units, judge, smaller_doc: bool, class_limit: int, bits: int = 26) -> DataFrame:
    """doc_id, text_key and ``spans``, the set of (a, b) unit ranges of the document covered by repeated windows.

    ``docs`` has doc_id, text_key and text. With ``smaller_doc`` a window repeats if it starts in a document with a
    smaller doc_id, else if it starts anywhere else.
    """
    spark = docs.sparkSession
    least, most = F.min, F.max
    of = [F.sum("n").alias("n"), *([least("d_min").alias("d_min"), most("d_max").alias("d_max")] if smaller_doc else [])]
    counted = docs.mapInArrow(_count(units, smaller_doc), count_schema(smaller_doc)).groupBy("anchor").agg(*of, least("s_min").alias("s_min"), most("s_max").alias("s_max"))
    shared = counted.filter(F.col("d_min") < F.col("d_max") if smaller_doc else F.col("n") > 1)
    classes = cut(shared.select("anchor", "n", F.col("d_min").alias("doc") if smaller_doc else F.lit(None).cast("long").alias("doc"),
                                (F.col("s_min") != F.col("s_max")).alias("several")), "classes")
    sent = spark.sparkContext.broadcast(bit_arrays(classes, class_keys, 2, bits))
    places = cut(docs.mapInArrow(_occurrences(units, sent, bits), OCCURRENCES), "occurrences")
    kept = ["doc_id", "text_key", "start", "n_windows"]
    later = F.col("doc_id") > F.col("doc") if smaller_doc else F.lit(True)
    lone = classes.filter("not several").select("anchor", "doc", "n")
    alone = join_groups(places.filter("segment is null").select(*kept, "anchor"), lone, ["anchor"], "n")
    alone = alone.filter(later).select(*kept, F.lit(True).alias("whole"), F.lit(None).cast("array<int>").alias("hits"))

    segment = ["anchor", "segment"]
    per_segment = [F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("doc"), *(F.min(c).alias(c) for c in ("before", "after"))]
    segments = cut(places.filter("segment is not null").groupBy(*segment).agg(*per_segment), "segments")
    halves = segments.select(F.explode(F.array("before", "after")).alias("half")).filter("half is not null")
    halves = spark.sparkContext.broadcast(bit_arrays(cut(halves.groupBy("half").count().filter("count > 1").select("half"), "halves"), shared_halves, 1, bits))
    several = segments.groupBy("anchor").count()
    large = cut(several.filter(F.col("count") > class_limit).select("anchor"), "large")
    senders = spark.sparkContext.broadcast(bit_arrays(segments, sender_keys, 1, bits))
    bodies = cut(docs.mapInArrow(_bodies(units, sent, senders, halves, bits), BODIES), "bodies")
    # ranges of anchors, split at sampled ones; a class stays whole
    small = join_small(bodies, large, "anchor", "left_anti").select("anchor", "segment", "lead", "n_windows", "doc", "body")
    judged = small.repartitionByRange("anchor").sortWithinPartitions("anchor", "doc", "segment").mapInArrow(_by_class(judge), JUDGED)
    single = join_small(bodies, large, "anchor", "left_semi").groupBy(*segment, "n_windows").agg(F.first("body").alias("body"))
    single = single.join(segments, segment).select(*segment, "n_windows", "copies", "doc", "body").mapInArrow(
        _windows(units), "anchor long, segment long, copies long, doc long, w int, h1 long, h2 long")
    of_window = single.groupBy("h1", "h2").agg(F.sum("copies").alias("_copies"), F.min("doc").alias("_doc"))
    hit = F.col("_doc") < F.col("doc") if smaller_doc else F.col("_copies") > 1
    single = single.join(of_window, ["h1", "h2"]).filter(hit)
    judged = cut(judged.unionByName(single.groupBy(*segment).agg(F.collect_list("w").alias("hits"))).filter(F.size("hits") > 0), "judged")
    whole = F.col("doc_id") > F.col("doc") if smaller_doc else F.col("copies") > 1
    verdicts = segments.select(*segment, "doc", "copies").join(judged, segment, "left")
    if not smaller_doc:
        verdicts = verdicts.filter((F.col("copies") > 1) | F.col("hits").isNotNull())
    found = join_groups(places.filter("segment is not null").select(*kept, *segment), cut(verdicts, "verdicts"), segment, "copies").withColumn("whole", whole)
    found = found.filter(F.col("whole") | F.col("hits").isNotNull()).select(*kept, "whole", "hits").unionByName(alone)
    spans = found.mapInArrow(_spans(units), "doc_id long, text_key long, a long, b long")
    return spans.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def rebuilt(docs: DataFrame, spans: DataFrame, rest, schema: str) -> DataFrame:
    """What ``rest`` makes of (doc_id, text, spans), spans null for none. Only texts with spans are shuffled."""
    spans = cut(spans.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"}), "spans")
    keys = cut(spans.select(F.col("_key").alias("text_key")).distinct(), "span-keys")
    own = join_small(docs, keys, "text_key", "left_semi").join(spans, (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    none = join_small(docs, keys, "text_key", "left_anti").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    return own.select("doc_id", "text", "spans").mapInArrow(rest, schema).unionByName(none.select("doc_id", "text", "spans").mapInArrow(rest, schema))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and the text, a null one empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def covered(spans, n: int) -> np.ndarray:
    """Units that lie in a span."""
    step = np.zeros(n + 1, np.int64)
    if spans:
        np.add.at(step, [s["a"] for s in spans], 1)
        np.add.at(step, [s["b"] for s in spans], -1)
    return np.cumsum(step[:-1]) > 0
