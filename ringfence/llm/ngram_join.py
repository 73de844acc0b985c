"""N-gram Jaccard join by prefix filters under several global token orders.

Tokens are the distinct shingles of a document as 64-bit hashes; documents with equal token sets are one set, which goes
under a hash of its tokens. Sets with Jaccard t share a token among the first n - ceil(t n) + 1 of each, in *any* order of
all tokens. Here an order puts tokens that are frequent last (by a count sketch over all documents, whose size is
fixed; only counts well above the mean matter) and the others in an order of its own hash. A pair has to
share a prefix token under each order, and more closely, with o the common tokens that t asks of a pair of these sizes: one
among the first n - o + 1 of each, at places from which o common tokens can still be reached.

1. Prefix tokens under the first order; tokens with one set only are done with.
2. Every set is compared with the hubs of its token lists, those that meet most other sets. Most near copies are linked here, so that large groups do not give their square of pairs.
3. Sets with candidates left under the first order send their prefix under the next one. Pairs from different
   components so far have to pass the filter of every order; then their whole sets are compared.
4. Candidates are first compared by the parities of their sets, a bit or two for each token, which differ in no more places
   than the sets in tokens; those ruled out take no part in the next order. Before whole sets are sent, pairs are compared by
   16 bits of each token, which have at least as many in common. Texts that are not asked for, and copies, are not cut into words again.

Links inside a component are left out; they change no component. Nothing else is: no list or candidate is capped.

Defined cases: a null or empty text has no token and no link; with fewer words than a shingle the words are the one
token; repeated rows have equal sets; a null doc_id is never the smallest. Sets are whole in a task, lists are streamed, long ones cut into blocks.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from ringfence.llm.components import components
from ringfence.llm.kernels import LOWER, grams, mix, pieces, word_hashes, words
from ringfence.llm.rows import text_key
from ringfence.llm.segments import bit_arrays, is_set
from ringfence.session import cut, join_small

SKETCH_BITS, CHUNK = 22, 1 << 18
LEADERS = 4
# sets of a token that one task pairs with each other, and pairs looked at in one step
BLOCK, PAIRS = 1 << 13, 1 << 20
SEEN = 1 << 20
SETS = "doc_id long, text_key long, set_key long, n int, parity binary, chunk int, counts binary"


def sets_of(column, size: int):
    """(row, sorted token array) of every text that has words."""
    for a, b, buf, at in pieces(column):
        low = LOWER[buf]
        starts, ends, first = words(low, at)
        h = word_hashes(low, starts, ends)
        g = grams(h, size)
        for i in range(b - a):
            lo, hi = int(first[i]), int(first[i + 1])
            if hi - lo >= size:
                s = np.sort(g[lo:hi - size + 1])
                yield a + i, s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif hi > lo:
                yield a + i, grams(h[lo:hi], hi - lo)


def set_key(tokens: np.ndarray) -> int:
    one = mix(mix(tokens, 21).sum(keepdims=True) ^ np.uint64(len(tokens)), 22)
    return int(one.view(np.int64)[0])


def parities(tokens: np.ndarray) -> np.ndarray:
    """Whether an odd number of tokens falls on each of 64 or more places, a power of two from the size of the set on; packed bits."""
    places = max(64, 1 << (len(tokens) - 1).bit_length())
    return np.packbits(np.bincount((tokens & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1 > 0)


def unlike(x: np.ndarray, y: np.ndarray) -> int:
    """Places where two parities differ: at most as many as tokens that one of the sets has alone."""
    if len(x) > len(y):
        x, y = y, x
    while len(y) > len(x):  # halves of a parity add up to that of half as many places
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def packed(counts: np.ndarray) -> bytes:
    """Counts byte by byte of their digits, compressed: most are small."""
    return zlib.compress(np.ascontiguousarray(counts.view(np.uint8).reshape(-1, 4).T), 1)


def unpacked(body: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(body), np.uint8).reshape(4, -1).T).view(np.int32).ravel()


def _describe(size: int):
    """A row per document, then the task's counts of all its tokens by leading bits."""
    names = [f.split()[0] for f in SETS.split(", ")]

    def describe(batches):
        import pyarrow as pa

        counts, held, many = np.zeros(1 << SKETCH_BITS, np.int32), [], 0
        for batch in batches:
            keys, sizes, parity = [None] * len(batch), [0] * len(batch), [None] * len(batch)
            for row, tokens in sets_of(batch.column("text"), size):
                keys[row], sizes[row], parity[row] = set_key(tokens), len(tokens), parities(tokens).tobytes()
                held.append((tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int32))
                many += len(tokens)
                if many > 1 << 19:
                    counts += np.bincount(np.concatenate(held), minlength=len(counts))
                    held, many = [], 0
            none = pa.nulls(len(batch), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(parity, pa.binary()), none, pa.nulls(len(batch), pa.binary())], names)
        if held:
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
        for chunk in range(0, len(counts), CHUNK):
            part = counts[chunk:chunk + CHUNK]
            if part.any():
                blank = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*blank, pa.array([chunk], pa.int32()), pa.array([packed(part)], pa.binary())], names)

    return describe


def _levels(mean: float):
    def levels(key, pdf):
        import pandas as pd

        counts = sum(unpacked(b).astype(np.int64) for b in pdf["counts"])
        level = np.floor(np.log2(np.maximum(counts / max(1e-9, 2 * mean), 0.5))) + 1
        return pd.DataFrame({"chunk": [key[0]], "levels": [np.clip(level, 0, 31).astype(np.uint8).tobytes()]})

    return levels


def frequency_levels(sketch: DataFrame) -> np.ndarray:
    """Per leading bits of a token: 0 up to twice the mean count, then one more for every doubling. A byte each comes to the driver."""
    many = sketch.filter("chunk is null").agg(F.sum("n")).first()[0] or 0  # every token is counted once for its row
    parts = sketch.filter("chunk is not null").select("chunk", "counts").groupBy("chunk").applyInPandas(_levels(many / (1 << SKETCH_BITS)), "chunk int, levels binary")
    levels = np.zeros(1 << SKETCH_BITS, np.uint8)
    for chunk, part in parts.collect():
        levels[chunk:chunk + CHUNK] = np.frombuffer(bytes(part), np.uint8)
    return levels


def prefix(tokens: np.ndarray, levels: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The first n - ceil(percent/100 n) + 1 tokens under an order, in that order; equal ranks by the token itself."""
    n = len(tokens)
    k = n + (-percent * n // 100) + 1
    rank = (levels[tokens >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64) << np.uint64(58)) | (mix(tokens, 100 + order) >> np.uint64(6))
    if k < n:
        near = rank <= np.partition(rank, k - 1)[k - 1]
        tokens, rank = tokens[near], rank[near]
    return tokens[np.lexsort((tokens, rank))][:k]


def _fresh_sets(column, size: int, seen: set):
    """Sets not met before in this task, as far as it remembers."""
    for _, tokens in sets_of(column, size):
        key = set_key(tokens)
        if key not in seen:
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(key)
            yield key, tokens


def _known_texts(batch, known, bits: int):
    """The texts of a batch whose keys are known."""
    import pyarrow as pa

    if known is None:
        return batch.column("text")
    return batch.column("text").filter(pa.array(is_set(known.value, batch.column("text_key").to_numpy().view(np.uint64), bits)))


LIST = ["token", "set_key", "n", "place"]
LISTS = "token long, set_key long, n int, place int"


def _postings(size: int, percent: int, order: int, levels, known, bits: int):
    def postings(batches):
        import pyarrow as pa

        seen, rank = set(), levels.value
        for batch in batches:
            keys, sizes, parts, held = [], [], [], 0

            def out():
                lengths = [len(p) for p in parts]
                return pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(parts).view(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), lengths)), pa.array(np.repeat(np.array(sizes, np.int32), lengths)),
                     pa.array(np.concatenate([np.arange(x, dtype=np.int32) for x in lengths]))], LIST)

            for key, tokens in _fresh_sets(_known_texts(batch, known, bits), size, seen):
                parts.append(prefix(tokens, rank, order, percent))
                keys.append(key)
                sizes.append(len(tokens))
                held += len(parts[-1])
                if held > 1 << 17:
                    yield out()
                    keys, sizes, parts, held = [], [], [], 0
            if parts:
                yield out()

    return postings


def _shared(batches):
    """Rows in order of (token, set): each set of a token once, tokens with one set left out."""
    import pyarrow as pa

    last = None  # the last row, and whether its token was given out before
    for batch in batches:
        if not len(batch):
            continue
        rows = [c.to_numpy() for c in batch.columns]
        if last is not None:
            rows = [np.concatenate([[x], r]) for x, r in zip(last[0], rows)]
        token, key = rows[0], rows[1]
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (key[1:] != key[:-1])])
        rows = [r[new] for r in rows]
        token = rows[0]
        again = token[1:] == token[:-1]
        keep = np.concatenate([[False], again]) | np.concatenate([again, [False]])
        given = last is not None and last[1]
        if given:
            keep[0] = False  # it went out with the batch before
        out = [r[keep] for r in rows]
        if len(out[0]):
            yield pa.RecordBatch.from_arrays([pa.array(o) for o in out], batch.schema.names)
        gone = bool(keep[-1]) or (len(keep) == 1 and given)
        last = ([r[-1] for r in rows], gone)


def _cross_pairs(percent: int):
    """Rows in order of (token, i, j, component): pairs of sets from different components that this token does not rule out.

    With i < j the rows are two blocks of a long list, told apart by ``side``, and only pairs between them are looked at.
    """

    def pairs(batches):
        import pyarrow as pa

        names, rest, held, many = [*LIST, "i", "j", "side", "component"], None, [], 0

        def combined():
            both = np.unique(np.concatenate(held, axis=1), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

        def parts():
            """Whole groups; the last group of a batch waits for the next one."""
            nonlocal rest
            for batch in batches:
                if not len(batch):
                    continue
                rows = dict(zip(names, (batch.column(c).to_numpy() for c in names)))
                if rest is not None:
                    rows = {c: np.concatenate([rest[c], rows[c]]) for c in names}
                end = int(np.flatnonzero(_starts(rows, "token", "i", "j"))[-1])
                rest = {c: r[end:] for c, r in rows.items()}
                if end:
                    yield {c: r[:end] for c, r in rows.items()}
            if rest is not None:
                yield rest

        for part in parts():
            for found in of_groups(part):
                held.append(found)
                many += found.shape[1]
                if many > 1 << 20:  # combine what this task has met before it is sent
                    yield combined()
                    held, many = [], 0
        if held:
            yield combined()

    def of_groups(rows):
        group = _starts(rows, "token", "i", "j")
        # a row meets the rows from the end of its component to the end of its group
        first, last = _ends(group | _starts(rows, "component")), _ends(group)
        many = last - first
        n, place, key = rows["n"].astype(np.int64), rows["place"].astype(np.int64), rows["set_key"]
        at, upto = 0, np.cumsum(many)
        while at < len(many):
            base = upto[at] - many[at]
            end = max(at + 1, int(np.searchsorted(upto, base + PAIRS, "right")))
            x = np.repeat(np.arange(at, end), many[at:end])
            y = np.arange(len(x)) - np.repeat(upto[at:end] - many[at:end] - base, many[at:end]) + first[x]
            at = end
            near = (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & ((rows["side"][x] != rows["side"][y]) | (rows["i"][x] == rows["j"][x]))
            x, y = x[near], y[near]
            least = -(-percent * (n[x] + n[y]) // (100 + percent))  # common tokens that the similarity asks for
            left = np.minimum(n[x] - place[x], n[y] - place[y])
            ok = (left >= least) & (np.minimum(place[x], place[y]) + left >= least)
            if ok.any():
                one, two = key[x[ok]], key[y[ok]]
                yield np.stack([np.minimum(one, two), np.maximum(one, two)])

    return pairs


def _starts(rows, *names) -> np.ndarray:
    """Where a row differs from the one before in one of the columns."""
    new = np.zeros(len(rows["token"]), bool)
    new[:1] = True
    for c in names:
        new[1:] |= rows[c][1:] != rows[c][:-1]
    return new


def _ends(new: np.ndarray) -> np.ndarray:
    """For every row the end of its run."""
    starts = np.flatnonzero(new)
    return np.append(starts[1:], len(new))[np.cumsum(new) - 1]


def first_bits(tokens: np.ndarray) -> np.ndarray:
    """16 bits of every token, in order: a quarter of the set, with as much in common with another one or more."""
    return (tokens >> np.uint64(48)).astype(np.uint16)


def _bodies(size: int, known, bits: int, short: bool):
    def bodies(batches):
        import pyarrow as pa

        seen = set()
        for batch in batches:
            keys, bodies, held = [], [], 0
            for key, tokens in _fresh_sets(_known_texts(batch, known, bits), size, seen):
                keys.append(key)
                bodies.append((first_bits(tokens) if short else tokens).tobytes())
                held += len(bodies[-1])
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(bodies, pa.binary())], ["set_key", "body"])
                    keys, bodies, held = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(bodies, pa.binary())], ["set_key", "body"])

    return bodies


def _counted(values: np.ndarray) -> np.ndarray:
    """Sorted values with repeats as different ones: each with its number among its equals."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    number = np.arange(len(values)) - np.repeat(starts, np.diff(np.append(starts, len(values))))
    return values.astype(np.int64) << 32 | number


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two arrays of different values reach the similarity."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _similar(percent: int, short: bool):
    def values(body):
        return _counted(np.frombuffer(body.as_buffer(), np.uint16)) if short else np.frombuffer(body.as_buffer(), np.uint64)

    def similar(batches):
        import pyarrow as pa

        for batch in batches:
            mask = pa.array([alike(values(x), values(y), percent) for x, y in zip(batch.column("body_a"), batch.column("body_b"))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return similar


def _near(percent: int):
    def near(batches):
        import pyarrow as pa

        for batch in batches:
            n, parts = [batch.column(f"n_{c}").to_numpy().astype(np.int64) for c in "ab"], [batch.column(f"parity_{c}") for c in "ab"]
            most = n[0] + n[1] - 2 * -(-percent * (n[0] + n[1]) // (100 + percent))  # tokens that a similar pair does not share
            differ = [unlike(*(np.frombuffer(p.as_buffer(), np.uint8) for p in pair)) for pair in zip(*parts)]
            mask = pa.array(np.array(differ, np.int64) <= most)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return near


def own_keys(batch):
    return [batch.column("text_key").to_numpy().view(np.uint64)]


def set_keys(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("set_key")).unionByName(pairs.select(F.col("b").alias("set_key"))).distinct()


class SetJoin:
    """The join of one document table with itself, its scans and filters."""

    def __init__(self, docs: DataFrame, size: int = 5, percent: int = 75, orders: int = 2, bits: int = 26, block: int = BLOCK):
        self.docs, self.size, self.percent, self.orders, self.bits, self.block = docs, size, percent, orders, bits, block
        self.texts = docs.select("text", text_key().alias("text_key"))
        self.context = docs.sparkSession.sparkContext
        self.described = cut(docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(_describe(size), SETS), "sets")
        self.rows = self.described.filter("chunk is null").select("doc_id", "text_key", "set_key", "n")
        self.levels = self.context.broadcast(frequency_levels(self.described))

    def known(self, keys: DataFrame):
        """A bit array of fixed size over a text of each of these sets, at every task; a false hit costs time only."""
        texts = self.rows.join(keys, "set_key").groupBy("set_key").agg(F.min("text_key").alias("text_key"))
        return self.context.broadcast(bit_arrays(texts.select("text_key"), own_keys, 1, self.bits)[0])

    def lists(self, order: int, known=None) -> DataFrame:
        postings = self.texts.mapInArrow(_postings(self.size, self.percent, order, self.levels, known, self.bits), LISTS)
        dealt = postings.repartition("token").sortWithinPartitions("token", "set_key")
        return cut(dealt.mapInArrow(_shared, LISTS), f"lists-{order}")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of set keys that reach the similarity; ``pairs`` are written out."""
        return self.compared(self.compared(pairs, True), False)

    def possible(self, pairs: DataFrame) -> DataFrame:
        """The pairs that may reach the similarity by the parities of their sets; ``pairs`` are written out."""
        sets = self.described.filter("chunk is null").select("set_key", "n", "parity").join(set_keys(pairs), "set_key", "left_semi")
        sets = cut(sets.groupBy("set_key").agg(F.first("n").alias("n"), F.first("parity").alias("parity")), "parities")
        met = self.met(pairs, sets, "n", "parity")
        return cut(met.mapInArrow(_near(self.percent), "a long, b long"), "possible")

    def compared(self, pairs: DataFrame, short: bool) -> DataFrame:
        """The pairs that reach the similarity by their whole sets, or may reach it by the first bits of their tokens."""
        label = "short" if short else "whole"
        keys = set_keys(pairs)
        sets = self.texts.mapInArrow(_bodies(self.size, self.known(keys), self.bits, short), "set_key long, body binary")
        sets = cut(sets.join(keys, "set_key", "left_semi").groupBy("set_key").agg(F.first("body").alias("body")), f"{label}-sets")
        return cut(self.met(pairs, sets, "body").mapInArrow(_similar(self.percent, short), "a long, b long"), f"{label}-verified")

    def met(self, pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
        """The pairs with these columns of either set."""
        one, two = (sets.select(F.col("set_key").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in columns]) for c in "ab")
        return pairs.join(two, "b").join(one, "a").select("a", "b", *[f"{x}_{c}" for x in columns for c in "ab"])

    def leader_pairs(self, lists: DataFrame) -> DataFrame:
        """Each set with up to ``LEADERS`` of its lists' hubs: the sets that meet most others, among those it may be similar to."""
        of_token = W.partitionBy("token")
        lists = lists.select("token", "set_key", "n")
        sized = lists.withColumn("_size", F.count(F.lit(1)).over(of_token))
        hubs = sized.join(sized.groupBy("set_key").agg(F.sum("_size").alias("_meets")), "set_key")
        first = of_token.orderBy(F.col("_meets").desc(), "set_key")
        hubs = hubs.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= LEADERS).select("token", F.col("set_key").alias("b"), F.col("n").alias("n_b"))
        led = lists.join(hubs, "token").filter(F.col("b") != F.col("set_key"))
        counted = led.groupBy(F.col("set_key").alias("a"), "b", F.col("n").alias("n_a"), "n_b").agg(F.count(F.lit(1)).alias("shared"))
        best = W.partitionBy("a").orderBy(F.col("shared").desc(), "b")
        alike = 100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b")
        # with the pair's own common prefix tokens, at most all but the prefixes can be common
        overlap = F.ceil(self.percent * (F.col("n_a") + F.col("n_b")) / (100 + self.percent))
        beyond = F.greatest(F.ceil(self.percent * F.col("n_a") / 100), F.ceil(self.percent * F.col("n_b") / 100)) - 1
        counted = counted.filter(alike & (F.col("shared") + beyond >= overlap))
        best = counted.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= LEADERS)
        return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def with_component(self, lists: DataFrame, parts: DataFrame) -> DataFrame:
        return lists.join(parts.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("component", F.coalesce("component", "set_key"))

    def crossing(self, lists: DataFrame, parts: DataFrame) -> DataFrame:
        """The pairs (a, b) of sets from different components that some token's list leaves possible.

        A list of more than ``block`` sets is cut into blocks by component; every pair of blocks that holds two components
        is a group of its own, so that neither a frequent token nor a large group of copies fills a task.
        """
        group = ["token", "i", "j"]
        none = F.lit(0)
        long = cut(lists.groupBy("token").count().filter(F.col("count") > self.block).select("token"), "long-lists")
        short = self.with_component(join_small(lists, long, "token", "left_anti"), parts)
        short = short.select(*LIST, none.alias("i"), none.alias("j"), none.alias("side"), "component")
        place = F.row_number().over(W.partitionBy("token").orderBy("component", "set_key")) - 1
        rows = self.with_component(join_small(lists, long, "token", "left_semi"), parts).withColumn("_block", F.floor(place / self.block).cast("int"))
        rows = cut(rows, "blocks")
        ends = cut(rows.groupBy("token", "_block").agg(F.min("component").alias("_low"), F.max("component").alias("_high")), "block-ends")
        one, two = (ends.select("token", F.col("_block").alias(c), F.col("_low").alias(f"low_{c}"), F.col("_high").alias(f"high_{c}")) for c in "ij")
        met = one.join(two, "token").filter((F.col("i") <= F.col("j")) & (F.least("low_i", "low_j") < F.greatest("high_i", "high_j")))
        met = cut(met.select(*group), "block-pairs")
        sides = [join_small(rows, pairs.withColumn("_block", F.col(c)), ["token", "_block"]).withColumn("side", F.lit(side))
                 for side, c, pairs in ((0, "i", met), (1, "j", met.filter("i < j")))]
        dealt = short.unionByName(sides[0].unionByName(sides[1]).select(*LIST, "i", "j", "side", "component"))
        dealt = dealt.repartition(*group).sortWithinPartitions(*group, "component", "set_key")
        return dealt.mapInArrow(_cross_pairs(self.percent), "a long, b long").distinct()

    def linked(self) -> DataFrame:
        """node, component of every set that is linked with another."""
        first = self.lists(0)
        links = self.verified(self.possible(cut(self.leader_pairs(first), "pairs")))
        parts = cut(components(links), "parts")
        candidates, survivors = None, None
        for order in range(self.orders):
            lists = first if order == 0 else self.lists(order, self.known(survivors))
            pairs = self.crossing(lists, parts)
            if candidates is None:
                candidates = self.possible(cut(pairs, "candidates-0"))
            else:
                candidates = cut(candidates.join(pairs, ["a", "b"], "left_semi"), f"candidates-{order}")
            survivors = set_keys(candidates)
        return components(links.unionByName(self.verified(candidates)))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75, orders: int = 2, bits: int = 26, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of every document; text_key, kept.

    One row of each component is to be kept: that of the smallest doc_id, by text_key among rows that share it.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    join = SetJoin(docs, size, percent, orders, bits, block)
    parts = join.linked().withColumnsRenamed({"node": "set_key", "component": "_part"})
    rows = cut(join.rows.join(parts, "set_key", "left").withColumn("_part", F.coalesce("_part", "set_key")), "members")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    least = rows.filter("n > 0").groupBy("_part").agg(F.min("doc_id").alias("component_id"), F.min(first).alias("_first"))
    linked = rows.filter("n > 0").join(least, "_part").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "text_key", first.eqNullSafe(F.col("_first")).alias("kept"))
    apart = rows.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), "text_key", F.lit(True).alias("kept"))
    return linked.unionByName(apart)
