"""Phrase collocations: word n-grams that occur often, scored against their parts.

A text, lower-case in A-Z, falls into pieces at ``.,;:!?`` and line ends, a piece into words; an n-gram lies in one
piece. Everything is per language.

1. *Frequent n-grams by mergeable Misra-Gries summaries.* N-grams are known by a 64-bit hash (of language and words) whose leading
   bits are the hash partition. A task keeps a summary per partition, with more counters than the partition's mass
   divided by the threshold; where it has more keys, the count of the first one too many is taken off all. Summaries of
   a partition are merged the same way, batch by batch. What was taken off is at most mass / counters, below the
   threshold, so every frequent n-gram survives, and a counter with what was taken off bounds its count from above.
   One round per length: an n-gram enters only if both its parts one word shorter survived. Masses are upper bounds
   counted in the round before.
2. *Exact counts.* The second pass writes the words of all n-grams whose hash survived, combined per task, and groups them
   by the words themselves. Neither a false hit nor a shared hash in the first pass changes a result.
3. Cuts, scores, contained phrases and ranks are joins and groupings over the frequent n-grams.

Survivors reach the tasks as bit arrays sized by their number, up to ``most_bits``; beyond it the second pass goes over
ranges of the hash, one after the other, and the first pass leaves out less.

Defined cases: a null text is empty, a null language is ``und``; repeated rows count each time; an empty table, or one
without a frequent phrase, gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from ringfence.llm.kernels import LOWER, SPACE, grams, mix, pieces, word_hashes, words
from ringfence.llm.segments import bit_arrays, is_set
from ringfence.session import cut, join_small

APART = SPACE.copy()
APART[[ord(c) for c in ".,;:!?"]] = True
BREAK = APART.copy()
BREAK[[0x20, 0x09]] = False

COUNTERS = 1 << 16
MIN_BINS, MAX_BINS = 1 << 10, 1 << 16
PENDING, HELD = 1 << 21, 1 << 21
SUMMARY = "bin int, keys binary, counts binary, off long, next long"
KEPT = "bin int, key long, upper long"


def text_words(batch):
    """Per piece: bytes in lower case, starts and ends of words, their hashes with the language, runs, language of each word.

    A run is a number that changes where an n-gram must not pass: at a break and between documents.
    """
    tongues = batch.column("lang").dictionary_encode()
    names = tongues.dictionary.to_pylist()
    seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") for x in names], np.uint64)
    of = tongues.indices.to_numpy(zero_copy_only=False)
    for a, b, buf, at in pieces(batch.column("text")):
        low = LOWER[buf]
        starts, ends, first = words(low, at, APART)
        if len(starts):
            doc = np.repeat(np.arange(b - a), np.diff(first))
            breaks = np.concatenate([[0], np.cumsum(BREAK[low])])[starts]
            yield low, starts, ends, mix(word_hashes(low, starts, ends) ^ seeds[of[a:b][doc]], 9), breaks + doc, of[a:b][doc], names


def whole(run: np.ndarray, k: int) -> np.ndarray:
    """Which of the places of n-grams of k words lie in one run."""
    return run[:len(run) - k + 1] == run[k - 1:] if len(run) >= k else np.empty(0, bool)


def bin_of(keys: np.ndarray, bins: int) -> np.ndarray:
    """Leading bits; ``bins`` is a power of two, 2 at least."""
    return (keys >> np.uint64(65 - int(bins).bit_length())).astype(np.int64)


def combined(keys: np.ndarray, counts: np.ndarray):
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts[:0]


def reduced(keys: np.ndarray, counts: np.ndarray, capacity: int):
    """The Misra-Gries step for distinct keys: at most ``capacity`` counters, and what was taken off each."""
    if len(keys) <= capacity:
        return keys, counts, 0
    off = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    stay = counts > off
    return keys[stay], counts[stay] - off, off


def _masses(bins: int):
    """Words per language (rows with lang) and masses of words and pairs per hash partition (rows with bin)."""

    def run(batches):
        import pyarrow as pa

        total, one, two = {}, np.zeros(bins, np.int64), np.zeros(bins, np.int64)
        for batch in batches:
            for _, _, _, h, run_, of, names in text_words(batch):
                for i, n in enumerate(np.bincount(of, minlength=len(names)).tolist()):
                    total[names[i]] = total.get(names[i], 0) + n
                one += np.bincount(bin_of(grams(h, 1), bins), minlength=bins)
                two += np.bincount(bin_of(grams(h, 2)[whole(run_, 2)], bins), minlength=bins)
        if total:
            n = len(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*total, *[None] * bins], pa.string()), pa.array([*[None] * n, *range(bins)], pa.int32()),
                 pa.array([*total.values(), *one.tolist()], pa.int64()), pa.array([*[0] * n, *two.tolist()], pa.int64())], ["lang", "bin", "n", "pairs"])

    return run


def _parts_known(h, run, k: int, known, bits: int):
    """Places of n-grams of k words in one run whose parts one word shorter have their bits set (``known`` None: all)."""
    ok = whole(run, k)
    if known is not None and len(ok):
        part = is_set(known, grams(h, k - 1), bits)
        ok = ok & part[:-1] & part[1:]
    return ok


def _summaries(k: int, bins: int, capacity, known, bits: int):
    """Summaries of one task; ``next`` bounds the mass of n-grams one word longer."""

    def run(batches):
        import pyarrow as pa

        room = capacity.value
        flags = known.value[0] if known is not None else None
        keys, counts, off = np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(bins, np.int64)
        longer, todo, size = np.zeros(bins, np.int64), [], 0

        def merged():
            """All that is pending as one summary per partition."""
            nonlocal keys, counts, todo, size
            got, n = combined(np.concatenate(todo), np.ones(size, np.int64)) if size else (keys[:0], counts[:0])
            keys, counts = combined(np.concatenate([keys, got]), np.concatenate([counts, n]))
            todo, size = [], 0
            edges = np.searchsorted(bin_of(keys, bins), np.arange(bins + 1))
            if (np.diff(edges) > room).any():
                parts = [reduced(keys[a:b], counts[a:b], int(c)) for a, b, c in zip(edges[:-1], edges[1:], room)]
                keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                off[:] += [p[2] for p in parts]

        def rows():
            nonlocal keys, counts
            edges = np.searchsorted(bin_of(keys, bins), np.arange(bins + 1))
            own = np.flatnonzero((np.diff(edges) > 0) | (off > 0) | (longer > 0))
            raw = [(keys[a:b].tobytes(), counts[a:b].astype(np.int32).tobytes() if (counts[a:b] < 2**31).all() else counts[a:b].tobytes())
                   for a, b in zip(edges[own].tolist(), edges[own + 1].tolist())]
            out = pa.RecordBatch.from_arrays(
                [pa.array(own.astype(np.int32)), pa.array([r[0] for r in raw], pa.binary()), pa.array([r[1] for r in raw], pa.binary()),
                 pa.array(off[own]), pa.array(longer[own])], [f.split()[0] for f in SUMMARY.split(", ")])
            keys, counts = keys[:0], counts[:0]
            off[:], longer[:] = 0, 0
            return out

        for batch in batches:
            for _, _, _, h, run_, _, _ in text_words(batch):
                ok = _parts_known(h, run_, k, flags, bits)
                todo.append(grams(h, k)[ok])
                size += len(todo[-1])
                more = whole(run_, k + 1)
                more &= ok[:-1] & ok[1:] if len(more) else True
                longer += np.bincount(bin_of(grams(h, k + 1)[more], bins), minlength=bins)
                if size >= PENDING:
                    merged()
                if len(keys) >= HELD:  # summaries merge, so a full task hands over and goes on
                    yield rows()
        merged()
        yield rows()

    return run


def _merge(bins: int, least: int, capacity):
    """Rows in order of bin; the summaries of a partition become one. Gives the counters that may reach ``least``."""

    def run(batches):
        import pyarrow as pa

        room, current = capacity.value, None
        keys, counts, off, longer = np.empty(0, np.uint64), np.empty(0, np.int64), 0, 0

        def done():
            upper = counts + off
            stay = upper >= least
            n = int(stay.sum())
            # the row without a key carries the mass for the next round
            return pa.RecordBatch.from_arrays(
                [pa.array([current] * (n + 1), pa.int32()), pa.array([*keys[stay].view(np.int64).tolist(), None], pa.int64()),
                 pa.array([*upper[stay].tolist(), longer], pa.int64())], [f.split()[0] for f in KEPT.split(", ")])

        for batch in batches:
            of = batch.column("bin").to_numpy()
            edges = [*np.flatnonzero(np.diff(of, prepend=-1)).tolist(), len(of)]
            for a, b in zip(edges, edges[1:]):
                if of[a] != current:
                    if current is not None:
                        yield done()
                    current, keys, counts, off, longer = int(of[a]), keys[:0], counts[:0], 0, 0
                part = batch.slice(a, b - a)
                new = [np.frombuffer(x, np.uint64) for x in part.column("keys").to_pylist()]
                n = [np.frombuffer(x, np.int32 if len(x) == 4 * len(y) else np.int64) for x, y in zip(part.column("counts").to_pylist(), new)]
                off += int(part.column("off").to_numpy().sum())
                longer += int(part.column("next").to_numpy().sum())
                keys, counts = combined(np.concatenate([keys, *new]), np.concatenate([counts, *n]))
                keys, counts, less = reduced(keys, counts, int(room[current]))
                off += less
        if current is not None:
            yield done()

    return run


def _own_keys(batch):
    return [batch.column("key").to_numpy().view(np.uint64)]


def _phrases(most: int, known, bits: list[int], part: int, parts: int):
    """The words and counts of the n-grams of 1 to ``most`` words whose bit is set, combined per task."""

    def run(batches):
        import pyarrow as pa

        flags = known.value
        met = [{} for _ in range(most)]  # per length, hash to (place in the lists below)
        lang, text, count = [], [], []

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(text, pa.string()), pa.array(count, pa.int64())], ["lang", "phrase", "f"])
            for m in met:
                m.clear()
            lang.clear(), text.clear(), count.clear()
            return out

        for batch in batches:
            for buf, starts, ends, h, run_, of, names in text_words(batch):
                other = mix(h, 11)
                for k in range(1, most + 1):
                    if flags[k - 1] is None or len(h) < k:
                        continue
                    g = grams(h, k)
                    own = np.flatnonzero(whole(run_, k))
                    own = own[g[own] % np.uint64(parts) == part] if parts > 1 else own
                    own = own[is_set(flags[k - 1], g[own], bits[k - 1])]
                    one, two = g[own], grams(other, k)[own]  # 128 bits
                    order = np.lexsort((two, one))
                    one, two = one[order], two[order]
                    first = np.flatnonzero((np.diff(one, prepend=one[:1]) != 0) | (np.diff(two, prepend=two[:1]) != 0) | (np.arange(len(one)) == 0))
                    n = np.diff(np.append(first, len(one)))
                    for key, i, c in zip(zip(one[first].tolist(), two[first].tolist()), own[order[first]].tolist(), n.tolist()):
                        place = met[k - 1].get(key)
                        if place is None:
                            met[k - 1][key] = len(text)
                            lang.append(names[of[i]])
                            text.append(b" ".join([buf[x:y].tobytes() for x, y in zip(starts[i:i + k].tolist(), ends[i:i + k].tolist())]).decode())
                            count.append(c)
                        else:
                            count[place] += c
                if len(text) >= PENDING // 4:
                    yield rows()
        yield rows()

    return run


def frequent_ngrams(docs: DataFrame, most: int = 5, least: int = 100, counters: int = COUNTERS, most_bits: int = 27, min_bins: int = MIN_BINS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all n-grams of 1 to ``most`` words that occur ``least`` times, and (lang, n), the words per language."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a partition of even mass has about ``counters`` counters at most (every second byte can be a word), more past MAX_BINS
    bins = min(MAX_BINS, max(min_bins, 1 << (int(size // 2 // (least * counters))).bit_length()))
    masses = cut(texts.mapInArrow(_masses(bins), "lang string, bin int, n long, pairs long").groupBy("lang", "bin").agg(F.sum("n").alias("n"), F.sum("pairs").alias("pairs")), "masses")
    totals = masses.filter("lang is not null").select("lang", "n")

    def capacities(rows):
        room = np.ones(bins, np.int64)
        for b, mass in rows:
            room[b] = mass // least + 1
        return spark.sparkContext.broadcast(room)

    room, pairs = (capacities(masses.filter("lang is null").select("bin", c).collect()) for c in ("n", "pairs"))
    known, bits, flags, sizes, total = None, 0, [], [], 0
    for k in range(1, most + 1):
        parts = texts.mapInArrow(_summaries(k, bins, room, known, bits), SUMMARY)
        ordered = parts.repartition("bin").sortWithinPartitions("bin")
        kept = cut(ordered.mapInArrow(_merge(bins, least, room), KEPT), f"frequent-{k}")
        survivors = kept.filter("key is not null")
        n = survivors.count()
        if not n:
            break
        total += n
        bits = min(most_bits, max(16, (16 * n).bit_length()))
        flags.append(bit_arrays(survivors, _own_keys, 1, bits)[0])
        sizes.append(bits)
        known = spark.sparkContext.broadcast([flags[-1]])
        # pairs were counted with the words; longer ones in the round before
        room = pairs if k == 1 else capacities(kept.filter("key is null").select("bin", "upper").collect())
    if not flags:
        empty = spark.createDataFrame([], "lang string, phrase string, k int, f long")
        return empty, totals
    every = spark.sparkContext.broadcast(flags + [None] * (most - len(flags)))
    rounds = 1 + (total * 8 >> most_bits)
    found = None
    for r in range(rounds):
        part = texts.mapInArrow(_phrases(most, every, sizes, r, rounds), "lang string, phrase string, f long")
        part = part.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
        found = part if found is None else found.unionByName(part)
    k = (F.length("phrase") - F.length(F.translate("phrase", " ", "")) + 1).cast("int")
    return cut(found.select("lang", "phrase", k.alias("k"), "f"), "ngrams"), totals


def first_per(rows: DataFrame, group: str, order: list, top: int, spread: str) -> DataFrame:
    """``rank`` and the first ``top`` rows of each group, by rounds of dealt parts so that no task holds a whole group."""
    parts = -(-rows.count() // max(32 * top, 1))
    while parts > 1:
        dealt = rows.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(parts)))
        line = W.partitionBy(group, "_part").orderBy(*order)
        rows = cut(dealt.withColumn("_no", F.row_number().over(line)).filter(F.col("_no") <= top).drop("_no", "_part"), "best")
        parts //= 32
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, most: int = 5, least: int = 100, top: int = 2000, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` phrases of 2 to ``most`` words of each language.

    a is the count of the phrase, l and r those of its parts at the lowest-scoring cut, n the words of the language; score =
    floor(1000 a n / (l r)). A phrase that only occurs inside a longer one is left out.
    """
    ngrams, totals = frequent_ngrams(docs, most, least, **options)
    phrases = ngrams.filter("k >= 2")
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("_words"), "k")
    cuts = cuts.withColumn("_at", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "_at", F.array_join(F.slice("_words", 1, F.col("_at")), " ").alias("_left"),
                       F.array_join(F.slice("_words", F.col("_at") + 1, F.col("k") - F.col("_at")), " ").alias("_right"))
    part = lambda side, f: ngrams.select("lang", F.col("phrase").alias(side), F.col("f").alias(f))
    cuts = cuts.join(part("_left", "l"), ["lang", "_left"]).join(part("_right", "r"), ["lang", "_right"])
    cuts = join_small(cuts, cut(totals, "totals"), "lang")
    big = {c: F.col(c).cast("decimal(19,0)") for c in "alrn"}
    # 1000 a n and l r pass 64 bits; the integral quotient of decimals is exact
    up, down = (F.lit(1000).cast("decimal(4,0)") * big["a"]).cast("decimal(19,0)") * big["n"], big["l"] * big["r"]
    scored = cuts.withColumns({"_up": up.cast("decimal(38,0)"), "_down": down.cast("decimal(38,0)")}).withColumn("score", F.expr("_up div _down"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "_at", "l", "r")).alias("_cut"))
    # a phrase inside a longer one of equal count is inside one a word longer of that count
    longer = phrases.filter("k > 2").select("lang", F.col("f").alias("a"), F.split("phrase", " ").alias("_words"), "k")
    inner = longer.select("lang", "a", F.explode(F.array(
        F.array_join(F.slice("_words", 1, F.col("k") - 1), " "), F.array_join(F.slice("_words", 2, F.col("k") - 1), " "))).alias("phrase")).distinct()
    own = best.join(inner, ["lang", "phrase", "a"], "left_anti").select(
        "lang", "phrase", "a", F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), "n", F.col("_cut.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    return first_per(cut(own, "phrases"), "lang", order, top, "phrase").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
