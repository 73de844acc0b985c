"""Merkle manifest of a dataset: leaf coordinates by bitmap ranks, levels reduced in keyed slot arrays.

A row's leaf is the SHA-256 of its fields. The leaves of a group ascend by doc_id and are hashed in runs of ``fan``, the
last run shorter, until one node is left; the groups' roots, by group name, are hashed to one root the same way.

1. *Bitmaps.* Per group and chunk (the id without its last 16 bits) the ids are a compressed bitmap, sorted 16-bit numbers while
   few, else 2^16 bits; ids that occur more than once have a list of their surplus. Tasks make partial ones, which are merged.
2. *Popcount directory.* Sums over chunks, over 2^16 chunks and over 2^32 chunks give the rows before each chunk; a step is
   over 2^16 numbers at most, whatever the number of rows.
3. *Ranks.* The rank of an id is what lies before its chunk plus the set bits before its own, and is the coordinate of its
   leaf; documents are never sorted. Rows that share an id are placed by leaf, spread over 2^16 ranges of it.
4. *Slot arrays.* ``fan``^``depth`` slots go to one array, keyed by group and slot / fan^depth, and are reduced by ``depth`` levels
   there. Then the way back: an array gets the path above it and gives every slot its own.

Defined cases: a null field is ``-``, others their byte count, ``:`` and value; a null id comes first in its group; a null
group is a group, the first; rows with equal ids are in order of their leaves, repeated rows each have a place; an
empty table has no leaf and no root. Other columns are not looked at. There is one row per group in the upper tree's numbering.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ringfence.session import cut, join_small

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
CHUNK_BITS, SPARSE = 16, 4096
PARTIAL_ROWS = 1 << 20
SPREAD = 1 << 16

BITMAPS = "grp string, chunk long, n long, bits binary, more binary"
RANKS = "grp string, doc_id long, rank long, same long"
LEVELS = "array<struct<before: string, after: string>>"


def leaf_of(row: dict[str, Column]) -> Column:
    """Lowercase hex digest of the named columns, in order."""
    parts = []
    for c in row.values():
        c = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


# Bitmaps


def pack(low: np.ndarray) -> bytes:
    """Distinct ascending 16-bit numbers, compressed."""
    if len(low) < SPARSE:
        return low.astype("<u2").tobytes()
    flags = np.zeros(1 << CHUNK_BITS, bool)
    flags[low] = True
    return np.packbits(flags, bitorder="little").tobytes()


def unpack(bits: bytes) -> np.ndarray:
    if len(bits) < 2 * SPARSE:
        return np.frombuffer(bits, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))


def rank(bits: bytes, low: np.ndarray) -> np.ndarray:
    """How many numbers of the bitmap are less than each of ``low``."""
    if len(bits) < 2 * SPARSE:
        return np.searchsorted(np.frombuffer(bits, "<u2"), low)
    words = np.frombuffer(bits, "<u8")
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])  # the popcount directory
    word, bit = low >> 6, (low & 63).astype(np.uint64)
    return before[word] + np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


def _containers(table):
    """Rows of BITMAPS from a table of distinct (grp, doc_id) with their number ``n``, or null where there is none."""
    import pyarrow as pa

    if not table.num_rows:
        return None
    table = table.sort_by([("grp", "ascending"), ("doc_id", "ascending")]).combine_chunks()
    grp = table.column("grp").combine_chunks().dictionary_encode()
    ids, n = table.column("doc_id").to_numpy(), table.column("n").to_numpy()
    of, chunk, low = grp.indices.to_numpy(), ids >> CHUNK_BITS, ids & ((1 << CHUNK_BITS) - 1)
    first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (chunk[1:] != chunk[:-1])]))
    end = np.append(first[1:], len(ids))
    surplus = [np.stack([low[a:b][n[a:b] > 1], n[a:b][n[a:b] > 1] - 1], 1).astype("<i8").tobytes() if (n[a:b] > 1).any() else None for a, b in zip(first, end)]
    return pa.RecordBatch.from_arrays(
        [grp.dictionary.take(pa.array(of[first])), pa.array(chunk[first]), pa.array(np.add.reduceat(n, first)),
         pa.array([pack(low[a:b]) for a, b in zip(first, end)], pa.binary()), pa.array(surplus, pa.binary())], [f.split()[0] for f in BITMAPS.split(", ")])


def _counted(table):
    """Distinct (grp, doc_id) with the sum of ``n``."""
    return table.group_by(["grp", "doc_id"]).aggregate([("n", "sum")]).rename_columns(["grp", "doc_id", "n"])


def _partial(batches):
    """Bitmaps of the rows of a task."""
    import pyarrow as pa

    held, rows = [], 0
    for batch in batches:
        held.append(pa.table([batch.column("grp"), batch.column("doc_id"), pa.array(np.ones(batch.num_rows, np.int64))], ["grp", "doc_id", "n"]))
        rows += batch.num_rows
        if rows >= PARTIAL_ROWS:
            yield _containers(_counted(pa.concat_tables(held)))
            held, rows = [], 0
    if rows:
        yield _containers(_counted(pa.concat_tables(held)))


def _listed(batch):
    """(grp, doc_id, n) of every id of the bitmaps of a batch."""
    import pyarrow as pa

    lows, counts = [], []
    for bits, more in zip(batch.column("bits").to_pylist(), batch.column("more").to_pylist()):
        low = unpack(bits)
        n = np.ones(len(low), np.int64)
        if more:
            at, surplus = np.frombuffer(more, "<i8").reshape(-1, 2).T
            n[rank(bits, at)] += surplus
        lows.append(low)
        counts.append(n)
    size = [len(x) for x in lows]
    of = np.repeat(np.arange(batch.num_rows), size)
    ids = (batch.column("chunk").to_numpy()[of] << CHUNK_BITS) + (np.concatenate(lows) if lows else of)
    return pa.table([batch.column("grp").take(pa.array(of)), pa.array(ids), pa.array(np.concatenate(counts) if counts else of)], ["grp", "doc_id", "n"])


def _united(batches):
    """Rows in order of (grp, chunk): the bitmaps of one become one."""
    import pyarrow as pa

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        both = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        both = both.combine_chunks()
        grp, chunk = both.column("grp"), both.column("chunk").to_numpy()
        open_ = (chunk == chunk[-1]) & np.array([g == grp[-1].as_py() for g in grp.to_pylist()])
        at = int(np.argmax(open_))
        if at:
            yield _containers(_counted(_listed(both.slice(0, at).combine_chunks().to_batches()[0])))
        held = both.slice(at)
        if held.num_rows > 64:
            held = pa.Table.from_batches([_containers(_counted(_listed(held.combine_chunks().to_batches()[0])))])
    if held is not None:
        yield _containers(_counted(_listed(held.combine_chunks().to_batches()[0])))


def _ranked(batches):
    """The rank of every id of the bitmaps, ``base`` rows being before their chunk."""
    import pyarrow as pa

    for batch in batches:
        for grp, chunk, bits, more, base in zip(*[batch.column(c).to_pylist() for c in ("grp", "chunk", "bits", "more", "base")]):
            low = unpack(bits)
            place, same = rank(bits, low), np.ones(len(low), np.int64)
            if more:
                at, surplus = np.frombuffer(more, "<i8").reshape(-1, 2).T
                own = rank(bits, at)
                same[own] += surplus
                place = place + np.concatenate([[0], np.cumsum(same - 1)])[:-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([grp] * len(low), pa.string()), pa.array((chunk << CHUNK_BITS) + low), pa.array(base + place), pa.array(same)], [f.split()[0] for f in RANKS.split(", ")])


def id_bitmaps(rows: DataFrame) -> DataFrame:
    """One compressed bitmap per group and chunk of the ids of ``rows`` (grp, doc_id), none of them null."""
    partial = rows.select("grp", "doc_id").mapInArrow(_partial, BITMAPS)
    return partial.repartition("grp", "chunk").sortWithinPartitions("grp", "chunk").mapInArrow(_united, BITMAPS)


def rank_ids(bitmaps: DataFrame) -> DataFrame:
    """(grp, doc_id, rank, same): the rows of the group with a smaller id, and those with this id."""
    levels, keys = bitmaps.select("grp", "chunk", "n"), ["grp"]
    for k in (2, 1):  # popcounts of 2^32 and 2^16 chunks
        levels = levels.withColumn(f"_p{k}", F.shiftright("chunk", 16 * k))
    mid = levels.groupBy("grp", "_p2", "_p1").agg(F.sum("n").alias("n"))
    top = mid.groupBy("grp", "_p2").agg(F.sum("n").alias("n"))
    before = lambda by, at: F.sum("n").over(W.partitionBy(*by).orderBy(at).rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    top = top.withColumn("_b2", before(["grp"], "_p2")).drop("n")
    mid = mid.withColumn("_b1", before(["grp", "_p2"], "_p1")).drop("n").join(top, ["grp", "_p2"])
    mid = cut(mid.select("grp", "_p1", (F.col("_b1") + F.col("_b2")).alias("_before")), "popcounts")
    own = bitmaps.withColumn("_p1", F.shiftright("chunk", 16)).withColumn("_b0", before(["grp", "_p1"], "chunk"))
    based = join_small(own, mid, ["grp", "_p1"]).withColumn("base", F.col("_b0") + F.col("_before"))
    return based.select("grp", "chunk", "bits", "more", "base").mapInArrow(_ranked, RANKS)


def coordinates(leaves: DataFrame, carry: list[str]) -> DataFrame:
    """``leaves`` (grp, doc_id, leaf and ``carry``) with ``slot``, the place in its group, and ``n``, the group's number of rows."""
    totals = cut(leaves.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("doc_id").isNull()).alias("_nulls")), "manifest-groups")
    known = leaves.filter("doc_id is not null")
    ranks = rank_ids(cut(id_bitmaps(known), "id-bitmaps"))
    placed = join_small(known.join(ranks, ["grp", "doc_id"]), totals, "grp").withColumn("rank", F.col("rank") + F.col("_nulls"))
    nameless = join_small(leaves.filter("doc_id is null"), totals, "grp").withColumns({"rank": F.lit(0).cast("long"), "same": F.col("_nulls")})
    placed = cut(placed.unionByName(nameless).drop("_nulls"), "placed")
    out = ["grp", "doc_id", "leaf", *carry, "n"]
    single = placed.filter("same = 1").select(*out, F.col("rank").alias("slot"))

    # rows that share an id: equal rows are one with a number, ranges of the leaf spread the rest
    held = placed.filter("same > 1").groupBy(*out, "rank").agg(F.count(F.lit(1)).alias("_m"))
    held = cut(held.withColumn("_range", F.conv(F.hex(F.substring("leaf", 1, 2)), 16, 10).cast("int")), "shared-ids")
    ranges = held.groupBy("grp", "doc_id", "_range").agg(F.sum("_m").alias("_all"))
    ranges = ranges.withColumn("_before", F.sum("_all").over(W.partitionBy("grp", "doc_id").orderBy("_range").rowsBetween(W.unboundedPreceding, 0)) - F.col("_all"))
    r = ranges.select(F.col("grp").alias("_g"), F.col("doc_id").alias("_d"), F.col("_range").alias("_r"), "_before")
    inner = W.partitionBy("grp", "doc_id", "_range").orderBy("leaf", *carry).rowsBetween(W.unboundedPreceding, 0)
    held = held.withColumn("_in", F.sum("_m").over(inner) - F.col("_m"))
    same = (F.col("grp") == F.col("_g")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_range") == F.col("_r"))
    first = held.join(r, same).withColumn("slot", F.col("rank") + F.col("_before") + F.col("_in"))
    spread = first.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_m - 1) div {SPREAD}")))).repartition("grp", "slot", "_block")
    upto = F.least(F.lit(SPREAD).cast("long"), F.col("_m") - F.col("_block") * SPREAD) - 1
    copies = spread.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), upto)))
    copies = copies.select(*out, (F.col("slot") + F.col("_block") * SPREAD + F.col("_i")).alias("slot"))
    return single.unionByName(copies)


# Slot arrays


def _arrays(batches):
    """The rows of each array, as dictionaries of column lists, in order of slot; rows come in order of (grp, block, slot)."""
    key, held = None, None
    for batch in batches:
        columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        keys = list(zip(columns["grp"], columns["block"]))
        a = 0
        for b in range(1, len(keys) + 1):
            if b < len(keys) and keys[b] == keys[a]:
                continue
            if keys[a] == key:
                for name, values in columns.items():
                    held[name] += values[a:b]
            else:
                if key is not None:
                    yield key, held
                key, held = keys[a], {name: values[a:b] for name, values in columns.items()}
            a = b
    if key is not None:
        yield key, held


def levels(nodes: list[str], n: int, fan: int, depth: int) -> list[list[str]]:
    """The array's nodes, level by level, ``n`` being the number of nodes of the whole tree at its lowest level."""
    out = [nodes]
    while n > 1 and len(out) <= depth:
        below = out[-1]
        out.append([sha256("".join(below[i:i + fan]).encode()).hexdigest() for i in range(0, len(below), fan)])
        n = -(-n // fan)
    return out


def _tops(fan: int, depth: int):
    def run(batches):
        import pyarrow as pa

        for (grp, block), rows in _arrays(batches):
            n = rows["n"][0]
            top = levels([x.hex() for x in rows["leaf"]], n, fan, depth)[-1][0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([grp], pa.string()), pa.array([block], pa.int64()), pa.array([bytes.fromhex(top)], pa.binary()), pa.array([-(-n // fan**depth)], pa.int64())],
                ["grp", "slot", "leaf", "n"])

    return run


def _paths(fan: int, depth: int, kept: list[str], kinds):
    """Every slot's path; the first row of an array (slot -1) has the path above it."""

    def run(batches):
        import pyarrow as pa

        for _, rows in _arrays(batches):
            above = rows["above"][0]
            nodes = [x.hex() for x in rows["leaf"][1:]]
            if not nodes:
                continue
            tree = levels(nodes, rows["n"][1], fan, depth)
            sides = []  # per level, what stands before and after each node in its run
            for level in tree[:-1]:
                runs = [level[i:i + fan] for i in range(0, len(level), fan)]
                sides.append([{"before": "".join(r[:j]), "after": "".join(r[j + 1:])} for r in runs for j in range(len(r))])
            paths = []
            for i in range(len(nodes)):
                own, at = [], i
                for side in sides:
                    own.append(side[at])
                    at //= fan
                paths.append(own + above)
            yield pa.RecordBatch.from_arrays([*[pa.array(rows[c][1:], k) for c, k in zip(kept, kinds)], pa.array(paths, pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))],
                                             [*kept, "path"])

    return run


def _in_arrays(rows: DataFrame, span: int) -> DataFrame:
    return rows.withColumn("block", F.expr(f"slot div {span}"))


def reduce_levels(nodes: DataFrame, fan: int, depth: int) -> list[DataFrame]:
    """``nodes`` (grp, slot, leaf, n, ...), then the nodes ``depth`` levels up, and so on to one node per group."""
    stages, span = [nodes], fan**depth
    while (stages[-1].agg(F.max("n")).first()[0] or 0) > 1:
        arrays = _in_arrays(stages[-1].select("grp", "slot", "leaf", "n"), span).repartition("grp", "block").sortWithinPartitions("grp", "block", "slot")
        stages.append(cut(arrays.mapInArrow(_tops(fan, depth), "grp string, slot long, leaf binary, n long"), "nodes"))
    return stages


def paths_down(stages: list[DataFrame], above: DataFrame, fan: int, depth: int, kept: list[str]) -> DataFrame:
    """The path of every row of the first stage, with its columns ``kept``; ``above`` (grp, path) is what lies above each group's root."""
    import pyarrow as pa

    from pyspark.sql.pandas.types import to_arrow_schema

    ups = above.select("grp", F.lit(0).cast("long").alias("block"), F.col("path").alias("above"))
    for i in range(max(0, len(stages) - 2), -1, -1):
        rows, names = stages[i], kept if i == 0 else ["grp", "slot"]
        arrays = _in_arrays(rows.select(*dict.fromkeys(["grp", "slot", "leaf", "n", *names])), fan**depth)
        both = arrays.withColumn("above", F.lit(None).cast(LEVELS)).unionByName(ups.withColumn("slot", F.lit(-1).cast("long")), allowMissingColumns=True)
        ordered = both.repartition("grp", "block").sortWithinPartitions("grp", "block", "slot")
        kinds = [to_arrow_schema(rows.select(c).schema).field(0).type for c in names]
        kinds = [pa.string() if pa.types.is_large_string(k) else pa.binary() if pa.types.is_large_binary(k) else k for k in kinds]
        schema = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in names) + f", path {LEVELS}"
        found = ordered.mapInArrow(_paths(fan, depth, names, kinds), schema)
        if i:
            ups = cut(found.select("grp", F.col("slot").alias("block"), F.col("path").alias("above")), "paths")
    return found


def merkle_manifest(docs: DataFrame, fields=FIELDS, group: str = "source", carry: dict[str, Column] | None = None, fan: int = 3, depth: int = 8) -> DataFrame:
    """doc_id, grp, slot, leaf, path, subroot, root of every row, digests as lowercase hex; ``carry`` names digests (hex) that ride along.

    ``path`` has, level by level from the leaf to the root, the digests that stand before and after the row's node in its run.
    ``grp`` is empty for a null group, else ``=`` and the name.
    """
    carry = carry or {}
    digests = {"leaf": leaf_of({c: F.col(c) for c in fields}), **carry}
    leaves = docs.select(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("grp"), F.col("doc_id").cast("long").alias("doc_id"),
                         *[F.unhex(c).alias(name) for name, c in digests.items()])
    leaves = cut(leaves, "leaves")
    slots = cut(coordinates(leaves, list(carry)), "slots")
    stages = reduce_levels(slots, fan, depth)
    subroots = cut(stages[-1].select("grp", F.col("leaf").alias("subroot")), "subroots")
    everything = W.partitionBy()
    upper = subroots.select(F.lit("").alias("grp"), (F.row_number().over(W.orderBy("grp")) - 1).cast("long").alias("slot"),
                            F.col("subroot").alias("leaf"), F.count(F.lit(1)).over(everything).alias("n"), F.col("grp").alias("member"))
    tops = reduce_levels(cut(upper, "upper"), fan, depth)
    root = tops[-1].select("leaf").first()
    origin = docs.sparkSession.createDataFrame([("", [])], f"grp string, path {LEVELS}")
    above = cut(paths_down(tops, origin, fan, depth, ["member"]).withColumnRenamed("member", "grp"), "above")
    found = paths_down(stages, above, fan, depth, ["grp", "slot", "doc_id", "leaf", *carry])
    found = join_small(found, subroots, "grp")
    text = lambda c: F.lower(F.hex(c))
    return found.select("doc_id", "grp", "slot", text("leaf").alias("leaf"), *[text(c).alias(c) for c in carry], "path",
                        text("subroot").alias("subroot"), F.lit(root["leaf"].hex() if root else None).cast("string").alias("root"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda node, level: F.sha2(F.concat(level["before"], node, level["after"]).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, from the leaf's level to the root's."""
    return F.sha2(F.array_join(F.transform(path, lambda level: F.concat(level["before"], level["after"])), "").cast("binary"), 256)


def tampered_manifest(docs: DataFrame) -> DataFrame:
    """The manifest checked against copies of the rows, some of them without their line ends."""
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    row = {c: F.col(c) for c in FIELDS} | {"text": changed}
    made = merkle_manifest(docs, carry={"tampered": leaf_of(row)}).withColumn("folded_root", fold(F.col("tampered"), F.col("path")))
    return made.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))
