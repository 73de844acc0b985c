"""Exact dedup with an extendible-hash index on shared files.

A key is the 64-bit hash of a text. The index has buckets that are ranges of the leading key bits. The directory starts with
one entry and doubles while a bucket holds more than ``capacity`` keys; only overfull buckets split. It is a table,
in pages of ``PROBE_BITS`` bits, and never comes to the driver.

Every key that two or more rows share sends its texts to the owner of its bucket, equal texts combined by every task before.
An owner task holds a range of keys. It walks the texts of a key and compares the bytes of each with those of the key's
chain: equal ones join a link, another one makes a new link. The links, with their largest doc_id and number of rows, are
written as the index, and each row is answered by the link it finds there. A key of one row is a link without bytes.

Defined cases: a null text is empty, empty texts equal one another; repeated rows are copies; a null doc_id counts
as the smallest; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from ringfence.llm.rows import join_groups
from ringfence.session import cut, join_small

PROBE_BITS = 12
# Bytes of texts a task holds to combine equal ones before they are sent.
HELD_BYTES = 32 << 20


def leading(key: str, bits: int) -> Column:
    """The first bits of a key as a number."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def build_directory(slots: DataFrame, capacity: int) -> DataFrame:
    """The buckets as (depth, prefix, below): the ranges of keys with these leading bits, found in pages of ``below`` bits.

    A round counts by ``PROBE_BITS`` more leading bits, for the buckets still overfull, and sums the counts upwards to
    every depth between. Only the number of overfull buckets comes to the driver.
    """
    spark = slots.sparkSession
    found, part, depth = [], slots.select("key"), 0
    nodes = spark.createDataFrame([(0, 0)], "depth int, prefix long")  # overfull, or the root
    while True:
        below = min(64, depth + PROBE_BITS)
        counts = part.groupBy(leading("key", below).alias("_entry")).count()
        counts = counts.select("_entry", "count", F.explode(F.sequence(F.lit(depth), F.lit(below))).alias("depth"))
        up = F.expr(f"shiftrightunsigned(_entry, {below} - depth)")
        level = counts.groupBy("depth", up.alias("prefix")).agg(F.sum("count").alias("n"))
        level = cut(level.unionByName(nodes.withColumn("n", F.lit(0).cast("long"))).groupBy("depth", "prefix").agg(F.sum("n").alias("n")), "directory")
        full = level.filter((F.col("n") > capacity) & (F.col("depth") < below))
        twice = F.explode(F.array(F.shiftleft("prefix", 1), F.shiftleft("prefix", 1).bitwiseOR(F.lit(1).cast("long"))))
        halves = full.select((F.col("depth") + 1).alias("depth"), twice.alias("prefix")).join(level, ["depth", "prefix"], "left")
        halves = halves.withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
        root = level.filter((F.col("depth") == 0) & (F.col("n") <= capacity)) if depth == 0 else level.limit(0)
        done = root.unionByName(halves.filter((F.col("n") <= capacity) | (F.col("depth") == 64)))
        found.append(done.select("depth", "prefix", F.lit(below).alias("below")))
        nodes = cut(halves.filter((F.col("n") > capacity) & (F.col("depth") == below)).select("depth", "prefix"), "overfull") if below < 64 else level.limit(0)
        if below == 64 or not nodes.count():
            break
        part = join_small(part.withColumn("_entry", leading("key", below)), nodes.select(F.col("prefix").alias("_entry")), "_entry", "left_semi").select("key")
        depth = below
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return cut(out, "buckets")


def with_bucket(slots: DataFrame, buckets: DataFrame) -> DataFrame:
    """Directory lookup: adds the bucket of every key, known by the first key of its range.

    A page has an entry for each value of its bits; a bucket of less depth has several. A key looks in one page a level.
    """
    levels = sorted(r[0] for r in buckets.select("below").distinct().collect())
    span = F.expr("shiftleft(1L, below - depth)")
    first = F.expr("shiftleft(prefix, below - depth)")
    entries = buckets.select("below", F.explode(F.sequence(first, first + (span - 1))).alias("_entry"), F.expr("shiftleft(prefix, 64 - depth)").alias("bucket"))
    pages = F.array(*[F.struct(F.lit(b).alias("below"), leading("key", b).alias("_entry")) for b in levels])
    looked = slots.withColumn("_page", F.explode(pages)).select(*slots.columns, "_page.below", "_page._entry")
    return join_small(looked, cut(entries, "pages"), ["below", "_entry"]).drop("below", "_entry")


def _later(a, b):
    """The larger doc_id; null is the smallest."""
    return b if a is None or (b is not None and b > a) else a


class Chain:
    """The different texts of one key, each with its largest doc_id and number of rows."""

    def __init__(self):
        self.links = []

    def add(self, text: bytes, doc_id, n: int) -> int:
        """Bytes that the chain grew by."""
        for link in self.links:
            if link[0] == text:
                link[1], link[2] = _later(link[1], doc_id), link[2] + n
                return 0
        self.links.append([text, doc_id, n])
        return len(text)


def _combined(schema):
    """Equal texts of a task as one row with their number."""

    def combined(batches):
        import pyarrow as pa

        def sent():
            rows = [(key, *link) for key, chain in held.items() for link in chain.links]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        held, size = {}, 0
        for batch in batches:
            for key, text, doc_id, n in zip(*(batch.column(c) for c in ("key", "text", "doc_id", "n"))):
                chain = held.setdefault(key.as_py(), Chain())
                size += chain.add(text.as_py(), doc_id.as_py(), n.as_py())
                if size >= HELD_BYTES:
                    yield sent()
                    held, size = {}, 0
        if held:
            yield sent()

    return combined


def _owned(schema):
    """The links of every key of an owner's range; its rows come in order of (bucket, key)."""

    def owned(batches):
        import pyarrow as pa

        out, last, chain = [], None, Chain()

        def linked():
            for number, (text, keep_id, n) in enumerate(chain.links, 1):
                out.append((*last, number, hashlib.sha256(text).hexdigest(), len(text), keep_id, n))

        def written():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

        for batch in batches:
            for bucket, key, text, doc_id, n in zip(*(batch.column(c) for c in ("bucket", "key", "text", "doc_id", "n"))):
                place = (bucket.as_py(), key.as_py())
                if place != last:
                    linked()
                    last, chain = place, Chain()
                    if len(out) >= 10_000:
                        yield written()
                        out.clear()
                chain.add(text.as_py(), doc_id.as_py(), n.as_py())
        linked()
        if out:
            yield written()

    return owned


def build_index(rows: DataFrame, keys: DataFrame, capacity: int) -> DataFrame:
    """bucket, key, chain, text_sha256, n_bytes, keep_id, group_size: the links of all keys.

    ``rows`` has doc_id, text and key, ``keys`` doc_id, key, text_sha256 and n_bytes of the same rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructType

    kind = rows.schema["doc_id"].dataType
    per_key = [F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.max("text_sha256").alias("text_sha256"), F.max("n_bytes").alias("n_bytes")]
    slots = cut(keys.groupBy("key").agg(*per_key), "exact-slots")
    buckets = build_directory(slots, capacity)
    shared = cut(slots.filter("group_size > 1").select("key"), "exact-shared")
    texts = join_small(rows, shared, "key", "left_semi").select("key", F.col("text").cast("binary").alias("text"), "doc_id", F.lit(1).cast("long").alias("n"))
    sent = StructType().add("key", LongType()).add("text", BinaryType()).add("doc_id", kind).add("n", LongType())
    # written before it is ranged, as the splitters are taken from a sample of it
    texts = cut(texts.mapInArrow(_combined(to_arrow_schema(sent)), sent), "exact-texts")
    link = StructType().add("bucket", LongType()).add("key", LongType()).add("chain", IntegerType())
    link = link.add("text_sha256", StringType()).add("n_bytes", IntegerType()).add("keep_id", kind).add("group_size", LongType())
    dealt = with_bucket(texts, buckets).repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key")
    chains = dealt.mapInArrow(_owned(to_arrow_schema(link)), link)
    alone = with_bucket(slots.filter("group_size = 1"), buckets).withColumn("chain", F.lit(1))
    return cut(chains.unionByName(alone), "exact-index")


def dedup_exact(docs: DataFrame, capacity: int = 1 << 16) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, text_key of every row; of equal texts the largest doc_id stays.

    Of repeated rows with that doc_id, all are marked kept: they are one document.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    keys = cut(rows.select("doc_id", "key", F.sha2("text", 256).alias("text_sha256"), F.octet_length("text").alias("n_bytes")), "exact-keys")
    links = build_index(rows, keys, capacity).drop("bucket", "chain")
    return join_groups(keys, links, ["key", "text_sha256", "n_bytes"], "group_size").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", F.col("key").alias("text_key"))
