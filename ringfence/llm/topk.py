"""Exact top-k search by inner product.

Rows are dealt into shards of about ``shard_rows`` by a hash of their id; the queries, a small stated part of the
rows, go to every shard in tiles. A task multiplies each tile with its shard, keeps the k best per query, and the
lists of the shards are merged in two levels. Vectors are turned into integers floor(scale * x), so scores are
exact: tiles are multiplied in single or double precision only where the product of the norms proves every partial
sum exactly representable, else as 64-bit integers.

Defined cases: a null vector, one with a null, NaN or infinite component, or a row without id takes no part; vectors of
different lengths don't meet; rows with the same id are told apart by a number, so a query meets its copies; ties go
to the smaller id; fewer than k candidates give all; a score beyond 64 bits is not defined. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ringfence.session import cut

SCHEMA = "query_id long, query_no int, vec_id long, vec_no int, score long"


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Per row the columns of the k highest scores; of equal ones the first columns."""
    n = scores.shape[1]
    if n <= k:
        return np.tile(np.arange(n), (len(scores), 1))
    if abs(scores).max(initial=0) < 2**62 // n:
        keys = scores.astype(np.int64) * n + np.arange(n - 1, -1, -1)
        return np.argpartition(keys, n - k, axis=1)[:, n - k:]
    return np.argsort(-scores.astype(object), axis=1, kind="stable")[:, :k]


def product(tile: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Exact integer inner products; the bound on every partial sum is the product of the norms."""
    bound = np.sqrt((tile.astype(float) ** 2).sum(1).max() * (shard.astype(float) ** 2).sum(1).max()) * (1 + 1e-9)
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    return (tile.astype(kind) @ shard.astype(kind).T).astype(np.int64)


def _search(k: int, tile_rows: int):
    """Per partition, rows in order of (shard, dim, kind, id): the vectors of a shard come before its queries."""

    def matrix(batch, dim):
        return batch.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)

    def tiles(batches):
        import pyarrow as pa

        held, own = None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            group = np.stack([table.column(c).to_numpy() for c in ("shard", "dim", "kind")], 1)
            cuts = np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(group)]):
                if b == a:
                    continue
                shard, dim, kind = group[a].tolist()
                part = table.slice(a, b - a)
                ids, nos, m = part.column("id").to_numpy(), part.column("no").to_numpy(), matrix(part, dim)
                if kind == 0:
                    held = (held if own == (shard, dim) else []) + [(ids, nos, m)]
                    own = (shard, dim)
                    continue
                if own != (shard, dim):
                    continue
                if len(held) > 1:
                    held = [tuple(np.concatenate(x) for x in zip(*held))]
                sid, sno, vectors = held[0]
                for lo in range(0, len(ids), tile_rows):
                    q, qn, qm = ids[lo:lo + tile_rows], nos[lo:lo + tile_rows], m[lo:lo + tile_rows]
                    at = best(product(qm, vectors), min(k + 1, len(sid)))  # one more: the query itself may be among them
                    row = np.repeat(np.arange(len(q)), at.shape[1])
                    col = at.ravel()
                    other = (sid[col] != q[row]) | (sno[col] != qn[row])
                    row, col = row[other], col[other]
                    score = np.einsum("ij,ij->i", qm[row], vectors[col])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q[row], qn[row], sid[col], sno[col], score)],
                                                     ["query_id", "query_no", "vec_id", "vec_no", "score"])

    return tiles


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, shard_rows: int = 1 << 15, tile_rows: int = 128) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for every row (vec_id, embedding) for which ``is_query`` holds.

    A tile has ``tile_rows`` queries, so a task holds tile_rows * shard_rows scores and one shard.
    """
    x = F.transform("embedding", lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    rows = cut(rows.select(F.col("vec_id").cast("long").alias("id"), is_query.alias("q"), x.alias("v"))
               .withColumn("no", F.row_number().over(W.partitionBy("id").orderBy("v"))), "topk-vectors")
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.select(F.pmod(F.xxhash64("id", "no"), F.lit(shards)).cast("int").alias("shard"), F.size("v").alias("dim"), F.lit(0).alias("kind"), "id", "no", "v")
    asked = rows.filter("q").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.size("v").alias("dim"), F.lit(1).alias("kind"), "id", "no", "v")
    both = dealt.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "dim", "kind", "id", "no")
    lists = both.mapInArrow(_search(k, tile_rows), SCHEMA)

    def merged(df, *by):
        order = W.partitionBy("query_id", "query_no", *by).orderBy(F.col("score").desc(), "vec_id", "vec_no")
        return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    half = merged(lists.withColumn("_part", F.pmod(F.hash("vec_id"), F.lit(max(1, int(shards ** 0.5))))), "_part").drop("rank", "_part")
    return merged(half).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
