"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Only DataFrame functions. The words of a source lie in shards of about ``shard_words`` (documents dealt by
a seeded hash), each shard is a line cut into blocks of ``block`` words. Blocks are seats: sources get them by
the highest quotients target/(2k+1), then the shards of a source theirs by size/(2k+1). In a shard the blocks
are drawn in a seeded order, over and over if the quota exceeds their number. What whole blocks leave open
(their rounding, the short last block of a shard) is settled in words in the largest shard of the source.

Defined cases: a null text or one without words has size 0 and is never taken; a null source is a source of its
own, the last; rows that repeat are rows; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ringfence.llm.rows import once, text_key
from ringfence.session import cut, join_small

WORD = r"[^\x20\x09-\x0D]+"


def apportion(items: DataFrame, group: list[str], votes: str, seats: str, order: list[str]) -> DataFrame:
    """Adds ``quota``: the ``seats`` of each group dealt to its items by highest quotients votes/(2k+1).

    With n items of share f the result lies within f*n/2 + 1 of the rounded share (the divisor that gives all
    seats moves the sum of n roundings by n/2 at most), so only quotients in that band are listed and ranked;
    seats below it are certain. Ties go to the first item in ``order``.
    """
    all_ = W.partitionBy(*group)
    band = (
        items.filter(F.col(votes) > 0)
        .withColumn("_share", F.col(votes) / F.sum(votes).over(all_))
        .withColumn("_slack", F.ceil(F.col("_share") * F.count(F.lit(1)).over(all_) / 2).cast("long") + 1)
        .withColumn("_mid", F.round(F.col("_share") * F.col(seats)).cast("long"))
        .withColumn("_sure", F.greatest(F.lit(0).cast("long"), F.col("_mid") - F.col("_slack")))
        .withColumn("_open", F.col(seats) - F.sum("_sure").over(all_))
    )
    listed = band.withColumn("_k", F.explode(F.sequence(F.col("_sure"), F.col("_mid") + F.col("_slack"))))
    best = W.partitionBy(*group).orderBy((F.col(votes) / (2 * F.col("_k") + 1)).desc(), *order)
    won = listed.withColumn("_rank", F.row_number().over(best)).filter("_rank <= _open")
    more = won.groupBy(*group, *order).agg(F.count(F.lit(1)).alias("_more"))
    keys = [*dict.fromkeys([*group, *order])]
    return (
        items.join(band.select(*keys, "_sure"), keys, "left").join(more, keys, "left")
        .withColumn("quota", F.coalesce("_sure", F.lit(0)) + F.coalesce("_more", F.lit(0))).drop("_sure", "_more")
    )


def source_targets(sizes: DataFrame, weights=(5, 2, 1), most: int = 3) -> DataFrame:
    """One row per source (``source``, ``source_size``): adds ``sid`` (place by code point, null last) and ``target``.

    The targets share all words by weight. None exceeds ``most`` times its source; with the sources in order of
    most * size / weight those that stop are the first ones. The level left to the others after the first k rises
    with k while those stop, and falls after, so it is the largest of the levels from running sums.
    The table has one row per source and is numbered as a whole.
    """
    named = W.orderBy(F.col("source").asc_nulls_last())
    by_cap = W.orderBy(F.col("_cap") / F.col("_w"), "sid")
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    sid = F.row_number().over(named) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    return (
        sizes.withColumn("sid", sid).withColumn("_w", weight).withColumn("_cap", (most * F.col("source_size")).cast("double"))
        .withColumn("_all", F.sum("source_size").over(whole)).withColumn("_weights", F.sum("_w").over(whole))
        .withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
                    / (F.col("_weights") - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
        .withColumn("target", F.least(F.col("_cap"), F.col("_w") * F.max("_level").over(whole)))
        .select("source", "source_size", "sid", "target")
    )


def mix_sources(docs: DataFrame, weights=(5, 2, 1), most: int = 3, block: int = 256, shard_words: int = 1 << 20, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target and ``taken``, the words that the mix takes of each document; text_key.

    ``rounds`` are the whole copies in it, ``runs`` the ranges of words [at, to) of the blocks drawn beyond them, in order,
    touching ranges as one. ``taken`` counts repeats and is at most ``most`` times the size. Per source it sums to the rounded target
    (in a source that stops at ``most`` times its size, short of it by a few blocks at most).
    """
    rows = cut(docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("_h"), text_key().alias("text_key"),
    ), "mix-rows")
    sources = cut(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
                  .withColumn("_seats", F.round(F.sum("source_size").over(W.partitionBy()) / block).cast("long"))
                  .withColumn("_all", F.lit(0)), "mix-sources")
    seats = apportion(sources, ["_all"], "target", "_seats", ["sid"])
    seats = cut(seats.select(F.col("source").alias("_source"), "source_size", "sid", "target", F.col("quota").alias("_blocks"),
                             F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long").alias("_shards")), "mix-seats")
    dealt = join_small(rows, seats, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # texts without words have no place on a line, however many a source has
    none, dealt = dealt.filter("size = 0"), dealt.filter("size > 0").withColumn("_shard", F.pmod("_h", "_shards"))
    line = W.partitionBy("sid", "_shard").orderBy("_h", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = cut(dealt.withColumn("_start", F.sum("size").over(line) - F.col("size")), "mix-placed")

    shards = placed.groupBy("sid", "_shard").agg(
        F.sum("size").alias("_words"), F.first("_blocks").alias("_blocks"), F.first("target").alias("target"))
    shards = apportion(shards, ["sid"], "_words", "_blocks", ["_shard"])
    shards = shards.withColumn("_n", F.ceil(F.col("_words") / block)).withColumn("quota", F.least("quota", most * F.col("_n")))
    drawn = W.partitionBy("sid", "_shard").orderBy(F.xxhash64(F.lit(seed), "sid", "_shard", "_b"), "_b")
    blocks = cut(
        shards.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
        .withColumn("_size", F.least(F.lit(block), F.col("_words") - F.col("_b") * block))
        .withColumn("_before", F.sum("_size").over(drawn.rowsBetween(W.unboundedPreceding, 0)) - F.col("_size"))
        .withColumn("_drawn", F.row_number().over(drawn)), "mix-blocks")
    by_quota = blocks.groupBy("sid", "_shard").agg(
        F.first("_words").alias("_words"), F.first("target").alias("target"),
        F.sum(F.col("_size") * (F.floor(F.col("quota") / F.col("_n")) + (F.col("_drawn") <= F.col("quota") % F.col("_n")).cast("long"))).alias("_got"))
    largest = W.partitionBy("sid").orderBy(F.col("_words").desc(), "_shard")
    open_ = F.round("target").cast("long") - F.sum("_got").over(W.partitionBy("sid"))
    budget = by_quota.withColumn("_budget", F.when(F.row_number().over(largest) == 1, F.greatest(
        F.lit(0).cast("long"), F.least(most * F.col("_words"), F.col("_got") + open_))).otherwise(F.col("_got")))
    budget = budget.select("sid", "_shard", "_budget", F.floor(F.col("_budget") / F.col("_words")).alias("_rounds"))
    taken = blocks.join(budget, ["sid", "_shard"]).select(
        "sid", "_shard", "_b", "_rounds",
        F.greatest(F.lit(0).cast("long"), F.least("_size", F.col("_budget") - F.col("_rounds") * F.col("_words") - F.col("_before"))).alias("_extra"))

    key = ["doc_id", "text_key", "source", "size", "source_size", "target", "sid", "_shard", "_start"]
    spread = placed.withColumn(
        "_b", F.explode(F.sequence(F.floor(F.col("_start") / block), F.floor((F.col("_start") + F.col("size") - 1) / block))))
    at = F.greatest(F.lit(0).cast("long"), F.col("_b") * block - F.col("_start"))
    to = F.least("size", F.col("_b") * block + F.col("_extra") - F.col("_start"))
    got = spread.join(taken, ["sid", "_shard", "_b"]).groupBy(*key).agg(
        (F.col("size") * F.first("_rounds") + F.sum(F.greatest(F.lit(0).cast("long"), to - at))).cast("long").alias("taken"),
        F.first("_rounds").alias("rounds"), F.sort_array(F.collect_list(F.when(to > at, F.struct(at.alias("at"), to.alias("to"))))).alias("_drawn"))
    heads = F.filter("_drawn", lambda r, i: F.coalesce(F.get("_drawn", i - 1)["to"] < r["at"], F.lit(True)))
    tails = F.filter("_drawn", lambda r, i: F.coalesce(F.get("_drawn", i + 1)["at"] > r["to"], F.lit(True)))
    got = got.withColumn("runs", F.zip_with(heads, tails, lambda a, b: F.struct(a["at"].alias("at"), b["to"].alias("to"))))
    none = none.withColumn("taken", F.lit(0).cast("long")).withColumn("rounds", F.lit(0).cast("long"))
    none = none.withColumn("runs", F.array().cast("array<struct<at: bigint, to: bigint>>"))
    out = ["doc_id", "source", "size", "source_size", "target", "taken", "text_key", "rounds", "runs"]
    return got.select(*out).unionByName(none.select(*out))


def take_mix(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix as documents, all columns: whole copies, then a row for each run of drawn words beyond them.

    ``mixed`` is :func:`mix_sources` of the same ``docs``. A run that is not the whole text has its words joined by one
    space; a column n_chars then has its length.
    """
    mixed = cut(mixed, "mixed")
    taken = mixed.filter("taken > 0").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("size").alias("_size"),
                                             F.col("rounds").alias("_rounds"), F.col("runs").alias("_runs"))
    # the documents may have columns of any name: they are one
    rows = once(docs, mixed)
    packed = rows.select(F.struct(*[rows[c] for c in docs.columns]).alias("_row"), rows["text"].alias("_text"), text_key(rows).alias("_own"))
    both = packed.join(taken, (F.col("_own") == F.col("_key")) & F.col("_row")["doc_id"].eqNullSafe(F.col("_id")))
    # a null stands for the whole text; the words of a text are listed once, for all of its runs
    piece = lambda words, r: F.when(r["to"] - r["at"] < F.col("_size"), F.array_join(
        F.slice(words, (r["at"] + 1).cast("int"), (r["to"] - r["at"]).cast("int")), " "))
    listed = F.when((F.size("_runs") > 0) & ~F.exists("_runs", lambda r: r["to"] - r["at"] == F.col("_size")),
                    F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
    runs = F.transform(F.array(listed), lambda words: F.transform("_runs", lambda r: piece(words, r)))[0]
    rows = both.withColumn("_pieces", F.concat(F.array_repeat(F.lit(None).cast("string"), F.col("_rounds").cast("int")), runs))
    rows = rows.withColumn("_piece", F.explode("_pieces"))
    own = {c: F.col("_row")[c] for c in docs.columns}
    own["text"] = F.coalesce("_piece", "_text")
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("_piece").isNotNull(), F.length("_piece").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return rows.select(*[v.alias(c) for c, v in own.items()])
