"""Rows known by doc_id and a hash of their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ringfence.session import cut, join_small


def text_key(docs: DataFrame | None = None) -> Column:
    return F.xxhash64(F.coalesce(F.col("text") if docs is None else docs["text"], F.lit("")))


def _matching(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    own = keys.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    # columns of their tables: the documents may have any name
    return join_small(docs, own, (text_key(docs) == own["_key"]) & docs["doc_id"].eqNullSafe(own["_id"]), how)


# A group with more than one in HOT_SHARE of the rows is met by broadcast; there are fewer than HOT_SHARE of them at any size.
HOT_SHARE = 10_000


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str) -> DataFrame:
    """Inner join of rows with a row per group of them; ``size``, a column of ``groups``, is at least its number of rows.

    Sizes add up to at most ``size`` summed over the groups, which bounds the hot ones: their rows stay where they are
    and the others are joined by key. Both tables are written out already; keys are not null.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) * HOT_SHARE > total
    few = cut(groups.filter(hot), "hot-groups")
    there = rows.join(F.broadcast(few), on)
    rest = rows.join(F.broadcast(few.select(*on)), on, "left_anti").join(groups.filter(~hot), on)
    return there.unionByName(rest)


def once(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` with one of the rows that share doc_id and text; ``keys`` lists a row for each of theirs."""
    twice = cut(keys.groupBy("doc_id", "text_key").count().filter("count > 1").select("doc_id", "text_key"), "twice")
    return _matching(docs, twice, "left_anti").unionByName(_matching(docs, twice, "left_semi").dropDuplicates(["doc_id", "text"]))


def keep_rows(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, for which the verdict (doc_id, text_key, kept) is to keep; repeated rows once."""
    verdict = cut(verdict.select("doc_id", "text_key", "kept"), "verdict")
    dropped = cut(verdict.filter("not kept").select("doc_id", "text_key").distinct(), "dropped")
    return once(_matching(docs, dropped, "left_anti"), verdict.filter("kept"))
