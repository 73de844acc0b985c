"""Ranks, running totals and quantiles: bucketed and plain paths against NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ringfence.operators.rank import _with_bucket, cut_points, order_statistics, quantiles, row_index, running_totals, value_histogram


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value and one group holds most rows."""
    rng = np.random.default_rng(3)
    n = 3000
    v = rng.normal(size=n).round(2)
    v[rng.random(n) < 0.34] = 0.25
    g = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c"], n))
    pdf = pd.DataFrame({"id": np.arange(n), "v": v, "g": g, "y": (rng.random(n) < 0.3).astype(int)})
    return pdf, spark.createDataFrame(pdf).repartition(5).cache()


@pytest.mark.parametrize("per_bucket", [10_000, 100, 17])
@pytest.mark.parametrize("by", [(), ("g",)])
def test_quantiles_match_numpy(skewed, per_bucket, by):
    pdf, df = skewed
    got = quantiles(df, "v", {"a": 0.0, "m": 0.5, "q": 0.937, "z": 1.0}, by, rows_per_bucket=per_bucket).toPandas()
    groups = pdf.groupby(list(by)) if by else [((None,), pdf)]
    for key, part in groups:
        row = got[got.g == key[0]].iloc[0] if by else got.iloc[0]
        for name, q in {"a": 0.0, "m": 0.5, "q": 0.937, "z": 1.0}.items():
            assert row[name] == pytest.approx(np.quantile(part.v, q), abs=1e-12)


@pytest.mark.parametrize("per_bucket", [10_000, 100, 17])
def test_running_totals_with_previous(skewed, per_bucket):
    pdf, df = skewed
    hist = value_histogram(df, "v", ["g"], positive="y")
    cuts = cut_points(df, F.col("v"), len(pdf), per_bucket)
    got = running_totals(hist, "v", ["pos", "neg"], ["g"], cuts, previous=True).toPandas()
    for g, part in pdf.groupby("g"):
        want = part.groupby("v").y.agg(["sum", "count"])
        mine = got[got.g == g].sort_values("v")
        assert list(mine.v) == list(want.index)
        pos = want["sum"].to_numpy()
        assert list(mine.pos_before) == list(np.cumsum(pos) - pos)
        assert set(mine.pos_total) == {pos.sum()}
        assert list(mine.pos_prev.iloc[1:]) == list(pos[:-1])
        assert pd.isna(mine.pos_prev.iloc[0])


@pytest.mark.parametrize("by", [(), ("g",)])
def test_row_index_same_for_any_bucket_count(skewed, by):
    pdf, df = skewed
    base = None
    for per_bucket in (10_000, 100, 9):
        got = row_index(df, "v", ["id"], by, rows_per_bucket=per_bucket).orderBy("id").toPandas()
        assert len(got) == len(pdf)
        for _, part in got.groupby(list(by)) if by else [(0, got)]:
            part = part.sort_values("row_idx")
            assert list(part.row_idx) == list(range(len(part)))
            assert part.v.is_monotonic_increasing
            assert set(part.n_rows) == {len(part)}
        base = got if base is None else base
        assert base.row_idx.equals(got.row_idx)


def test_row_index_does_not_depend_on_partitions(skewed):
    _, df = skewed
    runs = [
        row_index(df.repartition(p), "v", ["id"], rows_per_bucket=100).orderBy("id").toPandas().row_idx
        for p in (1, 3, 8)
    ]
    assert runs[0].equals(runs[1]) and runs[0].equals(runs[2])


@pytest.mark.parametrize("per_bucket", [10_000, 100])
def test_positions_follow_values_at_every_size(spark, skewed, per_bucket):
    """Hot values are ordered by the ties themselves; NULL comes first, NaN last; integers beyond 2^53 stay apart."""
    pdf, df = skewed
    got = row_index(df, "v", ["id"], rows_per_bucket=per_bucket).orderBy("row_idx").toPandas()
    assert list(got.id) == list(pdf.sort_values(["v", "id"]).id)
    odd = spark.createDataFrame([(None, 0), (float("nan"), 1)] + [(float(i), i) for i in range(2, 500)], "v double, id long")
    assert [r.id for r in row_index(odd, "v", ["id"], rows_per_bucket=per_bucket).orderBy("row_idx").collect()] == [0, *range(2, 500), 1]
    large = spark.range(500).select((F.lit(2**60) + (F.col("id") * 7) % 500).alias("v"), "id").withColumn("k", F.when(F.col("id") < 400, "a"))
    for r in row_index(large, "v", (), ["k"], rows_per_bucket=per_bucket).groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("row_idx").alias("d"), F.max("row_idx").alias("m")).collect():
        assert (r.n, r.d, r.m + 1) == ((400,) * 3 if r.k else (100,) * 3)


def test_quantiles_skip_null_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (2.0,), (3.0,), (7.0,)], "v double")
    assert quantiles(df, "v", {"q": 0.9}).first()["q"] == pytest.approx(5.8)


@pytest.mark.parametrize("per_bucket", [10_000, 50])
def test_order_statistics(skewed, per_bucket):
    pdf, df = skewed
    v = np.sort(pdf.v)
    for k in (0, 1, 1500, 2999):
        value, below, same = order_statistics(df, "v", [k], len(v), per_bucket)[k]
        assert value == v[k] and below == (v < value).sum() and same == (v == value).sum()


@pytest.mark.parametrize("buckets", [10, 1_000, 100_000])
def test_running_totals_over_two_levels_of_cuts(spark, buckets):
    rows = 200_000
    # a third of the rows holds one value
    df = spark.range(rows).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.xxhash64("id") / F.lit(2.0**60)).alias("v"))
    cuts = cut_points(df, F.col("v"), rows, rows // buckets, ranges=100)
    assert cuts == sorted(cuts) and len(cuts) >= 0.6 * (buckets - 1)
    hist = value_histogram(df, "v")
    got = running_totals(hist, "v", ["n"], (), cuts, previous=True)
    want = running_totals(hist, "v", ["n"], (), (), previous=True)
    columns = ["v", "n", "n_before", "n_total", "n_prev"]
    assert got.select(columns).exceptAll(want.select(columns)).isEmpty() and got.count() == want.count()
    sizes = _with_bucket(df.filter("v <> 7"), "v", cuts, "b").groupBy("b").count().agg(F.max("count")).first()[0]
    assert sizes <= max(40, 3 * rows // buckets)


def test_positions_of_keys_named_like_helper_columns(spark):
    """A long table is written in ranges; columns made on the way must not meet those of the caller."""
    names = ["_all", "_n", "_below", "_bucket"]
    rows = [(i % 2, i % 3 == 0, None if i % 5 else i, -i, i) for i in range(300)]
    df = spark.createDataFrame(rows, "_all int, _n boolean, _below int, _bucket int, t int")
    for by in (["_all"], ["_n", "_all"], names[:3]):
        got = row_index(df, "t", (), by, rows_per_bucket=40)
        assert sorted(got.columns) == sorted([*names, "t", "row_idx", "n_rows"])
        seen = {}
        for r in sorted(got.collect(), key=lambda r: r["t"]):
            group = seen.setdefault(tuple(r[k] for k in by), [])
            assert r["row_idx"] == len(group)
            group.append(r["n_rows"])
        assert all(set(sizes) == {len(sizes)} for sizes in seen.values())


def test_long_tables_are_moved_and_sorted_once(skewed):
    """Numbers come from the sorted ranges as written: no window, no second shuffle; equal rows get numbers of their own."""
    _, df = skewed
    twice = df.unionAll(df)
    got = row_index(twice, "v", ["id"], ["g"], rows_per_bucket=100, name="_at", total=None)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
    for r in got.groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("_at").alias("d"), F.min("_at").alias("a"), F.max("_at").alias("z")).collect():
        assert (r.d, r.a, r.z) == (r.n, 0, r.n - 1)
    for per_bucket in (100, 100_000):
        lean = row_index(twice, "v", ["id"], ["g"], rows_per_bucket=per_bucket, name="_at", total=None, keep=["y"])
        assert lean.columns == ["g", "y", "_at"] and lean.count() == got.count()
    ordered = got.orderBy("g", "_at").select("g", "v", "id").collect()
    assert ordered == twice.orderBy("g", "v", "id").select("g", "v", "id").collect()
