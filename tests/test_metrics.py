"""Ranking metrics by hand-made cases and brute force; thresholds and splits."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ringfence.operators import metrics, splits, threshold
from ringfence.operators.sampling import mini_batches, pseudo_groups


def brute_auc(s, y):
    p, n = s[y == 1], s[y == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a in p for b in n])


def brute_ap(s, y):
    total = 0.0
    for v in sorted(set(s), reverse=True):
        here = (s == v) & (y == 1)
        total += here.sum() / (y == 1).sum() * (y[s >= v] == 1).mean()
    return total


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(8)
    n = 1500
    g = np.where(rng.random(n) < 0.5, "hot", rng.choice(["a", "b"], n))
    pdf = pd.DataFrame({"g": g, "score": rng.normal(size=n).round(1), "label": (rng.random(n) < 0.3).astype(int)})
    pdf.loc[rng.random(n) < 0.3, "score"] = 0.5
    return pdf, spark.createDataFrame(pdf).cache()


@pytest.mark.parametrize("per_bucket", [10_000, 60])
def test_auc_and_ap_with_ties(scored, per_bucket):
    pdf, df = scored
    whole = metrics.ranking(df, rows_per_bucket=per_bucket).first()
    s, y = pdf.score.to_numpy(), pdf.label.to_numpy()
    assert whole["auc"] == pytest.approx(brute_auc(s, y)) and whole["ap"] == pytest.approx(brute_ap(s, y))
    for r in metrics.ranking(df, by=["g"], rows_per_bucket=per_bucket).collect():
        part = pdf[pdf.g == r["g"]]
        assert r["auc"] == pytest.approx(brute_auc(part.score.to_numpy(), part.label.to_numpy()))
        assert r["ap"] == pytest.approx(brute_ap(part.score.to_numpy(), part.label.to_numpy()))


def test_step_sum_case_by_hand(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "score double, label int")
    r = metrics.ranking(df).first()
    assert r["auc"] == pytest.approx(0.75) and r["ap"] == pytest.approx(0.8333333, abs=1e-6)


def test_single_class_gives_null(spark):
    ones = spark.createDataFrame([(0.1, 1), (0.2, 1)], "score double, label int")
    zeros = ones.withColumn("label", F.lit(0))
    assert metrics.ranking(ones).first()["auc"] is None and metrics.ranking(ones).first()["ap"] == 1.0
    assert metrics.ranking(zeros).first()["auc"] is None and metrics.ranking(zeros).first()["ap"] is None
    assert metrics.classes_present(ones).first()["single_class"]


def test_curve_points(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.7, 0), (0.6, 1), (0.5, 0), (0.4, 0)], "score double, label int")
    every = metrics.roc_points(df, drop_collinear=False).orderBy(F.desc_nulls_first("threshold")).collect()
    assert [round(r["tpr"], 3) for r in every] == [0, 0.333, 0.667, 0.667, 1, 1, 1]
    assert [round(r["fpr"], 3) for r in every] == [0, 0, 0, 0.333, 0.333, 0.667, 1]
    corners = metrics.roc_points(df).orderBy(F.desc_nulls_first("threshold")).collect()
    assert [r["threshold"] for r in corners] == [None, 0.8, 0.7, 0.6, 0.4]
    pr = metrics.pr_points(df).orderBy(F.asc_nulls_last("threshold")).collect()
    assert (pr[-1]["precision"], pr[-1]["recall"]) == (1.0, 0.0)
    assert pr[0]["recall"] == 1.0 and pr[0]["precision"] == 0.5


def test_decisions_with_zero_division(spark):
    df = spark.createDataFrame([(0, 1), (0, 0)], "is_anomaly int, label int")
    r = metrics.decisions(df).first()
    assert (r["precision"], r["recall"], r["f1"], r["flag_rate"]) == (0.0, 0.0, 0.0, 0.0)


def test_small_groups_are_left_out(spark):
    rows = [("a", float(i), i % 2) for i in range(6)] + [("b", 1.0, 0), (None, 1.0, 1)]
    got = metrics.auc_by_group(spark.createDataFrame(rows, "g string, score double, label int"), "g").collect()
    assert [(r["g"], r["n_rows"]) for r in got] == [("a", 6)]


# -- thresholds --------------------------------------------------------------------


def plain_ewma(scores, tau, a=0.1):
    out = []
    for s in scores:
        if s == s and s <= tau:
            tau = (1 - a) * tau + a * s
        out.append(tau)
    return out


@pytest.mark.parametrize("chunk_rows", [10_000, 64, 7])
def test_moving_threshold_same_for_any_chunk(spark, chunk_rows):
    rng = np.random.default_rng(2)
    n = 900
    pdf = pd.DataFrame({"k": np.where(rng.random(n) < 0.8, "hot", "b"), "t": rng.permutation(n),
                        "score": rng.normal(size=n) - np.linspace(0, 2, n)})
    pdf.loc[::50, "score"] = np.nan
    got = threshold.moving_threshold(spark.createDataFrame(pdf), "score", ["k"], "t", 0.7, chunk_rows=chunk_rows).toPandas()
    assert len(got) == n
    for k, part in got.groupby("k"):
        want = plain_ewma(pdf[pdf.k == k].sort_values("t").score, 0.7)
        assert np.allclose(part.sort_values("t").tau_after, want, atol=1e-12)


def test_moving_threshold_options(spark):
    df = spark.createDataFrame([("a", 1, -1.0), ("a", 2, 0.55), ("a", 3, 0.2)], "k string, t int, score double")
    run = lambda **o: [round(r["tau_after"], 6) for r in threshold.moving_threshold(df, "score", ["k"], "t", 0.5, **o).orderBy("t").collect()]
    assert run() == [0.35, 0.35, 0.335]
    assert run(skip_override=True) == [0.5, 0.5, 0.47]
    assert run(margin=0.1, skip_override=True) == [0.5, 0.505, 0.4745]
    assert run(margin=0.1, skip_override=True, chunk_rows=1) == [0.5, 0.505, 0.4745]


def test_last_n_per_key(spark):
    df = spark.range(100).selectExpr("id", "id % 2 as k")
    got = threshold.last_n(df, ["k"], "id", 3).orderBy("id").collect()
    assert [r["id"] for r in got] == [94, 95, 96, 97, 98, 99]


# -- splits -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(5)
    n = 1000
    g = np.where(rng.random(n) < 0.34, "g0", np.char.add("g", rng.integers(1, 23, n).astype(str)))
    pdf = pd.DataFrame({"id": range(n), "g": g})
    pdf.loc[::97, "g"] = None
    return pdf, spark.createDataFrame(pdf).repartition(4).cache()


def test_group_split_is_whole_and_stable(groups):
    pdf, df = groups
    train, test = splits.group_split(df, "g")
    a, b = set(r["g"] for r in train.collect()), set(r["g"] for r in test.collect())
    n = pdf.g.nunique()
    assert not (a & b) and len(b) == -(-n // 5) and None in a
    assert train.count() + test.count() == len(pdf)
    again = splits.group_split(df.repartition(7), "g")[1]
    assert set(r["g"] for r in again.collect()) == b
    assert set(r["g"] for r in splits.group_split(df, "g", seed=7)[1].collect()) != b


@pytest.mark.parametrize("k", [None, 3])
def test_group_folds_are_balanced_and_whole(groups, k):
    pdf, df = groups
    got = splits.with_folds(df, "g", k).toPandas()
    assert len(got) == len(pdf) and got.fold.notna().all()
    assert (got.groupby(got.g.fillna("-")).fold.nunique() == 1).all()
    folds = k or 5
    load, sizes = [0] * folds, sorted(pdf.g.fillna("-").value_counts(), reverse=True)
    for s in sizes:
        load[load.index(min(load))] += s
    assert sorted(got.fold.value_counts()) == sorted(load)


def test_level_plan_equals_one_by_one():
    classes = [(900, 1), (40, 3), (7, 200), (1, 1500)]
    load = [0] * 5
    for size, many in classes:
        for _ in range(many):
            load[load.index(min(load))] += size
    mine = [0] * 5
    for size, take in splits._level(classes, 5):
        mine = [m + size * t for m, t in zip(mine, take)]
    assert mine == load


def test_few_groups():
    assert [splits.fold_count(n) for n in (1, 2, 4, 5, 99)] == [2, 2, 4, 5, 5]


def test_last_groups_ignore_null_and_keep_train_whole(groups):
    pdf, df = groups
    first = pdf.dropna().groupby("g").id.min().sort_values()
    train, test = splits.holdout_last_groups(df, "g", "id")
    assert set(r["g"] for r in test.collect()) == set(first.index[-3:])
    assert train.count() + test.count() == len(pdf)


@pytest.mark.parametrize("per_bucket", [10_000, 80])
def test_tail_of_large_integers_and_ties(spark, per_bucket):
    df = spark.range(100).select((F.lit(2**60) + F.col("id")).alias("t"), "id")
    for ties in ((), ("id",)):
        test = splits.holdout_tail(df, "t", ties, rows_per_bucket=per_bucket)[1]
        assert sorted(r["id"] for r in test.collect()) == list(range(80, 100))


def test_tail_splits_ties_by_value(spark):
    df = spark.range(1000).withColumn("t", F.lit(7))
    train, test = splits.holdout_tail(df, "t", ["id"], rows_per_bucket=80)
    assert (train.count(), test.count()) == (800, 200)
    assert sorted(r["id"] for r in test.collect()) == list(range(800, 1000))
    again = splits.holdout_tail(df.repartition(5), "t", ["id"])[1]
    assert sorted(r["id"] for r in again.collect()) == sorted(r["id"] for r in test.collect())


def test_tail_groups_and_batches(groups):
    pdf, df = groups
    train, test = splits.holdout_tail(df, "id", rows_per_bucket=90)
    assert sorted(r["id"] for r in test.collect()) == list(range(800, 1000)) and train.count() == 800
    got = mini_batches(df, 64, "id", rows_per_bucket=90).orderBy("id").toPandas()
    assert list(got.batch_id) == [i // 64 for i in range(1000)]
    assert pseudo_groups(df, "id").select("pseudo_group").distinct().count() == 10
    big = splits.min_group_size(df, "g", 50)
    assert set(r["g"] for r in big.collect()) == {"g0"}
