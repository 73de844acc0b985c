"""Fits on Spark against the kernel run on the same rows in order."""

import weakref

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ringfence.functions.kernel import fit, from_fields
from ringfence.operators.fit import _gathered, batch_stats, fit_by_key, fit_one, fit_steps, objective_trace, update_by_key
from ringfence.operators.merge import fit_merged
from ringfence.operators.sampling import median_sigma, sample
from ringfence.operators.score import boundary, score

FEATS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def keyed(spark):
    """One key holds most rows."""
    rng = np.random.default_rng(11)
    n = 4000
    pdf = pd.DataFrame(rng.normal(size=(n, 3)), columns=FEATS)
    pdf["k"] = np.where(rng.random(n) < 0.7, "hot", rng.choice(["x", "y"], n))
    pdf["t"] = rng.permutation(n)
    return pdf, spark.createDataFrame(pdf).repartition(6).cache()


def kernel_model(pdf, key, **kw):
    return fit(pdf[pdf.k == key].sort_values("t")[FEATS].to_numpy(), 1.3, **kw)[0]


def same(row, model):
    mine = from_fields(row)
    return np.array_equal(mine.sv, model.sv) and np.allclose(mine.alpha, model.alpha, atol=1e-9) and mine.seen == model.seen


@pytest.mark.parametrize("chunk_rows", [100_000, 400, 150])
def test_fit_by_key_equals_sequential_pass_for_any_chunk(keyed, chunk_rows):
    pdf, df = keyed
    got = fit_by_key(df, FEATS, ["k"], "t", sigma=1.3, chunk_rows=chunk_rows, rows_per_bucket=700).collect()
    assert sorted(r["k"] for r in got) == ["hot", "x", "y"]
    for r in got:
        assert same(r, kernel_model(pdf, r["k"]))


def test_fit_does_not_depend_on_partitions(keyed):
    _, df = keyed
    runs = []
    for p in (1, 3, 8):
        rows = fit_by_key(df.repartition(p), FEATS, ["k"], "t", sigma=1.3).orderBy("k").collect()
        runs.append([(r["k"], r["sv"], r["alpha"]) for r in rows])
    assert runs[0] == runs[1] == runs[2]


@pytest.mark.parametrize("chunk_rows", [100_000, 300])
def test_update_equals_one_longer_fit_and_keeps_idle_keys(keyed, chunk_rows):
    pdf, df = keyed
    first = fit_by_key(df.filter("t < 2000"), FEATS, ["k"], "t", sigma=1.3)
    later = df.filter("t >= 2000 and k != 'y'")
    got = update_by_key(first, later, FEATS, ["k"], "t", chunk_rows=chunk_rows, rows_per_bucket=500)
    for r in got.collect():
        part = pdf if r["k"] != "y" else pdf[pdf.t < 2000]
        assert same(r, kernel_model(part, r["k"]))


@pytest.mark.parametrize("chunk_rows", [200, 100])
def test_batches_of_passed_over_chunks_are_listed(keyed, chunk_rows):
    pdf, df = keyed
    _, steps = fit_steps(df, FEATS, ["k"], "t", sigma=1.3, batch_rows=100, chunk_rows=chunk_rows)
    _, whole = fit_steps(df, FEATS, ["k"], "t", sigma=1.3, batch_rows=100)
    order = ["k", "batch"]
    a, b = (batch_stats(s, ["k"]).toPandas().sort_values(order).reset_index(drop=True) for s in (steps, whole))
    assert a.equals(b)
    assert steps.agg({"processed": "sum"}).first()[0] == len(pdf)


def test_batches_and_trace(keyed):
    pdf, df = keyed
    _, steps = fit_steps(df, FEATS, ["k"], "t", sigma=1.3, batch_rows=100, trace=True)
    stats = batch_stats(steps, ["k"]).toPandas()
    for k, part in stats.groupby("k"):
        n = int((pdf.k == k).sum())
        assert list(part.sort_values("batch").batch) == list(range(-(-n // 100)))
        assert part.processed.sum() == n
        assert part.added.sum() - part.removed.sum() == part.sort_values("batch").n_sv.iloc[-1]
        assert part.n_sv.iloc[-1] == kernel_model(pdf, k).size
    trace = objective_trace(steps, ["k"]).toPandas()
    want = []
    kernel_model(pdf, "hot", trace=want)
    assert np.allclose(trace[trace.k == "hot"].sort_values("seq").radius, want)


def test_rows_with_missing_features_are_seen_but_not_learned(spark):
    pdf = pd.DataFrame({"t": range(5), "a": [None, 0.0, 0.5, np.nan, 1.0], "b": [1.0, 0.0, 0.1, 0.0, 1.0]})
    r = fit_one(spark.createDataFrame(pdf), ["a", "b"], "t", sigma=1.0).first()
    assert r["seen"] == 5 and not np.isnan(r["sv"]).any()


def test_score_paths_agree_and_zones(keyed, spark):
    pdf, df = keyed
    models = fit_by_key(df, FEATS, ["k"], "t", sigma=1.3)
    extra = spark.createDataFrame(
        pd.DataFrame({"a": [50.0, np.nan, 0.0], "b": 0.0, "c": 0.0, "k": ["hot", "hot", "new"], "t": [-1, -2, -3]})
    )
    rows = df.unionByName(extra)
    wide = score(rows, models, FEATS, ["k"], detail=True).orderBy("t").toPandas()
    joined = score(rows, models, FEATS, ["k"], detail=True, broadcast_bytes=0).orderBy("t").toPandas()
    assert len(wide) == len(pdf) + 3
    for c in ("score", "raw_score", "max_sim"):
        assert np.allclose(wide[c], joined[c], equal_nan=True)
    assert wide.zone.fillna("-").equals(joined.zone.fillna("-"))
    assert wide.zone.iloc[2] == "far" and wide.score.iloc[2] == -1.0 and wide.raw_score.iloc[2] > 0
    assert wide.score.iloc[:2].isna().all()
    assert (wide.zone == "duplicate").sum() == sum(kernel_model(pdf, k).size for k in ("hot", "x", "y"))
    flagged = score(rows, models, FEATS, ["k"], flag_far=True).filter("t = -1").first()["score"]
    assert flagged == pytest.approx(wide.raw_score.iloc[2])


@pytest.mark.parametrize("shape", ["gauss", "sorted_clusters", "heavy", "copies", "grid"])
def test_merged_fit_leaves_no_row_outside(spark, shape):
    rng = np.random.default_rng(4)
    n = 3000
    x = rng.normal(size=(n, 3))
    if shape == "sorted_clusters":
        x = x * 0.3 + np.repeat(rng.normal(size=(8, 3)) * 3, n // 8, axis=0)
    elif shape == "heavy":
        x = rng.standard_t(2.5, size=(n, 3))
    elif shape == "copies":
        x[: n // 3] = x[0]
    elif shape == "grid":
        x = np.round(x * 2) / 2
    pdf = pd.DataFrame(x, columns=FEATS)
    pdf["id"] = np.arange(n)
    df = spark.createDataFrame(pdf).repartition(4)
    runs = [fit_merged(df.repartition(p), FEATS, ["id"], 1.3, bucket_rows=400) for p in (1, 8)]
    m = boundary(runs[0])
    assert runs[0].first()["sv"] == runs[1].first()["sv"]
    assert (m.score(x) <= 1e-6).all() and m.seen == n
    assert m.alpha.min() >= 0 and m.alpha.sum() == pytest.approx(1.0)


def test_merged_fit_refuses_a_width_that_keeps_every_row(spark):
    x = np.random.default_rng(0).normal(size=(200, 3))
    x = 2 * x / np.linalg.norm(x, axis=1, keepdims=True)
    pdf = pd.DataFrame(x, columns=FEATS).assign(id=range(200))
    with pytest.raises(ValueError, match="sigma too small"):
        fit_merged(spark.createDataFrame(pdf), FEATS, ["id"], 0.7, bucket_rows=12)


def test_sigma_and_sample(keyed):
    pdf, df = keyed
    x = pdf[FEATS].to_numpy()
    few = sample(df, 500, ["t"]).toPandas()
    again = sample(df.repartition(3), 500, ["t"]).toPandas()
    assert sorted(few.t) == sorted(again.t) and few.t.is_unique and len(few) == 500
    got = median_sigma(df, FEATS, ["t"], n=10_000).first()
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    assert got["sigma"] == pytest.approx(np.median(d[d > 0]) / np.sqrt(2))


def _awkward(spark, n=900):
    """Tied order, a NULL key, missing features, many one-row keys."""
    rng = np.random.default_rng(8)
    rows = [(None if i % 3 else "a", int(rng.integers(0, 25)), i, *rng.normal(size=2).tolist()) for i in range(n)]
    rows += [("a", 3, n + 1, float("nan"), 0.0), ("a", None, n + 2, 0.1, 0.1), (None, 5, n + 3, None, 1.0)]
    rows += [(f"one{i}", 1, n + 10 + i, float(i), 0.0) for i in range(40)]
    return spark.createDataFrame(rows, "k string, t int, id long, x double, y double")


def _models(df):
    return {r["k"]: (r["n_sv"], r["seen"], round(r["radius"], 12), [round(a, 9) for a in r["alpha"]]) for r in df.collect()}


@pytest.mark.parametrize("seed", ["first", "central"])
def test_model_does_not_depend_on_size_parameters(spark, seed):
    df = _awkward(spark)
    whole = _models(fit_by_key(df, ["x", "y"], ["k"], "t", ["id"], 0.7, seed=seed))
    chunked = _models(fit_by_key(df, ["x", "y"], ["k"], "t", ["id"], 0.7, seed=seed, chunk_rows=37, rows_per_bucket=50))
    assert whole == chunked and None in whole and len(whole) == 42


def test_merged_fit_keeps_small_and_null_keys(spark):
    from ringfence.operators.merge import fit_merged

    small = spark.range(3000).select((F.col("id") + 10).cast("string").alias("k"), "id", F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    rng = np.random.default_rng(3)
    large = spark.createDataFrame([(None, i, *rng.normal(size=2).tolist()) for i in range(1200)], "k string, id long, x double, y double")
    got = {r["k"]: r for r in fit_merged(small.unionByName(large), ["x", "y"], ["id"], 1.0, ["k"], bucket_rows=1000).select("k", "n_sv", "seen").collect()}
    assert len(got) == 3001 and got[None]["seen"] == 1200 and got["10"]["n_sv"] == 1


def test_both_scoring_paths_agree(spark):
    df = _awkward(spark)
    models = fit_by_key(df, ["x", "y"], ["k"], "t", ["id"], 0.7)
    one, two = (score(df, models, ["x", "y"], ["k"], keep=["id"], timed=True, broadcast_bytes=b).orderBy("id").toPandas() for b in (1 << 26, 0))
    assert np.allclose(one.score, two.score, equal_nan=True) and one.score.isna().sum() == 2
    assert two.score_seconds.notna().all() and one.k.isna().sum() == two.k.isna().sum() > 0
    arrays = df.select("k", "t", "id", F.array("x", "y").alias("v")).unionByName(
        spark.createDataFrame([("a", 1, -1, None), ("a", 1, -2, [1.0]), ("a", 1, -3, [1.0, None])], "k string, t int, id long, v array<double>"))
    one, two = (score(arrays, models, "v", ["k"], keep=["id"], broadcast_bytes=b).orderBy("id").toPandas() for b in (1 << 26, 0))
    assert np.allclose(one.score, two.score, equal_nan=True) and one.score.isna().sum() == 5


def test_look_ahead_scans_few_chunks(spark, monkeypatch):
    """Rows of a settled key are scanned once in all, not once per learned chunk."""
    from ringfence.operators import fit as module

    rows = spark.range(4000).select(F.lit("a").alias("k"), "id", F.when(F.col("id") % 1000 < 3, F.col("id") / 500).otherwise(0.01 * F.sin("id")).alias("x"), F.lit(0.0).alias("y"))
    scanned, inner = [], module.score

    def counted(df, *args, **kw):
        scanned.append(df.count())
        return inner(df, *args, **kw)

    monkeypatch.setattr(module, "score", counted)
    got = fit_by_key(rows, ["x", "y"], ["k"], "id", (), 1.0, chunk_rows=100)
    learned = len(scanned)
    assert sum(scanned) < 4000 * 3 and learned > 3
    monkeypatch.setattr(module, "score", inner)
    assert _models(got) == _models(fit_by_key(rows, ["x", "y"], ["k"], "id", (), 1.0))


def test_one_model_over_a_table_of_many_ranges(keyed):
    """The single model groups by a constant key of its own; its rows are numbered in several ranges."""
    pdf, df = keyed
    got = fit_one(df, FEATS, "t", sigma=1.3, chunk_rows=400, rows_per_bucket=700).first()
    assert same(got, fit(pdf.sort_values("t")[FEATS].to_numpy(), 1.3)[0])


@pytest.mark.parametrize("features", [["x", "y"], "v"])
def test_batches_of_a_key_are_let_go(features):
    """A key's rows arrive batch by batch; only features and order are kept, and the order is that of the whole key."""
    draw, alive, order = np.random.default_rng(5), [], [("_head", "ascending"), ("_t_0", "ascending"), ("_t_1", "ascending")]
    t, tie, xy = draw.integers(0, 9, 400).astype(float), draw.permutation(400), draw.random((400, 2))
    t[::7] = np.nan

    def batch(at):
        x = xy[at:at + 100]
        made = pa.record_batch({
            "x": pa.array(x[:, 0]), "y": pa.array(x[:, 1]), "v": pa.array(x.tolist()), "_head": pa.array(np.ones(100, np.int32)),
            "_t_0": pa.array(t[at:at + 100], from_pandas=True), "_t_1": pa.array(tie[at:at + 100]), "w": pa.array(np.full(100, 0.7)),
        })
        alive.append(weakref.ref(made))
        return made

    def batches():
        for at in range(0, 400, 100):
            assert len([a for a in alive if a() is not None]) <= 1  # the one just read
            yield batch(at)

    got, width = _gathered(batches(), features, order, "w")
    want = np.lexsort((tie, np.where(np.isnan(t), -1, t)))
    assert width == 0.7 and (got == xy[want]).all()


@pytest.mark.parametrize("chunk_rows", [400, 150])
def test_trace_is_whole_and_the_same_in_any_chunks(keyed, chunk_rows):
    """A radius for every row, also of chunks that are passed over, numbered through the key as in one task."""
    pdf, df = keyed
    one, many = (
        objective_trace(fit_steps(df, FEATS, ["k"], "t", sigma=1.3, trace=True, chunk_rows=c, rows_per_bucket=700)[1], ["k"]).toPandas()
        for c in (100_000, chunk_rows)
    )
    one, many = (t.sort_values(["k", "seq"]).reset_index(drop=True) for t in (one, many))
    assert len(many) == len(pdf) - 3 and list(many.columns) == ["k", "chunk", "seq", "radius"]
    assert many[["k", "chunk", "seq"]].equals(one[["k", "chunk", "seq"]]) and (many.chunk == 0).all()
    assert np.allclose(many.radius, one.radius, atol=1e-9)


def test_missing_features_give_the_same_steps_in_any_chunks(spark):
    """A key whose first chunk has no whole row still gets its model; batches and trace count whole rows."""
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(900, 2)), columns=["a", "b"])
    pdf["k"], pdf["t"] = np.where(np.arange(900) < 600, "late", "plain"), np.arange(900)
    pdf.loc[:119, "a"] = np.nan
    pdf.loc[650:655, "b"] = np.inf
    df = spark.createDataFrame(pdf)
    found = []
    for chunk_rows in (10_000, 50):
        models, steps = fit_steps(df, ["a", "b"], ["k"], "t", sigma=1.0, batch_rows=25, trace=True, chunk_rows=chunk_rows)
        batches = batch_stats(steps, ["k"]).orderBy("k", "batch").collect()
        trace = objective_trace(steps, ["k"]).orderBy("k", "seq").toPandas()
        seen = models.orderBy("k").select("k", "seen", "n_sv").collect()
        found.append((batches, list(trace.k), list(trace.seq), seen, steps.groupBy("k").agg(F.sum("processed")).orderBy("k").collect(), trace.radius))
    assert found[0][:-1] == found[1][:-1] and np.allclose(found[0][-1], found[1][-1], atol=1e-9)
    assert [r["seen"] for r in found[0][3]] == [600, 300] and len(found[0][1]) == 479 + 293


@pytest.mark.parametrize("odd", [None, [1.0]])
def test_uneven_vectors_are_an_error_in_any_chunks(spark, odd):
    rows = [(i, [float(i % 5), 0.0]) for i in range(60)] + [(60, odd)]
    df = spark.createDataFrame(rows, "t long, v array<double>")
    for chunk_rows in (1000, 10):
        with pytest.raises(Exception, match="differ in length or are missing"):
            fit_one(df, "v", "t", sigma=1.0, chunk_rows=chunk_rows).collect()
