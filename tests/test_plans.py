"""Train, store, update, evaluate; sources and reports; cross-validation and baselines."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from ringfence.functions.kernel import fit, from_fields
from ringfence.operators import analysis, baselines, crossval
from ringfence.plans.evaluate import compare_baselines, comparison_report, evaluate
from ringfence.plans.train import load, train
from ringfence.plans.update import update, update_stored
from ringfence.sources import arrays, records, tables
from ringfence.sources.models import latest_version, load_header, load_models
from ringfence.spec import AnomalyRule, DatasetSpec, get_spec

SPEC = DatasetSpec("demo", ("a", "b", "c"), target="y", clip=("c",), log=("c",), invert=("c",), rule=AnomalyRule("lt", 0.0),
                   quantile=0.9, sigma_method="fixed", sigma=1.4)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(12)
    n = 1200
    pdf = pd.DataFrame(rng.normal(size=(n, 3)), columns=["a", "b", "c"])
    pdf["c"] = np.exp(pdf.c)
    bad = rng.random(n) < 0.15
    pdf.loc[bad, "a"] += rng.choice([-4, 4], bad.sum())
    pdf["y"] = np.where(bad, -1.0, 1.0)
    pdf["id"] = range(n)
    pdf["content"] = ["v%02d" % (i // 100) for i in range(n)]
    pdf["k"] = np.where(rng.random(n) < 0.5, "p", "q")
    return pdf, spark.createDataFrame(pdf).cache()


def by_hand(pdf, top=None):
    x = pdf[["a", "b", "c"]].copy()
    x["c"] = np.log1p(x.c.clip(lower=0))
    x["c"] = (x.c.max() if top is None else top) - x.c
    return x


def test_training_equals_the_plain_computation(data):
    pdf, df = data
    x = by_hand(pdf)
    z = ((x - x.mean()) / x.std(ddof=0)).to_numpy()
    want, _ = fit(z, 1.4)
    got = train(df, SPEC, "id", mode="single")
    mine = from_fields(got.models.first())
    assert np.allclose(mine.sv, want.sv) and np.allclose(mine.alpha, want.alpha, atol=1e-8)
    scores = want.score(z)
    assert got.taus.first()["tau"] == pytest.approx(np.quantile(scores, 0.9))
    out = got.score(df).orderBy("id").toPandas()
    assert np.allclose(out.score, scores) and out.is_anomaly.sum() == (scores > np.quantile(scores, 0.9)).sum()
    assert (scores == -1).sum() == want.size  # every support vector scores -1 on itself


def test_save_load_score_and_update(spark, data, tmp_path):
    pdf, df = data
    path = str(tmp_path / "m")
    for keys in ((), ("k",)):
        name = "demo" if not keys else "demo_k"
        spec = SPEC.with_(name=name)
        first = train(df.filter("id < 700"), spec, "id", keys=keys, mode="by_key" if keys else "single")
        first.save(path)
        again = load(spark, path, spec, keys=keys)
        one = first.score(df).orderBy("id").toPandas()
        two = again.score(df).orderBy("id").toPandas()
        assert np.array_equal(one.score, two.score) and np.array_equal(one.tau, two.tau)
        newer = update_stored(spark, path, spec, df.filter("id >= 700"), "id", keys=keys, source="later")
        assert latest_version(spark, path, name) == 2
        head = load_header(spark, path, name).first()
        assert (head["parent_version"], head["data_source"], head["new_rows"]) == (1, "later", 500)
        assert load_models(spark, path, name, keys=keys).agg(F.sum("seen")).first()[0] == 1200
        assert load_models(spark, path, name, 1, keys).agg(F.sum("seen")).first()[0] == 700
        three = load(spark, path, spec, keys=keys).score(df).orderBy("id").toPandas()
        assert np.array_equal(three.score, newer.score(df).orderBy("id").toPandas().score)


def test_threshold_scope_and_frozen_scaler(data):
    pdf, df = data
    first = train(df.filter("id < 700"), SPEC, "id", mode="single")
    new, old = df.filter("id >= 700"), df.filter("id < 700")
    a, b = update(first, new, "id"), update(first, new, "id", threshold_scope="all", earlier=old)
    assert a.scaler is first.scaler and a.models.first()["sv"] == b.models.first()["sv"]
    m = from_fields(a.models.first())
    mean, scale = (np.array([d[c] for c in "abc"]) for d in (first.scaler.mean, first.scaler.scale))
    z = lambda part: (by_hand(part).to_numpy() - mean) / scale
    s_new, s_old = m.score(z(pdf[700:])), m.score(z(pdf[:700]))
    assert a.taus.first()["tau"] == pytest.approx(np.quantile(s_new, 0.9))
    assert b.taus.first()["tau"] == pytest.approx(np.quantile(np.concatenate([s_new, s_old]), 0.9))
    with pytest.raises(ValueError):
        update(first, new, "id", threshold_scope="all")


def test_median_width_and_unknown_settings(data):
    pdf, df = data
    got = train(df, SPEC.with_(sigma_method="median_heuristic", sigma=None), "id", mode="merge")
    x = by_hand(pdf)
    z = ((x - x.mean()) / x.std(ddof=0)).to_numpy()
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))
    assert got.sigma == pytest.approx(np.median(d[d > 0]) / np.sqrt(2))
    assert (from_fields(got.models.first()).score(z) <= 1e-6).all()
    with pytest.raises(ValueError, match="Unknown sigma method"):
        train(df, SPEC.with_(sigma_method="guess"), "id")
    with pytest.raises(ValueError, match="Unknown mode"):
        train(df, SPEC, "id", mode="other")


def test_evaluation_record(data):
    pdf, df = data
    det = train(df.filter("y > 0"), SPEC, "id", mode="single")
    r = evaluate(det, df, "id").first()
    assert r["test_samples"] == 300 and r["dataset"] == "demo" and 0.8 < r["auc"] <= 1
    assert 0 < r["flag_rate"] < 100 and r["num_sv"] == det.models.first()["n_sv"]
    tail = evaluate(det, df.drop("content"), "id").first()
    assert tail["test_samples"] == 240
    blind = evaluate(det, df.drop("y"), "id").first()
    assert blind["auc"] is None and blind["flag_rate"] == pytest.approx(r["flag_rate"])


def test_baselines_find_planted_rows(data):
    _, df = data
    det = train(df.filter("y > 0"), SPEC, "id", mode="merge")
    table = compare_baselines(det, df, df, ["id"], normal_training=True)
    got = {r["Model"]: r["AUC"] for r in table.collect()}
    assert set(got) == {"Isolation Forest", "One-Class SVM (Linear)", "SVDD (RBF Kernel)", "Incremental SVDD"}
    assert got["Isolation Forest"] > 0.85 and got["SVDD (RBF Kernel)"] > 0.85 and got["Incremental SVDD"] > 0.85
    none = compare_baselines(det, df, df.filter("y > 0"), ["id"])
    assert none is None
    report = comparison_report({"demo": table, "flat": none, "more": table.withColumn("Dataset", F.lit("a"))}).collect()
    assert [r["Dataset"] for r in report] == ["a"] * 4 + ["demo"] * 4
    assert report[0]["AUC"] == max(got.values())


def test_forest_does_not_depend_on_partitions(data):
    _, df = data
    runs = [baselines.fit_forest(df.repartition(p), ["a", "b"], ["id"], 20, 64).orderBy("tree").collect() for p in (1, 6)]
    assert runs[0] == runs[1] and len(runs[0]) == 20
    small = baselines.fit_forest(df.limit(50), ["a", "b"], ["id"], 10, 64)
    assert small.first()["rows"] == 50


def test_plane_leaves_the_wanted_share_outside(data):
    _, df = data
    plane = baselines.fit_rbf_svm(df, ["a", "b", "c"], nu=0.2)
    share = plane.score(df).agg(F.avg((F.col("score") > 0).cast("double"))).first()[0]
    assert share == pytest.approx(0.2, abs=0.03)


def _lowest_share(margins, nu):
    """Mean of the nu * n lowest margins, the last row in part."""
    m, want = np.sort(margins), nu * len(margins)
    whole = int(want)
    return (m[:whole].sum() + (want - whole) * (m[whole] if whole < len(m) else 0.0)) / want


@pytest.mark.parametrize("shift, nu", [(3.0, 0.1), (1.0, 0.3), (0.35, 0.8), (2.0, 1.0)])
def test_plane_is_certified(spark, shift, nu):
    """Nearly centred rows too: the normal is a mean of the hull, and no mean of the hull is much shorter."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 4)) * [1.0, 0.5, 2.0, 1.0] + shift
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double, d double")
    plane = baselines.fit_linear_svm(df, list("abcd"), nu, tolerance=1e-4)
    w, proof = plane.w, plane.proof
    assert proof.converged and not proof.vanishing and proof.steps < 60
    exact = float(w @ w) - _lowest_share(x @ w, nu)
    assert -1e-9 <= exact <= proof.gap + 1e-9 and proof.gap <= 1e-4 * (w @ w)
    for u in rng.normal(size=(200, 4)):
        assert w @ u >= _lowest_share(x @ u, nu) - 1e-9
    outside = plane.score(df).filter("score > 0").count()
    assert abs(outside - nu * 3000) <= 30


@pytest.mark.parametrize("spread, shift", [(1.0, 0.0), (30.0, 5.0), (1e5, -3.0), (1e300, 0.0)])
def test_bounds_of_margins_hold_and_are_close(spread, shift):
    """Rows told apart in single precision are never told wrongly, however long they are."""
    rng = np.random.default_rng(7)
    x, w = rng.normal(size=(5000, 4)) * spread + shift, rng.normal(size=64)
    lift = baselines._Fourier(4, 64, 0.25, 1)
    margin, floor = lift(x) @ w, lift.floor(x, w)
    assert not (floor > margin).any()
    if spread < 100:
        assert (margin - floor).max() < 1e-4 * spread * np.abs(w).sum()


def test_pass_lifts_only_rows_below_its_last_edge(spark):
    rng = np.random.default_rng(8)
    x, w = rng.normal(size=(4000, 3)), rng.normal(size=32)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").coalesce(1)
    lift = baselines._Fourier(3, 32, 0.5, 2)
    z = lift(x)
    margin = z @ w
    edges = np.quantile(margin, [0.0, 0.05, 0.1, 0.2])
    at = np.searchsorted(edges, margin)
    for last in (False, True):
        got = baselines._pass(df, list("abc"), w, edges, lift, last)
        assert list(got[:, 32]) == list(np.bincount(at, minlength=5))
        for i in range(5 if last else 4):
            mine = at == i
            assert np.allclose(got[i, :32], z[mine].sum(axis=0))
            assert np.allclose(got[i, 33:], [margin[mine].min(), margin[mine].max()])
    # rows past the last edge leave no sum behind: they were never lifted
    few = baselines._pass(df, list("abc"), w, edges, lift)
    assert not np.allclose(few[4, :32], z[at == 4].sum(axis=0))


def test_plane_through_a_centred_cloud_says_so(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([tuple(map(float, r)) for r in rng.normal(size=(2000, 2))], "a double, b double")
    proof = baselines.fit_linear_svm(df, ["a", "b"], 0.9).proof
    assert proof.vanishing and proof.length_sq <= 1e-6 * proof.scale
    short = baselines.fit_linear_svm(df.withColumn("a", F.col("a") + 9), ["a", "b"], 0.05, steps=2, tolerance=1e-12).proof
    assert not short.converged and short.steps == 2 and short.gap > 0


def test_plane_of_equal_and_missing_rows(spark):
    df = spark.createDataFrame([(2.0, 1.0)] * 50 + [(None, 1.0)], "a double, b double")
    plane = baselines.fit_linear_svm(df, ["a", "b"], 0.2)
    assert np.allclose(plane.w, [2, 1]) and plane.proof.converged
    assert plane.score(df).filter("score > 1e-9").count() == 0
    with pytest.raises(ValueError, match="no rows"):
        baselines.fit_linear_svm(df.filter("a is null"), ["a", "b"])


def test_pca_is_centred(data):
    pdf, df = data
    means, parts = baselines.fit_pca(df, ["a", "b", "c"])
    got = baselines.project_pca(df, ["a", "b", "c"], means, parts).orderBy("id").toPandas()
    x = pdf[["a", "b", "c"]].to_numpy()
    _, _, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    want = (x - x.mean(0)) @ v[0]
    assert np.allclose(np.abs(got.pc1), np.abs(want)) and abs(got.pc1.mean()) < 1e-9


def test_cross_validation_equals_fold_by_fold(data):
    pdf, df = data
    base = df.withColumn("label", F.when(F.col("y") < 0, 1).otherwise(0))
    folds, tested = crossval.cross_validate(base, ["a", "b", "c"], "content", "label", "id", 1.4, 0.9)
    got, rows = folds.toPandas().sort_values("fold"), tested.toPandas().sort_values("id")
    assert len(got) == 5 and len(rows) == len(pdf)
    of = rows.set_index("id").cv
    for r in got.itertuples():
        inside = of.reindex(pdf.id).to_numpy() == r.fold - 1
        x = pdf[["a", "b", "c"]].to_numpy()
        tr = x[~inside & (pdf.y > 0)]
        m, _ = fit(tr, 1.4)
        assert r.n_train == len(tr) and r.n_test == inside.sum()
        assert r.tau == pytest.approx(np.quantile(m.score(tr), 0.9))
        assert np.allclose(rows[rows.cv == r.fold - 1].score, m.score(x[inside]))
        assert r.t_train_s > 0 and r.t_score_s > 0
    assert crossval.fold_summary(folds).count() == 6
    grid = crossval.grid_search(base, ["a", "b", "c"], "content", "label", "id", [0.7, 1.4], [0.8, 0.9], folds=3)
    best = crossval.best_setting(grid).first()
    assert grid.count() == 4 and best["AUC"] == max(r["AUC"] for r in grid.collect())


# -- sources and reports -------------------------------------------------------------


def test_csv_by_header_name_and_missing_file(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("content,QoE_win,vmaf_mean,extra\nv1,0.5,90.1,7\nv2,oops,80,8\n")
    got = tables.read(spark, str(p), get_spec("LIVE_NFLX_II"), strict=False).collect()
    assert [(r["vmaf_mean"], r["QoE_win"], r["content"]) for r in got] == [(90.1, 0.5, "v1"), (80.0, None, "v2")]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read(spark, str(tmp_path / "no.csv"), get_spec("LIVE_NFLX_II"))
    both = tables.read_present(spark, {"one": str(p), "two": str(tmp_path / "no.csv")}, get_spec("LIVE_NFLX_II"), strict=False)
    assert both.select("dataset").distinct().collect()[0][0] == "one" and both.count() == 2
    assert tables.read_present(spark, {"two": str(tmp_path / "no.csv")}) is None
    with pytest.raises(ValueError, match="schema"):
        tables.read(spark, str(p))


def test_csv_columns_follow_each_header(spark, tmp_path):
    (tmp_path / "t.csv").mkdir()
    (tmp_path / "t.csv" / "a.csv").write_text("x,y,n\n1,2,a\n3,4,b\n")
    (tmp_path / "t.csv" / "b.csv").write_text('y,"x"\n6,5\n')
    got = tables.read(spark, str(tmp_path / "t.csv"), T.StructType.fromDDL("x double, y double, n string")).collect()
    assert sorted(map(tuple, got), key=str) == [(1.0, 2.0, "a"), (3.0, 4.0, "b"), (5.0, 6.0, None)]
    with pytest.raises(ValueError, match="no column z"):
        tables.read(spark, str(tmp_path / "t.csv"), T.StructType.fromDDL("x double, z double"))
    (tmp_path / "t.csv" / "b.csv").write_text("y,x\nsix,5\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tables.read(spark, str(tmp_path / "t.csv"), T.StructType.fromDDL("x double, y double")).collect()


def test_shared_folder_is_needed_off_one_machine(spark, monkeypatch):
    from ringfence import session

    class Elsewhere:
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("Context", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Elsewhere)


def test_null_key_survives_save_update_and_flags(spark, tmp_path):
    from ringfence.operators.threshold import flagged, threshold
    from ringfence.session import key_join

    left = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, v int")
    right = spark.createDataFrame([(None, 10), ("a", 20), ("c", 30)], "k string, w int")
    assert sorted(map(tuple, key_join(left, right, "k").collect()), key=str) == [("a", 2, 20), (None, 1, 10)]
    assert sorted(map(tuple, key_join(left, right, ["k"], "full").collect()), key=str) == [("a", 2, 20), ("b", 3, None), ("c", None, 30), (None, 1, 10)]
    scored = spark.range(200).select(F.when(F.col("id") % 2 == 0, "a").alias("k"), F.col("id").cast("double").alias("score"))
    out = flagged(scored, threshold(scored, 0.9, ["k"]), ["k"]).groupBy("k").agg(F.sum("is_anomaly").alias("n"), F.count("tau").alias("t")).collect()
    assert {r.k: (r.n, r.t) for r in out} == {"a": (10, 100), None: (10, 100)}


def test_flatten_cuts_to_the_shortest_and_drops_incomplete(spark):
    df = spark.createDataFrame([("f1.mat", [1.0, 2.0, 3.0], [4.0, 5.0]), ("f2.mat", [1.0], None), ("f3.mat", [], [1.0])],
                               "file string, a array<double>, b array<double>")
    got = arrays.flatten(df, ["a", "b"], ["file"]).orderBy("pos").collect()
    assert [tuple(r) for r in got] == [("f1.mat", 0, 1.0, 4.0), ("f1.mat", 1, 2.0, 5.0)]
    with pytest.raises(ValueError, match="Missing columns: z"):
        arrays.flatten(df, ["a", "z"])
    nested = spark.createDataFrame([([[1.0, 2.0]],)], "a array<array<double>>")
    assert arrays.unwrap_matrix(nested, ["a"]).first()["a"] == [1.0, 2.0]


def test_records_skip_missing_and_corrupt(spark, tmp_path):
    path = str(tmp_path / "r")
    rec = spark.createDataFrame([("A", 10, 0.1, 20.0, 5, 0.7, 0.6, 0.5, 0.4, 0.3)], records.METRIC_SCHEMA)
    records.write_records(rec.unionByName(rec.withColumn("dataset", F.lit("B"))), path)
    (tmp_path / "r" / "_part=C").mkdir()
    (tmp_path / "r" / "_part=C" / "x.json").write_text("{broken\n")
    got = records.read_records(spark, path, ["A", "B", "C", "D"])
    assert sorted(r["dataset"] for r in got.collect()) == ["A", "B"]
    assert records.read_records(spark, str(tmp_path / "none")).count() == 0
    table, summary = records.write_report(got.withColumn("auc", F.when(F.col("dataset") == "A", F.col("auc"))), str(tmp_path / "out"))
    text = spark.read.option("header", True).csv(str(tmp_path / "out" / "comparison")).orderBy("Dataset").collect()
    assert text[1]["AUC"] == "N/A" and text[0]["AUC"] == "0.7" and text[0]["Train Samples"] == "N/A"
    auc = summary.filter("metric = 'AUC'").first()
    assert auc["mean"] == pytest.approx(0.7) and auc["std"] is None


def test_correlations_with_gaps_and_constants(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(rng.normal(size=(300, 3)) + 1000, columns=list("abc"))
    pdf["b"] += 0.8 * pdf.a
    pdf.loc[::7, "a"] = np.nan
    pdf["flat"] = 0.1
    got = analysis.correlations(spark.createDataFrame(pdf).repartition(5), list(pdf.columns)).collect()
    want = pdf.corr()
    assert len(got) == 16
    for r in got:
        w = want.loc[r["feature_a"], r["feature_b"]]
        assert r["r"] is None if "flat" in (r["feature_a"], r["feature_b"]) else r["r"] == pytest.approx(w)


def test_diagnosis_and_screen(spark):
    pdf = pd.DataFrame({"y": np.arange(90.0)})
    pdf["up"], pdf["down"] = pdf.y * 2, -pdf.y
    pdf["near"] = pdf.y + np.random.default_rng(0).normal(size=90) * 12
    pdf["noise"] = np.random.default_rng(1).normal(size=90)
    df = spark.createDataFrame(pdf)
    d = analysis.diagnosis(df, ["up", "down", "noise"], "y", AnomalyRule("lt", 50.0)).first()
    assert d["strong_negative"] and d["min_feature"] == "down" and d["few_good_rows"] and not d["weak_correlations"]
    kept = {r["feature"]: r["reason"] for r in analysis.feature_screen(df, ["up", "down", "near", "noise"], "y").collect()}
    assert kept["noise"] == "weak" and sorted(kept.values()).count("ok") == 1


def test_latency_pivot_and_summary(spark):
    df = spark.createDataFrame([("d", "m", 0.001 * i) for i in range(1, 101)], "d string, m string, s double")
    r = analysis.latency_summary(df, ["d", "m"], "s").first()
    assert r["mean_ms"] == pytest.approx(50.5) and r["p99_ms"] == pytest.approx(np.percentile(np.arange(1, 101), 99))
    assert r["rows_per_s"] == pytest.approx(100 / 5.05)
    cells = spark.createDataFrame([("A", "x", 0.5), ("A", "y", 0.6), ("B", "x", 0.7)], "d string, m string, v double")
    p = analysis.pivot_metric(cells, "d", "m", ["x", "y"], "v").orderBy("d").collect()
    assert [tuple(r) for r in p] == [("A", 0.5, 0.6), ("B", 0.7, None)]
    s = analysis.summary_stats(spark.createDataFrame([("1.0",), ("N/A",), ("3.0",)], "AUC string"), ["AUC"]).first()
    assert (s["mean"], s["min"], s["max"]) == (2.0, 1.0, 3.0) and s["std"] == pytest.approx(np.sqrt(2))


def test_key_sets(spark):
    same = spark.createDataFrame([(["b", "a"],), (["a", "b"],)], "k array<string>")
    assert analysis.consistent(same, F.col("k")).first()["consistent"] == 1
    odd = same.unionByName(spark.createDataFrame([(["a"],)], "k array<string>"))
    assert analysis.consistent(odd, F.col("k")).first()["consistent"] == 0


def test_passes_read_packed_rows(spark, monkeypatch):
    """A pass over packed rows gives the bits of one over the rows; a fit makes its passes over them."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 3))
    df = spark.createDataFrame([tuple(r) for r in x.tolist()], "a double, b double, c double").coalesce(1)
    packed = baselines._packed(df, list("abc"))
    assert packed.columns == ["_rows"] and packed.agg(F.sum(F.length("_rows"))).first()[0] == 8 * x.size
    for lift, d in ((baselines._Identity(), 3), (baselines._Fourier(3, 16, 0.5, 1), 16)):
        w = rng.normal(size=d)
        edges = np.quantile(lift(x) @ w, [0.1, 0.4])
        one, many = (baselines._pass(rows, list("abc"), w, edges, lift, True) for rows in (df, packed))
        assert np.array_equal(one, many) and many[:, d].sum() == 3000
    assert baselines._pass(baselines._packed(df.limit(0), list("abc")), list("abc"), w, edges, lift)[:, 16].sum() == 0
    seen, whole = [], baselines._pass
    monkeypatch.setattr(baselines, "_pass", lambda rows, *a: seen.append(rows.columns) or whole(rows, *a))
    baselines.fit_linear_svm(df, list("abc"))
    assert seen and all(c == ["_rows"] for c in seen)
