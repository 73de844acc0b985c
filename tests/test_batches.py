"""Training in batches: checkpoints, resuming, history; the forest's decision."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ringfence.functions.kernel import Boundary
from ringfence.operators.baselines import fit_forest, flag_forest, score_forest
from ringfence.plans import batches
from ringfence.plans.batches import train_batches, training_history
from ringfence.plans.train import load, train
from ringfence.sources.models import headers
from ringfence.spec import AnomalyRule, DatasetSpec

SPEC = DatasetSpec("b", ("x", "y"), rule=AnomalyRule(), quantile=0.9, sigma_method="fixed", sigma=1.0,
                   initial_batch=40, incremental_batch=50, checkpoint_every=2, checkpoints=True)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(300, 2)), columns=["x", "y"])
    pdf["k"], pdf["t"] = np.where(np.arange(300) % 5 < 4, "long", "short"), rng.permutation(300)
    return spark.createDataFrame(pdf)


def model_bits(models):
    return {r["k"]: tuple(np.array(r[c]).tobytes() for c in ("sv", "alpha", "inverse", "radius", "seen")) for r in models.collect()}


def test_resumed_training_gives_the_same_bits(spark, tmp_path, rows):
    whole = train_batches(rows, SPEC, str(tmp_path / "a"), "t", keys=["k"])
    path, calls = str(tmp_path / "b"), 0
    while (got := train_batches(rows, SPEC, path, "t", keys=["k"], legs=2)) is None:
        calls += 1
    assert calls == 1 and model_bits(got.models) == model_bits(whole.models)
    again = train_batches(rows.limit(0), SPEC, path, "t", keys=["k"])  # finished: rows are not looked at
    assert model_bits(again.models) == model_bits(whole.models)
    assert {r["k"]: r["tau"] for r in got.taus.collect()} == {r["k"]: r["tau"] for r in again.taus.collect()}
    # and equal to the single pass
    want = train(rows, SPEC, "t", keys=["k"], mode="by_key")
    mine, plain = ({r["k"]: r for r in d.models.collect()} for d in (got, want))
    for k in ("long", "short"):
        assert mine[k]["n_sv"] == plain[k]["n_sv"] and np.allclose(mine[k]["alpha"], plain[k]["alpha"]) and np.allclose(mine[k]["sv"], plain[k]["sv"])
    assert {r["k"]: r["tau"] for r in got.taus.collect()} == pytest.approx({r["k"]: r["tau"] for r in want.taus.collect()})
    heads = headers(spark, path, "b").filter("k = 'long'").orderBy("version").collect()
    # batches 0 to 4 of 240 rows: after batch 0, 1, 3 and the last; then the finished one
    assert [h["version"] for h in heads] == list(range(5)) and [h["seen"] for h in heads] == [40, 90, 190, 240, 240]
    assert all(h["parent_version"] == (h["version"] - 1 if h["version"] else None) for h in heads)


def test_history(spark, tmp_path, rows):
    """Every batch, and the radius after every row, as when the same rows come one after the other."""
    one = rows.filter("k = 'short'").drop("k").unionByName(rows.filter("k = 'long' and t % 5 = 0").drop("k"))
    spec, n = SPEC.with_(checkpoints=False), one.count()
    assert train_batches(one, spec, str(tmp_path), "t", legs=1) is None
    got = train_batches(one, spec, str(tmp_path), "t")
    batches, trace = (t.toPandas() for t in training_history(spark, str(tmp_path), spec))
    batches = batches.sort_values("batch")
    assert list(batches.processed) == [40, 50, n - 90] and list(batches.batch) == [0, 1, 2]
    assert (batches.added - batches.removed).sum() == batches.n_sv.iloc[-1] == got.models.first()["n_sv"]
    pdf = one.orderBy("t").toPandas()
    x = np.column_stack([(pdf[c] - got.scaler.mean[c]) / got.scaler.scale[c] for c in ("x", "y")])
    model = Boundary.start(x[0], 1.0)
    model.learn(x[1:], [])
    assert trace.sort_values(["leg", "chunk", "seq"]).radius.iloc[-1] == pytest.approx(model.radius)
    heads = headers(spark, str(tmp_path), "b").orderBy("version").collect()
    assert [h["seen"] for h in heads] == [40, n, n]
    assert load(spark, str(tmp_path), spec).scaler == got.scaler


def test_forest_flags_a_tenth(spark, rows):
    forest = fit_forest(rows, ["x", "y"], ["t"])
    scored = score_forest(rows, forest, ["x", "y"])
    out = flag_forest(scored, scored).toPandas()
    assert out.is_anomaly.sum() == (out.score > np.quantile(out.score, 0.9)).sum() == 30
    new = score_forest(spark.createDataFrame([(9.0, 9.0), (0.0, 0.0)], "x double, y double"), forest, ["x", "y"])
    assert [r["is_anomaly"] for r in flag_forest(new, scored).orderBy("x").collect()] == [0, 1]


def test_jobs_do_not_grow_with_the_checkpoints(spark, tmp_path, rows, monkeypatch):
    """Legs learned together leave the versions, batches and trace of legs learned one by one."""
    spec = SPEC.with_(incremental_batch=10, checkpoint_every=1)
    calls = []
    whole = batches.fit_steps
    monkeypatch.setattr(batches, "fit_steps", lambda *a, **k: calls.append(1) or whole(*a, **k))
    # 240 rows of the long key: 40 in batch 0, then 20 batches, each a leg of its own
    together = train_batches(rows, spec, str(tmp_path / "a"), "t", keys=["k"])
    assert len(calls) == 1
    monkeypatch.setattr(batches, "LEGS_PER_JOB", 1)
    alone = train_batches(rows, spec, str(tmp_path / "b"), "t", keys=["k"])
    assert len(calls) > 20 and model_bits(together.models) == model_bits(alone.models)
    for a, b in zip(training_history(spark, str(tmp_path / "a"), spec), training_history(spark, str(tmp_path / "b"), spec)):
        assert sorted(a.columns) == sorted(b.columns)
        assert sorted(map(repr, a.select(sorted(a.columns)).collect())) == sorted(map(repr, b.select(sorted(b.columns)).collect()))
    for number in (1, 7, 21):
        a, b = (load(spark, str(tmp_path / d), spec, number, ["k"]) for d in "ab")
        assert model_bits(a.models) == model_bits(b.models)
    a, b = (sorted(map(repr, headers(spark, str(tmp_path / d), "b").drop("tau").collect())) for d in "ab")
    assert a == b
