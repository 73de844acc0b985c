"""Streams against their batch replay, late events, restarts, model versions."""

import datetime as dt
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ringfence.functions.kernel import fit, from_fields
from ringfence.operators.analysis import latency_summary
from ringfence.operators.windows import window_features as batch_features
from ringfence.plans.train import load, train
from ringfence.plans.update import update
from ringfence.sources.models import headers, load_models
from ringfence.spec import AnomalyRule, DatasetSpec
from ringfence.streaming.adaptive import Online, Ring, adapt_stream, control_rows, status
from ringfence.streaming.progress import ProgressLog
from ringfence.streaming.score import score_stream
from ringfence.streaming.sources import file_events, run_available, with_end
from ringfence.streaming.update import learn_batches
from ringfence.streaming.windows import window_features, windowed

SPEC = DatasetSpec("s", ("a", "b"), rule=AnomalyRule(), quantile=0.9, sigma_method="fixed", sigma=1.0,
                   refit_every=5, min_refit=3, buffer_max=8, refit_sample=5)


@pytest.fixture(scope="module", autouse=True)
def state_store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(6)
    n = 400
    pdf = pd.DataFrame(rng.normal(size=(n, 2)), columns=["a", "b"])
    pdf["k"] = np.where(rng.random(n) < 0.7, "hot", "x")
    pdf["t"] = np.arange(n)
    pdf.loc[[50, 300], "a"] = [4.0, np.nan]
    pdf.loc[120, ["a", "b"]] = 40.0
    return pdf


@pytest.fixture(scope="module")
def detector(spark, rows):
    base = pd.DataFrame(np.random.default_rng(1).normal(size=(300, 2)), columns=["a", "b"]).assign(t=range(300))
    return train(spark.createDataFrame(base), SPEC, "t", mode="single")


def stream_of(spark, tmp_path, parts, schema="a double, b double, k string, t long"):
    src = str(tmp_path / "in")
    for i, p in enumerate(parts):
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(src)
    return file_events(spark, src, spark.read.parquet(src).schema, files_per_trigger=1)


def replay(detector, rows, **options):
    base = from_fields(detector.models.first())
    tau = detector.taus.first()["tau"]
    out = {}
    for k, part in rows.groupby("k"):
        online = Online(base.copy(), tau, Ring(SPEC.buffer_max), 0, SPEC, **options)
        for r in part.sort_values("t").itertuples():
            x = [(v - detector.scaler.mean[c]) / detector.scaler.scale[c] for c, v in (("a", r.a), ("b", r.b))]
            out[r.t] = online.step(np.array(x))
    return out


@pytest.mark.parametrize("options", [{}, {"skip_override": True}])
def test_adaptive_stream_equals_replay(spark, tmp_path, rows, detector, options):
    parts = [rows[:150].sample(frac=1, random_state=0), rows[150:]]
    # one micro-batch per file, in the order written
    src = str(tmp_path / "in")
    ck, out_path = str(tmp_path / "ck"), str(tmp_path / "out")
    schema = "a double, b double, k string, t long"
    got = None
    for p in parts:  # a restart from the checkpoint in between
        spark.createDataFrame(p[["a", "b", "k", "t"]], schema).coalesce(1).write.mode("append").parquet(src)
        stream = file_events(spark, src, spark.read.parquet(src).schema)
        got = run_available(adapt_stream(stream, detector, ["k"], ["t"], **options), ck, out_path)
    table = got.toPandas().set_index("t").sort_index()
    want = replay(detector, rows, **options)
    assert len(table) == len(rows) == len(want)
    names = ["score", "is_anomaly", "threshold_used", "threshold_after", "buffer_size", "n_sv", "since_refit", "refitted"]
    for t, w in want.items():
        mine = [None if pd.isna(v) else v for v in table.loc[t, names]]
        assert mine[0] == (None if w[0] is None else pytest.approx(w[0], abs=1e-9))
        assert mine[1:] == pytest.approx(list(w[1:]), abs=1e-9)
    assert table.refitted.sum() > 2
    assert table.loc[300, "is_anomaly"] == 0 and pd.isna(table.loc[300, "score"])
    assert table.loc[120, "score"] == -1.0 and table.loc[120, "is_anomaly"] == 0
    last = status(got, ["k"], ["t"]).toPandas().set_index("k")
    assert 3 < last.loc["hot", "buffer_size"] <= 8 and (last.seen_since_refit < 5).all()


@pytest.mark.parametrize("reads", [1, 1000])
def test_backlog_equals_replay(spark, tmp_path, rows, detector, reads):
    """Files larger than a read, a bound of one file for each micro-batch, a ring that fills and is refitted across them."""
    parts = [rows.iloc[a:a + 130][["a", "b", "k", "t"]].sample(frac=1, random_state=a) for a in range(0, len(rows), 130)]
    src = str(tmp_path / "in")
    for i, p in enumerate(parts):
        spark.createDataFrame(p, "a double, b double, k string, t long").coalesce(1).write.parquet(f"{src}/p{i}")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", reads)
    try:
        out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
        for i in range(len(parts)):
            stream = file_events(spark, f"{src}/p[0-{i}]", spark.read.parquet(f"{src}/p0").schema, files_per_trigger=1)
            got = run_available(adapt_stream(stream, detector, ["k"], ["t"]), ck, out)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    table, want = got.toPandas().set_index("t").sort_index(), replay(detector, rows)
    assert list(table.buffer_size) == [want[t][4] for t in table.index] and list(table.refitted) == [want[t][7] for t in table.index]
    assert np.allclose(table.threshold_after, [want[t][3] for t in table.index]) and table.buffer_size.max() == 8


def test_reload_while_running(spark, tmp_path, rows, detector):
    """Model rows in the stream take effect at their place, for their key, and empty its buffer."""
    base = rows.dropna()
    keyed = train(spark.createDataFrame(base[base.t < 150]), SPEC, "t", keys=["k"], mode="by_key")
    other = train(spark.createDataFrame(base[base.t >= 150]), SPEC, "t", keys=["k"], mode="by_key")
    later = rows[rows.t >= 200][["a", "b", "k", "t"]]
    control = str(tmp_path / "control")
    control_rows(other, ["k"], {"t": 260}).filter("k = 'hot'").coalesce(1).write.parquet(control)
    models = file_events(spark, control, spark.read.parquet(control).schema)
    got = run_available(adapt_stream(stream_of(spark, tmp_path, [later]), keyed, ["k"], ["t"], control=models)).toPandas().set_index("t").sort_index()
    assert len(got) == len(later)

    def start(d, k):
        return from_fields(d.models.filter(F.col("k") == k).first()), d.taus.filter(F.col("k") == k).first()["tau"]

    scaled = {c: (later[c] - keyed.scaler.mean[c]) / keyed.scaler.scale[c] for c in ("a", "b")}
    for k in ("hot", "x"):
        model, tau = start(keyed, k)
        online, fresh = Online(model.copy(), tau, Ring(8), 0, SPEC), k == "x"
        for i in later.index[later.k == k]:
            t = later.t[i]
            if t >= 260 and not fresh:
                model, tau = start(other, k)
                online, fresh = Online(model.copy(), tau, Ring(8), 0, SPEC), True
            w = online.step(np.array([scaled["a"][i], scaled["b"][i]]))
            assert got.loc[t, "threshold_after"] == pytest.approx(w[3]) and got.loc[t, "buffer_size"] == w[4], (k, t)


def test_new_key_starts_with_its_model_row(spark, tmp_path, rows, detector):
    keyed = train(spark.createDataFrame(rows.dropna()), SPEC, "t", keys=["k"], mode="by_key")
    later = rows[:20].assign(k="late")[["a", "b", "k", "t"]]
    control = str(tmp_path / "control")
    control_rows(keyed, ["k"], {"t": 10}).filter("k = 'hot'").withColumn("k", F.lit("late")).coalesce(1).write.parquet(control)
    models = file_events(spark, control, spark.read.parquet(control).schema)
    got = run_available(adapt_stream(stream_of(spark, tmp_path, [later]), keyed, ["k"], ["t"], control=models)).toPandas().set_index("t").sort_index()
    assert got.score[:10].isna().all() and got.score[10:].notna().all()


def test_idle_keys_start_anew(spark, tmp_path, rows, detector):
    src, ck, out = (str(tmp_path / x) for x in ("in", "ck", "out"))
    schema = "a double, b double, k string, t long"
    calm = rows[(rows.k == "x")].dropna()[["a", "b", "k", "t"]]

    def add(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)

    def until(n):
        for _ in range(120):
            time.sleep(0.5)
            try:
                done = spark.read.parquet(out)
                if done.count() >= n:
                    return done
            except Exception:  # noqa: BLE001  nothing written yet
                pass
        raise AssertionError(f"{n} rows never came")

    add(calm[:6])
    stream = file_events(spark, src, spark.read.parquet(src).schema)
    writer = adapt_stream(stream, detector, ["k"], ["t"], idle_seconds=3).writeStream.format("parquet").option("checkpointLocation", ck)
    query = writer.trigger(processingTime="500 milliseconds").start(out)
    try:
        until(6)
        time.sleep(8)
        add(calm[6:9])
        table = until(9).toPandas().set_index("t").sort_index()
    finally:
        query.stop()
    # each part as if the key had never been seen
    want = {**replay(detector, calm[:6]), **replay(detector, calm[6:9])}
    assert list(table.buffer_size) == [want[t][4] for t in table.index] and table.buffer_size.iloc[5] > table.buffer_size.iloc[6]
    assert np.allclose(table.threshold_after, [want[t][3] for t in table.index])


def test_ring_keeps_the_last_rows():
    ring = Ring(3)
    for i in range(7):
        ring.append(np.array([i]))
        assert [int(r[0]) for r in ring] == list(range(max(0, i - 2), i + 1)) and len(ring) == min(3, i + 1)
    ring.clear()
    assert list(ring) == [] and len(ring) == 0


def test_decision_before_update_threshold_after(detector):
    online = Online(from_fields(detector.models.first()).copy(), 0.5, Ring(8), 0, SPEC)
    s, anomalous, used, after, *_ = online.step(np.array([0.1, 0.1]))
    assert not anomalous and used == 0.5 and after == pytest.approx(0.9 * 0.5 + 0.1 * s)


def test_far_point_is_learned_only_when_asked(detector):
    far = np.array([60.0, 60.0])
    gated = Online(from_fields(detector.models.first()).copy(), 0.0, Ring(8), 0, SPEC)
    before = gated.model.size
    assert gated.step(far)[:2] == (-1.0, 0) and gated.model.size == before
    always = Online(from_fields(detector.models.first()).copy(), 0.0, Ring(8), 0, SPEC, expand_always=True)
    always.step(far)
    assert any(np.array_equal(v, far) for v in always.model.sv)


def test_refit_uses_buffer_and_oldest_rows(detector):
    slow = SPEC.with_(refit_every=30, min_refit=10, buffer_max=40, refit_sample=15)
    online = Online(from_fields(detector.models.first()).copy(), 9.0, Ring(40), 0, slow)
    xs = np.random.default_rng(3).normal(size=(30, 2))
    out = [online.step(x) for x in xs]
    assert out[-1][-1] == 1 and online.since_refit == 0
    want, _ = fit(xs, 1.0)
    assert np.array_equal(online.model.sv, want.sv)
    assert online.tau == pytest.approx(np.quantile(want.score(xs[:15]), 0.9))


def test_keyed_start_from_initial_state(spark, tmp_path, rows):
    base = rows.dropna()
    keyed = train(spark.createDataFrame(base[base.t < 200]), SPEC, "t", keys=["k"], mode="by_key")
    later = rows[rows.t >= 200]
    new = later[:3].assign(k="new", t=[1000, 1001, 1002])
    stream = stream_of(spark, tmp_path, [pd.concat([later, new])[["a", "b", "k", "t"]]])
    got = run_available(adapt_stream(stream, keyed, ["k"], ["t"])).toPandas()
    assert len(got) == len(later) + 3
    assert got[got.k == "new"].score.isna().all() and (got[got.k == "new"].is_anomaly == 0).all()
    assert got[got.k == "hot"].score.notna().sum() == later[later.k == "hot"].a.notna().sum()


def test_scoring_a_stream_equals_batch(spark, tmp_path, rows, detector):
    stream = stream_of(spark, tmp_path, [rows[["a", "b", "k", "t"]][:200], rows[["a", "b", "k", "t"]][200:]])
    got = run_available(score_stream(stream, detector)).orderBy("t").toPandas()
    want = detector.score(spark.createDataFrame(rows)).orderBy("t").toPandas()
    assert np.allclose(got.score, want.score, equal_nan=True) and list(got.is_anomaly) == list(want.is_anomaly)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    first = pd.DataFrame({"ts": [base + dt.timedelta(minutes=m) for m in (0, 1, 30)], "v": 1.0})
    late = pd.DataFrame({"ts": [base + dt.timedelta(minutes=m) for m in (2, 31)], "v": 1.0})
    src, ck, out = str(tmp_path / "in"), str(tmp_path / "ck"), str(tmp_path / "out")
    log = ProgressLog(spark, str(tmp_path / "log"), held=2)
    for p in (first, late):
        spark.createDataFrame(p, "ts timestamp, v double").coalesce(1).write.mode("append").parquet(src)
        stream = file_events(spark, src, spark.read.parquet(src).schema)
        got = run_available(windowed(stream, "ts", "5 minutes", [F.count("*").alias("n")], late="5 minutes"), ck, out, "update")
    for _ in range(40):  # progress comes from another thread
        time.sleep(0.25)
        seen = log.table().agg(F.sum("rows").alias("rows"), F.sum("dropped_late").alias("late")).first()
        if (seen["rows"], seen["late"]) == (5, 1):
            break
    log.close()
    assert (seen["rows"], seen["late"]) == (5, 1)
    times = latency_summary(log.table().filter("rows > 0"), ["query"], "batch_seconds").collect()
    assert len(times) == 1 and times[0]["mean_ms"] > 0 and times[0]["p99_ms"] >= times[0]["mean_ms"]
    last = got.groupBy("window_start").agg(F.max_by("n", "batch_id").alias("n")).orderBy("window_start").collect()
    assert [r["n"] for r in last] == [2, 2]  # the row at minute 2 came too late


@pytest.fixture(scope="module")
def samples():
    """Sessions with gaps, ties of time, missing values and stalls long before."""
    rng = np.random.default_rng(9)
    n, base = 400, dt.datetime(2024, 1, 1)
    pdf = pd.DataFrame({"us": np.sort(rng.integers(0, 60_000_000, n) // 100_000 * 100_000), "s": rng.choice(["u", "v", "w"], n, p=[0.6, 0.35, 0.05]),
                        "q": rng.normal(90, 5, n), "br": rng.uniform(1, 9, n), "id": np.arange(n)})
    pdf = pdf[~((pdf.us > 20_000_000) & (pdf.us < 33_000_000) & (pdf.s == "v"))]
    pdf["ts"] = [base + dt.timedelta(microseconds=int(u)) for u in pdf.us]
    pdf["stall"] = np.where(pdf.us < 9_000_000, (rng.random(len(pdf)) < 0.1).astype(float), np.nan)
    pdf.loc[pdf.index % 11 == 0, "q"] = np.nan
    pdf.loc[pdf.index % 13 == 0, "br"] = np.nan
    return pdf.drop(columns="us")


SAMPLES = "s string, q double, br double, id long, ts timestamp, stall double"
COLUMNS = ["n_samples", "quality_mean", "quality_std", "quality_mad", "bitrate_mean", "stall_ratio", "tsl_end"]


def sample_rows(spark, pdf):
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in pdf[["s", "q", "br", "id", "ts", "stall"]].itertuples(index=False)]
    return spark.createDataFrame([(*r[:4], pd.Timestamp(r[4]).to_pydatetime(), r[5]) for r in rows], SAMPLES)


@pytest.mark.parametrize("parts, reads", [(1, 10_000), (7, 3)])
def test_stream_window_features_equal_batch(spark, tmp_path, samples, parts, reads):
    """Rows come in any order, in one or several micro-batches, few or many to a read."""
    src = str(tmp_path / "in")
    mixed = samples.sample(frac=1, random_state=parts)
    for i in range(parts):
        sample_rows(spark, mixed.iloc[i::parts]).coalesce(1).write.mode("append").parquet(src)
    df = spark.read.parquet(src)
    stream = with_end(file_events(spark, src, df.schema, files_per_trigger=1), "ts", "2030-01-01")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", reads)
    try:
        # the end row comes with the first file: lateness keeps it back until all files are read
        late = "10 years" if parts > 1 else "10 seconds"
        feats = window_features(stream, ["s"], "ts", "q", "br", F.col("stall") == 1, 5, late, ["id"], slots=8)
        live = run_available(feats).filter("s is not null").toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    if parts > 1:
        assert len(live) == 0  # nothing may close yet
        return
    batch = batch_features(df, ["s"], "ts", "q", "br", F.col("stall") == 1, 5, ["id"], 8).toPandas()
    one, two = (x.sort_values(["s", "window_start"]).reset_index(drop=True) for x in (live, batch))
    assert (one.window_start == two.window_start).all() and (one.s == two.s).all() and two.tsl_end.notna().sum() > 20
    for c in COLUMNS:
        assert np.allclose(one[c].astype(float), two[c].astype(float), equal_nan=True), c


def test_windows_close_once_and_carry_stalls_over_restarts(spark, tmp_path, samples):
    """Shuffled within the lateness, over several runs from one checkpoint: every row as in batch."""
    src, ck, out = (str(tmp_path / x) for x in ("in", "ck", "out"))
    order = samples.assign(at=samples.ts + pd.to_timedelta(np.random.default_rng(2).uniform(0, 4, len(samples)), unit="s")).sort_values("at")
    end = pd.DataFrame([{"s": None, "ts": dt.datetime(2025, 1, 1), "id": 0}])
    for part in [*np.array_split(np.arange(len(order)), 5), None]:
        rows = end.reindex(columns=samples.columns) if part is None else order.iloc[part]
        sample_rows(spark, rows).coalesce(1).write.mode("append").parquet(src)
        stream = file_events(spark, src, spark.read.parquet(src).schema)
        feats = window_features(stream, ["s"], "ts", "q", "br", F.col("stall") == 1, 5, "5 seconds", ["id"], slots=8, forget=1e6)
        live = run_available(feats, ck, out)
    batch = batch_features(sample_rows(spark, samples), ["s"], "ts", "q", "br", F.col("stall") == 1, 5, ["id"], 8).toPandas()
    one, two = (x.sort_values(["s", "window_start"]).reset_index(drop=True) for x in (live.filter("s is not null").toPandas(), batch))
    assert len(one) == len(two)
    for c in COLUMNS:
        assert np.allclose(one[c].astype(float), two[c].astype(float), equal_nan=True), c


@pytest.mark.parametrize("slots", [1, 7, 64])
def test_batch_window_features_by_hand(spark, slots):
    rng = np.random.default_rng(10)
    n = 400
    us = np.sort(rng.integers(0, 70_000_000, n))
    pdf = pd.DataFrame({"us": us, "s": np.where(rng.random(n) < 0.8, "hot", None), "q": rng.normal(size=n), "id": range(n)})
    pdf["stall"] = rng.random(n) < 0.05
    df = spark.createDataFrame(pdf).withColumn("ts", F.timestamp_micros("us"))
    # a window of 7 s cuts evenly into any of these slot counts
    got = batch_features(df, ["s"], "ts", "q", "q", F.col("stall"), 7.0, ["id"], slots).toPandas()
    pdf["w"] = pdf.us // 7_000_000
    assert len(got) == pdf.groupby(["s", "w"], dropna=False).ngroups
    hot = got[got.s == "hot"].sort_values("window_start")
    want = pdf[pdf.s == "hot"].sort_values(["us", "id"]).groupby("w")
    assert np.allclose(hot.quality_mad, want.q.apply(lambda q: q.diff().abs().mean()), equal_nan=True)
    assert np.allclose(hot.quality_std, want.q.std(), equal_nan=True)
    stalls = pdf[(pdf.s == "hot") & pdf.stall].us
    for r, w in zip(hot.itertuples(), sorted(want.groups)):
        end = (w + 1) * 7_000_000
        seen = stalls[stalls < end]
        assert (pd.isna(r.tsl_end) and seen.empty) or r.tsl_end == pytest.approx((end - seen.max()) / 1e6)


def test_versions_from_micro_batches(spark, tmp_path, rows, detector):
    path = str(tmp_path / "models")
    detector.save(path, version=0)
    clean = rows.dropna()[["a", "b", "k", "t"]]
    stream = stream_of(spark, tmp_path, [clean[:200], clean[200:]])
    writer = learn_batches(stream, path, SPEC, "t")
    writer.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    heads = headers(spark, path, "s").orderBy("version").collect()
    assert [(r["version"], r["parent_version"]) for r in heads] == [(0, None), (1, 0), (2, 1)]
    assert heads[-1]["seen"] == 300 + len(clean) and heads[1]["new_rows"] == 200
    # the same as two plain updates
    step = update(update(detector, spark.createDataFrame(clean[:200]), "t"), spark.createDataFrame(clean[200:]), "t")
    mine, want = load_models(spark, path, "s").first(), step.models.first()
    # files may arrive in either order
    assert mine["seen"] == want["seen"] and load(spark, path, SPEC).scaler == detector.scaler
