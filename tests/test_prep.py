"""Preparation, scaling and labels on awkward values."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ringfence.functions.columns import flag
from ringfence.operators import prep
from ringfence.spec import AnomalyRule, QOE_CAPS, DatasetSpec, get_spec, registered_specs

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, v) for i, v in enumerate([None, NAN, INF, -INF, -1.0, -2.0, 0.0, 3.0, 9.0])]
    return spark.createDataFrame(rows, "id long, a double").withColumn("b", F.lit(5.0))


def column(df, c="a"):
    return [r[c] for r in df.orderBy("id").select(c).collect()]


def test_specs_and_unknown_name():
    assert registered_specs() == ["LIVE_NFLX_II", "LIVE_NFLX", "LFOVIA_QoE"]
    with pytest.raises(ValueError, match="Unknown dataset 'X'. Available datasets: LIVE_NFLX_II, LIVE_NFLX, LFOVIA_QoE"):
        get_spec("X")
    assert get_spec("LFOVIA_QoE").invert == ("TSL", "SSIM") and get_spec("LIVE_NFLX").sigma == 1.5
    assert DatasetSpec("d", ("x",)).quantile == 0.95


def test_clip_keeps_missing_values(odd):
    assert column(prep.transform(odd, clip=["a"], clip_max=5.0)) == [None, None, 5.0, 0.0, 0.0, 0.0, 0.0, 3.0, 5.0]
    assert column(prep.transform(odd, clip=["a", "not there"]))[-1] == 9.0


def test_log_of_minus_one_and_below_is_null(odd):
    got = column(prep.transform(odd, log=["a"]))
    assert got[4] is None and got[5] is None and got[8] == pytest.approx(math.log(10))


def test_invert_uses_batch_maximum_or_given_one(odd):
    small = odd.filter("id >= 4")
    assert column(prep.transform(small, clip=["a"], invert_cols=["a"])) == [9.0, 9.0, 9.0, 6.0, 0.0]
    assert column(prep.transform(small, clip=["a"], invert_cols=["a"], maxima={"a": 10.0}))[-1] == 1.0
    # NaN does not become the maximum
    assert column(prep.transform(odd.filter("id in (1, 7, 8)"), invert_cols=["a"])) == [None, 6.0, 0.0]


def test_pipeline_matches_pandas():
    spec = get_spec("LFOVIA_QoE")
    assert spec.clip == spec.log == ("TSL", "Nrebuffers")


def test_lfovia_preparation_matches_pandas(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(rng.normal(size=(50, 4)) * 10, columns=["TSL", "Nrebuffers", "NIQE", "SSIM"])
    pdf["id"] = range(50)
    want = pdf.copy()
    for c in ("TSL", "Nrebuffers"):
        want[c] = np.log1p(want[c].clip(lower=0))
    for c in ("TSL", "SSIM"):
        want[c] = want[c].max() - want[c]
    spec = get_spec("LFOVIA_QoE")
    df = spark.createDataFrame(pdf)
    got = prep.prepare(df, spec).orderBy("id").toPandas()
    fitted = prep.prepare(df, spec, prep.fit_maxima(df, spec)).orderBy("id").toPandas()
    for c in spec.features:
        assert np.allclose(got[c], want[c]) and np.allclose(fitted[c], want[c])


def test_fixed_caps(spark):
    df = spark.createDataFrame([(1, 5e4, 400.0, 2.0), (2, -1.0, 10.0, 0.5)], "id long, bitrate_mean double, tsl_end double, stall_ratio double")
    got = prep.transform(df, log=list(QOE_CAPS), caps=QOE_CAPS).orderBy("id").collect()
    assert [got[0][c] for c in QOE_CAPS] == pytest.approx([math.log1p(20000), math.log1p(300), math.log1p(1)])
    assert [got[1][c] for c in QOE_CAPS] == pytest.approx([0.0, math.log1p(10), math.log1p(0.5)])


def test_inverting_a_stream_needs_a_maximum(spark, tmp_path):
    stream = spark.readStream.schema("TSL double, Nrebuffers double, NIQE double, SSIM double").json(str(tmp_path))
    with pytest.raises(ValueError, match="maxima"):
        prep.prepare(stream, get_spec("LFOVIA_QoE"))
    with pytest.raises(ValueError, match="Length mismatch: 2 values but 4 feature names"):
        prep.check_width(["a", "b"], get_spec("LFOVIA_QoE"))


def test_scaler_is_population_and_keeps_constants(odd):
    few = odd.filter("id >= 6")
    s = prep.fit_scaler(few, ["a", "b"])
    assert s.mean == {"a": 4.0, "b": 5.0}
    assert s.scale["a"] == pytest.approx(np.std([0, 3, 9])) and s.scale["b"] == 1.0
    assert column(s.transform(few), "b") == [0.0, 0.0, 0.0]
    with pytest.raises(ValueError, match="no values"):
        prep.fit_scaler(odd.filter("id = 0"), ["a"])


def test_label_boundaries(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 50.0), (3, NAN), (4, None), (5, -0.1)], "id long, y double")
    got = lambda rule: column(df.withColumn("l", rule.column("y")), "l")
    assert got(AnomalyRule("le", 0.0)) == [1, 0, 0, 0, 1]
    assert got(AnomalyRule("lt", 0.0)) == [0, 0, 0, 0, 1]
    assert got(AnomalyRule("lt", 50.0)) == [1, 0, 0, 0, 1]
    with pytest.raises(ValueError):
        AnomalyRule("gt", 1.0)


def test_missing_scores_are_never_flagged(odd):
    assert column(odd.withColumn("f", flag(F.col("a"), 2.0)), "f") == [0, 0, 1, 0, 0, 0, 0, 1, 1]
    assert column(odd.withColumn("f", flag(F.col("a"), 2.0, margin=1.0)), "f")[7] == 0


def test_project_names_what_is_missing(odd):
    with pytest.raises(ValueError, match="Missing columns: zz"):
        prep.project(odd, ["a", "zz"])
    assert prep.project(odd, ["b", "a"]).columns == ["b", "a"]
