"""Every operator as a query over the test tables: name -> function of (spark, folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ringfence.operators import analysis, baselines, crossval, metrics, prep, projection, sampling, splits, threshold, windows
from ringfence.operators.fit import batch_stats, fit_by_key, fit_one, fit_steps, objective_trace, update_by_key
from ringfence.operators.merge import fit_merged
from ringfence.operators.score import score, score_joined, uniform_model
from ringfence.plans.evaluate import compare_baselines, evaluate
from ringfence.plans.batches import train_batches, training_history
from ringfence.plans.train import Detector, load, train
from ringfence.plans.update import update_stored
from ringfence.session import cut, new_path
from ringfence.sources import arrays, records, tables
from ringfence.sources.models import headers
from ringfence.spec import AnomalyRule, DatasetSpec
from ringfence.streaming import adaptive, score as stream_scoring, sources as stream_sources, update as stream_update
from ringfence.streaming import windows as stream_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

ITEM_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
ITEM_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ITEM_TIES = ["l_linenumber", "l_partkey", "l_suppkey"]

ITEMS = DatasetSpec(
    name="lineitem",
    features=tuple(ITEM_FEATURES),
    target="l_tax",
    clip=("l_quantity", "l_extendedprice"),
    log=("l_extendedprice",),
    invert=("l_discount",),
    rule=AnomalyRule("lt", 0.01),
    quantile=0.90,
    sigma_method="fixed",
    sigma=1.66,
)
EVENTS = DatasetSpec(
    name="events",
    features=("value", "hour"),
    target="k",
    clip=("value",),
    log=("value",),
    rule=AnomalyRule("lt", 10.0),
    quantile=0.90,
    sigma_method="fixed",
    sigma=0.8,
    refit_every=40,
    min_refit=20,
)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r(c, digits: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def _events(spark, sf) -> DataFrame:
    """Events with the number inside ``props`` as ``k`` and the time of day as ``hour``."""
    return _with_k(_t(spark, sf, "events"))


def _with_k(df: DataFrame) -> DataFrame:
    day = F.lit(86_400_000_000)
    return df.withColumns({
        "k": F.get_json_object("props", "$.k").cast("double"),
        "hour": F.pmod(F.unix_micros(F.col("ts").cast("timestamp")), day) / F.lit(3.6e9),
    })


def _vectors(spark, sf) -> DataFrame:
    return _t(spark, sf, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))


def _class_means(vectors: DataFrame) -> DataFrame:
    """(label, center): mean vector of every class."""
    cells = vectors.select("label", F.posexplode("embedding").alias("pos", "v"))
    means = cells.groupBy("label", "pos").agg(F.avg("v").alias("m"))
    packed = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("c"))
    return packed.select("label", F.transform("c", lambda s: s["m"]).alias("center"))


def _fixed_scores(spark, sf, detail: bool = False) -> DataFrame:
    """All vectors scored against the class means with equal weights."""
    vectors = _vectors(spark, sf)
    model = cut(uniform_model(_class_means(vectors), "center", "label", sigma=1.0, radius=0.6), "refs")
    return score(vectors, model, "embedding", keep=["vec_id", "label"], detail=detail)


def _ranked(spark, sf) -> DataFrame:
    """Scores rounded so that they tie, with class 0 as the anomaly."""
    return _fixed_scores(spark, sf).select(
        "vec_id", _r("score", 3).alias("score"), F.when(F.col("label") == 0, 1).otherwise(0).alias("label")
    )


def _item_vectors(spark, sf, keep=()) -> DataFrame:
    items = _t(spark, sf, "lineitem")
    ready = prep.prepare(items, ITEMS, prep.fit_maxima(items, ITEMS))
    return prep.fit_scaler(ready, ITEM_FEATURES).transform(ready).select(*dict.fromkeys([*ITEM_KEYS, *ITEM_FEATURES, *keep]))


# -- preparation ----------------------------------------------------------------


@query
def prep_clip_log_invert(spark, sf):
    out = prep.prepare(_t(spark, sf, "lineitem"), ITEMS)
    return out.select(*ITEM_KEYS, *[_r(c).alias(c) for c in ITEM_FEATURES])


@query
def prep_both_bounds(spark, sf):
    out = prep.transform(_t(spark, sf, "events"), clip=["value", "absent"], clip_min=1.0, clip_max=100.0)
    return out.select("event_id", _r("value").alias("value"))


@query
def prep_caps(spark, sf):
    caps = {"l_extendedprice": (0.0, 20000.0), "l_quantity": (0.0, 30.0), "l_discount": (0.0, 0.05)}
    out = prep.transform(_t(spark, sf, "lineitem"), log=list(caps), caps=caps)
    return out.select(*ITEM_KEYS, *[_r(c).alias(c) for c in caps])


@query
def scale_population(spark, sf):
    items = _t(spark, sf, "lineitem")
    out = prep.fit_scaler(items, ITEM_FEATURES).transform(items)
    return out.select(*ITEM_KEYS, *[_r(c, 4).alias(c) for c in ITEM_FEATURES])


@query
def scaler_table(spark, sf):
    out = prep.scaler_stats(_t(spark, sf, "lineitem"), ITEM_FEATURES)
    return out.select("feature", _r("mean", 4).alias("mean"), _r("scale", 4).alias("scale"))


@query
def label_rule(spark, sf):
    rule = AnomalyRule("le", 0.0)
    return _t(spark, sf, "labels").select("doc_id", rule.column("quality").alias("label"))


@query
def label_rule_strict(spark, sf):
    rule = AnomalyRule("lt", 50.0)
    return _t(spark, sf, "lineitem").groupBy(rule.column("l_quantity").cast("long").alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def window_features(spark, sf):
    out = windows.window_features(
        _events(spark, sf), ["event_type"], "ts", "value", "k", F.col("value") < 0.1, 86400, ["event_id"]
    )
    return out.select(
        "event_type", F.unix_seconds("window_start").alias("window_start"), "n_samples",
        *[_r(c, 8).alias(c) for c in ("quality_mean", "quality_std", "quality_mad", "bitrate_mean", "stall_ratio", "tsl_end")],
    )


# -- sources and sinks ----------------------------------------------------------


@query
def csv_roundtrip(spark, sf):
    path = new_path(spark, "csv")
    tables.write_csv(_t(spark, sf, "lineitem").select(*ITEM_KEYS, *ITEM_FEATURES, "l_returnflag"), path)
    back = tables.read(spark, path, ITEMS.schema(("l_returnflag",)), "csv")
    return back.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), *[_r(F.sum(c), 2).alias(c) for c in ITEM_FEATURES]
    )


@query
def present_tables(spark, sf):
    both = tables.read_present(
        spark, {"customer": f"{sf}/customer.parquet", "nowhere": f"{sf}/nowhere.parquet", "supplier": f"{sf}/supplier.parquet"}
    )
    return both.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"), _r(F.sum(F.coalesce("c_acctbal", "s_acctbal")), 2).alias("balance")
    )


@query
def flatten_arrays(spark, sf):
    files = tables.with_lineage(_t(spark, sf, "embeddings")).withColumn("up", F.filter("embedding", lambda v: v > 0))
    out = arrays.flatten(files, ["embedding", "up"], ["vec_id", "file", "content"])
    return out.select("vec_id", "file", "content", F.col("pos").cast("long").alias("pos"),
                      _r("embedding").alias("embedding"), _r("up").alias("up"))


@query
def metric_records(spark, sf):
    """Records written as JSON per dataset, read back and laid out as the comparison table."""
    scored = _events(spark, sf).select("event_type", "value", EVENTS.rule.column("k").alias("label"))
    pred = scored.withColumn("is_anomaly", F.when(F.col("value") > 50, 1).otherwise(0))
    rec = metrics.decisions(pred, by=["event_type"]).select(
        F.col("event_type").alias("dataset"), F.col("n_rows").alias("test_samples"), F.lit(50.0).alias("threshold"),
        (F.col("flag_rate") * 100).alias("flag_rate"), "precision", "recall", "f1",
    )
    path = new_path(spark, "records")
    records.write_records(rec, path)
    table = analysis.comparison_table(records.read_records(spark, path))
    return table.select(
        F.col("Dataset").alias("dataset"), _r("F1").alias("f1"), _r("Precision").alias("precision"),
        _r("Recall").alias("recall"), _r(F.col("`Flag Rate (%)`")).alias("flag_rate"), "Threshold", "AUC",
    ).withColumnRenamed("Threshold", "threshold").withColumnRenamed("AUC", "auc")


@query
def schema_consistency(spark, sf):
    return analysis.key_sets(_t(spark, sf, "events"), F.json_object_keys("props"))


@query
def array_profile(spark, sf):
    out = analysis.array_profile(_t(spark, sf, "embeddings"), ["embedding"], ["label"])
    return out.select("label", "key", "n_values", *[_r(c).alias(c) for c in ("v_min", "v_max", "v_mean", "v_std")])


@query
def array_head(spark, sf):
    out = analysis.array_head(_t(spark, sf, "embeddings"), ["embedding"], ["vec_id"])
    return out.select("vec_id", "key", F.col("size").cast("long").alias("size"), _r(F.col("head")[0].cast("double")).alias("v1"),
                      _r(F.col("head")[4].cast("double")).alias("v5"))


@query
def union_sets(spark, sf):
    both = analysis.stacked({
        "customer": _t(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")),
        "supplier": _t(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")),
    })
    return both.groupBy("source", "nation").agg(F.count(F.lit(1)).alias("n"), _r(F.sum("balance"), 2).alias("balance"))


# -- filters, splits, samples ---------------------------------------------------


@query
def normal_only(spark, sf):
    return splits.normal_only(_t(spark, sf, "lineitem"), ITEMS).select(*ITEM_KEYS, "l_tax")


@query
def membership(spark, sf):
    builders = _t(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return splits.members(_t(spark, sf, "orders"), "o_custkey", builders).select("o_orderkey", "o_custkey")


@query
def membership_list(spark, sf):
    return splits.members(_t(spark, sf, "events"), "event_type", ["click", "view"]).select("event_id", "event_type")


@query
def holdout_last_groups(spark, sf):
    events = _t(spark, sf, "events")
    fit_part, test = splits.holdout_last_groups(events, "user_id", "event_id")
    return analysis.stacked({"train": fit_part.select("event_id"), "test": test.select("event_id")}, "part")


@query
def holdout_tail(spark, sf):
    fit_part, test = splits.holdout_tail(_t(spark, sf, "events"), "ts", ["event_id"])
    return analysis.stacked({"train": fit_part.select("event_id"), "test": test.select("event_id")}, "part")


@query
def min_group(spark, sf):
    return splits.min_group_size(_t(spark, sf, "lineitem"), "l_orderkey", 5).select(*ITEM_KEYS)


@query
def distinct_groups(spark, sf):
    return splits.distinct_groups(_t(spark, sf, "events"), "user_id")


@query
def group_split(spark, sf):
    fit_part, test = splits.group_split(_t(spark, sf, "orders"), "o_custkey")
    return analysis.stacked({"train": fit_part.select("o_orderkey"), "test": test.select("o_orderkey")}, "part")


@query
def group_kfold(spark, sf):
    out = splits.with_folds(_t(spark, sf, "orders"), "o_custkey")
    return out.groupBy(F.col("fold").cast("long").alias("fold")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("o_custkey").alias("n_groups")
    )


@query
def sample_rows(spark, sf):
    return sampling.sample(_t(spark, sf, "events"), sampling.SIGMA_SAMPLE, ["event_id"]).select("event_id", "value")


@query
def minibatches(spark, sf):
    return sampling.mini_batches(_t(spark, sf, "events"), 50, "ts", ["event_id"]).select("event_id", "batch_id")


@query
def pseudo_groups(spark, sf):
    return sampling.pseudo_groups(_t(spark, sf, "orders"), "o_orderkey").select("o_orderkey", "pseudo_group")


# -- model ------------------------------------------------------------------------


@query
def sigma_median(spark, sf):
    out = sampling.median_sigma(_vectors(spark, sf), "embedding", ["vec_id"])
    return out.select(_r("sigma").alias("sigma"), "sample_rows")


@query
def score_fixed_refs(spark, sf):
    out = _fixed_scores(spark, sf, detail=True)
    return out.select("vec_id", _r("score").alias("score"), _r("raw_score").alias("raw_score"),
                      _r("max_sim").alias("max_sim"), "zone")


@query
def score_joined_refs(spark, sf):
    """The join form of scoring: every vector against the mean of its own class."""
    vectors = _vectors(spark, sf)
    own = _class_means(vectors).select(
        "label", F.col("center").alias("sv"), F.array(F.lit(1.0)).alias("alpha"), F.lit(0.6).alias("radius"),
        F.lit(0.8).alias("sigma"), F.lit(1e-8).alias("eps_near"), F.lit(1e-8).alias("eps_far"),
        F.lit(1).alias("n_sv"), F.size("center").alias("dim"),
    )
    out = score_joined(vectors, own, "embedding", ["label"], detail=True)
    return out.select("vec_id", _r("score").alias("score"), _r("max_sim").alias("max_sim"), "zone")


@query
def threshold_quantile(spark, sf):
    scored = _fixed_scores(spark, sf)
    tau = threshold.threshold(scored, 0.9, ["label"])
    return tau.select("label", _r("tau").alias("tau"))


@query
def threshold_flags(spark, sf):
    scored = cut(_fixed_scores(spark, sf), "scores")
    out = threshold.flagged(scored, threshold.threshold(scored, 0.9))
    return out.select("vec_id", _r("tau").alias("tau"), F.col("is_anomaly").cast("long").alias("is_anomaly"))


@query
def fit_by_key_flags(spark, sf):
    """Flagship: prepare, scale, fit per key, score, threshold and flag the whole table."""
    detector = train(_t(spark, sf, "lineitem"), ITEMS, "l_orderkey", ITEM_TIES, ["l_returnflag"])
    scored = detector.score(_t(spark, sf, "lineitem"), keep=())
    return scored.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("is_anomaly").cast("long")).alias("n_flagged"), _r(F.max("tau")).alias("tau"),
        _r(F.sum("score"), 3).alias("total_score"),
    )


def _digest(models: DataFrame, by=(), dims: int = len(ITEM_FEATURES)) -> DataFrame:
    """What a model is, rounded: size, radius, weights and weighted centre of its support vectors."""
    places = F.sequence(F.lit(0), F.col("n_sv") - 1)

    def center(i):
        parts = F.transform(places, lambda j: F.get("alpha", j) * F.get("sv", j * F.col("dim") + i))
        return _r(F.aggregate(parts, F.lit(0.0), lambda a, b: a + b))

    squares = F.aggregate("alpha", F.lit(0.0), lambda a, b: a + b * b)
    return models.select(
        *by, F.col("n_sv").cast("long").alias("n_sv"), _r("radius", 8).alias("radius"), "seen", _r(squares, 8).alias("weight_sq"),
        _r(F.array_max("alpha"), 8).alias("weight_top"), *[center(i).alias(f"c{i + 1}") for i in range(dims)],
    )


@query
def fit_models(spark, sf):
    models = fit_by_key(_item_vectors(spark, sf, ["l_returnflag"]), ITEM_FEATURES, ["l_returnflag"], "l_orderkey", ITEM_TIES, 1.66)
    return _digest(models, ["l_returnflag"])


@query
def fit_single(spark, sf):
    return _digest(fit_one(_item_vectors(spark, sf), ITEM_FEATURES, "l_orderkey", ITEM_TIES, sigma=1.66))


@query
def fit_batches(spark, sf):
    _, steps = fit_steps(
        _item_vectors(spark, sf, ["l_returnflag"]), ITEM_FEATURES, ["l_returnflag"], "l_orderkey", ITEM_TIES, 1.66,
        batch_rows=100,
    )
    return batch_stats(steps, ["l_returnflag"])


@query
def train_in_batches(spark, sf):
    """Stopped after the first checkpoint and resumed; what every batch did."""
    path, items = new_path(spark, "batches"), _t(spark, sf, "lineitem")
    spec = ITEMS.with_(initial_batch=2000, incremental_batch=1000, checkpoint_every=25, checkpoints=True)
    for legs in (1, None):
        train_batches(items, spec, path, "l_orderkey", ITEM_TIES, ["l_returnflag"], legs=legs)
    return training_history(spark, path, spec)[0].select("l_returnflag", "batch", "processed", "added", "removed", "n_sv")


@query
def fit_trace(spark, sf):
    _, steps = fit_steps(
        _vectors(spark, sf), "embedding", ["label"], "vec_id", (), 1.0, trace=True
    )
    return objective_trace(steps, ["label"]).withColumn("radius", _r("radius", 8))


@query
def fit_merged_rounds(spark, sf):
    return fit_merged(_item_vectors(spark, sf), ITEM_FEATURES, ITEM_KEYS, 1.66, bucket_rows=20_000).select(
        "n_sv", "radius", "seen", "rounds"
    )


@query
def update_models(spark, sf):
    """Models of the first orders of each key, continued with the later ones: the models of one pass over all."""
    rows = _item_vectors(spark, sf, ["l_returnflag"])
    early, late = splits.holdout_tail(rows, "l_orderkey", ITEM_TIES, 0.5)
    first = fit_by_key(early, ITEM_FEATURES, ["l_returnflag"], "l_orderkey", ITEM_TIES, 1.66)
    return _digest(update_by_key(first, late, ITEM_FEATURES, ["l_returnflag"], "l_orderkey", ITEM_TIES), ["l_returnflag"])


@query
def model_roundtrip(spark, sf):
    """A saved, loaded, updated and reloaded detector scoring the whole table."""
    items = _t(spark, sf, "lineitem")
    path = new_path(spark, "models")
    early, late = splits.holdout_tail(items, "l_orderkey", ITEM_TIES, 0.5)
    train(early, ITEMS, "l_orderkey", ITEM_TIES, mode="single").save(path)
    update_stored(spark, path, ITEMS, late, "l_orderkey", ITEM_TIES, source="late")
    again = load(spark, path, ITEMS)
    return again.score(items, keep=()).groupBy("is_anomaly").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))


# -- evaluation -------------------------------------------------------------------


@query
def roc_auc(spark, sf):
    return metrics.roc_auc(_ranked(spark, sf)).select(_r("auc").alias("auc"), "n_pos", "n_neg")


@query
def avg_precision(spark, sf):
    return metrics.average_precision(_ranked(spark, sf)).select(_r("ap").alias("ap"), "n_pos")


@query
def roc_points(spark, sf):
    out = metrics.roc_points(cut(_ranked(spark, sf), "ranked"), drop_collinear=False)
    return out.select(_r("threshold", 3).alias("threshold"), _r("fpr").alias("fpr"), _r("tpr").alias("tpr"))


@query
def roc_corners(spark, sf):
    out = metrics.roc_points(cut(_ranked(spark, sf), "ranked"))
    return out.select(_r("threshold", 3).alias("threshold"), _r("fpr").alias("fpr"), _r("tpr").alias("tpr"))


@query
def pr_points(spark, sf):
    out = metrics.pr_points(cut(_ranked(spark, sf), "ranked"))
    return out.select(_r("threshold", 3).alias("threshold"), _r("precision").alias("precision"), _r("recall").alias("recall"))


@query
def prf1(spark, sf):
    scored = _events(spark, sf).select(
        "event_type", EVENTS.rule.column("k").alias("label"), F.when(F.col("value") > 50, 1).otherwise(0).alias("is_anomaly")
    )
    out = metrics.decisions(scored, by=["event_type"])
    return out.select("event_type", "n_rows", *[_r(c).alias(c) for c in ("precision", "recall", "f1", "flag_rate")])


@query
def auc_by_group(spark, sf):
    scored = _events(spark, sf).select("user_id", "value", EVENTS.rule.column("k").alias("label"))
    out = metrics.auc_by_group(scored, "user_id", "value")
    return out.select("user_id", _r("auc").alias("auc"), "n_rows")


@query
def session_p95_auc(spark, sf):
    scored = _events(spark, sf).select("user_id", "value", F.when(F.col("k") < 2, 1).otherwise(0).alias("label"))
    return metrics.session_auc(scored, "user_id", "value").select(_r("auc").alias("auc"), "n_pos", "n_neg")


@query
def class_guard(spark, sf):
    rows = _t(spark, sf, "labels").select(F.col("toxic").alias("label"))
    out = metrics.classes_present(rows)
    return out.select("n_pos", "n_neg", F.col("single_class").cast("int").cast("long").alias("single_class"))


def _cv(spark, sf):
    rows = _events(spark, sf)
    ready = prep.prepare(rows, EVENTS).withColumn("label", EVENTS.rule.column("k"))
    vectors = prep.fit_scaler(ready, EVENTS.features).transform(ready)
    return crossval.cross_validate(
        vectors, EVENTS.features, "user_id", "label", "ts", EVENTS.sigma, EVENTS.quantile, ["event_id"]
    )


@query
def cv_folds(spark, sf):
    return _cv(spark, sf)[0]


@query
def cv_summary(spark, sf):
    return crossval.fold_summary(_cv(spark, sf)[0])


@query
def cv_timing(spark, sf):
    return crossval.timing_summary(_cv(spark, sf)[0])


@query
def cv_group_auc(spark, sf):
    """AUC per user inside the last fold."""
    tested = _cv(spark, sf)[1]
    last = tested.agg(F.max("cv")).scalar()
    return metrics.auc_by_group(tested.filter(F.col("cv") == last), "user_id")


@query
def grid_best(spark, sf):
    rows = _events(spark, sf)
    ready = prep.prepare(rows, EVENTS).withColumn("label", EVENTS.rule.column("k"))
    vectors = prep.fit_scaler(ready, EVENTS.features).transform(ready)
    grid = crossval.grid_search(
        vectors, EVENTS.features, "user_id", "label", "ts", [0.5, 0.8], [0.9, 0.95], ["event_id"], folds=3
    )
    return crossval.best_setting(grid)


@query
def evaluation_record(spark, sf):
    rows = _events(spark, sf).withColumn("content", F.col("user_id").cast("string"))
    detector = train(rows, EVENTS, "ts", ["event_id"], mode="single")
    return evaluate(detector, rows, "ts", ["event_id"])


@query
def spread_of_metrics(spark, sf):
    scored = _events(spark, sf).select(
        "user_id", EVENTS.rule.column("k").alias("label"), F.when(F.col("value") > 50, 1).otherwise(0).alias("is_anomaly")
    )
    out = metrics.spread(metrics.decisions(scored, by=["user_id"]), ["precision", "recall", "f1", "flag_rate"])
    return out.select("metric", _r("mean").alias("mean"), _r("std").alias("std"))


# -- baselines --------------------------------------------------------------------


@query
def iforest(spark, sf):
    rows = _events(spark, sf).select("event_id", *EVENTS.features)
    forest = baselines.fit_forest(rows, EVENTS.features, ["event_id"])
    return baselines.score_forest(rows, forest, EVENTS.features).select("event_id", "score")


@query
def iforest_flags(spark, sf):
    """Decisions at the contamination of the fitted rows: the highest tenth of their scores."""
    rows = _events(spark, sf).select("event_id", *EVENTS.features)
    forest = baselines.fit_forest(rows, EVENTS.features, ["event_id"])
    scored = cut(baselines.score_forest(rows, forest, EVENTS.features), "forest-scores")
    return baselines.flag_forest(scored, scored).agg(
        F.count("score").alias("n"), F.sum(F.col("is_anomaly")).cast("long").alias("flagged"), F.max("tau").alias("tau"))


@query
def linear_svm(spark, sf):
    rows = _item_vectors(spark, sf)
    out = baselines.fit_linear_svm(rows, ITEM_FEATURES).score(rows)
    return out.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("score") > 0, 1.0).otherwise(0.0)).alias("outside"))


@query
def rbf_svm(spark, sf):
    rows = _item_vectors(spark, sf)
    out = baselines.fit_rbf_svm(rows, ITEM_FEATURES, size=64).score(rows)
    return out.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("score") > 0, 1.0).otherwise(0.0)).alias("outside"))


@query
def plane_certificates(spark, sf):
    """Both planes with what bounds their distance to the optimum."""
    rows = cut(_item_vectors(spark, sf), "plane-rows")
    planes = {"linear": baselines.fit_linear_svm(rows, ITEM_FEATURES), "rbf": baselines.fit_rbf_svm(rows, ITEM_FEATURES, size=64)}
    proofs = [(k, p.proof.steps, float(p.proof.gap), float(p.proof.length_sq), bool(p.proof.converged), bool(p.proof.vanishing)) for k, p in planes.items()]
    return spark.createDataFrame(proofs, "plane string, steps int, gap double, length_sq double, converged boolean, vanishing boolean")


@query
def pca2(spark, sf):
    rows = _item_vectors(spark, sf)
    means, parts = baselines.fit_pca(rows, ITEM_FEATURES)
    return baselines.project_pca(rows, ITEM_FEATURES, means, parts).select(*ITEM_KEYS, _r("pc1", 5).alias("pc1"), _r("pc2", 5).alias("pc2"))


@query
def pca_models(spark, sf):
    """Vectors and the support vectors of their classes' models in one plane."""
    rows = _vectors(spark, sf)
    models = fit_by_key(rows, "embedding", ["label"], "vec_id", (), 1.0)
    drawn = projection.draw_models(rows, models, "embedding", ["vec_id"], ["label"])
    return drawn.select("label", "vec_id", "kind", _r("weight").alias("weight"), _r("pc1").alias("pc1"), _r("pc2").alias("pc2"))


@query
def baseline_comparison(spark, sf):
    rows = _events(spark, sf)
    fit_part, test = splits.holdout_last_groups(rows, "user_id", "event_id")
    detector = train(fit_part, EVENTS, "ts", ["event_id"], mode="merge")
    return compare_baselines(detector, fit_part, test, ["event_id"], normal_training=True)


# -- analysis ---------------------------------------------------------------------


@query
def corr_matrix(spark, sf):
    out = analysis.correlations(_t(spark, sf, "lineitem"), ITEM_FEATURES)
    return out.select("feature_a", "feature_b", _r("r").alias("r"))


@query
def target_correlation(spark, sf):
    out = analysis.target_correlations(_t(spark, sf, "lineitem"), ITEM_FEATURES[1:], "l_quantity")
    return out.select("feature", _r("r").alias("r"))


@query
def class_means(spark, sf):
    out = analysis.class_means(_t(spark, sf, "lineitem"), ITEM_FEATURES[1:], AnomalyRule("lt", 25.0).column("l_quantity").cast("long"))
    return out.select("label", *[_r(c, 4).alias(c) for c in ITEM_FEATURES[1:]])


@query
def split_profile(spark, sf):
    out = analysis.split_profile(_t(spark, sf, "lineitem"), "l_quantity", AnomalyRule("lt", 25.0), ["l_linestatus"])
    return out.select("l_linestatus", "n_rows", "n_good", "n_bad", "target_min", "target_max", _r("target_mean", 4).alias("target_mean"))


@query
def diagnosis(spark, sf):
    out = analysis.diagnosis(_t(spark, sf, "lineitem"), ITEM_FEATURES[1:], "l_quantity", AnomalyRule("lt", 25.0))
    flags = ["weak_correlations", "few_good_rows", "strong_negative", "all_weak"]
    return out.select(*[F.col(c).cast("int").cast("long").alias(c) for c in flags], "min_feature",
                      _r("min_r").alias("min_r"), _r("max_r").alias("max_r"), "n_good")


@query
def feature_screen(spark, sf):
    rows = _t(spark, sf, "lineitem").select(
        *ITEM_FEATURES, (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        (F.col("l_extendedprice") + 300 * F.col("l_quantity")).alias("mix"),
    )
    out = analysis.feature_screen(rows, ["l_extendedprice", "net", "l_discount", "l_tax", "l_quantity"], "mix")
    return out.select("feature", _r("r").alias("r"), F.col("kept").cast("long").alias("kept"), "reason")


@query
def compare_pivot(spark, sf):
    cells = _t(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(_r(F.avg("o_totalprice"), 4).alias("m"))
    return analysis.pivot_metric(cells, "o_orderpriority", "o_orderstatus", ["F", "O", "P"], "m")


@query
def summary_stats(spark, sf):
    rows = _t(spark, sf, "orders").select("o_totalprice", "o_orderpriority")
    out = analysis.summary_stats(rows, ["o_totalprice", "o_orderpriority"])
    return out.select("metric", *[_r(c, 4).alias(c) for c in ("mean", "std", "min", "max")])


@query
def latency_summary(spark, sf):
    out = analysis.latency_summary(_t(spark, sf, "events"), ["event_type"], "value")
    return out.select("event_type", *[_r(c, 4).alias(c) for c in ("mean_ms", "p99_ms", "rows_per_s")])


@query
def latency_scored(spark, sf):
    """Kernel time per row of scoring the whole table with per-flag models."""
    rows = _item_vectors(spark, sf, ["l_returnflag"])
    models = fit_by_key(rows, ITEM_FEATURES, ["l_returnflag"], "l_orderkey", ITEM_TIES, 1.66)
    timed = cut(score(rows, models, ITEM_FEATURES, ["l_returnflag"], keep=(), timed=True), "timed")
    return analysis.latency_summary(timed, ["l_returnflag"], "score_seconds")


@query
def report_order(spark, sf):
    cells = _t(spark, sf, "events").groupBy("event_type", "user_id").agg(_r(F.avg("value"), 8).alias("m"))
    return analysis.report_order(cells, "event_type", "m")


# -- adapting thresholds and streams ------------------------------------------------


@query
def buffer_last_n(spark, sf):
    return threshold.last_n(_t(spark, sf, "events"), ["event_type"], "ts", 500, ["event_id"]).select(
        "event_type", "event_id", F.col("age").cast("long").alias("age")
    )


@query
def ewma_threshold(spark, sf):
    rows = _t(spark, sf, "events").select("event_id", "user_id", "ts", F.log1p("value").alias("score"))
    out = threshold.moving_threshold(rows, "score", ["user_id"], "ts", 3.0, ties=["event_id"])
    return out.select("event_id", _r("tau_used").alias("tau_used"), _r("tau_after").alias("tau_after"),
                      F.col("accepted").cast("long").alias("accepted"))


def _rocksdb(spark) -> None:
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def _stream(spark, sf):
    schema = _t(spark, sf, "events").schema
    return stream_sources.file_events(spark, sf, schema, glob="events.parquet")


@query
def stream_window_counts(spark, sf):
    counts = stream_windows.windowed(
        _stream(spark, sf), "ts", "1 day", [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")], ["event_type"]
    )
    done = stream_sources.run_available(counts, mode="update")
    last = done.groupBy("event_type", "window_start").agg(F.max_by(F.struct("n", "total"), "batch_id").alias("s"))
    return last.select("event_type", F.unix_seconds("window_start").alias("window_start"), F.col("s.n").alias("n"),
                       _r("s.total", 2).alias("total"))


@query
def stream_window_features(spark, sf):
    """Equal to the batch windows: the time since a stall of an earlier window included."""
    _rocksdb(spark)
    rows = stream_sources.with_end(_with_k(_stream(spark, sf)), "ts", "2200-01-01")
    feats = stream_windows.window_features(rows, ["event_type"], "ts", "value", "k", F.col("value") < 0.1, 3600, "1 hour", ["event_id"])
    done = stream_sources.run_available(feats)
    return done.select(
        "event_type", F.unix_seconds("window_start").alias("window_start"), "n_samples",
        *[_r(c, 8).alias(c) for c in ("quality_mean", "quality_std", "quality_mad", "bitrate_mean", "stall_ratio", "tsl_end")],
    )


def _event_detector(spark, sf, mode="single"):
    return train(_events(spark, sf), EVENTS, "ts", ["event_id"], mode=mode)


@query
def stream_score_only(spark, sf):
    """Events on a stream against the per-type means of log value and hour."""
    events = _events(spark, sf)
    ready = prep.prepare(events, EVENTS)
    scaler = prep.fit_scaler(ready, EVENTS.features)
    centers = scaler.transform(ready).groupBy("event_type").agg(F.array(F.avg("value"), F.avg("hour")).alias("center"))
    model = cut(uniform_model(centers, "center", "event_type", sigma=1.0, radius=0.5), "refs")
    taus = spark.range(1).select(F.lit(0.0).alias("tau"))
    detector = Detector(EVENTS, scaler, {}, model, taus, 1.0)
    out = stream_scoring.score_stream(_with_k(_stream(spark, sf)).select("event_id", "value", "hour"), detector)
    done = stream_sources.run_available(out.select("event_id", "score", "is_anomaly"))
    return done.select("event_id", _r("score").alias("score"), F.col("is_anomaly").cast("long").alias("is_anomaly"))


@query
def stream_adaptive(spark, sf):
    _rocksdb(spark)
    out = adaptive.adapt_stream(_with_k(_stream(spark, sf)), _event_detector(spark, sf), ["user_id"], ["ts", "event_id"])
    return stream_sources.run_available(out)


@query
def stream_status(spark, sf):
    return adaptive.status(stream_adaptive(spark, sf), ["user_id"], ["ts", "event_id"])


@query
def stream_learn(spark, sf):
    """One model version per micro-batch; returns the headers."""
    path = new_path(spark, "learn")
    _event_detector(spark, sf).save(path, version=0)
    writer = stream_update.learn_batches(_with_k(_stream(spark, sf)), path, EVENTS, "ts", ["event_id"])
    writer.option("checkpointLocation", path + "-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return headers(spark, path, EVENTS.name).select("version", "parent_version", "n_sv", "seen", "tau", "new_rows")
