"""Metrics, blending, ensembles, learned forecasters and versions."""

import datetime as dt
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.base import Tables
from shelfcast.operators import diagnostics as dg
from shelfcast.operators import ensemble as ens
from shelfcast.operators import features as ft
from shelfcast.operators import learners as ln
from shelfcast.operators import metrics as m
from shelfcast.operators import registry as rg
from shelfcast.operators import seasonal as se
from shelfcast.operators.etl import clean_sales
from shelfcast.operators.stacking import ALPHAS, fit_blend, nonnegative_solution
from shelfcast.plans.ensemble import EnsembleModel, build_ensemble, fit_ensemble
from shelfcast.sources.storage import new_path, stage

MODELS = {"a": "pa", "b": "pb", "c": "pc"}
D0 = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(5)
    n = 120
    y = rng.uniform(5, 50, n)
    return [
        (D0 + dt.timedelta(days=i // 4), i % 4, "f", float(y[i]), float(y[i] + rng.normal(0, 2)),
         float(0.5 * y[i] + rng.normal(0, 4)), float(rng.uniform(0, 50)))
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def preds(spark, numbers):
    return spark.createDataFrame(numbers, "date date, store_nbr int, family string, sales double, pa double, pb double, pc double")


def pairs(spark, rows):
    return spark.createDataFrame(rows, "sales double, p double")


def test_metric_families_when_all_actuals_are_zero(spark):
    df = pairs(spark, [(0.0, 2.0)] * 8)
    one = m.aggregate(df, m.ensemble_metrics("sales", "p")).first()
    assert math.isinf(one.mape) and math.isinf(one.wape) and one.forecast_accuracy == 0.0 and one.r2 == 0.0
    two = m.aggregate(df, m.forecaster_metrics("sales", "p")).first()
    assert math.isinf(two.mape) and two.smape == 200.0 and two.r2 == 0.0
    three = m.aggregate(df, m.evaluator_metrics("sales", "p")).first()
    assert three.mape is None and three.bias_pct == 0.0 and three.forecast_accuracy == 0.0


def test_perfect_forecast(spark):
    one = m.aggregate(pairs(spark, [(3.0, 3.0), (0.0, 0.0)]), m.ensemble_metrics("sales", "p")).first()
    assert (one.rmse, one.smape, one.r2) == (0.0, 0.0, 1.0)


def test_forecaster_metrics_floor_predictions(spark):
    one = m.aggregate(pairs(spark, [(0.0, -5.0), (4.0, 4.0)]), m.forecaster_metrics("sales", "p")).first()
    assert one.mae == 0.0


def test_small_segments_and_missing_values_are_told(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0)] * 4 + [(2, 1.0, 2.0)] * 5 + [(1, None, 9.0), (1, 9.0, None)], "s int, sales double, p double")
    got = {r.segment: (r.n_samples, r.n_missing, r.enough_rows, r.mae) for r in m.segment_metrics(df, "s", predicted="p").collect()}
    assert got == {1: (4, 2, False, 0.0), 2: (5, 0, True, 1.0)}
    nulls = df.where("p is null")
    assert m.aggregate(nulls, m.forecaster_metrics("sales", "p")).first().mae is None


def test_directional_accuracy_per_series(spark):
    rows = [(1, "f", i, float(v), float(p)) for i, (v, p) in enumerate([(1, 1), (2, 3), (3, 2), (3, 2)])]
    rows += [(2, "f", i, float(v), float(p)) for i, (v, p) in enumerate([(9, 9), (1, 2)])]
    df = spark.createDataFrame(rows, "store_nbr int, family string, date int, sales double, p double")
    assert m.directional_accuracy(df, "sales", "p").first()[0] == pytest.approx(3 / 4)


def test_directional_accuracy_of_a_whole_table(spark):
    rng = random.Random(3)
    rows = [(i // 7, i % 7, None if i % 50 == 0 else float(rng.randrange(6)), float(rng.randrange(6))) for i in range(3000)]
    df = spark.createDataFrame(rows, "d int, s int, sales double, p double").repartition(5)
    sign = lambda x: (x > 0) - (x < 0)
    same = [sign(b[2] - a[2]) == sign(b[3] - a[3]) for a, b in zip(rows, rows[1:]) if a[2] is not None and b[2] is not None]
    got = m.directional_accuracy(df, "sales", "p", series=(), order=("d", "s"))
    assert got.first()[0] == pytest.approx(sum(same) / len(same))
    assert m.directional_accuracy(df.limit(0), "sales", "p", series=(), order=("d", "s")).first()[0] is None


def test_magnitude_bins_of_few_rows_and_merged_edges(spark):
    few = spark.createDataFrame([(float(i), 1.0) for i in range(99)], "sales double, p double")
    assert sorted(r.n for r in dg.error_by_magnitude(few, predicted="p").collect()) == [9] * 2 + [10] * 8
    one = spark.createDataFrame([(2.0, 1.0)] * 3, "sales double, p double")
    assert dg.error_by_magnitude(one, predicted="p").count() == 0
    tied = spark.createDataFrame([(1.0, 1.0)] * 80 + [(float(i), 1.0) for i in range(2, 42)], "sales double, p double")
    out = dg.error_by_magnitude(tied, predicted="p").orderBy("bin").collect()
    assert sum(r.n for r in out) == 120 and len(out) < 10
    assert out[0].lower_edge == 1.0 and all(r.lower_edge < r.avg_actual <= r.upper_edge for r in out[1:])


def test_histogram_of_constant_residual(spark):
    df = spark.createDataFrame([(2.0,)] * 6, "r double")
    assert [(r.bin, r.n) for r in dg.residual_histogram(df, "r").collect()] == [(0, 6)]


def test_uniform_sample_is_repeatable(spark):
    df = spark.range(1000)
    first = [r.id for r in dg.uniform_sample(df, ["id"], 50).collect()]
    again = [r.id for r in dg.uniform_sample(df.repartition(7), ["id"], 50).collect()]
    assert sorted(first) == sorted(again) and len(set(first)) == 50


def test_report_lines(spark):
    metrics = m.aggregate(pairs(spark, [(2.0, 3.0), (4.0, 4.0)]), m.evaluator_metrics("sales", "p")).withColumns(
        {k: F.lit(0.5) for k in ("median_bias", "directional_accuracy", "error_p50", "error_p90", "error_p95", "error_p99")}
    )
    text = dg.evaluation_report(metrics, "X").first()[0]
    assert "MAE:                 0.50" in text and "Direction:           Over-forecasting" in text
    assert "Accuracy: 50.0%" in text


def brute_nonnegative(x, y, alpha):
    """Projected coordinate descent on centred data."""
    xc, yc = x - x.mean(0), y - y.mean()
    g, t = xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc
    w = np.zeros(x.shape[1])
    for _ in range(5000):
        for j in range(len(w)):
            w[j] = max(0.0, (t[j] - g[j] @ w + g[j, j] * w[j]) / g[j, j])
    return w, y.mean() - w @ x.mean(0)


@pytest.mark.parametrize("true", [[0.5, 0.3, 0.2], [1.0, -0.7, 0.0], [-1.0, -1.0, -1.0]])
def test_nonnegative_solution(true):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 3))
    y = x @ np.array(true) + rng.normal(0, 0.1, 80)
    xc = x - x.mean(0)
    got = nonnegative_solution(xc.T @ xc + np.eye(3), xc.T @ (y - y.mean()))
    assert got == pytest.approx(brute_nonnegative(x, y, 1.0)[0], abs=1e-6)


def test_ridge_blend_matches_direct_folds(preds, numbers):
    blend = fit_blend(preds, "sales", MODELS)
    data = sorted(numbers, key=lambda r: r[:3])
    y, x = np.array([r[3] for r in data]), np.array([r[4:7] for r in data])
    size = len(y) // 4
    scores = {}
    for alpha in ALPHAS:
        each = []
        for k in range(3):
            start = len(y) - size * (3 - k)
            w, b = brute_nonnegative(x[:start], y[:start], alpha)
            gap = y[start : start + size] - x[start : start + size] @ w - b
            each.append(math.sqrt((gap**2).mean()))
        scores[alpha] = np.mean(each)
    assert blend.cv_rmse == pytest.approx(scores, rel=1e-6)
    assert blend.alpha == min(ALPHAS, key=lambda a: scores[a])
    w, b = brute_nonnegative(x, y, blend.alpha)
    assert [blend.coefficients[k] for k in "abc"] == pytest.approx(list(w), abs=1e-6)
    assert blend.intercept == pytest.approx(b, abs=1e-5)


def test_linear_blend(preds, numbers):
    blend = fit_blend(preds, "sales", MODELS, regularized=False)
    y, x = np.array([r[3] for r in numbers]), np.array([r[4:7] for r in numbers])
    w, b = brute_nonnegative(x, y, 0.0)
    assert [blend.coefficients[k] for k in "abc"] == pytest.approx(list(w), abs=1e-6)
    assert sum(blend.weights.values()) == pytest.approx(1.0) and min(blend.weights.values()) >= 0


def test_segment_weights_by_size(spark):
    rows = [(1, float(i), i + 1.0, i + 3.0) for i in range(9)] + [(2, float(i), i + 1.0, i + 3.0) for i in range(10)]
    df = spark.createDataFrame(rows, "s int, sales double, pa double, pb double")
    got = {r.segment: r.weights for r in ens.segment_weights(df, "sales", {"a": "pa", "b": "pb"}, "s").collect()}
    assert got[1] == {"a": 0.5, "b": 0.5}
    assert got[2]["a"] == pytest.approx(0.75) and got[2]["b"] == pytest.approx(0.25)


@pytest.mark.parametrize("method", ens.METHODS)
def test_ensemble_round_trip(spark, preds, method):
    model, out = build_ensemble(preds, preds, MODELS, method, segment_col="store_nbr")
    folder = new_path(spark, "ensemble")
    model.save(folder)
    loaded = EnsembleModel.load(spark, folder)
    again = loaded.predict_with_intervals(preds, MODELS)
    keys = ["date", "store_nbr"]
    cols = ["forecast_ensemble", "forecast_lower", "forecast_upper"]
    a = {tuple(r[:2]): r for r in out.select(*keys, *cols).collect()}
    b = {tuple(r[:2]): r for r in again.select(*keys, *cols).collect()}
    assert len(a) == 120
    for k, r in a.items():
        assert list(b[k])[2:] == pytest.approx(list(r)[2:])
        assert 0 <= r.forecast_lower <= r.forecast_ensemble <= r.forecast_upper
    assert sum(model.weights.values()) == pytest.approx(1.0)
    assert {r.model for r in loaded.comparison.collect()} == {*MODELS, f"ENSEMBLE ({method})"}


def test_unseen_segments_use_global_weights(spark, preds):
    model = fit_ensemble(preds.where("store_nbr < 3"), MODELS, "dynamic_weighted", segment_col="store_nbr")
    other = preds.where("store_nbr = 3")
    want = ens.combine(MODELS, model.weights)
    for r in model.predict(other, MODELS).withColumn("want", want).collect():
        assert r.forecast_ensemble == pytest.approx(max(r.want, 0.0))


def test_ensemble_arguments(preds):
    with pytest.raises(ValueError):
        fit_ensemble(preds, {"a": "pa"})
    with pytest.raises(ValueError):
        fit_ensemble(preds, MODELS, "median")
    with pytest.raises(ValueError):
        fit_ensemble(preds.withColumn("pa", F.when(F.col("store_nbr") > 0, F.col("pa"))), MODELS)


def test_manual_weights(preds):
    model = fit_ensemble(preds, MODELS, "weighted_average").with_weights({"a": 1.0})
    assert all(r.forecast_ensemble == max(r.pa, 0.0) for r in model.predict(preds, MODELS).collect())


def test_periods_without_rows_are_zero(spark):
    days = [dt.date(2020, 1, 5), dt.date(2020, 1, 6), dt.date(2020, 3, 1)]
    df = spark.createDataFrame([(d, 2.0) for d in days], "date date, f double")
    weeks = [(r.period, r.total) for r in ens.weekly_totals(df, "f").orderBy("period").collect()]
    assert weeks[0] == (dt.date(2020, 1, 5), 2.0) and weeks[1] == (dt.date(2020, 1, 12), 2.0)
    assert len(weeks) == 9 and weeks[4][1] == 0.0
    months = [(r.period, r.total) for r in ens.monthly_totals(df, "f").orderBy("period").collect()]
    assert months == [(dt.date(2020, 1, 31), 4.0), (dt.date(2020, 2, 29), 0.0), (dt.date(2020, 3, 31), 2.0)]


def test_contribution_has_top_features(spark):
    weights = spark.createDataFrame([("a", 0.7), ("b", 0.3)], "model string, weight double")
    metrics = spark.createDataFrame([("a", 1.0, 0.1, 2.0)], "model string, rmse double, mape double, training_time_s double")
    features = spark.createDataFrame([("a", f"x{i}", float(i)) for i in range(7)], "model string, feature string, importance double")
    got = {r.model: r for r in ens.contribution_table(weights, metrics, features).collect()}
    assert got["a"].top_features == ["x6", "x5", "x4", "x3", "x2"] and got["b"].standalone_rmse is None


def test_seasonal_fit_recovers_the_signal(spark):
    def value(i, s):
        day = (D0 + dt.timedelta(days=i)).toordinal()
        return s * (50 + 0.1 * i) * (1 + 0.3 * math.sin(2 * math.pi * day / 7) + 0.2 * math.cos(2 * math.pi * day / 365.25))

    rows = [(D0 + dt.timedelta(days=i), s, "f", value(i, s)) for s in (1, 2) for i in range(760)]
    df = spark.createDataFrame(rows, "date date, store_nbr int, family string, sales double")
    train, test = ln.split_by_date(df, 30)
    keys = ["store_nbr", "family"]
    models = se.fit_seasonal(se.daily_by_series(train), keys)
    out = se.forecast_series(models, test, keys).collect()
    assert len(out) == 60
    assert max(abs(r.yhat - r.sales) / r.sales for r in out) < 0.05
    total = se.fit_seasonal(se.daily_totals(train), [])
    assert se.validate_total(total, test).first().mape < 5
    feats = se.seasonal_features(total, test.unionByName(test)).collect()
    assert len(feats) == 120 and all(r.prophet_trend > 0 for r in feats)


def test_short_series_get_their_mean(spark):
    df = spark.createDataFrame([(D0 + dt.timedelta(days=i), 1, "f", float(v)) for i, v in enumerate((2, 4, 6))], "date date, store_nbr int, family string, y double")
    models = se.fit_seasonal(df, ["store_nbr", "family"])
    assert [r.yhat for r in se.forecast_series(models, df, ["store_nbr", "family"]).collect()] == pytest.approx([4.0] * 3)
    assert se.daily_by_series(df.withColumnRenamed("y", "sales")).count() == 3


def test_trees_beat_the_naive_forecast(spark):
    sales = Tables(spark, "/root/testdata/sf0.01").sales
    built = clean_sales(sales).transform(ft.add_time_features).transform(ft.add_lag_features).transform(ft.smart_fill)
    features = ["store_nbr", "onpromotion", "month", "sales_lag_7", "sales_rolling_mean_7", "sales_rolling_mean_28"]
    train, held_out = ln.split_by_date(stage(built, "features"), 365)
    naive = held_out.agg(F.stddev_pop("sales")).first()[0]
    forest = ln.RandomForest(trees=10, depth=6).train(train, held_out, features)
    boosted = ln.BoostedTrees(trees=5, depth=4, learning_rate=0.3, chunk=2).train(train, held_out, features)
    for model in (forest, boosted):
        assert model.metrics["validation"]["rmse"] < naive
        assert model.predict(held_out).agg(F.min("prediction")).first()[0] >= 0
        assert model.importance().count() == len(features)


def test_versions(spark):
    path = new_path(spark, "registry")
    assert rg.best_and_latest(rg.read_registry(spark, path)).first().best_version is None
    for rmse in (5.0, 3.0, 4.0):
        rg.register_version(spark, path, {"ensemble": {"rmse": rmse}, "rf": {"rmse": rmse + 1}})
    rg.register_version(spark, path, {"rf": {"rmse": 1.0}})
    registry = rg.read_registry(spark, path)
    assert tuple(rg.best_and_latest(registry).first()) == ("v2", "v4")
    ranked = rg.ranked_versions(registry).collect()
    assert [r.version for r in ranked] == ["v2", "v3", "v1", "v4"] and ranked[3].n_models == 1


def test_a_row_of_an_unknown_series_is_not_fitted(spark):
    days = spark.createDataFrame([(D0 + dt.timedelta(days=i), s, float(s)) for i in range(3) for s in (1, 2)], "date date, store_nbr int, sales double")
    model = se.SeasonalForecaster(keys=("store_nbr",)).train(days.where("store_nbr = 1"), days, [])
    got = {(r.store_nbr, r.fitted, r.prediction) for r in model.predict(days).collect()}
    assert got == {(1, True, 1.0), (2, False, 1.0)}


def test_registered_trees_are_the_class_defaults():
    from checks.learned import SEED_OF
    from shelfcast.operators.learners import BoostedTrees, RandomForest

    assert SEED_OF == {"xgboost": BoostedTrees(), "rf": RandomForest()}
    assert (SEED_OF["xgboost"].trees, SEED_OF["xgboost"].learning_rate) == (1000, 0.05)
    assert (SEED_OF["rf"].trees, SEED_OF["rf"].depth) == (500, 15)


def _waves(spark, n=1500):
    rows = [(float(i % 97), float(i % 31), 40 + 30 * math.sin((i % 97) / 15) + (i % 31) / 5 + 3 * math.cos(i * 7.3)) for i in range(n)]
    return spark.createDataFrame(rows, "a double, b double, sales double").withColumn("part", F.monotonically_increasing_id() % 3)


def test_boosting_goes_on_while_it_gains_and_is_cut_where_the_error_is_least(spark, tmp_path):
    rows = stage(_waves(spark, 600).coalesce(1), "waves")
    train, held = rows.where("part < 2"), rows.where("part = 2")
    learner = ln.BoostedTrees(trees=110, depth=2, learning_rate=0.03, patience=20, chunk=55, row_share=1.0, feature_share=1.0)
    model = learner.train(train, held, ["a", "b"])
    assert model.trees > 100 and model.curve[model.trees] == min(model.curve)
    own = model.predict(held, "p").agg(F.avg((F.col("sales") - F.col("p")) ** 2)).first()[0]
    assert own == pytest.approx(model.curve[model.trees])  # no forecast is below 0 here
    # the curve is that of the library's model cut after every tree
    from pyspark.ml import PipelineModel

    assembled = PipelineModel(model.model.stages[:1]).transform(held).withColumnRenamed("sales", "label")
    assert model.model.stages[-1].evaluateEachIteration(assembled, "squared") == pytest.approx(model.curve[: model.trees + 1])
    model.save(str(tmp_path / "m"))
    again = ln.TrainedForecaster.load(str(tmp_path / "m"))
    assert (again.trees, again.curve) == (model.trees, model.curve)
    assert again.predict(model.predict(held, "x"), "y").where("x <> y").count() == 0


def test_boosting_stops_after_its_patience(spark):
    noise = spark.range(900).selectExpr("double(id % 7) as a", "double(pmod(xxhash64(id), 100)) as sales", "id % 3 as part")
    rows = stage(noise, "noise")
    model = ln.BoostedTrees(trees=400, depth=5, learning_rate=0.3, patience=6, chunk=5).train(rows.where("part < 2"), rows.where("part = 2"), ["a"])
    assert len(model.curve) - 1 - model.trees >= 6 and len(model.curve) < 60
    none = ln.BoostedTrees(trees=4, depth=2, chunk=3).train(rows, rows.limit(0), ["a"])
    assert none.trees == 4 or len(none.model.stages[-1].treeWeights) == 5


def test_no_feature_knows_the_sales_of_its_row(spark):
    from checks.learned import FEATURE_NAMES, LEFT_OUT
    from shelfcast.plans.features import build_features

    t = Tables(spark, "/root/testdata/sf0.001")
    fact = stage(t.fact, "fact")
    last = fact.agg(F.max("date")).first()[0]
    other = stage(fact.withColumn("sales", F.when(F.col("date") == last, F.col("sales") + 17).otherwise(F.col("sales"))), "fact")
    keys = ["date", "store_nbr", "family"]
    names = [c for c in FEATURE_NAMES if c not in LEFT_OUT and c not in keys]
    one, two = (sorted(map(str, stage(build_features(x).select(*keys, *names), "features").where(F.col("date") == last).collect())) for x in (fact, other))
    assert one and one == two
    assert "is_zero_sales" in LEFT_OUT


def test_a_stored_model_is_trained_once_and_told_apart(spark, tmp_path, monkeypatch):
    from shelfcast.operators import model_store as ms

    rows = stage(_waves(spark, 300).select("a", "b", F.when(F.col("a") > 5, F.col("sales")).alias("sales")), "waves")
    shuffled = rows.repartition(7)
    assert ms.fingerprint(rows, ["a", "b", "sales"]) == ms.fingerprint(shuffled, ["a", "b", "sales"])
    assert ms.fingerprint(rows, ["a", "b", "sales"]) != ms.fingerprint(rows.unionByName(rows.limit(1)), ["a", "b", "sales"])
    nulls = spark.createDataFrame([(None, 1), (1, None)], "a int, b int")
    assert ms.fingerprint(nulls.limit(1), ["a", "b"]) != ms.fingerprint(nulls.where("a = 1"), ["a", "b"])
    forest, calls = ln.RandomForest(trees=7, depth=3, parts=3), []
    train = ln.RandomForest.train
    monkeypatch.setattr(ln.RandomForest, "train", lambda self, *a: calls.append(1) or train(self, *a))
    folder = str(tmp_path / "store")
    first = ms.train_once(folder, forest, rows, rows, ["a", "b"])
    second = ms.train_once(folder, forest, shuffled, rows, ["a", "b"])
    assert len(calls) == 1 and first.metrics == second.metrics and len(second.model.stages[-1].trees) == 7
    assert second.predict(first.predict(rows, "x"), "y").where("not x <=> y").count() == 0
    ms.train_once(folder, ln.RandomForest(trees=7, depth=2, parts=3), rows, rows, ["a", "b"])
    ms.train_once(folder, forest, rows, rows, ["b", "a"])
    assert len(calls) == 3
    total = first.importance().agg(F.sum("importance")).first()[0]
    assert total == pytest.approx(1.0)


def test_versions_registered_at_once_get_numbers_of_their_own(spark):
    from concurrent.futures import ThreadPoolExecutor

    path = new_path(spark, "registry")
    sessions = [spark.newSession() for _ in range(6)]
    with ThreadPoolExecutor(6) as pool:
        names = list(pool.map(lambda i: rg.register_version(sessions[i], path, {"ensemble": {"rmse": 10.0 - i}}, f"session {i}"), range(6)))
    assert sorted(names) == [f"v{i}" for i in range(1, 7)]
    for i, name in enumerate(names):
        held = rg.load_version(spark, path, name)
        assert (held.description, [r.value for r in held.metrics.collect()]) == (f"session {i}", [10.0 - i])
    # metrics that were written but never committed are not there
    spark.createDataFrame([("rf", "rmse", 0.5)], "model string, metric string, value double").write.parquet(f"{path}/metrics/id=lost")
    assert rg.read_registry(spark, path).count() == 6
    with pytest.raises(LookupError):
        rg.load_version(spark, path, "v7")
    with pytest.raises(LookupError):
        rg.load_version(spark, new_path(spark, "registry"))


def test_a_version_brings_its_models(spark):
    rows = stage(_waves(spark, 300), "waves")
    path, keys = new_path(spark, "registry"), ("store_nbr",)
    days = spark.createDataFrame([(D0 + dt.timedelta(days=i), 1, float(5 + i % 7)) for i in range(90)], "date date, store_nbr int, sales double")
    seasonal = se.SeasonalForecaster(keys=keys).train(days, days, [], holidays=days.select("date").limit(3))
    forests = [ln.RandomForest(trees=3, depth=d, parts=2).train(rows, rows, ["a", "b"]) for d in (1, 4)]
    for i, forest in enumerate(forests):
        rg.register_version(spark, path, {"ensemble": {"rmse": 2.0 - i}}, models={"rf": forest, "prophet": seasonal}, parameters={"depth": forest.name, "i": i})
    best = rg.load_version(spark, path, best=True)
    assert (best.version, best.parameters["i"], sorted(best.models)) == ("v2", 1, ["prophet", "rf"])
    assert best.models["rf"].predict(forests[1].predict(rows, "x"), "y").where("x <> y").count() == 0
    assert best.models["prophet"].predict(seasonal.predict(days, "x").drop("fitted"), "y").where("not x <=> y").count() == 0
    registry = rg.read_registry(spark, path)
    assert {tuple(r.models) for r in registry.collect()} == {("prophet", "rf")}
    assert registry.select("parameters_digest").distinct().count() == 2


def test_seasonal_intervals_widen_and_holidays_count(spark):
    holiday = {D0 + dt.timedelta(days=i) for i in range(9, 900, 30)}
    rows = [(D0 + dt.timedelta(days=i), (50 + 0.05 * i + 8 * math.sin(i / 40)) * (1.5 if D0 + dt.timedelta(days=i) in holiday else 1) + math.cos(i * 9.1)) for i in range(900)]
    df = spark.createDataFrame(rows, "date date, y double")
    days = spark.createDataFrame([(d,) for d in holiday], "date date")
    train = df.where(F.col("date") < D0 + dt.timedelta(days=700))
    model = stage(se.fit_seasonal(train, [], days), "model")
    known = model.first()
    assert known.seasonal and known.holiday == pytest.approx(0.5, abs=0.1)
    out = se.forecast_dates(model, df, days).orderBy("date").collect()
    width = [r.yhat_upper - r.yhat_lower for r in out]
    assert max(width[:699]) == pytest.approx(min(width[:699]))
    plain = [w for r, w in zip(out[700:], width[700:], strict=True) if r.date not in holiday]
    assert plain[-1] > plain[0] > width[0]
    short = se.fit_seasonal(train.limit(10), [], days, min_days=11).first()
    assert not short.seasonal and short.bend == 0


def test_features_to_forecasts_as_one_run(spark):
    from shelfcast.plans.forecast import run_forecasts

    draw = random.Random(4)
    rows = [(D0 + dt.timedelta(days=i), s, "f", 10.0 * s + 3 * (i % 7) + draw.random(), i % 7, float(s)) for i in range(120) for s in (1, 2)]
    table = spark.createDataFrame(rows, "date date, store_nbr int, family string, sales double, weekday int, size double")
    table = stage(table, "feature_table")
    learners = {"xgboost": ln.BoostedTrees(trees=6, depth=3, learning_rate=0.5, patience=3, chunk=3, seed=1), "rf": ln.RandomForest(trees=5, depth=4, parts=2), "prophet": se.SeasonalForecaster()}
    path = new_path(spark, "registry")
    run = run_forecasts(table, ["weekday", "size"], learners, stop_days=20, holdout_days=14, registry=path)
    got = run.forecasts.collect()
    assert len(got) == 28 and run.version == "v1"
    naive = statistics.pstdev([r.sales for r in got])
    assert math.sqrt(statistics.mean((r.sales - r.forecast_ensemble) ** 2 for r in got)) < naive / 2
    assert all(r.forecast_lower <= r.forecast_ensemble <= r.forecast_upper for r in got)
    share = {r.model: r for r in run.contributions.collect()}
    assert sum(r.weight for r in share.values()) == pytest.approx(1) and share["prophet"].top_features is None
    assert set(share["rf"].top_features) == {"weekday", "size"} and share["rf"].training_time_s > 0
    held = rg.load_version(spark, path)
    assert set(held.models) == set(learners) and held.parameters["method"] == "inverse_error_weighted"
    assert {r.model for r in held.metrics.collect()} == {"xgboost", "rf", "prophet", "ensemble"}
