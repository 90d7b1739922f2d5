"""Forecasters and reconciliation: exactness where a closed form exists, invariants elsewhere."""

from functools import partial

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from demandloom.models import hierarchical as hm
from demandloom.models import panel_models as pm
from demandloom.models import pretrained as pt
from demandloom.models import segmented as sg
from demandloom.models import series as se
from demandloom.models import smoothing as sm
from demandloom.models import store as ms
from demandloom.models import trees as tr
from demandloom.operators import erm_l1
from demandloom.operators import folds as fd
from demandloom.operators import reconcile as rc

H = 14


@pytest.fixture(scope="module")
def points(toy):
    return fd.cutoffs(toy, H, 2)


def _rmse(pdf, col):
    return float(np.sqrt(((pdf[col] - pdf["y"]) ** 2).mean()))


def test_smoothers_beat_naive_on_a_seasonal_series(toy, points):
    models = {"Theta": partial(sm.theta, season=7), "ETS": partial(sm.ets, season=7)}
    cv = se.series_cv(toy, models, H, points).toPandas()
    base = fd.baseline_cv(toy, H, 2).toPandas()
    assert len(cv) == 2 * H * 3 and np.isfinite(cv[["Theta", "ETS"]].to_numpy()).all()
    assert _rmse(cv, "Theta") < _rmse(base, "Naive") and _rmse(cv, "ETS") < _rmse(base, "Naive")


def test_series_edge_cases():
    for fn in (sm.theta, sm.ets, sm.seasonal_naive):
        for y in (np.zeros(50), np.ones(3), np.array([2.0])):
            ahead, inside = fn(y, 5)
            assert len(ahead) == 5 and np.isfinite(ahead).all() and len(inside) == len(y)
    assert (sm.seasonal_naive(np.arange(10.0), 9)[0] == np.r_[np.arange(3.0, 10), 3, 4]).all()
    assert (sm.seasonal_naive(np.array([1.0, 3.0]), 2)[0] == 2).all()


def test_ets_searches_the_whole_admissible_region():
    """Near a random walk alpha is close to 1, with a fast-moving season gamma is."""
    rng = np.random.default_rng(11)
    walk = np.cumsum(rng.normal(0, 1, 300))
    season = np.cumsum(rng.normal(0, 1, (43, 7)), axis=0).ravel()[:300]
    alpha, gamma = (g.ravel() for g in np.meshgrid(np.linspace(0.0005, 0.9995, 80), np.linspace(0.0005, 0.9995, 80)))
    alpha, gamma = alpha[alpha + gamma <= 1], gamma[alpha + gamma <= 1]
    for y in (walk, season):
        level0 = y[:14].mean()
        sse, *_ = sm._seasonal_pass(y, 7, alpha, gamma, level0, (y[:7] + y[7:14]) / 2 - level0)
        assert max(alpha[sse.argmin()], gamma[sse.argmin()]) > 0.6
        assert ((y - sm.ets(y, 7)[1]) ** 2).sum() <= sse.min() * (1 + 1e-6)


def test_pretrained_hook_sees_only_history(toy, points):
    got = pt.cv_pretrained(toy, pt.seasonal_naive_loader(), H, points).toPandas()
    ref = fd.baseline_cv(toy, H, 2).toPandas()
    both = got.merge(ref, on=["unique_id", "ds", "cutoff"])
    assert len(both) == len(ref) and np.allclose(both["Pretrained"], both["SeasonalNaive"])


def test_global_models_are_finite_and_deterministic(toy):
    for fc, name in ((pm.fc_global_linear, "Linear"), (pm.fc_global_tweedie, "Tweedie"), (pm.fc_segmented, "Segmented")):
        got = fc(toy, 5).orderBy("unique_id", "ds").toPandas()
        assert len(got) == 15 and np.isfinite(got[name]).all()
        assert np.allclose(got[name], fc(toy, 5).orderBy("unique_id", "ds").toPandas()[name])


def test_tree_recursion(toy):
    got = pm.fc_global_tree(toy, 3, iterations=3, depth=3).toPandas()
    assert len(got) == 9 and (got["Trees"] >= 0).all()


def test_segment_fit_equals_ridge_closed_form(toy):
    train = pm.training_frame(toy)
    beta = {r["store_id"]: np.array(r["beta"]) for r in rows(pm.fit_segments(train, ["store_id"]).table)}
    pdf = train.toPandas()
    for store, g in pdf.groupby("store_id"):
        x = np.column_stack([np.ones(len(g)), *[g[f].to_numpy(float) - (2000 if f == "year" else 0) for f in pm.BASE_FEATURES]])
        want = np.linalg.solve(x.T @ x + np.eye(x.shape[1]), x.T @ g["y"].to_numpy())
        assert np.allclose(beta[store], want, rtol=1e-6, atol=1e-6)


def test_count_regression_recovers_weekday_pattern(spark):
    days = pd.date_range("2020-01-06", periods=140)
    data = [(u, d.date(), float(lvl * (3 if d.dayofweek == 5 else 1)), int(d.dayofweek), 1.0, 0) for u, lvl in (("a", 2), ("b", 6)) for d in days]
    df = spark.createDataFrame(data, "unique_id string, ds date, y double, dayofweek int, price_norm double, snap int")
    routes = spark.createDataFrame([("a", "p", "pooled"), ("b", "p", "pooled")], "unique_id string, pool string, route string")
    out = {(r["unique_id"], r["ds"].weekday()): r["CountGLM"] for r in rows(pm.fc_count_glm(df, routes, df.where(F.col("ds") < "2020-01-13").drop("y")))}
    assert abs(out["a", 5] / out["a", 0] - 3) < 0.3 and out["b", 0] > 2 * out["a", 0]


# --- reconciliation --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def small_hierarchy(spark):
    """Total, two groups, four bottom series, with random base forecasts and residuals."""
    rng = np.random.default_rng(3)
    groups = {"T": ["a", "b", "c", "d"], "G": ["a", "b"], "H": ["c", "d"], "a": ["a"], "b": ["b"], "c": ["c"], "d": ["d"]}
    nodes, bottoms = list(groups), ["a", "b", "c", "d"]
    s = np.array([[float(b in groups[n]) for b in bottoms] for n in nodes])
    y_hat, actual = rng.normal(10, 3, (7, 2)), rng.normal(10, 2, (7, 40))
    fitted = actual + rng.normal(0, 1, (7, 40)) * np.arange(1, 8)[:, None]
    base = spark.createDataFrame(
        [(n, y_hat[i].tolist(), fitted[i].tolist(), actual[i].tolist()) for i, n in enumerate(nodes)],
        "node_id string, y_hat array<double>, fitted array<double>, actual array<double>",
    )
    edges = spark.createDataFrame([(b, n, b == n) for n, bs in groups.items() for b in bs], "bottom_id string, node_id string, is_bottom boolean")
    return s, y_hat, fitted, actual, base, edges


def _bottoms(df):
    return np.array([[r["k1"], r["k2"]] for r in sorted(rows(df), key=lambda r: r["bottom_id"])])


def _dense(s, w, y_hat):
    wi = np.linalg.inv(w)
    return np.linalg.solve(s.T @ wi @ s, s.T @ wi @ y_hat)


def test_mintrace_equals_dense_solution(small_hierarchy):
    s, y_hat, fitted, actual, base, edges = small_hierarchy
    res = actual - fitted
    assert np.allclose(_bottoms(rc.recon_mintrace(base, edges, 2, "ols")), _dense(s, np.eye(7), y_hat), atol=1e-6)
    assert np.allclose(_bottoms(rc.recon_mintrace(base, edges, 2, "wls_struct")), _dense(s, np.diag(s.sum(1)), y_hat), atol=1e-6)
    assert np.allclose(_bottoms(rc.recon_mintrace(base, edges, 2, "wls_var")), _dense(s, np.diag((res**2).mean(1)), y_hat), atol=1e-6)


def test_shrunk_covariance_equals_dense_solution(small_hierarchy):
    s, y_hat, fitted, actual, base, edges = small_hierarchy
    res = actual - fitted
    res = res - res.mean(1, keepdims=True)
    t = res.shape[1]
    sd = np.sqrt((res**2).mean(1))
    x = res / sd[:, None]
    corr = x @ x.T / t
    off = ~np.eye(7, dtype=bool)
    spread = sum(((x[i] * x[j] - corr[i, j]) ** 2).sum() for i in range(7) for j in range(7) if i != j)
    lam = np.clip(t / (t - 1) ** 3 * spread / (corr[off] ** 2).sum(), 0, 1)
    weigh_lam = rc.shrunk_weights(rc.settle(rc.standardised_residuals(base)), 2)[1]
    assert abs(weigh_lam - lam) < 1e-9
    w = lam * np.diag(sd**2) + (1 - lam) * res @ res.T / t
    assert np.allclose(_bottoms(rc.recon_mintrace(base, edges, 2, "mint_shrink")), _dense(s, w, y_hat), atol=1e-6)


def test_constant_nodes_leave_the_shrinkage_alone(spark, small_hierarchy):
    rng, actual = np.random.default_rng(5), small_hierarchy[3]
    fitted = actual + rng.normal(0, 2, 40) + rng.normal(0, 1, (7, 40))  # errors in common
    base = spark.createDataFrame([(str(i), [0.0, 0.0], fitted[i].tolist(), actual[i].tolist()) for i in range(7)], small_hierarchy[4].schema)
    res = actual - fitted - (actual - fitted).mean(1, keepdims=True)
    x = res / res.std(1, keepdims=True)
    corr, off = x @ x.T / 40, ~np.eye(7, dtype=bool)
    spread = sum(((x[i] * x[j] - corr[i, j]) ** 2).sum() for i in range(7) for j in range(7) if i != j)
    dense = 40 / 39**3 * spread / (corr[off] ** 2).sum()
    flat = spark.createDataFrame([(f"flat{i}", [1.0, 1.0], [2.0] * 40, [2.0] * 40) for i in range(10)], base.schema)
    intensity = lambda b: rc.shrunk_weights(rc.settle(rc.standardised_residuals(b)), 2)[1]
    assert 0 < dense < 1 and abs(intensity(base) - dense) < 1e-9 and abs(intensity(base.unionByName(flat)) - dense) < 1e-9


def test_days_before_a_series_began_count_for_nothing(spark, small_hierarchy):
    s, y_hat, fitted, actual, base, edges = small_hierarchy
    longer = base.select("node_id", "y_hat", *[F.concat(F.array_repeat(F.lit(float("nan")), 9), c).alias(c) for c in ("fitted", "actual")])
    for method in ("wls_var", "mint_shrink"):
        assert np.isfinite(_bottoms(rc.recon_mintrace(longer, edges, 2, method))).all()
    assert np.allclose(_bottoms(rc.recon_mintrace(longer, edges, 2, "wls_var")), _bottoms(rc.recon_mintrace(base, edges, 2, "wls_var")), atol=1e-6)
    assert np.allclose(_bottoms(rc.recon_erm(longer, edges, 2)), actual[3:] @ np.linalg.solve(fitted.T @ fitted + 0.01 * np.trace(fitted.T @ fitted) / 49 * np.eye(40), fitted.T @ y_hat), atol=1e-6)


def test_unfinished_reconciliation_is_an_error(small_hierarchy):
    s, y_hat, fitted, actual, base, edges = small_hierarchy
    weights = base.select("node_id", F.lit(1.0).alias("w"))
    with pytest.raises(RuntimeError):
        rc.solve_bottom(rc._wide(base, 2), edges, rc.diagonal_weights(weights, 2), rc.system_diagonal(edges, weights), 2, max_iter=1)


def test_erm_dual_equals_primal(small_hierarchy):
    s, y_hat, fitted, actual, base, edges = small_hierarchy
    k = fitted.T @ fitted
    lam = 0.01 * np.trace(k) / len(k)
    primal = actual[3:] @ fitted.T @ np.linalg.inv(fitted @ fitted.T + lam * np.eye(7)) @ y_hat
    assert np.allclose(_bottoms(rc.recon_erm(base, edges, 2)), primal, atol=1e-6)


def test_erm_closed_has_no_penalty(small_hierarchy):
    s, y_hat, fitted, actual, base, edges = small_hierarchy
    dense = actual[3:] @ np.linalg.pinv(fitted) @ y_hat
    assert np.allclose(_bottoms(rc.METHODS["ERM_closed"](base, edges, 2)), dense, atol=1e-6)


def test_erm_reg_bu_is_an_l1_fit(small_hierarchy):
    s, y_hat, fitted, actual, base, edges = small_hierarchy
    want = []
    for i in range(3, 7):  # coordinate descent
        p, left = np.zeros(7), actual[i] - fitted[i]
        for _ in range(5000):
            for j in range(7):
                part = fitted[j] @ (left - p @ fitted + p[j] * fitted[j]) / 40
                p[j] = np.sign(part) * max(abs(part) - 0.01, 0) / (fitted[j] @ fitted[j] / 40)
        want.append(y_hat[i] + p @ y_hat)
    assert np.allclose(_bottoms(rc.METHODS["ERM_reg_bu"](base, edges, 2)), np.array(want), atol=1e-6)
    strong = rc.recon_erm_l1(base, edges, 2, lam=1e6)
    assert np.allclose(_bottoms(strong), y_hat[3:])


def test_l1_fit_meets_its_conditions_with_repeated_rows():
    rng = np.random.default_rng(2)
    x = rng.normal(3, 1, (40, 200)) * rng.uniform(0.1, 100, (40, 1))
    x = np.vstack([x, x[:10], x[:20] + x[20:], np.zeros((2, 200))])
    r = rng.normal(0, 5, 200)
    for lam in (0.01, 1.0, 50.0):
        p = rc.Lasso(x, lam).solve(r)
        slope = x @ (r - p @ x) / 200
        assert np.all(np.abs(slope) <= lam * (1 + 1e-4)) and np.allclose(slope[p != 0], lam * np.sign(p[p != 0]), rtol=1e-3)


def test_hierarchical_forecast_columns(toy):
    statics = toy.select("unique_id", "item_id", "dept_id", "cat_id", "store_id", "state_id").distinct()
    got = hm.hier_forecast(toy, statics, 3, ("BU", "MinT_OLS")).toPandas()
    assert len(got) == 9 and np.isfinite(got[["BU", "MinT_OLS"]].to_numpy()).all()
    with pytest.raises(ValueError):
        hm.hier_forecast(toy, statics, 3, ("Unknown",))


def test_hierarchy_queries_run_every_method(spark):
    """On the smallest tables: every method has a forecast for every series, day and fold."""
    from demandloom.plans import load_all, registry

    load_all()
    methods = {"BU", "MinT_OLS", "MinT_shrink"}
    for name in ("hier_values", "cv_hier_values"):
        got = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert methods <= set(got.columns)
        assert got.where(" OR ".join(f"{m} IS NULL OR isnan({m})" for m in methods)).isEmpty() and not got.isEmpty()


# --- the bordered system ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def folded_hierarchy(spark):
    """Two folds of unlike length over 6 items x 5 stores in 2 states, one series and its days missing in the first fold."""
    rng = np.random.default_rng(9)
    cells = [(i, s) for i in range(6) for s in range(5) if (i + 2 * s) % 7]
    groups: dict[str, list[str]] = {}
    for i, s in cells:
        b = f"b{i}-{s}"
        for n in ("T", f"S{s % 2}", f"D{i % 2}", f"st{s}", f"st{s}D{i % 2}", f"i{i}", f"i{i}S{s % 2}", b):
            groups.setdefault(n, []).append(b)
    bottoms = [f"b{i}-{s}" for i, s in cells]
    edges = [(b, n, b == n, b.split("-")[0]) for n, bs in groups.items() for b in bs]
    base, dense = [], {}
    for fold, t in (("f1", 30), ("f2", 45)):
        gone = bottoms[3] if fold == "f1" else None
        here = [b for b in bottoms if b != gone]
        nodes = [n for n, bs in groups.items() if any(b in here for b in bs)]
        s = np.array([[float(b in groups[n]) for b in here] for n in nodes])
        y_hat, actual = s @ rng.normal(10, 3, (len(here), 2)) + rng.normal(0, 2, (len(nodes), 2)), rng.normal(10, 2, (len(nodes), t))
        fitted = actual + rng.normal(0, 1, t) + rng.normal(0, 1, (len(nodes), t)) * rng.uniform(0.5, 5, (len(nodes), 1))
        if fold == "f2":
            fitted[4] = actual[4]  # a node without variance
        base += [(fold, n, y_hat[k].tolist(), fitted[k].tolist(), actual[k].tolist()) for k, n in enumerate(nodes)]
        dense[fold] = (s, here, y_hat, actual - fitted)
    base = spark.createDataFrame(base, "fold string, node_id string, y_hat array<double>, fitted array<double>, actual array<double>")
    return base.repartition(5), spark.createDataFrame(edges, "bottom_id string, node_id string, is_bottom boolean, block string"), dense


def _covariance(method, s, res):
    if method == "ols":
        return np.eye(len(s))
    if method == "wls_struct":
        return np.diag(s.sum(1))
    if method == "wls_var":
        return np.diag(np.maximum((res**2).mean(1), rc.VAR_FLOOR))
    x, d = rc.bd.standardise(res, np.zeros_like(res))
    t = res.shape[1]
    corr = x @ x.T / t
    off = ~np.eye(len(x), dtype=bool)
    products = x[:, None] * x[None] - corr[:, :, None]
    lam = np.clip(t / (t - 1) ** 3 * (products**2).sum(2)[off].sum() / (corr[off] ** 2).sum(), 1e-4, 1)
    r = x * np.sqrt(d)[:, None]
    return lam * np.diag(d) + (1 - lam) * r @ r.T / t


@pytest.mark.parametrize("method", list(rc.TRACE_METHODS.values()))
def test_bordered_and_iterated_solutions_equal_the_dense_one(folded_hierarchy, method):
    base, edges, dense = folded_hierarchy
    for limit in (None, 0) if method in ("wls_struct", "mint_shrink") else (None,):  # without a border the fallback runs
        # a weight of 1e8 beside others of 1 is too much for conjugate gradients, which stop at a share of the whole
        folds = ["f1"] if limit == 0 and method == "mint_shrink" else ["f1", "f2"]
        found = rc.recon_mintrace(base.where(F.col("fold").isin(folds)), edges, 2, method, limit=limit)
        got = {(r.fold, r.bottom_id): (r.k1, r.k2) for r in found.collect()}
        for fold in folds:
            s, here, y_hat, res = dense[fold]
            want = _dense(s, _covariance(method, s, res), y_hat)
            assert np.allclose([got.pop((fold, b)) for b in here], want, atol=1e-5 if limit is None else 1e-3)
        assert not got
    if method != "wls_var":
        gradient = rc.mintrace_gradient(base, edges, rc.recon_mintrace(base, edges, 2, method), 2, method).collect()
        assert len(gradient) == sum(len(d[1]) for d in dense.values()) and max(abs(r.k1) + abs(r.k2) for r in gradient) < 1e-7
        wrong = rc.recon_mintrace(base, edges, 2, method).withColumn("k1", F.col("k1") + 0.1)
        assert max(abs(r.k1) for r in rc.mintrace_gradient(base, edges, wrong, 2, method).collect()) > 1e-4


# --- many series, many folds -----------------------------------------------------------------


def test_batches_of_theta_equal_single_series():
    rng = np.random.default_rng(4)
    many = [np.maximum(rng.normal(5, 3, n) + 2 * np.sin(np.arange(n) * 2 * np.pi / 7) * (n % 2), 0) for n in (1, 2, 9, 40, 41, 200, 203)]
    many += [np.zeros(30), np.ones(25), rng.uniform(1, 9, 77)]
    for y, (ahead, inside) in zip(many, sm.theta_batch(many, 6)):
        want = sm.theta(y, 6)
        assert np.allclose(ahead, want[0]) and np.allclose(inside, want[1], equal_nan=True)


def test_weekday_median():
    y = np.arange(1.0, 25.0)
    ahead, inside = sm.weekday_median(y, 9, 7, 3)
    assert ahead[0] == np.median([18, 11, 4]) and ahead[7] == ahead[0] and ahead[8] == ahead[1]
    assert np.isnan(inside[:7]).all() and inside[7] == 1 and inside[21] == np.median([1, 8, 15])
    assert (sm.weekday_median(np.array([4.0, 6.0]), 3)[0] == [5, 5, 5]).all() and (sm.weekday_median(np.zeros(0), 2)[0] == 0).all()


def test_folds_know_nothing_of_later_days(toy, points):
    statics = toy.select("unique_id", "item_id", "dept_id", "cat_id", "store_id", "state_id").distinct()
    methods = ("BU", "MinT_OLS", "MinT_shrink")
    both = hm.cv_hier(toy, statics, H, points, methods).toPandas().sort_values(["cutoff", "unique_id", "ds"])
    assert len(both) == 2 * 3 * H
    early = toy.withColumn("y", F.when(F.col("ds") > points[0], F.col("y") * 3).otherwise(F.col("y")))
    again = hm.cv_hier(early, statics, H, points, methods).toPandas().sort_values(["cutoff", "unique_id", "ds"])
    first = (both["cutoff"] == both["cutoff"].min()).to_numpy()
    assert np.allclose(both[first][list(methods)], again[first][list(methods)])
    assert not np.allclose(both[~first][list(methods)], again[~first][list(methods)])
    # one fold alone gives the same
    alone = hm.hier_forecast(toy.where(F.col("ds") <= points[1]), statics, H, methods, end=points[1]).toPandas().sort_values(["unique_id", "ds"])
    assert np.allclose(both[~first][list(methods)], alone[list(methods)])


def test_all_nodes_are_coherent(toy):
    statics = toy.select("unique_id", "item_id", "dept_id", "cat_id", "store_id", "state_id").distinct()
    nodes = hm.hier_forecast(toy, statics, 3, ("BU", "MinT_OLS"), bottom_only=False).toPandas()
    bottom = nodes[nodes["level_idx"] == 11]
    assert set(nodes["level_idx"]) == set(range(12)) and np.isfinite(nodes["base"]).all()
    for _, level in nodes.groupby("level_idx"):
        assert np.allclose(level.groupby("ds")[["BU", "MinT_OLS"]].sum(), bottom.groupby("ds")[["BU", "MinT_OLS"]].sum())
    assert np.allclose(bottom["BU"], bottom["base"])


@pytest.mark.parametrize("lam", [0.01, 2.0])
def test_l1_regressions_over_blocks_of_nodes(spark, lam, monkeypatch):
    monkeypatch.setattr(erm_l1, "NAMED", 2)  # working sets grow over many rounds
    rng = np.random.default_rng(12)
    x = rng.normal(0, 1, (25, 60)) * rng.uniform(0.5, 30, (25, 1))
    x = np.vstack([x, x[:3], np.zeros((1, 60))])
    ahead, r = rng.normal(0, 1, (29, 2)), rng.normal(0, 4, (5, 60))
    r, ahead[25:28] = np.vstack([r, np.zeros((1, 60))]), ahead[:3]  # repeated rows may share a weight in any way
    nodes = spark.createDataFrame([(f"n{k}", bytearray(x[k].tobytes()), bytearray(ahead[k].tobytes())) for k in range(29)], "node_id string, x binary, y binary")
    series = spark.createDataFrame([(f"s{k}", bytearray(v.tobytes()), bytearray(np.ones(2).tobytes())) for k, v in enumerate(r)], "bottom_id string, r binary, own binary")
    got = {g.bottom_id: g for g in erm_l1.l1_regressions(nodes, series, lam, 2, node_block=7).collect()}
    assert len(got) == 6 and max(g.gap for g in got.values()) <= erm_l1.TOLERANCE
    for k in range(5):
        p = erm_l1.Lasso(x, lam).solve(r[k])
        assert np.allclose([got[f"s{k}"].k1, got[f"s{k}"].k2], 1 + p @ ahead, atol=1e-3)
        assert got[f"s{k}"].alive >= got[f"s{k}"].used
    assert got["s5"].k1 == 1 and got["s5"].used == 0


def test_segments_of_all_folds_equal_single_fits(toy, points):
    spark = toy.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit("2019-12-01").cast("date"), F.lit("2021-01-01").cast("date"))).alias("ds"))
    calendar = days.select("ds", F.when(F.dayofmonth("ds") == 5, "fair").otherwise("none").alias("event_name_1"), (F.dayofmonth("ds") <= 10).cast("int").alias("snap_NORTH"))
    cuts = se.as_dates(toy, points)
    train = sg.settle(sg.segment_frame(toy, calendar, ["NORTH"], F.lit(min(cuts))))
    models = sg.fit_folds(train, ["store_id"], cuts)
    pdf = train.toPandas()
    for m in models.collect():
        part = pdf[(pdf["store_id"] == m.store_id) & (pd.to_datetime(pdf["ds"]) <= pd.Timestamp(m.cutoff))]
        x = sg._design(part, sg.FEATURES)
        want = np.linalg.solve(x.T @ x + sg.RIDGE * np.eye(x.shape[1]), x.T @ part["y"].to_numpy(dtype=float))
        assert np.allclose(m.beta, want, atol=1e-6)
    zeros = [r.equation for r in sg.score_equations(train, models, ["store_id"], cuts).collect()]
    assert len(zeros) == models.count() * (len(sg.FEATURES) + 1) and max(map(abs, zeros)) < 1e-9
    cv = sg.cv_segmented(toy, calendar, H, points, ["store_id"], states=["NORTH"]).toPandas()
    base = fd.baseline_cv(toy, H, 2).toPandas()
    assert len(cv) == 2 * H * 3 and _rmse(cv, "Segmented") < _rmse(base, "SeasonalNaive")
    later = toy.withColumn("y", F.when(F.col("ds") > points[0], 99.0).otherwise(F.col("y")))
    again = sg.cv_segmented(later, calendar, H, points, ["store_id"], states=["NORTH"]).toPandas()
    keys = ["unique_id", "ds"]
    one, two = (c[c["cutoff"] == c["cutoff"].min()].sort_values(keys)["Segmented"].to_numpy() for c in (cv, again))
    assert np.allclose(one, two)


def _fair(spark):
    days = spark.range(1).select(F.explode(F.sequence(F.lit("2019-12-01").cast("date"), F.lit("2021-01-01").cast("date"))).alias("ds"))
    return days.select("ds", F.when(F.dayofmonth("ds") == 5, "fair").otherwise("none").alias("event_name_1"), (F.dayofmonth("ds") <= 10).cast("int").alias("snap_NORTH"))


def test_written_forest_is_the_fitted_one(toy, points):
    calendar, point = _fair(toy.sparkSession), points[1]
    past = toy.where(F.col("ds") <= point)
    recent = tr.recent_rows(past, point)
    nodes, start = tr.trained(recent, calendar, ["NORTH"], point, rounds=6, trees=4, depth=4, step=0.5)
    state = tr.forecast_states(recent, calendar, H, states=["NORTH"], end=point)
    forest = tr.assemble(nodes, tr.FEATURES, start)
    assert len(forest.roots) == 24 and 1 <= forest.depth <= 4
    ahead = tr.forecast(state, H, nodes, start).toPandas()
    assert len(ahead) == 3 * H and (ahead["Trees"] > 0).all()
    again = tr.first_step_by_joins(state, nodes, start).toPandas()
    both = ahead.merge(again, on=["unique_id", "ds"])
    assert len(both) == 3 and np.allclose(both["Trees_x"], both["Trees_y"])
    truth = fd.fold_test(toy, [point], H).toPandas().merge(ahead, on=["unique_id", "ds"])
    base = fd.baseline_cv(toy, H, 2).toPandas()
    assert _rmse(truth, "Trees") < _rmse(base[base["cutoff"] == base["cutoff"].max()], "SeasonalNaive")


def test_a_published_model_scores_like_the_one_in_memory(spark, toy, tmp_path):
    store = str(tmp_path)
    with pytest.raises(ValueError):
        ms.load(spark, store)
    scorer = ms.train_linear(toy)
    ms.publish(toy, scorer, store, "first")
    wrong = pm.Scorer(scorer.features, tuple(0.0 for _ in scorer.features), 7.0)
    ms.publish(toy, wrong, store, "second")
    (tmp_path / "published" / "00000009").mkdir()  # a writer that died
    stored = ms.load(spark, store)
    assert stored.version == "second" and stored.scorer == wrong
    ms.publish(toy, scorer, store, "third")
    stored = ms.load(spark, store)
    asked = spark.createDataFrame([("tea-green_north-1",), ("tea-green_north-1",), ("nobody",)], "unique_id string")
    ahead, unknown = ms.score_ids(stored, asked, 5)
    memory = {(r.unique_id, r.ds): r.y_hat for r in pm.recurse_batches(pm.forecast_state(toy), 5, scorer, "y_hat").collect()}
    got = {(r.unique_id, r.ds): r.y_hat for r in ahead.collect()}
    assert len(got) == 5 and all(abs(memory[k] - v) < 1e-9 for k, v in got.items())
    assert [r.unique_id for r in unknown.collect()] == ["nobody"]
    own, rejects = ms.score_histories(stored, toy.select("unique_id", "ds", "y").where("unique_id <> 'soap-oak_south-1' OR ds < '2020-01-20'"), 5)
    assert {r.unique_id for r in rejects.collect()} == {"soap-oak_south-1"}
    assert {(r.unique_id, r.ds): round(r.y_hat, 9) for r in own.collect()} == {k: round(v, 9) for k, v in memory.items() if k[0] != "soap-oak_south-1"}


@pytest.mark.parametrize("days", [9, 150])
def test_folds_of_few_nodes_need_no_column_per_day(spark, folded_hierarchy, days):
    """Residuals are turned into as many columns as nodes; with more nodes than days they stay, and either has the products of all days."""
    nodes = 24
    rng = np.random.default_rng(3)
    x = {fold: rng.normal(0, 1, (nodes, days)) for fold in ("a", "b")}
    rows = spark.createDataFrame([(f, f"n{k:02}", b"", 1.0, bytearray(x[f][k].tobytes())) for f in x for k in range(nodes)], "fold string, node_id string, y binary, w double, x binary")
    kept, shrink = rc.bd.shrinkage(rows.repartition(7), nodes, rc.shrinkage_intensity)
    for fold in x:
        own = (x[fold] ** 2).mean(axis=1, keepdims=True)
        some = shrink[fold]
        assert some.side == min(nodes, days) and some.inner.shape == (some.side, some.side) and some.light.inner is None
        assert abs(some.lam - rc.shrinkage_intensity(x[fold].T @ x[fold], (own**2).sum(), ((x[fold] ** 2 - own) ** 2).sum())) < 1e-9
        got = kept.where(F.col("fold") == fold).orderBy("node_id").toPandas()
        low = rc.bd._values(got["x"], some.side)
        assert np.allclose(low @ low.T, x[fold] @ x[fold].T)
        assert np.allclose(some.inner, np.eye(some.side) + (1 - some.lam) / (days * some.lam) * low.T @ low)


def test_a_backtest_writes_no_histories(toy, points, monkeypatch):
    """Fitted values are as many as nodes x days x folds: cv_hier neither settles them nor the residuals as long as the days."""
    statics = toy.select("unique_id", "item_id", "dept_id", "cat_id", "store_id", "state_id").distinct()
    written = []
    for module in (hm, rc, rc.bd):
        monkeypatch.setattr(module, "settle", lambda df, settle=module.settle: written.append(out := settle(df)) or out)
    got = hm.cv_hier(toy, statics, H, points, ("BU", "MinT_OLS", "MinT_shrink")).toPandas()
    assert len(got) == 2 * 3 * H and np.isfinite(got[["BU", "MinT_OLS", "MinT_shrink"]].to_numpy()).all()
    assert written and not any({"fitted", "actual"} & set(df.columns) for df in written)
    nodes = hm.keyed_edges(statics).select("node_id").distinct().count()
    assert all(r["n"] <= 8 * nodes for df in written if "x" in df.columns for r in df.select(F.max(F.octet_length("x")).alias("n")).collect())


def test_l1_fit_closes_its_gap_on_sums_of_series():
    """Nodes that are sums of each other, with penalties far below the correlations: the gap of every series is closed."""
    rng = np.random.default_rng(0)
    y = rng.poisson(rng.uniform(200, 900, (12, 1)) * (1 + 0.1 * np.sin(np.arange(400) / 9))).astype(float)
    level = np.array([np.convolve(np.r_[np.full(20, v[0]), v], np.full(20, 1 / 20))[20:420] for v in y])
    s = np.vstack([np.ones((1, 12)), np.repeat(np.eye(3), 4, axis=1), np.tile(np.eye(4), 3), np.repeat(np.eye(6), 2, axis=1), np.eye(12), np.eye(12)])
    one = rc.Lasso(s @ level, 0.01)
    for r in y - level:
        power = float(r @ r) / len(r)
        p, gap = one.fit(one.x @ r / len(r), power)
        left = r - p @ one.x
        assert gap <= 1e-6 * power and np.all(np.abs(one.x @ left) / len(r) <= one.lam * (1 + 1e-3))
