"""Metrics, score axes, value added, diagnostics and intervals on the toy backtest."""

import datetime as dt

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from demandloom.operators import demand as dm
from demandloom.operators import diagnostics as dg
from demandloom.operators import fva
from demandloom.operators import hierarchy as hr
from demandloom.operators import intervals as iv
from demandloom.operators import metrics as m
from demandloom.operators import scoring as s


def _day(k):
    return dt.date(2020, 1, 1) + dt.timedelta(days=k)


def test_components(spark, toy_scoring):
    comp = toy_scoring.components.toPandas()
    assert abs(comp["weight"].sum() - 1) < 1e-12 and (comp["scale"] > 0).all()
    data = [("flat", _day(k), 2.0) for k in range(5)] + [("one", _day(0), 1.0)] + [("up", _day(k), float(k)) for k in range(5)]
    got = {r["unique_id"]: (r["weight"], r["scale"]) for r in rows(m.wrmsse_components(spark.createDataFrame(data, "unique_id string, ds date, y double")))}
    assert set(got) == {"one", "up"} and got["one"][1] is None and got["up"][1] == 1.0 and abs(got["up"][0] - 10 / 21) < 1e-12


def test_perfect_is_zero_and_first(toy_scoring):
    got = rows(m.wrmsse_for_models(toy_scoring.cv, toy_scoring.components))
    assert got[0]["model"] == "Exact" and got[0]["wrmsse"] == 0 and len(got) == 3
    head = rows(s.score_headline(toy_scoring))
    bias = {r["model"]: r["bias"] for r in head}
    assert abs(bias["High"] - 2.25) < 1e-9 and bias["Exact"] == 0


def test_no_overlap_raises(spark, toy_scoring):
    other = toy_scoring.cv.withColumn("unique_id", F.lit("stranger"))
    with pytest.raises(ValueError):
        m.wrmsse(other, other, toy_scoring.components, "Naive")
    with pytest.raises(ValueError):
        m.wrmsse(toy_scoring.cv, other, toy_scoring.components, "Naive")


def test_weighted_and_plain_means_differ_as_they_should(toy_scoring):
    ps = m.per_series_metrics(toy_scoring.long, toy_scoring.scales)
    pdf = ps.join(toy_scoring.components, "unique_id").toPandas()
    got = {r["model"]: r["rmse"] for r in rows(m.aggregate_series_metrics(ps, toy_scoring.components))}
    for model, g in pdf.groupby("model"):
        assert abs(got[model] - np.average(g["rmse"], weights=g["weight"])) < 1e-9


def test_axes(toy_scoring):
    assert len(rows(s.score_per_fold(toy_scoring))) == 6
    assert {r["h"] for r in rows(s.score_per_horizon(toy_scoring))} == set(range(1, 15))
    seg = rows(s.score_per_segment(toy_scoring, "store_id"))
    assert {(r["segment"], r["n_series"]) for r in seg} == {("north-1", 2), ("south-1", 1)}
    assert rows(s.score_per_segment(toy_scoring, "absent")) == []
    levels = rows(s.score_per_level(toy_scoring))
    assert len({r["level_idx"] for r in levels}) == 12
    assert all(r["wrmsse"] < 1e-9 for r in levels if r["model"] == "Exact")
    bottom = {r["model"]: r["wrmsse"] for r in levels if r["level_idx"] == hr.BOTTOM}
    flat = {r["model"]: r["wrmsse"] for r in rows(m.wrmsse_for_models(toy_scoring.cv, toy_scoring.components))}
    assert all(abs(bottom[k] - flat[k]) < 1e-9 for k in flat)


def test_missing_attribute_is_an_error(toy_scoring):
    from dataclasses import replace

    with pytest.raises(ValueError):
        s.score_per_level(replace(toy_scoring, statics=toy_scoring.statics.drop("item_id")))


def test_hierarchy_sums(toy):
    nodes = hr.hier_aggregate(toy).toPandas()
    totals = nodes.groupby(["level_idx", "ds"])["y"].sum().unstack(0)
    assert np.allclose(totals.to_numpy(), totals[[0]].to_numpy())
    edges = hr.hier_edges(toy.select("unique_id", *hr.PLACE_PRODUCT).distinct())
    assert edges.count() == 36


def test_rank_helpers(spark, toy_scoring):
    table = spark.createDataFrame([("a", -3.0), ("b", 0.5), ("c", float("nan"))], "model string, bias double")
    assert [(r["model"], r["rank"]) for r in rows(s.metric_rank(table, "bias").orderBy("rank"))] == [("b", 1), ("a", 2)]
    with pytest.raises(ValueError):
        s.lift_vs_baseline(m.wrmsse_for_models(toy_scoring.cv, toy_scoring.components), "absent")


def test_fva(toy_scoring):
    star = {r["model"]: r for r in rows(fva.fva_star(toy_scoring, "Naive"))}
    assert star["Exact"]["fva_abs"] > 0 and abs(star["Exact"]["fva_pct"] - 1) < 1e-9
    chain = rows(fva.fva_chain(toy_scoring, ["Naive", "High", "Exact"]).orderBy("pos"))
    assert chain[0]["is_baseline"] and chain[0]["fva_abs"] == 0 and chain[2]["previous"] == "High"
    net = sum(r["fva_abs"] for r in chain)
    assert abs(net - (chain[0]["error_step"] - chain[2]["error_step"])) < 1e-9
    for bad in (lambda: fva.fva_star(toy_scoring, "absent"), lambda: fva.fva_star(toy_scoring, "Naive", "mape"), lambda: fva.fva_chain(toy_scoring, ["Naive"])):
        with pytest.raises(ValueError):
            bad()


def test_concentration_ends_at_one_and_skips_perfect(toy_scoring):
    got = rows(dg.error_concentration(toy_scoring))
    assert {r["model"] for r in got} == {"High", "Naive"}
    last = [r for r in got if r["rank"] == 3]
    assert all(abs(r["cum_weight"] - 1) < 1e-9 and abs(r["cum_error_share"] - 1) < 1e-9 for r in last) and len(last) == 2


def test_bootstrap(toy_scoring):
    got = {(r["model_a"], r["model_b"]): r["p_value"] for r in rows(dg.bootstrap_pvalues(toy_scoring, n_iter=50))}
    again = {(r["model_a"], r["model_b"]): r["p_value"] for r in rows(dg.bootstrap_pvalues(toy_scoring, n_iter=50))}
    assert got == again and len(got) == 9
    assert got["Naive", "Naive"] == 1 and got["Exact", "High"] == 0 and got["High", "Exact"] == 1


def test_bias_variance_identity(toy_scoring):
    for r in rows(dg.bias_variance(toy_scoring)):
        assert abs(r["bias_sq"] + r["variance"] - r["mse"]) < 1e-9


def test_exemplars_are_distinct(toy_scoring):
    ids = [r["unique_id"] for r in rows(dg.exemplar_series(toy_scoring.train))]
    assert len(ids) == len(set(ids)) == 3


def test_intervals(toy_scoring):
    cv = toy_scoring.cv.join(toy_scoring.statics, "unique_id")
    for method, group in (("pooled", None), ("scaled", None), ("grouped", "dept_id")):
        out = iv.conformal_apply(iv.conformal_fit(cv, "Naive", method=method, group_col=group), cv)
        assert out.where((F.col("Naive_lo") > F.col("Naive_hi")) | (F.col("Naive_lo") < 0)).count() == 0
        if method == "pooled":
            assert iv.interval_coverage(out, "Naive").first()["coverage"] >= 0.8
    strict = iv.conformal_fit(cv, "Naive", method="grouped", group_col="dept_id", enforce_min_group=True)
    assert strict.grouped.count() == 0
    bare = iv.conformal_apply(iv.conformal_fit(cv, "Naive"), toy_scoring.cv.where(F.col("cutoff") == _day(171)).drop("cutoff"))
    assert bare.where(F.col("Naive_hi").isNull()).count() == 0
    with pytest.raises(ValueError):
        iv.conformal_fit(cv, "Naive", method="other")
    with pytest.raises(ValueError):
        iv.conformal_fit(cv, "Naive", method="grouped")


def test_intermittency_and_requests(spark, toy):
    data = [("never", _day(k), 0.0) for k in range(4)] + [("rare", _day(k), 3.0 if k == 0 else 0.0) for k in range(4)]
    data += [("rare2", _day(k), 3.0 if k == 1 else 0.0) for k in range(4)] + [("steady", _day(k), 5.0) for k in range(4)]
    profile = dm.intermittency_profile(spark.createDataFrame(data, "unique_id string, ds date, y double"))
    kinds = {r["unique_id"]: r["demand_class"] for r in rows(profile)}
    assert kinds == {"never": "no_demand", "rare": "intermittent", "rare2": "intermittent", "steady": "smooth"}
    pools = spark.createDataFrame([(k, "p") for k in kinds], "unique_id string, dept string")
    routes = {r["unique_id"]: r["route"] for r in rows(dm.demand_route(profile, pools, "dept"))}
    assert routes == {"never": "univariate", "rare": "pooled", "rare2": "pooled", "steady": "univariate"}

    asked = spark.createDataFrame([("tea-green_north-1",), ("tea-green_north-1",), ("nobody",)], "unique_id string")
    assert dm.score_requests_by_id(asked, toy, 5).count() == 5
    assert [r["unique_id"] for r in rows(dm.request_rejects_by_id(asked, toy))] == ["nobody"]
    history = spark.createDataFrame([(" ", _day(0), 1.0), ("nobody", _day(0), -1.0)], "unique_id string, ds date, y double")
    assert {r["reasons"] for r in rows(dm.validate_requests(history, toy, min_rows=1))} == {"blank_id,unknown_id", "negative_y,unknown_id"}


def test_resampled_sums_are_the_same_in_any_number_of_blocks(spark):
    import hashlib

    terms = spark.createDataFrame([(k, float(k), 1.0) for k in range(7)], "_pick long, a double, b double")
    want = [sum(int(hashlib.md5(f"42:{i}:{j}".encode()).hexdigest()[:16], 16) % 7 for j in range(7)) for i in range(20)]
    for rows_ in (None, 3):
        got = {r.iteration: (r.a, r.b) for r in dg.resampled_sums(terms, 7, ["a", "b"], 20, 42, rows_).collect()}
        assert got == {i: (float(w), 7.0) for i, w in enumerate(want)}


@pytest.mark.parametrize("name, column", [("conformal_fit_pooled", "q"), ("conformal_fit_grouped", "q"), ("conformal_fit_scaled", "q"), ("interval_width", "avg_width"), ("coverage_by_step", "avg_width"), ("alpha_sweep", "avg_width"), ("method_compare", "avg_width"), ("calibration_deciles", "mean_forecast")])
def test_interval_queries_are_not_constant(spark, name, column):
    from demandloom.plans import load_all, registry

    load_all()
    values = [r[column] for r in registry.QUERIES[name](spark, "/root/testdata/sf0.01").collect()]
    # units are whole, so widths of unlike steps may be equal; constant ones are not
    assert max(values) > 0 and len(set(values)) >= min(4, len(values))
