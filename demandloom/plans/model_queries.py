"""Registered queries: folds, forecasters, reconciliation."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from demandloom.functions.expr import ratio, rounded
from demandloom.models import hierarchical as hm
from demandloom.models import panel_models as pm
from demandloom.models import pretrained as pt
from demandloom.models import segmented as sg
from demandloom.models import series as se
from demandloom.models import smoothing as sm
from demandloom.models import store as ms
from demandloom.models import trees as tr
from demandloom.operators import demand as dm
from demandloom.operators import features as ft
from demandloom.operators import folds as fd
from demandloom.operators import hierarchy as hr
from demandloom.operators import reconcile as rc
from demandloom.operators.erm_l1 import TOLERANCE
from demandloom.plans.inputs import H, REGIONS, Data
from demandloom.plans.registry import query
from demandloom.plans.score_queries import _level_rows, _slash
from demandloom.plans.sql import STATIC, R, sql
from demandloom.session import fresh_path

SN = "SeasonalNaive"
THETA = partial(sm.theta, season=7)
ETS = partial(sm.ets, season=7)
HIER_METHODS = ("BU", "MinT_OLS", "MinT_shrink")


@query(
    "cv_folds",
    sql(
        """SELECT fold, cutoff, count(*) FILTER (WHERE ds <= cutoff) AS n_train, count(*) FILTER (WHERE ds > cutoff AND ds <= cutoff + 28) AS n_test
        FROM panel, folds GROUP BY fold, cutoff""",
        "panel",
        "folds",
    ),
)
def _folds(d: Data):
    table = fd.fold_table(d.panel, H, 3, end=d.end).select("fold", "cutoff")
    train = fd.fold_train(d.panel, d.points).groupBy("cutoff").agg(F.count("*").alias("n_train"))
    test = fd.fold_test(d.panel, d.points, H).groupBy("cutoff").agg(F.count("*").alias("n_test"))
    return table.join(train, "cutoff").join(test, "cutoff")


@query("baseline_cv", sql(f"SELECT unique_id, ds, cutoff, y, Naive, {R(SN)} AS {SN} FROM cv", "cv"))
def _baseline_cv(d: Data):
    return rounded(fd.baseline_cv(d.panel, H, 3, end=d.end))


@query(
    "fc_naive",
    sql("SELECT unique_id, last_ds + k::INTEGER AS ds, y AS Naive FROM panel JOIN last_day ON ds = last_ds, range(1, 29) t(k)", "panel", "last_day"),
)
def _fc_naive(d: Data):
    return fd.baseline_forecast(d.panel, H, end=d.end).select("unique_id", "ds", "Naive")


@query(
    "fc_seasonal_naive",
    sql(
        f"""SELECT unique_id, last_ds + k::INTEGER AS ds, y AS {SN} FROM panel, last_day, range(1, 29) t(k) WHERE panel.ds = last_ds - 6 + CAST((k - 1) % 7 AS INTEGER)""",
        "panel",
        "last_day",
    ),
)
def _fc_seasonal(d: Data):
    return fd.baseline_forecast(d.panel, H, end=d.end).select("unique_id", "ds", SN)


@query("ensemble", sql(f"SELECT unique_id, ds, cutoff, y, {R(f'0.25 * Naive + 0.75 * {SN}')} AS ensemble FROM cv", "cv"))
def _ensemble(d: Data):
    return rounded(fd.ensemble(d.cv, ["Naive", SN], [1.0, 3.0]).select("unique_id", "ds", "cutoff", "y", "ensemble"))


@query("fc_theta")
def _fc_theta(d: Data):
    return rounded(se.series_forecast(d.small, {"Theta": THETA}, H, d.end))


@query("fc_ets")
def _fc_ets(d: Data):
    return rounded(se.series_forecast(d.small, {"AutoETS": ETS}, H, d.end))


@query("fc_stats_bundle")
def _fc_bundle(d: Data):
    models = {"Theta": THETA, "AutoETS": ETS, SN: partial(sm.seasonal_naive, season=7)}
    return rounded(se.series_cv(d.small, models, H, d.points))


@query(
    "apply_series_model",
    sql(
        f"""SELECT p.unique_id, p.ds, f.cutoff, p.y, {R('h.mean_y')} AS Mean FROM panel p JOIN folds f ON p.ds > f.cutoff AND p.ds <= f.cutoff + 28
        JOIN hist h ON h.unique_id = p.unique_id AND h.cutoff = f.cutoff AND h.rn = 1""",
        "hist",
    ),
)
def _apply_series(d: Data):
    return rounded(se.apply_series_model(d.panel, sm.mean_model, "Mean", H, d.points))


@query("fc_pretrained", sql(f"SELECT unique_id, last_ds + k::INTEGER AS ds, y AS Pretrained FROM panel, last_day, range(1, 29) t(k) WHERE panel.ds = last_ds - 6 + CAST((k - 1) % 7 AS INTEGER)", "panel", "last_day"))
def _fc_pretrained(d: Data):
    return pt.fc_pretrained(d.panel, pt.seasonal_naive_loader(), H)


@query("cv_pretrained", sql(f"SELECT unique_id, ds, cutoff, y, {R(SN)} AS Pretrained FROM cv", "cv"))
def _cv_pretrained(d: Data):
    return rounded(pt.cv_pretrained(d.panel, pt.seasonal_naive_loader(), H, d.points))


@query(
    "future_exog",
    sql(
        f"""SELECT unique_id, store_id, last_ds + k::INTEGER AS ds, {R('price', 8)} AS sell_price, CAST(day(last_ds + k::INTEGER) <= 10 AS INTEGER) AS early
        FROM (SELECT unique_id, store_id, arg_max(sell_price, ds) FILTER (WHERE sell_price IS NOT NULL) AS price FROM panel GROUP BY ALL), last_day, range(1, 29) t(k)""",
        "panel",
        "last_day",
    ),
)
def _future_exog(d: Data):
    out = pm.future_exog(d.panel, _future_calendar(d), H)
    return rounded(out.select("unique_id", "store_id", "ds", "sell_price", "early"), 8)


def _future_calendar(d: Data):
    """Days after the panel with their flags."""
    days = d.spark.range(1).select(F.explode(F.sequence(F.date_add(d.end, 1), F.date_add(d.end, H))).alias("ds"))
    dom = F.dayofmonth("ds")
    flags = {"snap_AFRICA": dom <= 10, "snap_AMERICA": (dom > 10) & (dom <= 20), "snap_ASIA": dom > 20, "early": dom <= 10}
    return days.withColumns({k: v.cast("int") for k, v in flags.items()}).withColumn("event_name_1", F.lit("none"))


@query("fc_global_linear")
def _fc_linear(d: Data):
    return rounded(pm.fc_global_linear(d.panel, H))


@query("fc_global_tweedie")
def _fc_tweedie(d: Data):
    return rounded(pm.fc_global_tweedie(d.panel, H))


_FEATURE_ROWS = "(SELECT unnest([" + ", ".join(f"'{f}'" for f in ("intercept", *sg.FEATURES)) + "]) AS feature)"


def _long_calendar(d: Data):
    """The calendar of the panel and of the horizon behind it."""
    future = _future_calendar(d)
    return d.calendar.unionByName(future.select(*d.calendar.columns))


def _equations(d: Data, points, keys):
    """The conditions of every coefficient, segment and fold on a second pass over the data: zeros."""
    cuts = se.as_dates(d.facts, points)
    train = hm.settle(sg.segment_frame(d.panel, d.calendar, REGIONS, F.lit(min(cuts))))
    return rounded(sg.score_equations(train, sg.fit_folds(train, keys, cuts), keys, cuts))


@query("fc_segmented", sql(f"SELECT store_id, dept_id, last_ds AS cutoff, feature, 0.0::DOUBLE AS equation FROM (SELECT DISTINCT store_id, dept_id FROM facts), last_day, {_FEATURE_ROWS}", "facts", "last_day"))
def _fc_segmented(d: Data):
    return _equations(d, [d.end], pm.SEGMENT_KEYS["store_dept"])


@query("fc_global_tree", sql("SELECT DISTINCT unique_id, last_ds + 1 AS ds, 0.0::DOUBLE AS difference FROM facts, last_day", "facts", "last_day"))
def _fc_tree(d: Data):
    """The first day of the forecast against the same day recomputed from the written splits with joins."""
    calendar, recent = _long_calendar(d), tr.recent_rows(d.panel, d.end)
    nodes, start = tr.trained(recent, calendar, REGIONS, d.end)
    state = tr.forecast_states(recent, calendar, H, states=REGIONS, end=d.end)
    ahead, again = tr.forecast(state, H, nodes, start), tr.first_step_by_joins(state, nodes, start)
    both = ahead.join(again.withColumnRenamed("Trees", "again"), ["unique_id", "ds"])
    return rounded(both.select("unique_id", "ds", (F.col("Trees") - F.col("again")).alias("difference")))


@query("fc_global_tree_values")
def _fc_tree_values(d: Data):
    return rounded(tr.fc_global_tree(d.panel, _long_calendar(d), H, states=REGIONS, end=d.end))


@query("fc_segmented_values")
def _fc_segmented_values(d: Data):
    return rounded(sg.fc_segmented(d.panel, _long_calendar(d), H, pm.SEGMENT_KEYS["store_dept"], states=REGIONS, end=d.end))


@query("cv_segmented", sql(f"SELECT store_id, cutoff, feature, 0.0::DOUBLE AS equation FROM (SELECT DISTINCT store_id FROM facts), folds, {_FEATURE_ROWS}", "facts", "folds"))
def _cv_segmented(d: Data):
    return _equations(d, d.points, pm.SEGMENT_KEYS["store"])


@query("cv_segmented_values")
def _cv_segmented_values(d: Data):
    return rounded(sg.cv_segmented(d.panel, _long_calendar(d), H, d.points, pm.SEGMENT_KEYS["store"], states=REGIONS))


@query("segment_profile", sql("SELECT store_id, cat_id, count(DISTINCT unique_id) AS n_series, count(*) AS n_rows FROM panel GROUP BY ALL", "panel"))
def _profile(d: Data):
    return pm.segment_profile(d.panel, pm.SEGMENT_KEYS["store_cat"])


@query("fc_count_glm")
def _count_glm(d: Data):
    features = ft.feat_minimal(d.panel.join(F.broadcast(d.calendar), "ds"), states=REGIONS).select("unique_id", "y", "dayofweek", "price_norm", "snap")
    routes = dm.demand_route(dm.intermittency_profile(d.panel), d.statics, "dept_id")
    future = ft.feat_snap(ft.feat_date(pm.future_exog(d.panel, _future_calendar(d), H)), REGIONS)
    usual = d.panel.groupBy("unique_id").agg(F.avg("sell_price").alias("usual"))
    future = future.join(usual, "unique_id").withColumn("price_norm", ratio(F.col("sell_price"), F.col("usual")))
    return rounded(pm.fc_count_glm(features, routes, future.select("unique_id", "ds", "dayofweek", "price_norm", "snap")))


# --- hierarchy: solutions are checked by the conditions that define them --------------------------------------------

MEDIAN = se.one_by_one(sm.weekday_median)
_AHEAD = "SELECT DISTINCT unique_id, last_ds + k::INTEGER AS ds FROM facts, last_day, range(1, 29) t(k)"


def _gradients(method: str):
    """The normal equations of a least-squares method at its solution, relative: zero for every series and day."""

    def run(d: Data):
        base = hm.settle(hm.node_base(d.facts, H, [d.end], hm.THETA))
        out = hm.gradients(base, hm.settle(hm.keyed_edges(d.statics)), H, [method]).drop("fold")
        return rounded(out.withColumnRenamed(method, "gradient"))

    return run


for _name, _method in (
    ("recon_ols", "MinT_OLS"),
    ("recon_wls_struct", "MinT_WLS_struct"),
    ("recon_wls_var", "MinT_WLS_var"),
    ("recon_mint_shrink", "MinT_shrink"),
):
    query(_name, sql(f"SELECT unique_id, ds, 0.0::DOUBLE AS gradient FROM ({_AHEAD})", "facts", "last_day"))(_gradients(_method))


@query("recon_erm_closed", sql("SELECT DISTINCT unique_id, 0.0::DOUBLE AS gradient FROM facts", "facts"))
def _erm_closed(d: Data):
    """Slope of the squared error in the weights of each series, over that of no weights."""
    base = hm.settle(hm.node_base(d.facts, H, [d.end], hm.THETA)).drop("fold")
    out = rc.recon_erm(base, hm.settle(hm.keyed_edges(d.statics)), H, None, certificate=True)
    return rounded(out.select(F.col("bottom_id").alias("unique_id"), "gradient"), 3)


@query("recon_erm_reg_bu", sql("SELECT DISTINCT unique_id, 1 AS gap_closed FROM facts_small", "facts_small"))
def _erm_l1(d: Data):
    """Whether the certified duality gap of every series is below the tolerance."""
    base = hm.settle(hm.node_base(d.small, H, [d.end], hm.THETA)).drop("fold")
    out = rc.recon_erm_l1(base, hm.settle(hm.keyed_edges(d.small_statics)), H, certificate=True)
    return out.select(F.col("bottom_id").alias("unique_id"), (F.col("gap") <= TOLERANCE).cast("int").alias("gap_closed"))


@query("recon_forecasts")
def _recon_forecasts(d: Data):
    """The forecasts themselves, of all methods that run on item x store."""
    base = hm.settle(hm.node_base(d.facts, H, [d.end], hm.THETA))
    methods = [*HIER_METHODS, "MinT_WLS_struct", "MinT_WLS_var", "ERM_closed"]
    return rounded(hm.hier_bottom(base, hm.settle(hm.keyed_edges(d.statics)), H, methods).drop("fold"), 4)


_NODES = _level_rows("facts", "CAST(sum(y) AS DOUBLE) AS y", "ds", hr.LEVELS, hr.LEVEL_NAMES, _slash)
# the weekday medians of every node and fold: the last eight values of a phase since the node's first day
_MEDIANS = {
    "nodes": _NODES,
    "spans": "SELECT level_idx, node, min(ds) AS first_ds FROM nodes GROUP BY ALL",
    "history": "SELECT level_idx, node, cutoff, sum(y) / (date_diff('day', min(ds), cutoff) + 1) AS mean_y FROM nodes JOIN cuts ON ds <= cutoff GROUP BY level_idx, node, cutoff",
    "phases": """SELECT s.level_idx, s.node, c.cutoff, p, median(coalesce(n.y, 0)) AS middle
        FROM spans s JOIN cuts c ON s.first_ds <= c.cutoff, range(7) t(p), range(8) u(j)
        LEFT JOIN nodes n ON n.level_idx = s.level_idx AND n.node = s.node AND n.ds = c.cutoff - 6 + CAST(p - 7 * j AS INTEGER)
        WHERE c.cutoff - 6 + CAST(p - 7 * j AS INTEGER) >= s.first_ds GROUP BY ALL""",
    "medians": """SELECT h.level_idx, h.node, h.cutoff, h.cutoff + k::INTEGER AS ds, coalesce(middle, mean_y) AS base
        FROM history h, range(1, 29) t(k) LEFT JOIN phases x ON x.level_idx = h.level_idx AND x.node = h.node AND x.cutoff = h.cutoff AND x.p = (k - 1) % 7""",
    "bottoms": f"""SELECT unique_id, {STATIC}, cutoff, ds, base FROM medians JOIN (SELECT *, {_slash(hr.LEVELS[hr.BOTTOM])} AS node FROM statics) USING (node)
        WHERE level_idx = {hr.BOTTOM}""",
}


@query(
    "hier_forecast",
    sql(
        f"""SELECT m.level_idx, b.level, m.node AS unique_id, m.ds, {R('m.base')} AS base, {R('b.BU')} AS BU, 0.0::DOUBLE AS MinT_OLS_gap, 0.0::DOUBLE AS MinT_shrink_gap
        FROM medians m JOIN summed b ON b.level_idx = m.level_idx AND b.node = m.node AND b.ds = m.ds""",
        "facts",
        "statics",
        "last_day",
        cuts="SELECT last_ds AS cutoff FROM last_day",
        **_MEDIANS,
        summed=_level_rows("bottoms", "sum(base) AS BU", "ds", hr.LEVELS, hr.LEVEL_NAMES, _slash),
    ),
)
def _hier_forecast(d: Data):
    """All nodes: own forecast, bottom-up sum, and what other methods' node forecasts differ from the sum over their edges."""
    out = hm.settle(hm.hier_forecast(d.facts, d.statics, H, HIER_METHODS, model=MEDIAN, batched=True, end=d.end, bottom_only=False))
    bottom = hr.hier_extract_bottom(out.where(F.col("level_idx") == hr.BOTTOM), d.statics)
    parts = hr.hier_edges(d.statics).join(bottom.select(F.col("unique_id").alias("bottom_id"), "ds", *HIER_METHODS[1:]), "bottom_id")
    sums = parts.groupBy("level_idx", F.col("node").alias("unique_id"), "ds").agg(*[F.sum(m).alias(f"_{m}") for m in HIER_METHODS[1:]])
    joined = out.join(sums, ["level_idx", "unique_id", "ds"])
    gaps = [(F.col(m) - F.col(f"_{m}")).alias(f"{m}_gap") for m in HIER_METHODS[1:]]
    return rounded(joined.select("level_idx", "level", "unique_id", "ds", "base", "BU", *gaps))


@query("hier_values")
def _hier_values(d: Data):
    """Forecasts of all nodes from Theta."""
    return rounded(hm.hier_forecast(d.facts, d.statics, H, HIER_METHODS, end=d.end, bottom_only=False), 4)


CV_TRACE = ("MinT_OLS", "MinT_WLS_struct", "MinT_shrink")


@query(
    "cv_hier",
    sql(
        f"""SELECT p.unique_id, p.ds, b.cutoff, p.y, {R('b.base')} AS BU, {', '.join(f'0.0::DOUBLE AS {m}_gradient' for m in CV_TRACE)}
        FROM panel p JOIN bottoms b ON b.unique_id = p.unique_id AND b.ds = p.ds""",
        "panel",
        "facts",
        "statics",
        "folds",
        cuts="SELECT cutoff FROM folds",
        **_MEDIANS,
    ),
)
def _cv_hier(d: Data):
    """Backtest of bottom-up, and the normal equations of the other methods in every fold."""
    d = d.keep()
    base, ahead = hm.with_ahead(hm.node_base(d.facts, H, d.points, MEDIAN), CV_TRACE)
    edges = hm.settle(hm.keyed_edges(d.statics))
    truth = fd.fold_test(d.panel, d.points, H).select("unique_id", "ds", "cutoff", F.col("y").cast("double").alias("y"))
    zero = hm.gradients(base, edges, H, CV_TRACE, ahead).select("fold", "unique_id", "ds", *[F.col(m).alias(f"{m}_gradient") for m in CV_TRACE])
    both = hm.hier_bottom(ahead, edges, H, ["BU"]).join(zero, ["fold", "unique_id", "ds"])
    return rounded(truth.join(both.withColumn("cutoff", F.col("fold").cast("date")).drop("fold"), ["unique_id", "ds", "cutoff"]))


@query("cv_hier_values")
def _cv_hier_values(d: Data):
    """Backtest of the forecasts themselves, from Theta."""
    d = d.keep()
    return rounded(hm.cv_hier(d.panel, d.statics, H, d.points, (*HIER_METHODS, "MinT_WLS_struct")), 4)


@query("score_requests_stored", sql("SELECT unique_id, last_ds + k::INTEGER AS ds, 0.0::DOUBLE AS difference, NULL AS reason FROM (SELECT DISTINCT unique_id FROM facts), last_day, range(1, 29) t(k) UNION ALL SELECT 'nobody', NULL, NULL, 'unknown_id'", "facts", "last_day"))
def _stored(d: Data):
    """A linear model trained, published, loaded and applied to stored history, against the same model in memory."""
    store = fresh_path(d.spark, "store")
    scorer = ms.train_linear(d.panel, d.end)
    ms.publish(d.panel, scorer, store, "v1")
    requests = d.facts.select("unique_id").unionByName(d.spark.createDataFrame([("nobody",)], "unique_id string"))
    ahead, unknown = ms.score_ids(ms.load(d.spark, store), requests, H)
    memory = pm.recurse_batches(pm.forecast_state(d.panel), H, scorer, "memory")
    both = ahead.join(memory, ["unique_id", "ds"]).select("unique_id", "ds", (F.col("y_hat") - F.col("memory")).alias("difference"))
    return rounded(both).unionByName(unknown, allowMissingColumns=True)
