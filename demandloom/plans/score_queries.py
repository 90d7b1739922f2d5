"""Registered queries: components, metrics, score axes, value added, diagnostics, intervals."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from demandloom.functions.expr import rounded
from demandloom.operators import diagnostics as dg
from demandloom.operators import fva
from demandloom.operators import hierarchy as hr
from demandloom.operators import intervals as iv
from demandloom.operators import metrics as m
from demandloom.operators import scoring as s
from demandloom.operators.reshape import models_long
from demandloom.plans.inputs import MODELS, Data
from demandloom.plans.registry import query
from demandloom.plans.sql import R, sql

SN = "SeasonalNaive"
SERIES = ("rmse", "mae", "smape", "bias", "mase")


def cols(*names: str, digits: int = 6) -> str:
    return ", ".join(f"{R(n, digits)} AS {n}" for n in names)


# --- components and metrics ------------------------------------------------------------------


@query("wrmsse_components", sql(f"SELECT unique_id, {R('weight', 10)} AS weight, {cols('scale')} FROM comp", "comp"))
def _components(d: Data):
    return rounded(d.scoring.components, weight=10)


@query("wrmsse_for_models", sql(f"SELECT model, {cols('wrmsse')} FROM scores", "scores"))
def _wrmsse_for_models(d: Data):
    return rounded(m.wrmsse_for_models(d.scoring.cv, d.scoring.components, MODELS))


@query("wrmsse", sql(f"SELECT {cols('wrmsse')} FROM scores WHERE model = '{SN}'", "scores"))
def _wrmsse(d: Data):
    inp = d.scoring
    return rounded(m.wrmsse(inp.cv, inp.cv, inp.components, SN))


@query(
    "accuracy_for_models",
    sql(
        f"""SELECT model, {R('avg(abs(y_hat - y))')} AS MAE, {R('sqrt(avg((y_hat - y) ** 2))')} AS RMSE,
        {R('avg(2 * abs(y_hat - y) / greatest(abs(y) + abs(y_hat), 1e-8))')} AS sMAPE, {R('avg(y_hat - y)')} AS bias,
        {R('avg(y_hat - y) / nullif(avg(abs(y)), 0)')} AS bias_pct_of_mean_y, count(*) AS n_obs FROM long GROUP BY model""",
        "long",
    ),
)
def _accuracy(d: Data):
    return rounded(m.accuracy_for_models(d.cv, MODELS))


@query(
    "conventional_metrics",
    sql(
        f"""SELECT model, count(y_hat) AS n_obs, {R('avg(abs(y_hat - y))')} AS MAE, {R('sqrt(avg((y_hat - y) ** 2))')} AS RMSE,
        {R('avg(CASE WHEN abs(y) + abs(y_hat) > 0 THEN 2 * abs(y_hat - y) / (abs(y) + abs(y_hat)) ELSE 0 END)')} AS sMAPE,
        {R('avg(y_hat - y)')} AS bias_mean_residual, {R('avg(y_hat - y) / nullif(avg(y), 0)')} AS bias_pct_of_mean_y FROM long GROUP BY model""",
        "long",
    ),
)
def _conventional(d: Data):
    return rounded(m.conventional_metrics(d.cv, MODELS))


@query("naive_scale", sql(f"SELECT unique_id, {cols('naive_scale')} FROM nscale", "nscale"))
def _naive_scale(d: Data):
    return rounded(m.naive_scale(d.scoring.train))


@query("per_series_metrics", sql(f"SELECT model, unique_id, {cols(*SERIES)}, n_obs FROM psm", "psm"))
def _per_series(d: Data):
    return rounded(m.per_series_metrics(d.scoring.long, d.scoring.scales))


_WEIGHTED = ", ".join(f"{R(f'sum(weight * {c}) / sum(weight)')} AS {c}" for c in SERIES)


@query(
    "aggregate_series_metrics",
    sql(
        f"""SELECT model, 'weighted' AS kind, {_WEIGHTED} FROM psm JOIN comp USING (unique_id) GROUP BY model
        UNION ALL SELECT model, 'plain', {', '.join(R(f'avg({c})') for c in SERIES)} FROM psm GROUP BY model""",
        "psm",
        "comp",
    ),
)
def _aggregate(d: Data):
    ps = m.per_series_metrics(d.scoring.long, d.scoring.scales)
    both = m.aggregate_series_metrics(ps, d.scoring.components).withColumn("kind", F.lit("weighted"))
    return rounded(both.unionByName(m.aggregate_series_metrics(ps).withColumn("kind", F.lit("plain"))))


_POOLED = f"""{R('sum(abs(y_hat - y)) / greatest(sum(abs(y)), 1e-9)')} AS wmape, {R('sum(y_hat - y) / greatest(abs(sum(y)), 1e-9)')} AS bias_pct"""


@query("wmape_bias_pct", sql(f"SELECT model, {_POOLED} FROM long GROUP BY model", "long"))
def _wmape(d: Data):
    return rounded(m.wmape_bias_pct(models_long(d.cv, MODELS)))


@query(
    "per_series_rmsse",
    sql(
        f"""SELECT model, count(rmsse) AS n_series, {R('avg(rmsse)')} AS mean, {R('min(rmsse)')} AS min, {R('max(rmsse)')} AS max,
        {R('quantile_cont(rmsse, 0.5)')} AS p50, {R('quantile_cont(rmsse, 0.75)')} AS p75, {R('quantile_cont(rmsse, 0.9)')} AS p90,
        {R('quantile_cont(rmsse, 0.99)')} AS p99 FROM rmsse GROUP BY model""",
        "rmsse",
    ),
)
def _per_series_rmsse(d: Data):
    from demandloom.functions.ordered import exact_quantiles

    per = m.per_series_rmsse(d.cv, d.scoring.components, MODELS)
    basic = per.groupBy("model").agg(
        F.count("rmsse").alias("n_series"), F.avg("rmsse").alias("mean"), F.min("rmsse").alias("min"), F.max("rmsse").alias("max")
    )
    probs = {0.5: "p50", 0.75: "p75", 0.9: "p90", 0.99: "p99"}
    spread = exact_quantiles(per, ["model"], "rmsse", list(probs))
    wide = spread.groupBy("model").agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n) for p, n in probs.items()])
    return rounded(basic.join(wide, "model"))


@query(
    "worst_n_series",
    sql(
        f"""SELECT model, unique_id, {R('rmsse')} AS rmsse, rank FROM (SELECT model, unique_id, rmsse,
        CAST(row_number() OVER (PARTITION BY model ORDER BY rmsse DESC NULLS LAST, unique_id) AS INTEGER) AS rank FROM rmsse) WHERE rank <= 10""",
        "rmsse",
    ),
)
def _worst(d: Data):
    return rounded(m.worst_n_series(m.per_series_rmsse(d.cv, d.scoring.components, MODELS)))


@query(
    "per_series_wrmsse_delta",
    sql(
        f"""SELECT a.unique_id, {R('a.rmsse')} AS {SN}, {R('b.rmsse')} AS Naive, {R('a.rmsse - b.rmsse')} AS delta
        FROM rmsse a JOIN rmsse b USING (unique_id) WHERE a.model = '{SN}' AND b.model = 'Naive'""",
        "rmsse",
    ),
)
def _delta(d: Data):
    return rounded(m.per_series_wrmsse_delta(d.cv, d.scoring.components, SN, "Naive"))


# --- score axes ------------------------------------------------------------------------------

_HEADLINE = f"""SELECT model, {_WEIGHTED} FROM psm JOIN comp USING (unique_id) GROUP BY model"""


@query(
    "score_headline",
    sql(f"SELECT h.*, {R('s.wrmsse')} AS wrmsse FROM ({_HEADLINE}) h JOIN scores s USING (model)", "psm", "comp", "scores"),
)
def _headline(d: Data):
    return rounded(s.score_headline(d.scoring))


@query(
    "score_headline_dash",
    sql(
        f"""SELECT h.*, {R('s.wrmsse')} AS wrmsse, wmape, bias_pct FROM ({_HEADLINE}) h JOIN scores s USING (model)
        JOIN (SELECT model, {_POOLED} FROM long GROUP BY model) p USING (model)""",
        "psm",
        "comp",
        "scores",
    ),
)
def _headline_dash(d: Data):
    return rounded(s.score_headline_dash(d.scoring))


def _axis_sql(axis: str, extra: str = "") -> str:
    return f"""SELECT model, {axis.split(' AS ')[-1]}, {R('sum(weight * sqrt(mse / scale))')} AS wrmsse FROM (
        SELECT model, unique_id, {axis}, avg((y_hat - y) ** 2) AS mse FROM long {extra} GROUP BY ALL) JOIN comp USING (unique_id) GROUP BY ALL"""


@query("score_per_fold", sql(_axis_sql("cutoff"), "long", "comp"))
def _per_fold(d: Data):
    return rounded(s.score_per_fold(d.scoring))


@query("score_per_horizon", sql(_axis_sql("CAST(date_diff('day', cutoff, ds) AS INTEGER) AS h"), "long", "comp"))
def _per_horizon(d: Data):
    return rounded(s.score_per_horizon(d.scoring))


@query(
    "score_per_segment",
    sql(
        f"""SELECT model, dept_id AS segment, {R('sum(weight * rmsse) / sum(weight)')} AS wrmsse, count(*) AS n_series
        FROM rmsse JOIN statics USING (unique_id) GROUP BY model, dept_id HAVING sum(weight) <> 0""",
        "rmsse",
        "statics",
    ),
)
def _per_segment(d: Data):
    return rounded(s.score_per_segment(d.scoring, "dept_id"))


def _segment_axis_sql(axis: str) -> str:
    weighted = ", ".join(f"sum(weight * {c}) / sum(weight) AS {c}" for c in SERIES)
    return f"""SELECT model, '{axis}' AS segment_axis, segment, n_series, {cols('wrmsse', *SERIES)}, wmape, bias_pct FROM (
        SELECT model, {axis} AS segment, count(*) AS n_series, sum(weight * sqrt(mse / scale)) / sum(weight) AS wrmsse, {weighted}
        FROM psm JOIN mse USING (model, unique_id) JOIN comp USING (unique_id) JOIN statics USING (unique_id) GROUP BY ALL HAVING sum(weight) > 0)
        JOIN (SELECT model, {axis} AS segment, {_POOLED} FROM long JOIN statics USING (unique_id) GROUP BY ALL) USING (model, segment)"""


@query(
    "score_segments_all",
    sql(" UNION ALL ".join(_segment_axis_sql(a) for a in s.SEGMENTS), "psm", "mse", "comp", "statics", "long"),
)
def _segments_all(d: Data):
    return rounded(s.score_segments_all(d.scoring))


def _level_rows(source: str, measures: str, by: str, specs, names, join) -> str:
    """One SELECT per level, stacked."""
    parts = []
    for idx, (cols_, name) in enumerate(zip(specs, names, strict=True)):
        parts.append(
            f"SELECT {idx} AS level_idx, '{name}' AS level, {join(cols_)} AS node, {by}, {measures} FROM {source} GROUP BY ALL"
        )
    return " UNION ALL ".join(parts)


def _slash(c) -> str:
    return " || '/' || ".join(["'Total'", *c])


def _pipe(c) -> str:
    ordered = [x for x in hr.PLACE_PRODUCT if x in c]
    return " || '|' || ".join(ordered) if ordered else "''"


_CV_SUMS = "sum(y) AS y, sum(Naive) AS Naive, sum(SeasonalNaive) AS SeasonalNaive, sum(Ensemble) AS Ensemble"


def _level_ctes(specs, names, join) -> dict[str, str]:
    unpivot = " UNION ALL ".join(f"SELECT level_idx, level, node, cutoff, ds, y, '{x}' AS model, {x} AS y_hat FROM lcv" for x in MODELS)
    return {
        "ltrain": _level_rows("(SELECT *, y * coalesce(sell_price, 0) AS rev FROM train)", "sum(y) AS y, sum(rev) AS rev", "ds", specs, names, join),
        "lsteps": """SELECT *, y - lag(y) OVER w AS d, row_number() OVER (PARTITION BY level_idx, node ORDER BY ds DESC) AS rn
            FROM ltrain WINDOW w AS (PARTITION BY level_idx, node ORDER BY ds)""",
        "lser": "SELECT level_idx, level, node, sum(rev) FILTER (WHERE rn <= 28) AS tail_revenue, avg(d * d) AS scale, avg(abs(d)) AS nscale FROM lsteps GROUP BY ALL",
        "lcomp": "SELECT level_idx, level, node, tail_revenue / sum(tail_revenue) OVER (PARTITION BY level_idx) AS weight, scale, nscale FROM lser QUALIFY scale > 0",
        "lcv": _level_rows("(SELECT * FROM cv JOIN statics USING (unique_id))", _CV_SUMS, "cutoff, ds", specs, names, join),
        "llong": unpivot,
        "lmse": """SELECT level_idx, level, node, model, avg((y_hat - y) ** 2) AS mse, avg(abs(y_hat - y)) AS mae, avg(y_hat - y) AS bias,
            avg(2 * abs(y_hat - y) / greatest(abs(y) + abs(y_hat), 1e-9)) AS smape FROM llong GROUP BY ALL""",
    }


_LEVELS = _level_ctes(hr.LEVELS, hr.LEVEL_NAMES, _slash)
_PLAIN_NAMES = [n for n, _ in hr.PLAIN_LEVELS]
_PLAIN = _level_ctes([c for _, c in hr.PLAIN_LEVELS], _PLAIN_NAMES, _pipe)
_PLAIN["bottom_w"] = _level_rows(
    "(SELECT unique_id, tail_revenue, s.* EXCLUDE (unique_id) FROM per_series JOIN statics s USING (unique_id))",
    "sum(tail_revenue) AS w",
    "1 AS one",
    [c for _, c in hr.PLAIN_LEVELS],
    _PLAIN_NAMES,
    _pipe,
)
_PLAIN["hier"] = """SELECT l.level, l.model, sum(b.w / b.total * sqrt(l.mse / s.scale)) AS wrmsse
    FROM lmse l JOIN lser s ON s.level_idx = l.level_idx AND s.node = l.node AND s.scale > 0
    JOIN (SELECT *, sum(w) OVER (PARTITION BY level_idx) AS total FROM bottom_w) b ON b.level_idx = l.level_idx AND b.node = l.node
    GROUP BY l.level, l.model"""


@query(
    "level_components",
    sql(f"SELECT level_idx, level, node, {R('weight', 10)} AS weight, {R('scale', 4)} AS scale FROM lcomp", "train", "cv", "statics", **_LEVELS),
)
def _level_components(d: Data):
    return rounded(s.level_components(d.scoring), weight=10, scale=4)


_PER_LEVEL = """SELECT l.model, l.level, l.level_idx, sum(weight * sqrt(mse / scale)) AS wrmsse, count(*) AS n_series
    FROM lmse l JOIN lcomp c ON c.level_idx = l.level_idx AND c.node = l.node GROUP BY ALL"""


@query(
    "score_per_level",
    sql(f"SELECT model, level, level_idx, n_series, {cols('wrmsse')} FROM ({_PER_LEVEL})", "train", "cv", "statics", **_LEVELS),
)
def _per_level(d: Data):
    return rounded(s.score_per_level(d.scoring))


@query(
    "score_levels_dash",
    sql(
        f"""SELECT model, level, level_idx, n_series, {cols('wrmsse', 'smape', 'mase')}, {cols('rmse', 'mae', 'bias', digits=4)}, wmape, bias_pct FROM (
        SELECT l.model, l.level, l.level_idx, count(*) AS n_series, sum(weight * sqrt(mse / scale)) AS wrmsse, sum(weight * sqrt(mse)) / sum(weight) AS rmse,
          sum(weight * mae) / sum(weight) AS mae, sum(weight * smape) / sum(weight) AS smape, sum(weight * bias) / sum(weight) AS bias,
          sum(weight * mae / nullif(nscale, 0)) / sum(weight) AS mase
        FROM lmse l JOIN lcomp c ON c.level_idx = l.level_idx AND c.node = l.node GROUP BY ALL)
        JOIN (SELECT model, level_idx, {_POOLED} FROM llong GROUP BY ALL) USING (model, level_idx)""",
        "train",
        "cv",
        "statics",
        **_LEVELS,
    ),
)
def _levels_dash(d: Data):
    return rounded(s.score_levels_dash(d.scoring), rmse=4, mae=4, bias=4)


@query("score_hier_notebook", sql(f"SELECT level, model, {cols('wrmsse')} FROM hier", "train", "cv", "statics", "per_series", **_PLAIN))
def _hier_notebook(d: Data):
    return rounded(s.score_hier_notebook(d.scoring))


_SUMMARY = f"""SELECT s.model, s.wrmsse AS WRMSSE_bottom, h.*, p.* EXCLUDE (m2) FROM scores s
    JOIN (SELECT model AS m1, avg(wrmsse) AS WRMSSE_mean_12L, {', '.join(f"max(wrmsse) FILTER (WHERE level = '{n}') AS WRMSSE_{n}" for n in _PLAIN_NAMES)} FROM hier GROUP BY model) h ON m1 = s.model
    JOIN (SELECT model AS m2, avg(abs(y_hat - y)) AS MAE, sqrt(avg((y_hat - y) ** 2)) AS RMSE,
        avg(CASE WHEN abs(y) + abs(y_hat) > 0 THEN 2 * abs(y_hat - y) / (abs(y) + abs(y_hat)) ELSE 0 END) AS sMAPE,
        avg(y_hat - y) / nullif(avg(y), 0) AS bias_pct_of_mean_y FROM long GROUP BY model) p ON m2 = s.model"""
_SUMMARY_COLS = ["WRMSSE_bottom", "WRMSSE_mean_12L", *[f"WRMSSE_{n}" for n in _PLAIN_NAMES], "MAE", "RMSE", "sMAPE", "bias_pct_of_mean_y"]


@query(
    "score_summary",
    sql(f"SELECT model, {cols(*_SUMMARY_COLS)} FROM ({_SUMMARY})", "scores", "train", "cv", "statics", "per_series", "long", **_PLAIN),
)
def _summary(d: Data):
    return rounded(s.score_summary(d.scoring))


@query(
    "benchmark_compare",
    sql(
        f"""SELECT model, {cols('WRMSSE_mean_12L')}, {R('WRMSSE_mean_12L - 0.520')} AS gap_to_first FROM (
        SELECT model, avg(wrmsse) AS WRMSSE_mean_12L FROM hier GROUP BY model
        UNION ALL SELECT * FROM (VALUES ('1st_place (YJ_STU)', 0.520), ('2nd_place (Anderer)', 0.528), ('3rd_place (mf)', 0.536)) t(model, w))""",
        "train",
        "cv",
        "statics",
        "per_series",
        **_PLAIN,
    ),
)
def _benchmark(d: Data):
    means = s.score_hier_notebook(d.scoring).groupBy("model").agg(F.avg("wrmsse").alias("WRMSSE_mean_12L"))
    return rounded(s.benchmark_compare(means))


@query("leaderboard_rank", sql(f"SELECT model, {cols('wrmsse')}, CAST(rank() OVER (ORDER BY wrmsse) AS INTEGER) AS rank FROM scores", "scores"))
def _leaderboard(d: Data):
    return rounded(s.leaderboard_rank(m.wrmsse_for_models(d.cv, d.scoring.components, MODELS)))


@query(
    "metric_rank",
    sql(
        f"""SELECT model, {cols('bias_pct')}, CAST(row_number() OVER (ORDER BY abs(bias_pct), model) AS INTEGER) AS rank
        FROM (SELECT model, sum(y_hat - y) / greatest(abs(sum(y)), 1e-9) AS bias_pct FROM long GROUP BY model)""",
        "long",
    ),
)
def _metric_rank(d: Data):
    return rounded(s.metric_rank(m.wmape_bias_pct(models_long(d.cv, MODELS)).drop("wmape"), "bias_pct"))


@query(
    "metric_filter",
    sql(
        f"""SELECT model, segment_axis, segment, {cols('wrmsse')} FROM ({' UNION ALL '.join(_segment_axis_sql(a) for a in ('state_id', 'cat_id'))})
        WHERE model = '{SN}' AND segment_axis = 'state_id'""",
        "psm",
        "mse",
        "comp",
        "statics",
        "long",
    ),
)
def _metric_filter(d: Data):
    rows = s.score_segments_all(d.scoring, ("state_id", "cat_id"))
    return rounded(s.metric_filter(rows, model=SN, segment_axis="state_id", segment=None).select("model", "segment_axis", "segment", "wrmsse"))


@query("distinct_values", sql("SELECT DISTINCT store_id FROM statics", "statics"))
def _distinct(d: Data):
    return s.distinct_values(d.statics, "store_id")


@query(
    "lift_vs_baseline",
    sql(
        f"""SELECT model, {cols('wrmsse')}, {R("(b - wrmsse) / b * 100", 2)} AS lift
        FROM scores, (SELECT wrmsse AS b FROM scores WHERE model = '{SN}')""",
        "scores",
    ),
)
def _lift(d: Data):
    return s.lift_vs_baseline(m.wrmsse_for_models(d.cv, d.scoring.components, MODELS), SN)


@query(
    "cumulative_error",
    sql(
        f"""SELECT model, h, {cols('cum_error', 'cum_abs_error', 'cum_actual', digits=3)}, {R('cum_error / greatest(cum_actual, 1e-9)')} AS cum_error_pct FROM (
        SELECT model, h, sum(e) OVER w AS cum_error, sum(ae) OVER w AS cum_abs_error, sum(ay) OVER w AS cum_actual FROM (
          SELECT model, CAST(date_diff('day', cutoff, ds) AS INTEGER) AS h, sum(y_hat - y) AS e, sum(abs(y_hat - y)) AS ae, sum(abs(y)) AS ay FROM long GROUP BY ALL)
        WINDOW w AS (PARTITION BY model ORDER BY h))""",
        "long",
    ),
)
def _cumulative(d: Data):
    return rounded(s.cumulative_error(d.scoring), cum_error=3, cum_abs_error=3, cum_actual=3)


# --- forecast value added --------------------------------------------------------------------

_SCALARS = """SELECT model, sum(weight * mae) / sum(weight) AS mae, sum(weight * rmse) / sum(weight) AS rmse, sum(weight * smape) / sum(weight) AS smape
    FROM psm JOIN comp USING (unique_id) GROUP BY model"""


@query(
    "scalar_metric",
    sql(
        f"""SELECT model, 'mae' AS metric, {R('mae')} AS error FROM sc UNION ALL SELECT model, 'rmse', {R('rmse')} FROM sc
        UNION ALL SELECT model, 'smape', {R('smape')} FROM sc UNION ALL SELECT model, 'wrmsse', {R('wrmsse')} FROM scores""",
        "psm",
        "comp",
        "scores",
        sc=_SCALARS,
    ),
)
def _scalar(d: Data):
    out = None
    for metric in fva.BASES:
        part = fva.scalar_metric(d.scoring, metric).withColumn("metric", F.lit(metric))
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@query(
    "fva_star",
    sql(
        f"""SELECT model, '{SN}' AS baseline, 'mae' AS metric, {R('b')} AS error_baseline, {R('mae')} AS error_model, {R('b - mae')} AS fva_abs,
        {R('CASE WHEN b > 0 THEN (b - mae) / b END')} AS fva_pct FROM sc, (SELECT mae AS b FROM sc WHERE model = '{SN}') WHERE model <> '{SN}'""",
        "psm",
        "comp",
        sc=_SCALARS,
    ),
)
def _fva_star(d: Data):
    return rounded(fva.fva_star(d.scoring, SN))


@query(
    "fva_chain",
    sql(
        f"""SELECT pos, model AS step, coalesce(lag(model) OVER w, '') AS previous, 'mae' AS metric, {R('lag(mae) OVER w')} AS error_previous, {R('mae')} AS error_step,
        {R('coalesce(lag(mae) OVER w - mae, 0)')} AS fva_abs, {R('CASE WHEN pos = 1 THEN 0 WHEN lag(mae) OVER w > 0 THEN (lag(mae) OVER w - mae) / lag(mae) OVER w END')} AS fva_pct,
        pos = 1 AS is_baseline FROM (SELECT *, CASE model WHEN 'Naive' THEN 1 WHEN '{SN}' THEN 2 ELSE 3 END AS pos FROM sc) WINDOW w AS (ORDER BY pos)""",
        "psm",
        "comp",
        sc=_SCALARS,
    ),
)
def _fva_chain(d: Data):
    return rounded(fva.fva_chain(d.scoring, ["Naive", SN, "Ensemble"]))


_FOLD_MAE = """SELECT model, cutoff, sum(weight * mae) / sum(weight) AS mae FROM (
    SELECT model, cutoff, unique_id, avg(abs(y_hat - y)) AS mae FROM long GROUP BY ALL) JOIN comp USING (unique_id) GROUP BY ALL"""
_FOLD_FVA = f"""SELECT f.model, '{SN}' AS baseline, f.cutoff, 'mae' AS metric, b.mae AS error_baseline, f.mae AS error_model, b.mae - f.mae AS fva_abs
    FROM fold_mae f JOIN fold_mae b ON b.cutoff = f.cutoff AND b.model = '{SN}' WHERE f.model <> '{SN}'"""


@query(
    "fva_per_fold",
    sql(f"SELECT model, baseline, cutoff, metric, {cols('error_baseline', 'error_model', 'fva_abs')} FROM ff", "long", "comp", fold_mae=_FOLD_MAE, ff=_FOLD_FVA),
)
def _fva_per_fold(d: Data):
    return rounded(fva.fva_per_fold(d.scoring, SN))


@query(
    "fva_consistency",
    sql(
        f"SELECT model, {R('avg(CAST(fva_abs > 0 AS DOUBLE))')} AS share_positive, {R('avg(fva_abs)')} AS mean_fva, count(*) AS n_folds FROM ff GROUP BY model",
        "long",
        "comp",
        fold_mae=_FOLD_MAE,
        ff=_FOLD_FVA,
    ),
)
def _fva_consistency(d: Data):
    return rounded(fva.fva_consistency(fva.fva_per_fold(d.scoring, SN)))


# --- diagnostics -----------------------------------------------------------------------------


@query(
    "bias_variance",
    sql(
        f"""SELECT model, {R('avg(y_hat - y)')} AS bias, {R('avg(y_hat - y) ** 2')} AS bias_sq, {R('var_pop(y_hat - y)', 4)} AS variance,
        {R('avg((y_hat - y) ** 2)')} AS mse, {R('sqrt(avg((y_hat - y) ** 2))')} AS rmse FROM long GROUP BY model""",
        "long",
    ),
)
def _bias_variance(d: Data):
    return rounded(dg.bias_variance(d.scoring), variance=4)


@query(
    "error_concentration",
    sql(
        f"""SELECT model, unique_id, rank, {cols('cum_weight', 'cum_error_share')} FROM (SELECT model, unique_id, row_number() OVER w AS rank,
        sum(weight) OVER w / sum(weight) OVER (PARTITION BY model) AS cum_weight, sum(c) OVER w / sum(c) OVER (PARTITION BY model) AS cum_error_share
        FROM (SELECT *, coalesce(weight * rmsse, 0) AS c FROM rmsse) WINDOW w AS (PARTITION BY model ORDER BY round(c, 14) DESC, unique_id ROWS UNBOUNDED PRECEDING))""",
        "rmsse",
    ),
)
def _concentration(d: Data):
    return rounded(dg.error_concentration(d.scoring))


def _bootstrap_sql(n_iter: int) -> str:
    draw = "CAST(('0x' || substr(md5('42:' || i || ':' || k), 1, 16))::UBIGINT % (SELECT count(*) FROM pos) AS BIGINT)"
    return sql(
        f"SELECT a.model AS model_a, b.model AS model_b, {R('CASE WHEN a.model = b.model THEN 1.0 ELSE avg(CAST(a.s - b.s >= 0 AS DOUBLE)) END')} AS p_value FROM sums a JOIN sums b USING (i) GROUP BY a.model, b.model",
        "rmsse",
        pos="SELECT unique_id, row_number() OVER (ORDER BY unique_id) - 1 AS pick FROM (SELECT unique_id FROM rmsse GROUP BY unique_id HAVING count(rmsse) = 3)",
        draws=f"SELECT i, {draw} AS pick FROM range({n_iter}) t(i), range((SELECT count(*) FROM pos)) u(k)",
        sums="SELECT i, model, sum(weight * rmsse) AS s FROM draws JOIN pos USING (pick) JOIN rmsse USING (unique_id) GROUP BY i, model",
    )


@query("bootstrap_pvalues", _bootstrap_sql(1000))
def _bootstrap(d: Data):
    return rounded(dg.bootstrap_pvalues(d.scoring, n_iter=1000, seed=42))


@query(
    "residuals_long",
    sql(f"SELECT model, unique_id, ds, y, {cols('y_hat')}, {R('y_hat - y')} AS residual FROM long", "long"),
)
def _residuals(d: Data):
    return rounded(dg.residuals_long(d.scoring))


@query("residual_drift", sql(f"SELECT model, ds, {R('avg(y_hat - y)')} AS mean_residual FROM long GROUP BY model, ds", "long"))
def _drift(d: Data):
    return rounded(dg.residual_drift(dg.residuals_long(d.scoring)))


@query(
    "residual_histogram",
    sql(
        f"""SELECT model, bins, bin, {R('lo + bin * (hi - lo) / bins')} AS "left", {R('lo + (bin + 1) * (hi - lo) / bins')} AS "right", count(*) AS n FROM (
        SELECT model, bins, lo, hi, CAST(coalesce(least(floor((y_hat - y - lo) / nullif(hi - lo, 0) * bins), bins - 1), 0) AS INTEGER) AS bin FROM long JOIN (
          SELECT model, min(y_hat - y) AS lo, max(y_hat - y) AS hi, CAST(least(60, greatest(10, floor(sqrt(count(*))))) AS INTEGER) AS bins FROM long GROUP BY model) USING (model)) GROUP BY ALL""",
        "long",
    ),
)
def _histogram(d: Data):
    return rounded(dg.residual_histogram(dg.residuals_long(d.scoring)))


_GRID = [(k + 1) / 200 for k in range(199)]


@query(
    "residual_qq",
    sql(
        f"""SELECT model, {R('p')} AS p, {R('theoretical')} AS theoretical, {R('residual')} AS residual FROM (
        SELECT model, unnest({_GRID}) AS p, unnest({[NormalDist().inv_cdf(p) for p in _GRID]}) AS theoretical, unnest(quantile_cont(y_hat - y, {_GRID})) AS residual
        FROM long GROUP BY model)""",
        "long",
    ),
)
def _qq(d: Data):
    return rounded(dg.residual_qq(dg.residuals_long(d.scoring)))


# The backtest of the nodes of all levels, a row per model.
_NODE_LONG = {
    "nodes": _level_rows("(SELECT * FROM cv JOIN statics USING (unique_id))", _CV_SUMS, "cutoff, ds", hr.LEVELS, hr.LEVEL_NAMES, _slash),
    "nlong": " UNION ALL ".join(f"SELECT y, '{x}' AS model, {x} AS y_hat FROM nodes" for x in MODELS),
}


@query(
    "calibration_deciles",
    sql(
        f"""SELECT model, CAST(bin AS INTEGER) AS bin, {R('avg(y_hat)')} AS mean_forecast, {R('avg(y)')} AS mean_y, {R('avg(y_hat - y)')} AS mean_residual, count(*) AS n FROM (
        SELECT l.*, greatest(len(list_filter(edges, lambda e: e < l.y_hat)) - 1, 0) AS bin FROM nlong l JOIN (
          SELECT model, list_distinct(quantile_cont(y_hat, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS edges FROM nlong GROUP BY model) USING (model)) GROUP BY model, bin""",
        "cv",
        "statics",
        **_NODE_LONG,
    ),
)
def _calibration(d: Data):
    rows = models_long(d.node_cv.drop("level"), MODELS)
    return rounded(dg.calibration_deciles(rows.withColumn("residual", F.col("y_hat") - F.col("y"))))


@query(
    "exemplar_series",
    sql(
        """SELECT tier, kind, unique_id FROM (
        SELECT tier, 'regular' AS kind, arg_min(unique_id, rk) AS unique_id FROM tiers GROUP BY tier
        UNION ALL SELECT tier, 'intermittent', CASE WHEN arg_min(unique_id, ri) <> arg_min(unique_id, rk) THEN arg_min(unique_id, ri) END FROM tiers GROUP BY tier) WHERE unique_id IS NOT NULL""",
        "train",
        tiers="""SELECT *, row_number() OVER (PARTITION BY tier ORDER BY z, unique_id) AS rk, row_number() OVER (PARTITION BY tier ORDER BY z DESC, unique_id) AS ri FROM (
            SELECT *, CASE WHEN pos <= greatest(1, n // 3) THEN 'high' WHEN pos <= greatest(2, 2 * n // 3) THEN 'mid' ELSE 'low' END AS tier FROM (
            SELECT unique_id, avg(CAST(y = 0 AS DOUBLE)) AS z, row_number() OVER (ORDER BY avg(y) DESC, unique_id) AS pos, count(*) OVER () AS n FROM train GROUP BY unique_id))""",
    ),
)
def _exemplars(d: Data):
    return dg.exemplar_series(d.scoring.train)


@query(
    "forecast_vs_actual",
    sql(
        f"""SELECT unique_id, ds, 'history' AS part, y, NULL::DOUBLE AS Naive, NULL::DOUBLE AS SeasonalNaive, NULL::DOUBLE AS Ensemble FROM train
        WHERE unique_id IN (SELECT unique_id FROM top) AND ds >= (SELECT min(ds) FROM cv) - 56
        UNION ALL SELECT unique_id, ds, 'backtest', y, {R('Naive')}, {R('SeasonalNaive')}, {R('Ensemble')} FROM cv WHERE unique_id IN (SELECT unique_id FROM top)""",
        "train",
        "cv",
        top="SELECT unique_id FROM panel GROUP BY unique_id ORDER BY sum(y) DESC, unique_id LIMIT 6",
    ),
)
def _forecast_vs_actual(d: Data):
    from demandloom.operators.reshape import top_n_series

    return rounded(dg.forecast_vs_actual(d.scoring, top_n_series(d.facts, 6)))


@query(
    "level_pivot",
    sql(
        f"""SELECT level_idx, level, {', '.join(f"{R(f'''max(wrmsse) FILTER (WHERE model = '{x}')''')} AS {x}" for x in MODELS)} FROM ({_PER_LEVEL}) GROUP BY level_idx, level""",
        "train",
        "cv",
        "statics",
        **_LEVELS,
    ),
)
def _level_pivot(d: Data):
    return rounded(dg.level_pivot(s.score_per_level(d.scoring), MODELS))


@query(
    "segment_pivot",
    sql(
        f"""SELECT segment, {', '.join(f"{R(f'''max(w) FILTER (WHERE model = '{x}')''')} AS {x}" for x in MODELS)}, {R('avg(w)')} AS row_mean FROM (
        SELECT model, store_id AS segment, sum(weight * rmsse) / sum(weight) AS w FROM rmsse JOIN statics USING (unique_id) GROUP BY ALL) GROUP BY segment""",
        "rmsse",
        "statics",
    ),
)
def _segment_pivot(d: Data):
    return rounded(dg.segment_pivot(s.score_per_segment(d.scoring, "store_id"), MODELS))


_RAW_FOLD = """SELECT model, cutoff, sum(weight * sqrt(mse / scale)) AS wrmsse FROM (
    SELECT model, unique_id, cutoff, avg((y_hat - y) ** 2) AS mse FROM long GROUP BY ALL) JOIN comp USING (unique_id) GROUP BY ALL"""
_RAW_H = _RAW_FOLD.replace("model, cutoff, sum", "model, h, sum").replace("unique_id, cutoff", "unique_id, CAST(date_diff('day', cutoff, ds) AS INTEGER) AS h")


@query(
    "fold_stability",
    sql(
        f"SELECT model, {R('avg(wrmsse)')} AS mean, {R('min(wrmsse)')} AS min, {R('max(wrmsse)')} AS max, {R('stddev_samp(wrmsse)')} AS std FROM ({_RAW_FOLD}) GROUP BY model",
        "long",
        "comp",
    ),
)
def _stability(d: Data):
    return rounded(dg.fold_stability(s.score_per_fold(d.scoring)))


@query("horizon_slope", sql(f"SELECT model, {R('regr_slope(wrmsse, h)')} AS slope, min(h) AS h_min, max(h) AS h_max FROM ({_RAW_H}) GROUP BY model", "long", "comp"))
def _slope(d: Data):
    return rounded(dg.horizon_slope(s.score_per_horizon(d.scoring)))


@query(
    "level_winners",
    sql(
        f"SELECT model, count(*) AS levels_won FROM (SELECT *, row_number() OVER (PARTITION BY level_idx ORDER BY wrmsse, model) AS r FROM ({_PER_LEVEL})) WHERE r = 1 GROUP BY model",
        "train",
        "cv",
        "statics",
        **_LEVELS,
    ),
)
def _winners(d: Data):
    return dg.level_winners(s.score_per_level(d.scoring))


@query(
    "bias_by_segment",
    sql(
        f"SELECT model, cat_id AS segment, {R('(avg(y_hat) - avg(y)) / nullif(avg(y), 0)')} AS bias FROM long JOIN statics USING (unique_id) GROUP BY ALL",
        "long",
        "statics",
    ),
)
def _bias_by_segment(d: Data):
    return rounded(dg.bias_by_segment(d.scoring, "cat_id"))


@query(
    "network_totals",
    sql(f"SELECT cutoff, ds, {', '.join(f'{R(f'sum({c})', 4)} AS {c}' for c in ('y', *MODELS))} FROM cv GROUP BY cutoff, ds", "cv"),
)
def _network(d: Data):
    return rounded(dg.network_totals(d.cv, MODELS), 4)


@query(
    "abs_error_by_h",
    sql(f"SELECT CAST(date_diff('day', cutoff, ds) AS INTEGER) AS h, {', '.join(f'{R(f'avg(abs({c} - y))')} AS {c}' for c in MODELS)} FROM cv GROUP BY ALL", "cv"),
)
def _abs_by_h(d: Data):
    return rounded(dg.abs_error_by_h(d.cv, MODELS))


@query(
    "hero_windows",
    sql(
        f"""SELECT unique_id, cutoff, ds, y, {R('Ensemble')} AS forecast, {R('SeasonalNaive')} AS baseline,
        {R('sqrt(avg((Ensemble - y) ** 2) OVER w)')} AS rmse_forecast, {R('sqrt(avg((SeasonalNaive - y) ** 2) OVER w)')} AS rmse_baseline
        FROM cv WHERE unique_id = (SELECT unique_id FROM panel WHERE y > 0 GROUP BY unique_id, cat_id ORDER BY cat_id = 'SIZE' DESC, count(*) DESC, unique_id LIMIT 1)
        WINDOW w AS (PARTITION BY unique_id, cutoff)""",
        "cv",
    ),
)
def _hero(d: Data):
    return rounded(dg.hero_windows(d.facts, d.cv, d.statics, "Ensemble", SN, prefer="SIZE"))


@query("insight_facts")
def _insights(d: Data):
    inp = d.scoring
    star = fva.fva_star(inp, SN)
    return rounded(
        dg.insight_facts(
            m.wrmsse_for_models(inp.cv, inp.components, MODELS),
            dg.bias_variance(inp),
            dg.bootstrap_pvalues(inp),
            star,
            fva.fva_chain(inp, ["Naive", SN, "Ensemble"]),
            fva.fva_per_fold(inp, SN),
        )
    )


# --- prediction intervals --------------------------------------------------------------------

# The backtest of the nodes of all levels: item x store alone sells on 3 days of 100, so its quantiles are 0.
_NODE_CV = {
    "ncv": f"""SELECT level_idx || ':' || node AS unique_id, level, ds, cutoff, y, {SN} FROM (
        {_level_rows("(SELECT * FROM cv JOIN statics USING (unique_id))", _CV_SUMS, "cutoff, ds", hr.LEVELS, hr.LEVEL_NAMES, _slash)})"""
}
_STEP = "CAST(date_diff('day', cutoff, ds) AS INTEGER)"
_Q = f"SELECT {_STEP} AS step, quantile_cont(abs(y - {SN}), 0.9) AS q FROM ncv GROUP BY 1"


@query(
    "cv_residuals",
    sql(f"SELECT unique_id, ds, cutoff, y, {R(SN)} AS {SN}, {_STEP} AS step, {R(f'y - {SN}')} AS residual FROM ncv", "cv", "statics", **_NODE_CV),
)
def _cv_residuals(d: Data):
    return rounded(iv.cv_residuals(d.node_cv, SN))


@query("conformal_fit_pooled", sql(f"SELECT step, {R('q')} AS q FROM ({_Q})", "cv", "statics", **_NODE_CV))
def _fit_pooled(d: Data):
    return rounded(iv.conformal_fit(d.node_cv, SN).pooled)


@query(
    "conformal_fit_grouped",
    sql(f"SELECT level, {_STEP} AS step, {R(f'quantile_cont(abs(y - {SN}), 0.9)')} AS q FROM ncv GROUP BY ALL", "cv", "statics", **_NODE_CV),
)
def _fit_grouped(d: Data):
    return rounded(iv.conformal_fit(d.node_cv, SN, method="grouped", group_col="level").grouped)


@query("conformal_fit_scaled", sql(f"SELECT step, {R('q')} AS q, {R('(SELECT avg(SeasonalNaive) FROM ncv)')} AS mean_forecast FROM ({_Q})", "cv", "statics", **_NODE_CV))
def _fit_scaled(d: Data):
    state = iv.conformal_fit(d.node_cv, SN, method="scaled")
    return rounded(state.pooled.withColumn("mean_forecast", state.mean_forecast.scalar()))


def _apply_sql(half: str) -> str:
    return f"""SELECT unique_id, ds, cutoff, y, {R(SN)} AS {SN}, {R(f'greatest({SN} - {half}, 0)')} AS {SN}_lo, {R(f'{SN} + {half}')} AS {SN}_hi"""


_APPLY_COLS = ("unique_id", "ds", "cutoff", "y", SN, f"{SN}_lo", f"{SN}_hi")


@query("conformal_apply", sql(f"{_apply_sql('q')} FROM ncv JOIN ({_Q}) t ON t.step = date_diff('day', cutoff, ds)", "cv", "statics", **_NODE_CV))
def _apply(d: Data):
    return rounded(iv.conformal_apply(iv.conformal_fit(d.node_cv, SN), d.node_cv).select(*_APPLY_COLS))


@query(
    "conformal_apply_scaled",
    sql(
        f"{_apply_sql('q * least(5, sqrt(greatest(SeasonalNaive, 0) / greatest((SELECT avg(SeasonalNaive) FROM ncv), 1e-8)))')} FROM ncv JOIN ({_Q}) t ON t.step = date_diff('day', cutoff, ds)",
        "cv", "statics", **_NODE_CV,
    ),
)
def _apply_scaled(d: Data):
    return rounded(iv.conformal_apply(iv.conformal_fit(d.node_cv, SN, method="scaled"), d.node_cv).select(*_APPLY_COLS))


@query(
    "conformal_apply_grouped",
    sql(
        f"""{_apply_sql('coalesce(gq, q)')} FROM (SELECT *, level AS dept FROM ncv) JOIN ({_Q}) t ON t.step = date_diff('day', cutoff, ds)
        LEFT JOIN (SELECT level AS gd, {_STEP} AS gs, quantile_cont(abs(y - {SN}), 0.9) AS gq FROM ncv GROUP BY ALL) g ON gd = dept AND gs = t.step""",
        "cv", "statics", **_NODE_CV,
    ),
)
def _apply_grouped(d: Data):
    state = iv.conformal_fit(d.node_cv, SN, method="grouped", group_col="level")
    return rounded(iv.conformal_apply(state, d.node_cv).select(*_APPLY_COLS))


_INSIDE = "avg(CAST(y >= greatest(f - h, 0) AND y <= f + h AS DOUBLE))"
_WIDTH = "avg(f + h - greatest(f - h, 0))"
_BAND = f"SELECT y, {SN} AS f, q AS h, step FROM ncv JOIN ({_Q}) t ON t.step = date_diff('day', cutoff, ds)"


@query("interval_coverage", sql(f"SELECT {R(_INSIDE)} AS coverage FROM ({_BAND})", "cv", "statics", **_NODE_CV))
def _coverage(d: Data):
    return rounded(iv.interval_coverage(iv.conformal_apply(iv.conformal_fit(d.node_cv, SN), d.node_cv), SN).select("coverage"))


@query("interval_width", sql(f"SELECT {R(_WIDTH)} AS avg_width FROM ({_BAND})", "cv", "statics", **_NODE_CV))
def _width(d: Data):
    return rounded(iv.interval_coverage(iv.conformal_apply(iv.conformal_fit(d.node_cv, SN), d.node_cv), SN).select("avg_width"))


@query("coverage_by_step", sql(f"SELECT step, {R(_INSIDE)} AS coverage, {R(_WIDTH)} AS avg_width FROM ({_BAND}) GROUP BY step", "cv", "statics", **_NODE_CV))
def _by_step(d: Data):
    return rounded(iv.coverage_by_step(iv.conformal_apply(iv.conformal_fit(d.node_cv, SN), d.node_cv), SN))


@query(
    "method_compare",
    sql(
        f"""SELECT 'pooled' AS method, {R(_INSIDE)} AS coverage, {R(_WIDTH)} AS avg_width FROM ({_BAND}) UNION ALL
        SELECT 'scaled', {R(_INSIDE)}, {R(_WIDTH)} FROM (SELECT y, f, h * least(5, sqrt(greatest(f, 0) / greatest((SELECT avg(SeasonalNaive) FROM ncv), 1e-8))) AS h FROM ({_BAND}))""",
        "cv",
        "statics",
        **_NODE_CV,
    ),
)
def _methods(d: Data):
    return rounded(iv.method_compare(d.node_cv, SN))


ALPHAS = [0.01 + k * (0.5 - 0.01) / 19 for k in range(20)]


@query(
    "alpha_sweep",
    sql(
        f"""SELECT {R('alpha')} AS alpha, {R(_INSIDE)} AS coverage, {R(_WIDTH)} AS avg_width FROM (SELECT y, {SN} AS f, q AS h, alpha FROM ncv JOIN qs ON step = date_diff('day', cutoff, ds)) GROUP BY alpha""",
        "cv",
        "statics",
        **_NODE_CV,
        qs=" UNION ALL ".join(f"SELECT {_STEP} AS step, {a!r}::DOUBLE AS alpha, quantile_cont(abs(y - {SN}), {1 - a}) AS q FROM ncv GROUP BY 1" for a in ALPHAS),
    ),
)
def _sweep(d: Data):
    return rounded(iv.alpha_sweep(d.node_cv, SN, ALPHAS))
