"""Registered queries: sources and sinks, reshaping, features, exploratory aggregates, requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.functions.expr import rounded
from demandloom.operators import demand as dm
from demandloom.operators import features as ft
from demandloom.operators import folds as fd
from demandloom.operators import hierarchy as hr
from demandloom.operators import metrics as m
from demandloom.operators import reshape as rs
from demandloom.plans.inputs import H, MODELS, REGIONS, Data
from demandloom.plans.registry import query
from demandloom.plans.sql import R, sql
from demandloom.session import fresh_path, settle
from demandloom.sources import cv_tables, retail, sinks
from demandloom.sources import tpch_panel as tp

PANEL = ("unique_id", "ds", "y", "wk", "item_id", "dept_id", "cat_id", "store_id", "state_id")
PLAIN = ", ".join(PANEL)
SN = "SeasonalNaive"


def cols(*names: str, digits: int = 6) -> str:
    return ", ".join(f"{R(n, digits)} AS {n}" for n in names)


# --- sources and sinks -----------------------------------------------------------------------


def _raw_calendar(d: Data) -> str:
    """The calendar as the raw CSV a retail data set ships."""
    path = fresh_path(d.spark, "raw")
    event = F.when(F.col("event_name_1") != "none", F.col("event_name_1"))
    rows = d.calendar.select(
        F.col("ds").alias("date"), tp.week_index(F.col("ds")).alias("wm_yr_wk"), event.alias("event_name_1"),
        F.when(event.isNotNull(), "National").alias("event_type_1"), F.lit(None).cast("string").alias("event_name_2"),
        F.lit(None).cast("string").alias("event_type_2"), F.col("snap_AFRICA").alias("snap_CA"),
        F.col("snap_AMERICA").alias("snap_TX"), F.col("snap_ASIA").alias("snap_WI"),
    )
    rows.write.option("header", True).csv(f"{path}/calendar.csv")
    return path


def _raw_prices(d: Data, path: str | None = None) -> str:
    path = path or fresh_path(d.spark, "raw")
    prices = d.small.where(F.col("sell_price").isNotNull()).groupBy("store_id", "item_id", F.col("wk").alias("wm_yr_wk"))
    prices.agg(F.max("sell_price").alias("sell_price")).write.option("header", True).csv(f"{path}/sell_prices.csv")
    return path


def _raw_sales(d: Data, path: str | None = None) -> str:
    """Units of every series and day as the wide text matrix (one column per day)."""
    path = path or fresh_path(d.spark, "raw")
    lo, hi = d.days.agg(F.min("ds"), F.max("ds")).first()
    n = (hi - lo).days + 1
    day = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")
    ids = ["item_id", "dept_id", "cat_id", "store_id", "state_id"]
    facts = tp.small_facts(d.spark, d.sf_dir)
    grid = facts.select(*ids).distinct().select(*ids, day)
    filled = grid.join(facts.withColumn("k", F.datediff("ds", F.lit(lo))), [*ids, "k"], "left")
    units = F.sort_array(F.collect_list(F.struct("k", F.coalesce("y", F.lit(0.0)).cast("int").cast("string").alias("u"))))
    rows = filled.groupBy(*ids).agg(F.array_join(F.transform(units, lambda s: s["u"]), ",").alias("_u"))
    label = F.concat_ws("_", "item_id", "store_id", F.lit("evaluation"))
    header = ",".join(["id", *ids, *[f"d_{k + 1}" for k in range(n)]])
    lines = rows.select(F.concat_ws(",", label, *ids, "_u").alias("value"))
    lines.union(d.spark.createDataFrame([(header,)], "value string")).write.text(f"{path}/sales_train_evaluation.csv")
    return path


@query(
    "src_calendar",
    sql(
        """SELECT ds AS date, CAST(floor(date_diff('day', DATE '1995-01-02', ds) / 7.0) AS INTEGER) AS wm_yr_wk, event_name_1,
        CASE WHEN event_name_1 = 'none' THEN 'none' ELSE 'National' END AS event_type_1, 'none' AS event_name_2, 'none' AS event_type_2,
        snap_AFRICA AS snap_CA, snap_AMERICA AS snap_TX, snap_ASIA AS snap_WI, 'd_' || row_number() OVER (ORDER BY ds) AS d FROM calendar""",
        "calendar",
    ),
)
def _src_calendar(d: Data):
    return retail.load_calendar(d.spark, _raw_calendar(d))


_PRICES = "SELECT store_id, item_id, wk AS wm_yr_wk, max(sell_price) AS sell_price FROM small WHERE sell_price IS NOT NULL GROUP BY ALL"


@query("src_prices", sql(f"SELECT store_id, item_id, wm_yr_wk, {R('sell_price::FLOAT', 2)} AS sell_price FROM ({_PRICES})", "small"))
def _src_prices(d: Data):
    return rounded(retail.load_prices(d.spark, _raw_prices(d)).withColumn("sell_price", F.col("sell_price").cast("double")), 2)


_MATRIX = """SELECT s.*, d.ds, 'd_' || row_number() OVER (PARTITION BY s.unique_id ORDER BY d.ds) AS d, coalesce(f.y, 0) AS y
    FROM (SELECT DISTINCT unique_id, item_id, dept_id, cat_id, store_id, state_id FROM facts_small) s CROSS JOIN days d
    LEFT JOIN facts_small f ON f.unique_id = s.unique_id AND f.ds = d.ds"""


@query(
    "src_sales_wide",
    sql(
        "SELECT unique_id, item_id, dept_id, cat_id, store_id, state_id, count(*) AS n_days, CAST(sum(y) AS DOUBLE) AS total FROM m GROUP BY ALL",
        "facts_small",
        "days",
        m=_MATRIX,
    ),
)
def _src_sales(d: Data):
    wide = retail.load_sales_wide(d.spark, _raw_sales(d))
    total = F.aggregate("units", F.lit(0.0).cast("double"), lambda a, v: a + v)
    return wide.select("unique_id", "item_id", "dept_id", "cat_id", "store_id", "state_id", F.size("units").cast("bigint").alias("n_days"), total.alias("total"))


@query("unpivot_sales", sql("SELECT unique_id, d, CAST(y AS DOUBLE) AS y FROM m", "facts_small", "days", m=_MATRIX))
def _unpivot(d: Data):
    wide = retail.load_sales_wide(d.spark, _raw_sales(d))
    long = rs.unpivot_sales(wide, ["unique_id"])
    return long.withColumn("y", F.col("y").cast("double"))


@query(
    "build_long",
    sql(
        f"""SELECT unique_id, ds, CAST(y AS DOUBLE) AS y, event_name_1, wk AS wm_yr_wk, {R('sell_price::FLOAT', 2)} AS sell_price FROM small JOIN calendar USING (ds)""",
        "small",
        "calendar",
    ),
)
def _build_long(d: Data):
    raw = _raw_sales(d, _raw_prices(d, _raw_calendar(d)))
    long = rs.build_long(retail.load_sales_wide(d.spark, raw), retail.load_calendar(d.spark, raw), retail.load_prices(d.spark, raw))
    out = long.select("unique_id", "ds", "y", "event_name_1", "wm_yr_wk", "sell_price")
    return rounded(out.withColumns({"y": F.col("y").cast("double"), "sell_price": F.col("sell_price").cast("double")}), 2)


@query("src_parquet", sql("SELECT unique_id, ds, y FROM small", "small"))
def _src_parquet(d: Data):
    path = sinks.sink_parquet(d.small.select("unique_id", "ds", "y"), fresh_path(d.spark, "panel"))
    return d.spark.read.parquet(path)


@query("sink_parquet", sql("SELECT unique_id, ds, y, state_id FROM small WHERE state_id = 'ASIA'", "small"))
def _sink_parquet(d: Data):
    path = sinks.sink_parquet(d.small.select("unique_id", "ds", "y", "state_id"), fresh_path(d.spark, "panel"), ["state_id"])
    return d.spark.read.parquet(path).where(F.col("state_id") == "ASIA")


@query("src_csv", sql("SELECT unique_id, ds, y FROM facts", "facts"))
def _src_csv(d: Data):
    path = fresh_path(d.spark, "facts")
    d.facts.select("unique_id", "ds", "y").write.option("header", True).csv(path)
    return retail.read_csv(d.spark, path, "unique_id string, ds date, y double")


def _cv_files(d: Data) -> str:
    """Two backtest tables: baselines without the last fold, and the mean without the first."""
    base = fresh_path(d.spark, "cv")
    sinks.sink_parquet(d.cv.where(F.col("cutoff") < d.points[2]).select("unique_id", "ds", "cutoff", "y", "Naive", SN), f"{base}/cv_base")
    both = d.cv.where(F.col("cutoff") > d.points[0]).select("unique_id", "ds", "cutoff", "y", F.col(SN), "Ensemble")
    sinks.sink_parquet(both, f"{base}/cv_mix")
    return base


_TWO_CV = {
    "a": "SELECT * FROM cv WHERE cutoff < (SELECT max(cutoff) FROM folds)",
    "b": "SELECT * FROM cv WHERE cutoff > (SELECT min(cutoff) FROM folds)",
}


@query(
    "load_cv_inner",
    sql(
        f"""SELECT a.unique_id, a.ds, a.cutoff, a.y, {R('a.Naive')} AS base_Naive, {R(f'a.{SN}')} AS base_{SN}, {R(f'b.{SN}')} AS mix_{SN}, {R('b.Ensemble')} AS mix_Ensemble
        FROM a JOIN b ON a.unique_id = b.unique_id AND a.ds = b.ds AND a.cutoff = b.cutoff""",
        "cv",
        **_TWO_CV,
    ),
)
def _load_inner(d: Data):
    return rounded(cv_tables.load_cv_inner(d.spark, cv_tables.discover(d.spark, _cv_files(d)))[0])


@query(
    "load_cv_outer",
    sql(
        f"""SELECT coalesce(a.unique_id, b.unique_id) AS unique_id, coalesce(a.ds, b.ds) AS ds, coalesce(a.cutoff, b.cutoff) AS cutoff, coalesce(a.y, b.y) AS y,
        {R('a.Naive')} AS Naive, {R(f'a.{SN}')} AS "base:{SN}", {R(f'b.{SN}')} AS "mix:{SN}", {R('b.Ensemble')} AS Ensemble
        FROM a FULL JOIN b ON a.unique_id = b.unique_id AND a.ds = b.ds AND a.cutoff = b.cutoff""",
        "cv",
        **_TWO_CV,
    ),
)
def _load_outer(d: Data):
    return rounded(cv_tables.load_cv_outer(d.spark, cv_tables.discover(d.spark, _cv_files(d)))[0])


@query(
    "load_cv_dashboard",
    sql(
        f"""SELECT a.unique_id, a.ds, a.cutoff, a.y, {R('a.Naive')} AS base_Naive, {R(f'a.{SN}')} AS base_{SN}, {R(f'b.{SN}')} AS mix_{SN}, {R('b.Ensemble')} AS mix_Ensemble
        FROM a JOIN b ON a.unique_id = b.unique_id AND a.ds = b.ds AND a.cutoff = b.cutoff""",
        "cv",
        **_TWO_CV,
    ),
)
def _load_dashboard(d: Data):
    base = _cv_files(d)
    sinks.sink_parquet(d.cv.select("unique_id", "ds", "cutoff", "y"), f"{base}/cv_truth")
    return rounded(cv_tables.load_cv_dashboard(d.spark, cv_tables.discover(d.spark, base))[0])


@query("sink_metrics", sql(f"SELECT model, {cols('wrmsse')} FROM scores", "scores"))
def _sink_metrics(d: Data):
    base = fresh_path(d.spark, "report")
    table = rounded(m.wrmsse_for_models(d.cv, d.scoring.components, MODELS))
    sinks.sink_metrics({"headline": table}, base)
    return retail.read_csv(d.spark, f"{base}/headline_csv", "model string, wrmsse double")


@query("sink_forecast", sql("SELECT unique_id, ds, Naive FROM fc", "panel", "last_day", fc="""SELECT p.unique_id, p.ds + k::INTEGER AS ds, p.y AS Naive
    FROM panel p JOIN last_day ON p.ds = last_ds, range(1, 29) t(k)"""))  # fmt: skip
def _sink_forecast(d: Data):
    path = sinks.sink_forecast(fd.baseline_forecast(d.panel, H, end=d.end).select("unique_id", "ds", "Naive"), "naive", fresh_path(d.spark, "out"))
    return d.spark.read.parquet(path)


@query(
    "sink_train_bundle",
    sql(
        """SELECT (SELECT count(*) FROM panel) AS n_rows, (SELECT count(DISTINCT unique_id) FROM panel) AS n_series, last_ds AS training_cutoff, 55 AS min_history_required,
        (SELECT count(*) FROM panel WHERE ds >= last_ds - 120) AS history_rows, (SELECT count(DISTINCT unique_id) FROM facts) AS static_rows FROM last_day""",
        "panel",
        "last_day",
    ),
)
def _bundle(d: Data):
    paths = sinks.sink_train_bundle(d.panel, fresh_path(d.spark, "bundle"), "v1")
    read = d.spark.read.parquet
    sizes = {f"{n}_rows": read(paths[p]).agg(F.count("*")).scalar() for n, p in (("history", "history"), ("static", "statics"))}
    return read(paths["metadata"]).select("n_rows", "n_series", "training_cutoff", "min_history_required", *[c.alias(n) for n, c in sizes.items()])


@query("train_select_history", sql("SELECT unique_id, ds, y FROM panel, last_day WHERE ds >= last_ds - 120", "panel", "last_day"))
def _history(d: Data):
    return sinks.train_select_history(d.panel)


@query(
    "sink_dashboard_json",
    sql(f"SELECT model, {cols('wrmsse')}, {R('CASE WHEN wrmsse = (SELECT min(wrmsse) FROM scores) THEN NULL ELSE 1 / (wrmsse - (SELECT min(wrmsse) FROM scores)) END', 3)} AS inverse_gap FROM scores", "scores"),
)
def _sink_json(d: Data):
    base = fresh_path(d.spark, "dash")
    table = settle(m.wrmsse_for_models(d.cv, d.scoring.components, MODELS))
    gap = F.col("wrmsse") - F.lit(table.agg(F.min("wrmsse")).first()[0])
    rows = table.withColumn("inverse_gap", F.when(gap == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1.0), gap)))
    sinks.sink_dashboard_json({"headline": rows}, base)
    return rounded(d.spark.read.schema("model string, wrmsse double, inverse_gap double").json(f"{base}/headline"), inverse_gap=3)


@query(
    "submission_wide",
    sql(
        "SELECT unique_id, " + ", ".join(f"max(y) FILTER (WHERE k = {k}) AS F{k}" for k in range(1, 29)) + " FROM fc GROUP BY unique_id",
        "panel",
        "last_day",
        fc="SELECT p.unique_id, k, p.y FROM panel p, last_day, range(1, 29) t(k) WHERE p.ds = last_ds - 6 + CAST((k - 1) % 7 AS INTEGER)",
    ),
)
def _submission(d: Data):
    # every series has at least 7 days, so the seasonal forecast repeats the last week
    return rs.submission_wide(fd.baseline_forecast(d.panel, H, end=d.end).select("unique_id", "ds", F.col(SN).alias("y")))


# --- reshaping -------------------------------------------------------------------------------


@query("densify_panel", sql(f"SELECT {PLAIN}, {R('sell_price', 8)} AS sell_price FROM small", "small"))
def _densify(d: Data):
    return rounded(d.small, 8)


@query(
    "densify_events",
    sql("""SELECT s.unique_id, d.ds, coalesce(f.y, 0) AS y FROM (SELECT unique_id, min(ds) AS lo FROM f GROUP BY 1) s
        JOIN (SELECT CAST(unnest(generate_series(min(ts)::DATE::TIMESTAMP, max(ts)::DATE::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS ds FROM events) d ON d.ds >= s.lo
        LEFT JOIN f ON f.unique_id = s.unique_id AND f.ds = d.ds""", f="SELECT event_type AS unique_id, CAST(ts AS DATE) AS ds, CAST(count(*) AS DOUBLE) AS y FROM events GROUP BY 1, 2"),  # fmt: skip
)
def _densify_events(d: Data):
    return tp.event_panel(d.spark, d.sf_dir)


@query("join_calendar", sql("SELECT unique_id, ds, y, event_name_1, snap_AFRICA, snap_AMERICA, snap_ASIA FROM facts JOIN calendar USING (ds)", "facts", "calendar"))
def _join_calendar(d: Data):
    joined = rs.join_calendar(d.facts, d.calendar, "ds")
    return joined.select("unique_id", "ds", "y", "event_name_1", *[f"snap_{r}" for r in REGIONS])


@query("join_prices", sql(f"SELECT unique_id, ds, y, {R('s.sell_price', 8)} AS sell_price FROM facts_small f JOIN (SELECT DISTINCT unique_id AS u, wk, sell_price FROM small) s ON u = unique_id AND s.wk = CAST(floor(date_diff('day', DATE '1995-01-02', ds) / 7.0) AS INTEGER)", "facts_small", "small"))
def _join_prices(d: Data):
    facts = tp.small_facts(d.spark, d.sf_dir).withColumn("wm_yr_wk", tp.week_index(F.col("ds")))
    weekly = facts.groupBy("store_id", "item_id", "wm_yr_wk").agg((F.sum("cents").cast("double") / 100.0 / F.sum("y")).alias("sell_price"))
    return rounded(rs.join_prices(facts, weekly).select("unique_id", "ds", "y", "sell_price"), 8)


_SHIFTED = "SELECT unique_id, ds, CASE WHEN ds < first_ds + 30 THEN 0 ELSE y END AS y FROM (SELECT *, min(ds) OVER (PARTITION BY unique_id) AS first_ds FROM small)"


@query(
    "drop_leading_zeros",
    sql(f"SELECT unique_id, ds, y FROM (SELECT *, min(ds) FILTER (WHERE y > 0) OVER (PARTITION BY unique_id) AS f FROM ({_SHIFTED})) WHERE ds >= f", "small"),
)
def _drop_zeros(d: Data):
    from pyspark.sql import Window as W

    first = F.min("ds").over(W.partitionBy("unique_id"))
    quiet = d.small.withColumn("_f", first).withColumn("y", F.when(F.col("ds") < F.date_add("_f", 30), 0.0).otherwise(F.col("y")))
    return rs.drop_leading_zeros(quiet.select("unique_id", "ds", "y"))


@query("trim_last_n_days", sql("SELECT unique_id, ds, y FROM panel WHERE ds >= (SELECT max(ds) FROM panel) - 400", "panel"))
def _trim(d: Data):
    return rs.trim_last_n_days(d.panel, 400).select("unique_id", "ds", "y")


@query(
    "subsample_series",
    sql(
        "SELECT unique_id, ds, y FROM facts WHERE unique_id IN (SELECT unique_id FROM (SELECT DISTINCT unique_id FROM facts) ORDER BY ('0x' || substr(md5('42:' || unique_id), 1, 8))::BIGINT, unique_id LIMIT 100)",
        "facts",
    ),
)
def _subsample(d: Data):
    return rs.subsample_series(d.facts, 100).select("unique_id", "ds", "y")


@query(
    "split_train_horizon",
    sql("SELECT CASE WHEN ds <= last_ds - 28 THEN 'train' ELSE 'holdout' END AS part, count(*) AS n_rows, min(ds) AS min_ds, max(ds) AS max_ds, sum(y) AS y FROM panel, last_day GROUP BY 1", "panel", "last_day"),
)
def _split(d: Data):
    out = None
    for part, df in zip(("train", "holdout"), rs.split_train_horizon(d.panel, H), strict=True):
        row = df.agg(F.count("*").alias("n_rows"), F.min("ds").alias("min_ds"), F.max("ds").alias("max_ds"), F.sum("y").alias("y")).withColumn("part", F.lit(part))
        out = row if out is None else out.unionByName(row)
    return out


def _edge_sql(direction: str) -> str:
    return sql(f"SELECT unique_id, ds, y FROM panel QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY ds {direction}) <= 5", "panel")


@query("tail_per_group", _edge_sql("DESC"))
def _tail(d: Data):
    return rs.tail_per_group(d.panel, 5).select("unique_id", "ds", "y")


@query("head_per_group", _edge_sql("ASC"))
def _head(d: Data):
    return rs.head_per_group(d.panel, 5).select("unique_id", "ds", "y")


@query(
    "pct_change",
    sql(f"SELECT unique_id, ds, {R('(y - lag(y) OVER w) / nullif(lag(y) OVER w, 0)')} AS pct_change FROM small WINDOW w AS (PARTITION BY unique_id ORDER BY ds)", "small"),
)
def _pct(d: Data):
    return rounded(rs.pct_change(d.small, "y").select("unique_id", "ds", "pct_change"))


@query("narrow_types", sql("SELECT unique_id, ds, CAST(y AS DOUBLE) AS y, wk FROM small", "small"))
def _narrow(d: Data):
    return rs.narrow_types(d.small.select("unique_id", "ds", "y", "wk"))


@query("static_attributes", sql("SELECT * FROM statics", "statics"))
def _statics(d: Data):
    return rs.static_attributes(d.facts)


@query(
    "encode_categoricals",
    sql(
        """SELECT unique_id, ds, CAST(r AS DOUBLE) AS store_id_idx FROM facts JOIN (SELECT store_id, row_number() OVER (ORDER BY count(*) DESC, store_id) - 1 AS r FROM facts GROUP BY store_id) USING (store_id)""",
        "facts",
    ),
)
def _encode(d: Data):
    return rs.encode_categoricals(d.facts, ["store_id"]).select("unique_id", "ds", "store_id_idx")


@query("fill_values", sql(f"SELECT unique_id, ds, {R('coalesce(sell_price, 1)', 8)} AS sell_price FROM small", "small"))
def _fill(d: Data):
    return rounded(rs.fill_values(d.small, {"sell_price": 1.0, "absent": 0.0}).select("unique_id", "ds", "sell_price"), 8)


@query("category_from_id", sql("SELECT split_part(unique_id, '_', 1) AS category, count(*) AS n FROM facts GROUP BY 1", "facts"))
def _category(d: Data):
    return rs.category_from_id(d.facts, "unique_id").groupBy("category").agg(F.count("*").alias("n"))


@query("top_n_series", sql("SELECT unique_id, sum(y) AS total FROM facts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", "facts"))
def _top(d: Data):
    return rs.top_n_series(d.facts, 20)


@query("dedupe_keep_latest", sql(f"SELECT unique_id, ds, cutoff, y, {R(SN)} AS {SN} FROM o QUALIFY row_number() OVER (PARTITION BY unique_id, ds ORDER BY cutoff DESC) = 1", "panel", "last_day", o=f"""
    SELECT p.unique_id, p.ds, c.cutoff, p.y, s.y AS {SN} FROM panel p JOIN (SELECT last_ds - CAST(28 + (2 - w) * 7 AS INTEGER) AS cutoff FROM last_day, range(3) t(w)) c ON p.ds > c.cutoff AND p.ds <= c.cutoff + 28
    JOIN panel s ON s.unique_id = p.unique_id AND s.ds = c.cutoff - 6 + CAST((date_diff('day', c.cutoff, p.ds) - 1) % 7 AS INTEGER)"""))  # fmt: skip
def _dedupe(d: Data):
    overlapping = fd.baseline_cv(d.panel, H, 3, step=7, end=d.end).drop("Naive")
    return rounded(rs.dedupe_keep_latest(overlapping))


@query("models_long", sql(f"SELECT unique_id, ds, cutoff, y, model, {cols('y_hat')} FROM long", "long"))
def _models_long(d: Data):
    return rounded(rs.models_long(d.cv))


@query("future_frame", sql("SELECT unique_id, last_ds + k::INTEGER AS ds FROM (SELECT DISTINCT unique_id FROM facts), last_day, range(1, 29) t(k)", "facts", "last_day"))
def _future(d: Data):
    return rs.future_frame(d.facts, H, d.end)


@query(
    "union_forecasts",
    sql(f"SELECT unique_id, ds, {cols('Naive')}, NULL::DOUBLE AS {SN} FROM cv WHERE cutoff = (SELECT min(cutoff) FROM folds) UNION ALL SELECT unique_id, ds, NULL, {R(SN)} FROM cv WHERE cutoff > (SELECT min(cutoff) FROM folds)", "cv"),
)
def _union(d: Data):
    first = d.cv.where(F.col("cutoff") == d.points[0]).select("unique_id", "ds", "Naive")
    rest = d.cv.where(F.col("cutoff") > d.points[0]).select("unique_id", "ds", SN)
    return rounded(rs.union_forecasts(first, rest))


# --- features --------------------------------------------------------------------------------

_DOW = "(isodow(ds) - 1)"
_WEEK = f"CAST(floor((dayofyear(ds) - {_DOW} + 10) / 7.0) AS INTEGER)"
_DATE = f"{_DOW} AS dayofweek, day(ds) AS day, {_WEEK} AS week, month(ds) AS month, year(ds) AS year, CAST({_DOW} >= 5 AS INTEGER) AS is_weekend"
_SNAP = "CASE state_id WHEN 'AFRICA' THEN snap_AFRICA WHEN 'AMERICA' THEN snap_AMERICA WHEN 'ASIA' THEN snap_ASIA ELSE 0 END"
_PRICE = {
    "price_norm": "sell_price / nullif(avg(sell_price) OVER (PARTITION BY unique_id), 0)",
    "price_change_pct": "coalesce((sell_price - lag(sell_price) OVER (PARTITION BY unique_id ORDER BY ds)) / nullif(lag(sell_price) OVER (PARTITION BY unique_id ORDER BY ds), 0), 0)",
}
_MEANS = {n: f"avg(y) OVER (PARTITION BY {', '.join(k)}, {_DOW})" for n, k in ft.ENCODING_KEYS.items()}
_STATS = {
    **{f"price_{f.replace('avg', 'mean')}": f"{f}(sell_price) OVER (PARTITION BY unique_id)" for f in ("avg", "min", "max")},
    "price_rank_in_store": "CASE WHEN sell_price IS NOT NULL THEN rank() OVER (PARTITION BY store_id, ds ORDER BY sell_price NULLS LAST) + (count(*) OVER (PARTITION BY store_id, ds, sell_price) - 1) / 2.0 END",
}
_RELEASE = "coalesce(date_diff('day', min(ds) FILTER (WHERE y > 0) OVER (PARTITION BY unique_id), ds), -1)"
_EVENTS = """SELECT ds, coalesce(date_diff('day', ds, min(e) OVER (ORDER BY ds ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)), 999) AS days_to_next_event,
    coalesce(date_diff('day', max(e) OVER (ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ds), 999) AS days_since_last_event
    FROM (SELECT ds, CASE WHEN event_name_1 <> 'none' THEN ds END AS e FROM calendar)"""
_WOM = "CAST(floor((day(ds) - 1) / 7.0) AS INTEGER) + 1 AS week_of_month"


def _exprs(table: dict[str, str], digits: int = 6) -> str:
    return ", ".join(f"{R(e, digits)} AS {n}" for n, e in table.items())


@query("feat_date", sql(f"SELECT unique_id, ds, {_DATE} FROM small", "small"))
def _feat_date(d: Data):
    return ft.feat_date(d.small.select("unique_id", "ds"))


@query("feat_snap", sql(f"SELECT unique_id, ds, {_SNAP} AS snap FROM small JOIN calendar USING (ds)", "small", "calendar"))
def _feat_snap(d: Data):
    return ft.feat_snap(d.small_calendar, REGIONS).select("unique_id", "ds", "snap")


@query("feat_event", sql("SELECT unique_id, ds, CAST(event_name_1 <> 'none' AS INTEGER) AS is_event FROM small JOIN calendar USING (ds)", "small", "calendar"))
def _feat_event(d: Data):
    return ft.feat_event(d.small_calendar).select("unique_id", "ds", "is_event")


@query("feat_price", sql(f"SELECT unique_id, ds, {_exprs(_PRICE)} FROM small", "small"))
def _feat_price(d: Data):
    return rounded(ft.feat_price(d.small).select("unique_id", "ds", *_PRICE))


@query("feat_mean_encoding", sql(f"SELECT unique_id, ds, {_exprs(_MEANS)} FROM small", "small"))
def _feat_means(d: Data):
    return rounded(ft.feat_mean_encoding(d.small).select("unique_id", "ds", *_MEANS))


@query(
    "feat_event_distance",
    sql(f"SELECT unique_id, ds, {_WOM}, days_to_next_event, days_since_last_event FROM small JOIN ({_EVENTS}) USING (ds)", "small", "calendar"),
)
def _feat_distance(d: Data):
    out = ft.feat_event_distance(d.small_calendar)
    return out.select("unique_id", "ds", "week_of_month", "days_to_next_event", "days_since_last_event")


@query("feat_price_stats", sql(f"SELECT unique_id, ds, {_exprs(_STATS, 5)} FROM small", "small"))
def _feat_stats(d: Data):
    return rounded(ft.feat_price_stats(d.small).select("unique_id", "ds", *_STATS), 5)


@query("feat_release", sql(f"SELECT unique_id, ds, {_RELEASE} AS days_since_release FROM small", "small"))
def _feat_release(d: Data):
    return ft.feat_release(d.small).select("unique_id", "ds", "days_since_release")


@query(
    "build_features",
    sql(
        f"""SELECT unique_id, ds, y, {_DATE}, {_SNAP} AS snap, CAST(event_name_1 <> 'none' AS INTEGER) AS is_event, {_exprs({**_PRICE, **_MEANS}, 5)},
        {_WOM}, days_to_next_event, days_since_last_event, {_exprs(_STATS, 5)}, {_RELEASE} AS days_since_release
        FROM small JOIN calendar USING (ds) JOIN ({_EVENTS}) USING (ds)""",
        "small",
        "calendar",
    ),
)
def _build_features(d: Data):
    out = ft.build_features(d.small_calendar, states=REGIONS, days=d.calendar)
    return rounded(out.select("unique_id", "ds", "y", *ft.DYNAMIC_COLUMNS, "dayofweek", "day", "week", "month", "year", "is_weekend"), 5)


@query(
    "feat_minimal",
    sql(
        f"SELECT unique_id, ds, {_DATE}, {_SNAP} AS snap, CAST(event_name_1 <> 'none' AS INTEGER) AS is_event, {_exprs(_PRICE)} FROM small JOIN calendar USING (ds)",
        "small",
        "calendar",
    ),
)
def _feat_minimal(d: Data):
    out = ft.feat_minimal(d.small_calendar, states=REGIONS)
    return rounded(out.select("unique_id", "ds", "dayofweek", "day", "week", "month", "year", "is_weekend", "snap", "is_event", *_PRICE))


_BY = "(PARTITION BY unique_id ORDER BY ds)"


@query("feat_lags", sql(f"SELECT unique_id, ds, {', '.join(f'lag(y, {k}) OVER {_BY} AS lag{k}' for k in (7, 14, 28))} FROM small", "small"))
def _feat_lags(d: Data):
    return ft.feat_lags(d.small).select("unique_id", "ds", "lag7", "lag14", "lag28")


def _rolling_sql(w: int) -> str:
    frame = f"(PARTITION BY unique_id ORDER BY ds ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
    return f"{R(f'CASE WHEN count(y) OVER {frame} = {w} THEN avg(y) OVER {frame} END')} AS rolling_mean_lag1_window_size{w}"


@query("feat_rolling_lagged", sql(f"SELECT unique_id, ds, {_rolling_sql(7)}, {_rolling_sql(28)} FROM small", "small"))
def _feat_rolling(d: Data):
    names = [f"rolling_mean_lag1_window_size{w}" for w in (7, 28)]
    return rounded(ft.feat_rolling_lagged(d.small).select("unique_id", "ds", *names))


@query("feat_difference", sql(f"SELECT unique_id, ds, y - lag(y) OVER {_BY} AS y_diff FROM small", "small"))
def _feat_difference(d: Data):
    return ft.feat_difference(d.small).select("unique_id", "ds", "y_diff")


@query(
    "undo_difference",
    sql("SELECT unique_id, ds, y FROM panel, last_day WHERE ds > last_ds - 28", "panel", "last_day"),
)
def _undo(d: Data):
    cutoff = F.date_sub(d.end, H)
    diffs = ft.feat_difference(d.panel).where(F.col("ds") > cutoff).select("unique_id", "ds", F.col("y_diff").alias("y"))
    last = d.panel.where(F.col("ds") == cutoff).select("unique_id", F.col("y").alias("level"))
    return ft.undo_difference(diffs, last, "y").select("unique_id", "ds", "y")


@query(
    "feat_context_window",
    sql(
        """SELECT i.unique_id, CAST(pos AS INTEGER) AS pos, coalesce(y, 0) AS value FROM (SELECT DISTINCT unique_id FROM small) i CROSS JOIN range(512) t(pos)
        LEFT JOIN (SELECT unique_id, y, 512 - row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS k FROM small) s ON s.unique_id = i.unique_id AND s.k = pos""",
        "small",
    ),
)
def _context(d: Data):
    return ft.feat_context_window(d.small, 512).select("unique_id", F.posexplode("context").alias("pos", "value"))


# --- exploratory aggregates ------------------------------------------------------------------


@query(
    "eda_levels",
    sql(
        "SELECT 'total' AS axis, 'total' AS value, ds, sum(y) AS y FROM facts GROUP BY ds UNION ALL "
        + " UNION ALL ".join(f"SELECT '{a}', {a}, ds, sum(y) FROM facts GROUP BY {a}, ds" for a in ("state_id", "store_id", "cat_id", "dept_id")),
        "facts",
    ),
)
def _eda_levels(d: Data):
    return dm.eda_levels(d.facts)


@query(
    "eda_price_hist",
    sql(
        """SELECT category, CAST(coalesce(least(floor((v - lo) / nullif(hi - lo, 0) * 30), 29), 0) AS INTEGER) AS bin, count(*) AS n FROM (
        SELECT category, v, min(v) OVER (PARTITION BY category) AS lo, max(v) OVER (PARTITION BY category) AS hi
        FROM (SELECT cat_id AS category, ln(1 + sell_price) AS v FROM panel WHERE y > 0)) GROUP BY ALL""",
        "panel",
    ),
)
def _eda_hist(d: Data):
    return dm.eda_price_hist(d.panel.where(F.col("y") > 0), "cat_id")


@query(
    "eda_calendar_effects",
    sql(
        f"""SELECT effect, key, {R('avg(y)')} AS mean_y FROM (SELECT y, unnest(['weekday', 'december_day', 'christmas']) AS effect,
        unnest([dayname(ds), CASE WHEN month(ds) = 12 THEN day(ds)::VARCHAR END, CASE WHEN month(ds) = 12 AND day(ds) = 25 THEN 'xmas' ELSE 'other' END]) AS key FROM panel)
        WHERE key IS NOT NULL GROUP BY ALL""",
        "panel",
    ),
)
def _eda_effects(d: Data):
    return rounded(dm.eda_calendar_effects(d.panel))


@query(
    "eda_rolling_mean",
    sql(
        f"""SELECT unique_id, ds, y, {R('CASE WHEN count(y) OVER w = 7 THEN avg(y) OVER w END')} AS rolling_mean FROM panel
        WHERE unique_id IN (SELECT unique_id FROM panel GROUP BY 1 ORDER BY sum(y) DESC, 1 LIMIT 6) WINDOW w AS (PARTITION BY unique_id ORDER BY ds ROWS 6 PRECEDING)""",
        "panel",
    ),
)
def _eda_rolling(d: Data):
    return rounded(dm.eda_rolling_mean(d.panel))


@query("panel_overview", sql("SELECT count(*) AS n_rows, count(DISTINCT unique_id) AS n_series, count(DISTINCT ds) AS n_days, min(ds) AS min_ds, max(ds) AS max_ds FROM panel", "panel"))
def _overview(d: Data):
    return dm.panel_overview(d.panel)


# --- hierarchy -------------------------------------------------------------------------------


def _per_level(select: str, source: str) -> str:
    return " UNION ALL ".join(
        select.format(i=i, name=name, node=" || '/' || ".join(["'Total'", *c])) + f" FROM {source} GROUP BY ALL"
        for i, (c, name) in enumerate(zip(hr.LEVELS, hr.LEVEL_NAMES, strict=True))
    )


@query("hier_levels", sql(_per_level("SELECT {i} AS level_idx, '{name}' AS level, {node} AS node, count(*) AS n_bottom", "statics"), "statics"))
def _hier_levels(d: Data):
    return hr.hier_nodes(d.statics)


@query(
    "hier_level_counts",
    sql(f"SELECT level_idx, level, count(DISTINCT node) AS n_series FROM ({_per_level('SELECT {i} AS level_idx, ' + chr(39) + '{name}' + chr(39) + ' AS level, {node} AS node', 'statics')}) GROUP BY ALL", "statics"),
)
def _hier_counts(d: Data):
    return hr.hier_level_counts(d.statics)


@query("hier_edges", sql(_per_level("SELECT {i} AS level_idx, '{name}' AS level, {node} AS node, unique_id AS bottom_id", "statics"), "statics"))
def _hier_edges(d: Data):
    return hr.hier_edges(d.statics)


_UPPER = {"nodes": _per_level("SELECT {i} AS level_idx, '{name}' AS level, {node} AS unique_id, ds, sum(y) AS y", "panel")}


@query("hier_aggregate", sql("SELECT level_idx, count(DISTINCT unique_id) AS n_series, count(*) AS n_rows, sum(y) AS y, sum(y * date_diff('day', DATE '1995-01-02', ds)) AS moment FROM nodes GROUP BY level_idx", "panel", **_UPPER))
def _hier_aggregate(d: Data):
    # digest of all 3 million node rows: counts, sums and the first time moment per level
    nodes = hr.hier_aggregate(d.panel, end=d.end)
    return nodes.groupBy("level_idx").agg(
        F.countDistinct("unique_id").alias("n_series"), F.count("*").alias("n_rows"), F.sum("y").alias("y"),
        F.sum(F.col("y") * F.datediff("ds", F.lit(tp.EPOCH).cast("date"))).alias("moment"),
    )


@query("hier_extract_bottom", sql("SELECT unique_id, ds, y FROM facts", "facts"))
def _extract(d: Data):
    nodes = hr.roll_up(d.facts, ["y"]).withColumnRenamed("node", "unique_id")
    return hr.hier_extract_bottom(nodes, d.statics).select("unique_id", "ds", "y")


@query(
    "recon_bottom_up",
    sql(_per_level("SELECT {i} AS level_idx, {node} AS unique_id, cutoff, ds, round(sum(SeasonalNaive), 6) AS BottomUp", "(SELECT * FROM cv JOIN (SELECT DISTINCT unique_id, item_id, dept_id, cat_id, store_id, state_id FROM facts) USING (unique_id))").replace("'{name}'", "''"), "cv", "facts"),
)
def _bottom_up(d: Data):
    from demandloom.operators.reconcile import bottom_up

    return rounded(bottom_up(d.cv, hr.hier_edges(d.statics), SN))


# --- intermittency and requests --------------------------------------------------------------

_PROFILE = """SELECT unique_id, adi, cv2, zero_rate, CASE WHEN adi IS NULL THEN 'no_demand' WHEN adi < 1.32 AND cv2 < 0.49 THEN 'smooth' WHEN adi < 1.32 THEN 'erratic'
    WHEN cv2 < 0.49 THEN 'intermittent' ELSE 'lumpy' END AS demand_class FROM (SELECT unique_id, count(*) / nullif(count(*) FILTER (WHERE y > 0), 0) AS adi,
    (stddev_pop(y) FILTER (WHERE y > 0) / avg(y) FILTER (WHERE y > 0)) ** 2 AS cv2, avg(CAST(y = 0 AS DOUBLE)) AS zero_rate FROM panel GROUP BY unique_id)"""
_ROUTES = """SELECT p.unique_id, dept_id AS pool, demand_class, coalesce(peers, 0) AS peers, CASE WHEN demand_class IN ('intermittent', 'lumpy') AND peers >= 2 THEN 'pooled' ELSE 'univariate' END AS route
    FROM profile p JOIN statics USING (unique_id) LEFT JOIN (SELECT dept_id, count(*) AS peers FROM profile JOIN statics USING (unique_id) WHERE demand_class IN ('intermittent', 'lumpy') GROUP BY 1) USING (dept_id)"""


@query("intermittency_profile", sql(f"SELECT unique_id, {cols('adi', 'cv2', 'zero_rate')}, demand_class FROM profile", "panel", profile=_PROFILE))
def _profile(d: Data):
    return rounded(dm.intermittency_profile(d.panel))


@query("demand_route", sql(_ROUTES, "panel", "statics", profile=_PROFILE))
def _route(d: Data):
    return dm.demand_route(dm.intermittency_profile(d.panel), d.statics, "dept_id")


@query(
    "route_mix",
    sql(f"SELECT demand_class, count(*) FILTER (WHERE route = 'pooled') AS pooled, count(*) FILTER (WHERE route = 'univariate') AS univariate FROM ({_ROUTES}) GROUP BY 1", "panel", "statics", profile=_PROFILE),
)
def _mix(d: Data):
    return dm.route_mix(dm.demand_route(dm.intermittency_profile(d.panel), d.statics, "dept_id"))


@query(
    "zero_rate_extremes",
    sql(
        f"""(SELECT 'highest' AS kind, unique_id, {R('zero_rate')} AS zero_rate FROM profile ORDER BY profile.zero_rate DESC, unique_id LIMIT 1)
        UNION ALL (SELECT 'lowest', unique_id, {R('zero_rate')} FROM profile ORDER BY profile.zero_rate, unique_id LIMIT 1)""",
        "panel",
        profile=_PROFILE,
    ),
)
def _extremes(d: Data):
    return rounded(dm.zero_rate_extremes(dm.intermittency_profile(d.panel)))


def _requests(d: Data):
    """Requested ids with many repeats: the known series, and type x region ids that the panel doesn't know."""
    return tp.small_facts(d.spark, d.sf_dir).select("unique_id").union(d.facts.select("unique_id"))


@query(
    "score_requests_by_id",
    sql(
        """SELECT unique_id, last_ds + k::INTEGER AS ds, y AS y_hat, NULL AS reason FROM panel JOIN last_day ON ds = last_ds, range(1, 29) t(k)
        UNION ALL SELECT DISTINCT unique_id, NULL, NULL, 'unknown_id' FROM facts_small""",
        "panel",
        "last_day",
        "facts_small",
    ),
)
def _by_id(d: Data):
    requests = _requests(d)
    ok = dm.score_requests_by_id(requests, d.panel, H)
    return ok.unionByName(dm.request_rejects_by_id(requests, d.panel), allowMissingColumns=True)


_SHORT = "SELECT unique_id FROM facts GROUP BY unique_id HAVING count(*) < 55"


@query(
    "score_requests_history",
    sql(
        f"""SELECT unique_id, lo + k::INTEGER AS ds, y_hat, store_id FROM (SELECT unique_id, store_id, max(ds) AS lo, arg_max(y, ds) AS y_hat FROM facts
        WHERE unique_id NOT IN ({_SHORT}) GROUP BY ALL), range(1, 29) t(k)""",
        "facts",
    ),
)
def _by_history(d: Data):
    history = d.facts.select("unique_id", "ds", "y")
    out = dm.score_requests_history(history, d.statics, 28, min_rows=55)
    return out.select("unique_id", "ds", "y_hat", "store_id")


@query(
    "validate_requests",
    sql(
        """SELECT unique_id, n_rows, concat_ws(',', CASE WHEN lo < 0 THEN 'negative_y' END, CASE WHEN n_rows < 55 THEN 'short_history' END, CASE WHEN state_id <> 'ASIA' THEN 'unknown_id' END) AS reasons
        FROM (SELECT unique_id, state_id, count(*) AS n_rows, min(y - 1.5) AS lo FROM facts GROUP BY ALL) WHERE lo < 0 OR n_rows < 55 OR state_id <> 'ASIA'""",
        "facts",
    ),
)
def _validate(d: Data):
    history = d.facts.select("unique_id", "ds", (F.col("y") - 1.5).alias("y"))
    return dm.validate_requests(history, d.statics.where(F.col("state_id") == "ASIA"), min_rows=55)


@query(
    "batch_limits",
    sql(
        """SELECT 'horizon' AS "check", 28::BIGINT AS value, 56::BIGINT AS cap, false AS rejected UNION ALL SELECT 'series', count(DISTINCT unique_id), 500, count(DISTINCT unique_id) > 500 FROM facts
        UNION ALL SELECT 'history_rows', count(*), 50000, count(*) > 50000 FROM facts""",
        "facts",
    ),
)
def _limits(d: Data):
    return dm.batch_limits(d.facts, 28, max_horizon=56, max_series=500, max_rows=50_000)
