"""Reshaping, ingest and features on small frames with the edge rows that matter."""

import datetime as dt

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from demandloom.operators import features as ft
from demandloom.operators import folds as fd
from demandloom.operators import reshape as rs
from demandloom.sources import cv_tables, retail, sinks


def _day(k):
    return dt.date(2020, 1, 1) + dt.timedelta(days=k)


def test_densify_fills_gaps_to_the_last_day(spark):
    facts = spark.createDataFrame([("a", _day(0), 2.0), ("a", _day(3), 1.0), ("b", _day(2), 5.0)], "unique_id string, ds date, y double")
    got = {(r["unique_id"], r["ds"]): r["y"] for r in rows(rs.densify_panel(facts))}
    assert got == {
        ("a", _day(0)): 2.0, ("a", _day(1)): 0.0, ("a", _day(2)): 0.0, ("a", _day(3)): 1.0, ("b", _day(2)): 5.0, ("b", _day(3)): 0.0,
    }


def test_leading_zeros_and_never_sold(spark):
    df = spark.createDataFrame([("a", _day(0), 0.0), ("a", _day(1), 3.0), ("a", _day(2), 0.0), ("z", _day(0), 0.0)], "unique_id string, ds date, y double")
    assert sorted((r["unique_id"], r["ds"]) for r in rows(rs.drop_leading_zeros(df))) == [("a", _day(1)), ("a", _day(2))]


def test_trim_keeps_n_plus_one_days_and_split(toy):
    assert rs.trim_last_n_days(toy, 10).select("ds").distinct().count() == 11
    train, holdout = rs.split_train_horizon(toy, 14)
    assert holdout.select("ds").distinct().count() == 14 and train.count() + holdout.count() == toy.count()


def test_tail_subsample_top(toy):
    assert rs.tail_per_group(toy, 5).count() == 15
    assert rs.subsample_series(toy, 2).select("unique_id").distinct().count() == 2
    assert rs.top_n_series(toy, 1).count() == 1


def test_narrow_types(spark):
    out = rs.narrow_types(spark.range(5).select(F.col("id").alias("small"), (F.col("id") * 100_000).alias("wide"), F.lit(1.5).alias("x")))
    assert [f.dataType.simpleString() for f in out.schema] == ["tinyint", "int", "float"]


def test_submission_layouts_and_errors(spark, toy):
    preds = rs.future_frame(toy, 3).withColumn("y_hat", F.lit(1.0))
    assert rs.submission_wide(preds, h=3).columns == ["unique_id", "F1", "F2", "F3"]
    assert rs.submission_wide(preds, h=3, layout="d_index").columns[1] == "d_1942"
    with pytest.raises(ValueError):
        rs.submission_wide(preds, h=4)
    with pytest.raises(ValueError):
        rs.submission_wide(preds.withColumn("other", F.lit(0)), h=3)


@pytest.fixture
def raw_dir(tmp_path):
    days = [_day(k) for k in range(6)]
    cal = ["date,wm_yr_wk,event_name_1,event_type_1,event_name_2,event_type_2,snap_CA,snap_TX,snap_WI"]
    cal += [f"{d},{11101 + k // 3},{'Xmas' if k == 2 else ''},,,,1,0,0" for k, d in enumerate(days)]
    (tmp_path / "calendar.csv").write_text("\n".join(cal) + "\n")
    (tmp_path / "sell_prices.csv").write_text("store_id,item_id,wm_yr_wk,sell_price\nCA_1,F_1_001,11101,2.5\n")
    head = "id,item_id,dept_id,cat_id,store_id,state_id," + ",".join(f"d_{k + 1}" for k in range(6))
    body = ["x,F_1_001,F_1,F,CA_1,CA,0,0,3,0,1,0", "y,F_1_002,F_1,F,CA_1,CA,0,0,0,0,0,0", "z,F_1_003,F_1,F,CA_1,CA,4,0,0,0,0,0"]
    (tmp_path / "sales_train_validation.csv").write_text("\n".join([head, *body]) + "\n")
    return str(tmp_path)


def test_build_long_from_csv(spark, raw_dir):
    cal, prices, sales = retail.load_calendar(spark, raw_dir), retail.load_prices(spark, raw_dir), retail.load_sales_wide(spark, raw_dir)
    assert {r["event_name_1"] for r in rows(cal)} == {"none", "Xmas"}
    long = rs.build_long(sales, cal, prices)
    got = {(r["unique_id"], r["ds"]): (r["y"], r["sell_price"]) for r in rows(long)}
    assert len(got) == 4 + 6 and got["F_1_001_CA_1", _day(2)] == (3.0, 2.5) and got["F_1_001_CA_1", _day(4)] == (1.0, None)
    trimmed = rows(rs.build_long(sales, cal, prices, last_n_days=2))
    assert sorted({r["ds"] for r in trimmed}) == [_day(3), _day(4), _day(5)] and len(trimmed) == 6


def test_quoted_sales_and_first_days(spark, raw_dir):
    path = f"{raw_dir}/sales_train_evaluation.csv"
    head = "id,item_id,dept_id,cat_id,store_id,state_id,d_1,d_2,d_3"
    with open(path, "w") as f:
        f.write(head + '\n"a, ""b""","F,1",F_1,F,CA_1,CA,1,"2",3\nx,F_2,F_1,F,CA_1,CA,,5,6\n')
    got = {r["id"]: r for r in rows(retail.load_sales_wide(spark, raw_dir, n_days=2))}
    assert got['a, "b"']["unique_id"] == "F,1_CA_1" and got['a, "b"']["units"] == [1.0, 2.0]
    assert got["x"]["units"] == [None, 5.0] and len(retail.load_sales_wide(spark, raw_dir).first()["units"]) == 3


def test_price_ranks_share_ties_and_skip_missing_prices(spark):
    prices = [("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", None), ("e", 5.0)]
    table = spark.createDataFrame([(u, "S", _day(0), p) for u, p in prices], "unique_id string, store_id string, ds date, sell_price double")
    got = {r["unique_id"]: r["price_rank_in_store"] for r in rows(ft.feat_price_stats(table))}
    assert got == {"a": 1.0, "b": 2.5, "c": 2.5, "d": None, "e": 4.0}


def test_calendar_with_a_gap_is_refused(spark, tmp_path):
    (tmp_path / "calendar.csv").write_text("date,wm_yr_wk\n2020-01-01,1\n2020-01-03,1\n")
    with pytest.raises(ValueError):
        retail.load_calendar(spark, str(tmp_path))


def test_cv_loaders(spark, toy_cv_pdf, tmp_path):
    cv = spark.createDataFrame(toy_cv_pdf)
    first, last = min(toy_cv_pdf["cutoff"]), max(toy_cv_pdf["cutoff"])
    sinks.sink_parquet(cv.where(F.col("cutoff") == first).select("unique_id", "ds", "cutoff", "y", "Naive"), f"{tmp_path}/cv_a.parquet")
    sinks.sink_parquet(cv.where(F.col("cutoff") == last).select("unique_id", "ds", "cutoff", "y", "Naive"), f"{tmp_path}/cv_b.parquet")
    found = cv_tables.discover(spark, str(tmp_path))
    assert list(found) == ["a", "b"]
    with pytest.raises(ValueError):
        cv_tables.load_cv_inner(spark, found)
    outer, names = cv_tables.load_cv_outer(spark, found)
    assert names == ["a:Naive", "b:Naive"] and outer.count() == len(toy_cv_pdf) and outer.where(F.col("y").isNull()).count() == 0
    inner, names = cv_tables.load_cv_inner(spark, {"a": found["a"]})
    assert names == ["a_Naive"] and inner.count() == len(toy_cv_pdf) // 2


def test_json_sink_writes_null_for_non_finite(spark, tmp_path):
    df = spark.createDataFrame([("a", float("inf")), ("b", float("nan")), ("c", 1.0)], "model string, v double")
    sinks.sink_dashboard_json({"t": df}, str(tmp_path))
    assert {r["model"]: r["v"] for r in rows(spark.read.schema("model string, v double").json(f"{tmp_path}/t"))} == {"a": None, "b": None, "c": 1.0}


def test_train_bundle(spark, toy, tmp_path):
    paths = sinks.sink_train_bundle(toy, str(tmp_path), "v1")
    meta = spark.read.parquet(paths["metadata"]).first()
    assert (meta["n_series"], meta["n_rows"], meta["min_history_required"]) == (3, 609, 55)
    assert spark.read.parquet(paths["history"]).count() == 3 * 121
    assert spark.read.parquet(paths["latest"]).first()["version"] == "v1"


# --- features --------------------------------------------------------------------------------


def test_week_differs_from_iso_in_2016(spark):
    df = spark.createDataFrame([(dt.date(2016, 1, 4),), (dt.date(2015, 6, 1),)], "ds date")
    plain = {r["ds"]: r["week"] for r in rows(ft.feat_date(df))}
    iso = {r["ds"]: r["week"] for r in rows(ft.feat_date(df, iso_week=True))}
    assert plain[dt.date(2015, 6, 1)] == iso[dt.date(2015, 6, 1)] and plain[dt.date(2016, 1, 4)] == 2 and iso[dt.date(2016, 1, 4)] == 1


def test_event_distance_is_strict_and_999_without_events(spark):
    names = ["Xmas", "none", "none", "Xmas"]
    df = spark.createDataFrame([("a", _day(k), n) for k, n in enumerate(names)], "unique_id string, ds date, event_name_1 string")
    got = [(r["days_to_next_event"], r["days_since_last_event"]) for r in rows(ft.feat_event_distance(df).orderBy("ds"))]
    assert got == [(3, 999), (2, 1), (1, 2), (999, 3)]
    quiet = ft.feat_event_distance(df.withColumn("event_name_1", F.lit("none")))
    assert {(r["days_to_next_event"], r["days_since_last_event"]) for r in rows(quiet)} == {(999, 999)}


def test_price_rank_averages_ties(spark):
    data = [("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", 5.0), ("e", None)]
    df = spark.createDataFrame([(u, _day(0), "s", p) for u, p in data], "unique_id string, ds date, store_id string, sell_price double")
    assert {r["unique_id"]: r["price_rank_in_store"] for r in rows(ft.feat_price_stats(df))} == {"a": 1.0, "b": 2.5, "c": 2.5, "d": 4.0, "e": None}


def test_full_feature_frame(toy):
    out = ft.build_features(toy.withColumn("event_name_1", F.lit("none")).withColumn("snap_NORTH", F.lit(1)), states=["NORTH"])
    pdf = out.toPandas()
    assert len(pdf) == 609 and set(ft.DYNAMIC_COLUMNS) <= set(pdf.columns)
    assert abs(pdf["price_norm"].mean() - 1) < 1e-9
    assert set(pdf.loc[pdf["state_id"] == "north", "snap"]) == {1} and set(pdf.loc[pdf["state_id"] == "south", "snap"]) == {0}
    assert pdf["days_since_release"].min() >= 0


def test_mean_encoding_as_of_ignores_later_rows(toy, toy_pdf):
    cut = dt.date(2020, 3, 1)
    got = ft.feat_mean_encoding(toy, as_of=F.lit(cut)).where((F.col("cat_id") == "drink") & (F.col("dayofweek") == 0)).first()["cat_id_mean_dow"]
    seen = toy_pdf[(toy_pdf["ds"] <= cut) & (toy_pdf["cat_id"] == "drink") & (pd.to_datetime(toy_pdf["ds"]).dt.dayofweek == 0)]
    assert abs(got - seen["y"].mean()) < 1e-9


def test_difference_round_trip(toy):
    cut = dt.date(2020, 7, 1)
    diffs = ft.feat_difference(toy).where(F.col("ds") > F.lit(cut)).select("unique_id", "ds", F.col("y_diff").alias("v"), "y")
    last = toy.where(F.col("ds") == F.lit(cut)).select("unique_id", F.col("y").alias("level"))
    assert ft.undo_difference(diffs, last, "v").where(F.abs(F.col("v") - F.col("y")) > 1e-9).count() == 0


def test_context_window_pads_with_zeros(spark):
    df = spark.createDataFrame([("a", _day(0), 1.0), ("a", _day(1), 2.0)], "unique_id string, ds date, y double")
    assert ft.feat_context_window(df, 4).first()["context"] == [0.0, 0.0, 1.0, 2.0]
    assert ft.feat_context_window(df, 1).first()["context"] == [2.0]


# --- folds -----------------------------------------------------------------------------------


def test_baseline_cv_matches_pandas(toy, toy_pdf):
    got = fd.baseline_cv(toy, 14, 2).toPandas()
    assert len(got) == 2 * 14 * 3 and got["cutoff"].nunique() == 2
    for r in got.sample(20, random_state=0).to_dict("records"):
        hist = toy_pdf[(toy_pdf["unique_id"] == r["unique_id"]) & (toy_pdf["ds"] <= r["cutoff"])]["y"].to_numpy()
        assert r["Naive"] == hist[-1] and r["SeasonalNaive"] == hist[-7:][((r["ds"] - r["cutoff"]).days - 1) % 7]


def test_short_history_uses_the_mean_and_overlapping_folds(spark):
    df = spark.createDataFrame([("a", _day(k), float(k)) for k in range(9)], "unique_id string, ds date, y double")
    got = rows(fd.baseline_cv(df, 3, 3, step=1))
    assert len(got) == 9 and {r["cutoff"] for r in got} == {_day(3), _day(4), _day(5)}
    assert {r["SeasonalNaive"] for r in got if r["cutoff"] == _day(3)} == {1.5}


def test_ensemble_checks_weights(toy):
    cv = fd.baseline_cv(toy, 7, 1)
    with pytest.raises(ValueError):
        fd.ensemble(cv, ["Naive"], [1.0, 2.0])
    with pytest.raises(ValueError):
        fd.ensemble(cv, ["Naive", "SeasonalNaive"], [1.0, -1.0])


def test_densify_keeps_repeated_days_and_drops_later_rows(spark):
    from pyspark.sql import functions as F

    from demandloom.operators.reshape import densify_panel

    facts = spark.sql(
        "SELECT 'a' AS unique_id, DATE '2020-01-01' AS ds, 2.0D AS y UNION ALL SELECT 'a', DATE '2020-01-01', 3.0D "
        "UNION ALL SELECT 'a', DATE '2020-01-03', 4.0D UNION ALL SELECT 'a', DATE '2020-01-09', 9.0D UNION ALL SELECT 'b', DATE '2020-01-04', 1.0D"
    )
    got = densify_panel(facts, until=F.lit("2020-01-04").cast("date"))
    rows = sorted((r.unique_id, r.ds.day, r.y) for r in got.collect())
    assert rows == [("a", 1, 2.0), ("a", 1, 3.0), ("a", 2, 0.0), ("a", 3, 4.0), ("a", 4, 0.0), ("b", 4, 1.0)]


def test_uneven_series_are_filled_to_the_last_day(spark, rough_pdf):
    last = max(rough_pdf["ds"])
    dense = rs.densify_panel(spark.createDataFrame(rough_pdf)).toPandas()
    for uid, part in rough_pdf.groupby("unique_id"):
        got = dense[dense["unique_id"] == uid]
        assert got["ds"].nunique() == (last - min(part["ds"])).days + 1 and got["y"].sum() == part["y"].sum()
        twice = part["ds"].duplicated().sum()
        assert len(got) == got["ds"].nunique() + twice
