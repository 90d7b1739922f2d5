"""Shared session and the toy panel the unit tests work on."""

from __future__ import annotations

import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DAYS = 203
COLUMNS = ["item_id", "dept_id", "cat_id", "store_id", "state_id"]
# item, department, category, store, state, weekday profile (Monday first), price
SERIES = (
    ("tea-green", "tea", "drink", "north-1", "north", (2, 3, 3, 4, 7, 9, 5), 2.4),
    ("tea-black", "tea", "drink", "north-1", "north", (6, 5, 5, 4, 3, 8, 9), 1.9),
    ("soap-oak", "soap", "home", "south-1", "south", (1, 2, 6, 2, 1, 4, 3), 5.5),
)


@pytest.fixture(scope="session")
def spark():
    from demandloom.session import build_session

    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="6g"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def toy_pdf():
    """Dense series: a weekday profile under a slow wave, Poisson counts, prices that rise every ten weeks."""
    rng = np.random.default_rng(7)
    days = pd.date_range("2020-01-01", periods=DAYS)
    wave = 1 + 0.3 * np.cos(np.arange(DAYS) / 20)
    parts = []
    for *attributes, profile, price in SERIES:
        mean = np.array(profile)[days.dayofweek] * wave
        part = pd.DataFrame({"unique_id": f"{attributes[0]}_{attributes[3]}", "ds": days.date, "y": rng.poisson(mean).astype(float)})
        part.loc[0, "y"] = 1.0  # no leading zeros
        parts.append(part.assign(**dict(zip(COLUMNS, attributes)), sell_price=price * (1 + 0.1 * (np.arange(DAYS) // 70))))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="session")
def rough_pdf():
    """Uneven series: another first day each, days without rows, a day with two rows, long zeros, a constant one, a single row."""
    rng = np.random.default_rng(8)
    start = pd.Timestamp("2021-03-01")
    rows_ = []
    for k, length in enumerate((90, 61, 33, 8)):
        for t in sorted(rng.choice(length, size=int(length * 0.7), replace=False).tolist()):
            rows_.append((f"r{k}", start + pd.Timedelta(days=90 - length + t), float(rng.integers(1, 20))))
    rows_.append((*rows_[5][:2], 4.0))
    rows_ += [("quiet", start + pd.Timedelta(days=t), 2.0 if t in (3, 70) else 0.0) for t in range(90)]
    rows_ += [("steady", start + pd.Timedelta(days=t), 6.0) for t in range(20, 90)]
    rows_.append(("once", start + pd.Timedelta(days=44), 9.0))
    out = pd.DataFrame(rows_, columns=["unique_id", "ds", "y"])
    return out.assign(ds=out["ds"].dt.date)


@pytest.fixture(scope="session")
def toy(spark, toy_pdf):
    return spark.createDataFrame(toy_pdf).persist()


@pytest.fixture(scope="session")
def toy_cv_pdf(toy_pdf):
    """Two folds of two weeks: Exact is the truth, High lies 2.25 above it, Naive repeats the last known value."""
    ends = sorted(set(toy_pdf["ds"]))
    parts = []
    for cutoff in (ends[-29], ends[-15]):
        known, ahead = toy_pdf[toy_pdf["ds"] <= cutoff], toy_pdf[toy_pdf["ds"] > cutoff]
        fold = ahead.groupby("unique_id").head(14)[["unique_id", "ds", "y"]]
        last = known.groupby("unique_id")["y"].last()
        parts.append(fold.assign(cutoff=cutoff, Exact=fold["y"], High=fold["y"] + 2.25, Naive=fold["unique_id"].map(last)))
    return pd.concat(parts, ignore_index=True)[["unique_id", "ds", "cutoff", "y", "Exact", "High", "Naive"]]


@pytest.fixture(scope="session")
def toy_scoring(spark, toy, toy_cv_pdf):
    from demandloom.operators.reshape import static_attributes
    from demandloom.operators.scoring import ScoringInputs

    return ScoringInputs.build(spark.createDataFrame(toy_cv_pdf).persist(), toy, static_attributes(toy))


def rows(df):
    """Collected rows as dicts."""
    return [r.asDict() for r in df.collect()]
