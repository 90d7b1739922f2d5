"""Exact order-based helpers against brute force, with a hot key and many copies."""

import numpy as np
import pandas as pd
from conftest import rows
from pyspark.sql import functions as F

from demandloom.functions.ordered import exact_quantiles, running_totals


def _hot(n=3000):
    rng = np.random.default_rng(1)
    key = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b"], n))
    value = np.where(rng.random(n) < 0.4, 2.5, rng.normal(size=n) * 10)
    value[:50] = 0.0
    return pd.DataFrame({"key": key, "value": value, "id": [f"s{i:05d}" for i in range(n)]})


def test_quantiles_equal_numpy(spark):
    pdf = _hot()
    probs = [0.0, 0.1, 0.5, 0.77, 0.9, 1.0]
    got = {(r["key"], r["p"]): r["q"] for r in rows(exact_quantiles(spark.createDataFrame(pdf), ["key"], "value", probs))}
    for key, g in pdf.groupby("key"):
        for p in probs:
            assert np.isclose(got[key, p], np.quantile(g["value"], p), rtol=1e-12), (key, p)


def test_quantiles_without_keys_and_with_null_key(spark):
    pdf = _hot(200)
    assert len(rows(exact_quantiles(spark.createDataFrame(pdf), [], "value", [0.5]))) == 1
    nulled = spark.createDataFrame(pdf).withColumn("key", F.when(F.col("key") != "a", F.col("key")))
    assert {r["key"] for r in rows(exact_quantiles(nulled, ["key"], "value", [0.5]))} == {"hot", "b", None}


def test_running_totals_equal_cumsum(spark):
    pdf = _hot()
    df = running_totals(
        spark.createDataFrame(pdf), ["key"], [F.desc("value"), F.asc("id")], {"rank": F.lit(1), "cum": F.col("value")}
    ).toPandas()
    ref = pdf.sort_values(["key", "value", "id"], ascending=[True, False, True])
    ref["rank"] = ref.groupby("key").cumcount() + 1
    ref["cum"] = ref.groupby("key")["value"].cumsum()
    both = df.merge(ref, on="id", suffixes=("", "_ref"))
    assert len(both) == len(pdf)
    assert (both["rank"] == both["rank_ref"]).all()
    assert np.allclose(both["cum"], both["cum_ref"])
