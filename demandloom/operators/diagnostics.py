"""Residual diagnostics, error concentration, paired bootstrap and score-table facts."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandloom.functions.expr import draw_index, ratio
from demandloom.functions.ordered import exact_quantiles, running_totals
from demandloom.operators.metrics import error, per_series_rmsse, rmsse, squared_error_by
from demandloom.operators.reshape import keep_series
from demandloom.operators.scoring import ScoringInputs

DRAW_BLOCK = 64 << 20  # bytes of drawn rows that every task of a bootstrap holds


def residuals_long(inp: ScoringInputs) -> DataFrame:
    """``model, unique_id, ds, y, y_hat, residual`` (forecast minus truth)."""
    return inp.long.select("model", "unique_id", "ds", "y", "y_hat", error().alias("residual"))


def bias_variance(inp: ScoringInputs) -> DataFrame:
    """Bias, squared bias, population variance, mse and rmse of the pooled residuals."""
    return (
        inp.long.withColumn("_r", error())
        .groupBy("model")
        .agg(F.avg("_r").alias("bias"), F.var_pop("_r").alias("variance"), F.avg(F.col("_r") * F.col("_r")).alias("mse"))
        .select("model", "bias", (F.col("bias") * F.col("bias")).alias("bias_sq"), "variance", "mse", F.sqrt("mse").alias("rmse"))
        .orderBy("mse", "model")
    )


def error_concentration(inp: ScoringInputs) -> DataFrame:
    """Per model the series by falling contribution with cumulative weight and error shares.

    Every series is in the curve; the running sums are made range by range.
    """
    scored = squared_error_by(inp.long).join(inp.components, "unique_id")
    part = scored.select("model", "unique_id", "weight", F.coalesce(F.col("weight") * rmsse(), F.lit(0.0)).alias("contribution"))
    totals = part.groupBy("model").agg(F.sum("weight").alias("_w"), F.sum("contribution").alias("_c")).where(F.col("_c") > 0)
    ordered = running_totals(
        part,
        ["model"],
        [F.desc("contribution"), F.asc("unique_id")],
        {"rank": F.lit(1).cast("bigint"), "_cw": F.col("weight"), "_cc": F.col("contribution")},
    )
    return ordered.join(F.broadcast(totals), "model").select(  # one row per model
        "model",
        "unique_id",
        "rank",
        (F.col("_cw") / F.col("_w")).alias("cum_weight"),
        (F.col("_cc") / F.col("_c")).alias("cum_error_share"),
    )


def bootstrap_pvalues(inp: ScoringInputs, n_iter: int = 1000, seed: int = 42) -> DataFrame:
    """Share of resamples in which model A is not better than model B, for every ordered pair.

    Series are drawn with replacement by a hash of (seed, iteration, draw), so all pairs share
    the draws and any engine can repeat them. Each resample needs one weighted sum per model;
    the pair differences are taken on those (iterations x models) sums.
    """
    models = list(inp.models)
    per = per_series_rmsse(inp.cv, inp.components, models).join(inp.components.select("unique_id", "weight"), "unique_id")
    wide = (
        per.groupBy("unique_id", "weight")
        .pivot("model", models)
        .agg(F.max("rmsse"))
        .dropna(subset=models)
    )
    numbered = running_totals(wide, [], [F.asc("unique_id")], {"_pos": F.lit(1).cast("bigint")})
    n, total = numbered.agg(F.count("*"), F.sum("weight")).first()
    if not n:
        return inp.cv.sparkSession.createDataFrame([], "model_a string, model_b string, p_value double")
    share = F.col("weight") / F.lit(total) if total > 0 else F.col("weight")
    terms = numbered.select((F.col("_pos") - 1).alias("_pick"), *[(share * F.col(f"`{m}`")).alias(f"_m{k}") for k, m in enumerate(models)])
    sums = resampled_sums(terms, n, [f"_m{k}" for k in range(len(models))], n_iter, seed)
    pairs = [
        F.struct(
            F.lit(a).alias("model_a"),
            F.lit(b).alias("model_b"),
            (F.lit(1.0) if a == b else (F.col(f"_m{i}") - F.col(f"_m{j}") >= 0).cast("double")).alias("hit"),
        )
        for i, a in enumerate(models)
        for j, b in enumerate(models)
    ]
    return sums.select(F.inline(F.array(*pairs))).groupBy("model_a", "model_b").agg(F.avg("hit").alias("p_value"))


def resampled_sums(terms: DataFrame, n: int, names: Sequence[str], n_iter: int, seed: int, block_rows: int | None = None) -> DataFrame:
    """``iteration`` and the sums of ``names`` over n draws with replacement from ``terms`` (``_pick`` from 0 to n - 1).

    Draws are made where they are counted: a task goes through its iterations, looks the drawn rows up in a block of terms
    and sends one partial sum per iteration, so n_iter * n draws are never shuffled. A block is broadcast; it has at most
    ``DRAW_BLOCK`` bytes, and more terms make more blocks (the draws are then repeated per block).
    """
    rows = block_rows or max(1, DRAW_BLOCK // (8 * (len(names) + 1)))
    parts = None
    for at in range(0, n, rows):
        block = terms.where((F.col("_pick") >= at) & (F.col("_pick") < at + rows))
        draws = terms.sparkSession.range(n_iter * n).select(
            F.floor(F.col("id") / n).alias("iteration"), draw_index(n, F.lit(seed), F.floor(F.col("id") / n), F.col("id") % n).alias("_pick")
        )
        part = draws.join(F.broadcast(block), "_pick").groupBy("iteration").agg(*[F.sum(m).alias(m) for m in names])
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("iteration").agg(*[F.sum(m).alias(m) for m in names])


def residual_drift(residuals: DataFrame) -> DataFrame:
    """Mean residual per (model, day)."""
    return residuals.groupBy("model", "ds").agg(F.avg("residual").alias("mean_residual"))


def residual_histogram(residuals: DataFrame) -> DataFrame:
    """Counts in ``min(60, max(10, floor(sqrt(n))))`` equal-width bins per model."""
    known = residuals.where(F.col("residual").isNotNull())
    span = known.groupBy("model").agg(F.min("residual").alias("_lo"), F.max("residual").alias("_hi"), F.count("*").alias("_n"))
    bins = F.least(F.lit(60), F.greatest(F.lit(10), F.floor(F.sqrt("_n")))).cast("int")
    place = F.floor(ratio(F.col("residual") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * F.col("bins")).cast("int")
    joined = known.join(F.broadcast(span.withColumn("bins", bins)), "model")  # one row per model
    bin_of = F.coalesce(F.least(place, F.col("bins") - 1), F.lit(0))
    width = (F.col("_hi") - F.col("_lo")) / F.col("bins")
    return (
        joined.withColumn("bin", bin_of)
        .groupBy("model", "bins", "bin", "_lo", "_hi")
        .agg(F.count("*").alias("n"))
        .select("model", "bins", "bin", (F.col("_lo") + F.col("bin") * width).alias("left"), (F.col("_lo") + (F.col("bin") + 1) * width).alias("right"), "n")
    )


def residual_qq(residuals: DataFrame, points: int = 199) -> DataFrame:
    """Residual quantiles against normal quantiles on an even probability grid.

    The normal quantiles of the grid are constants, so no residual is sorted globally.
    """
    grid = [(k + 1) / (points + 1) for k in range(points)]
    normal = NormalDist()
    theory = residuals.sparkSession.createDataFrame([(p, normal.inv_cdf(p)) for p in grid], "p double, theoretical double")
    return exact_quantiles(residuals, ["model"], "residual", grid, out="residual").join(F.broadcast(theory), "p")


def calibration_deciles(residuals: DataFrame, bins: int = 10) -> DataFrame:
    """Per forecast decile of each model the mean forecast, truth and residual.

    Decile edges that coincide are merged, so a model may have fewer bins.
    """
    known = residuals.dropna(subset=["y_hat", "y", "residual"])
    edges = exact_quantiles(known, ["model"], "y_hat", [k / bins for k in range(bins + 1)])
    edges = edges.groupBy("model").agg(F.array_sort(F.collect_set("q")).alias("_edges"))
    below = F.size(F.filter("_edges", lambda e: e < F.col("y_hat")))
    return (
        known.join(F.broadcast(edges), "model")  # one row per model
        .withColumn("bin", F.greatest(below - 1, F.lit(0)))
        .groupBy("model", "bin")
        .agg(F.avg("y_hat").alias("mean_forecast"), F.avg("y").alias("mean_y"), F.avg("residual").alias("mean_residual"), F.count("*").alias("n"))
    )


def exemplar_series(train: DataFrame) -> DataFrame:
    """Least and most intermittent series of the high, mid and low volume third: ``tier, kind, unique_id``."""
    per = train.groupBy("unique_id").agg(F.avg("y").alias("mean_y"), F.avg((F.col("y") == 0).cast("double")).alias("zero_share")).dropna()
    ranked = running_totals(per, [], [F.desc("mean_y"), F.asc("unique_id")], {"_pos": F.lit(1).cast("bigint")})
    n = ranked.agg(F.max("_pos")).scalar()
    third = F.floor(n / 3)
    high = F.greatest(F.lit(1), third)
    mid = F.greatest(F.lit(2), F.floor(2 * n / 3))
    tier = F.when(F.col("_pos") <= high, "high").when(F.col("_pos") <= mid, "mid").otherwise("low")
    steady = F.min(F.struct("zero_share", "unique_id"))
    lumpy = F.min(F.struct(-F.col("zero_share"), F.col("unique_id")))
    picked = ranked.groupBy(tier.alias("tier")).agg(steady["unique_id"].alias("regular"), lumpy["unique_id"].alias("intermittent"))
    other = F.when(F.col("intermittent") != F.col("regular"), F.col("intermittent"))
    both = picked.withColumn("intermittent", other).unpivot(["tier"], ["regular", "intermittent"], "kind", "unique_id")
    return both.where(F.col("unique_id").isNotNull())


def forecast_vs_actual(inp: ScoringInputs, ids: DataFrame, history_days: int = 56) -> DataFrame:
    """Recent history and backtest rows of the chosen series, stacked: ``unique_id, ds, part, y, models``."""
    cv = keep_series(inp.cv, ids)
    start = cv.groupBy("unique_id").agg(F.min("ds").alias("_start"))
    recent = keep_series(inp.train, ids).join(start, "unique_id", "left")
    whole = F.coalesce(F.col("_start"), F.max("ds").over(W.partitionBy("unique_id")))
    recent = recent.withColumn("_from", F.date_sub(whole, history_days)).where(F.col("ds") >= F.col("_from"))
    blank = [F.lit(None).cast("double").alias(m) for m in inp.models]
    left = recent.select("unique_id", "ds", F.lit("history").alias("part"), "y", *blank)
    return left.unionByName(cv.select("unique_id", "ds", F.lit("backtest").alias("part"), "y", *inp.models))


def level_pivot(levels: DataFrame, models: Sequence[str]) -> DataFrame:
    """Level x model matrix of WRMSSE."""
    return levels.groupBy("level_idx", "level").pivot("model", list(models)).agg(F.max("wrmsse")).orderBy("level_idx")


def segment_pivot(segments: DataFrame, models: Sequence[str]) -> DataFrame:
    """Segment x model matrix with the row mean, ordered by it."""
    means = segments.groupBy("segment").agg(
        *[F.max(F.when(F.col("model") == m, F.col("wrmsse"))).alias(m) for m in models], F.avg("wrmsse").alias("row_mean")
    )
    return means.orderBy("row_mean", "segment")


def fold_stability(per_fold: DataFrame) -> DataFrame:
    """Mean, minimum, maximum and sample standard deviation over the folds."""
    return per_fold.groupBy("model").agg(
        F.avg("wrmsse").alias("mean"), F.min("wrmsse").alias("min"), F.max("wrmsse").alias("max"), F.stddev_samp("wrmsse").alias("std")
    )


def horizon_slope(per_horizon: DataFrame) -> DataFrame:
    """Least-squares slope of the score over the horizon step; 0 for a single step."""
    return per_horizon.groupBy("model").agg(
        F.when(F.count("*") > 1, F.regr_slope("wrmsse", "h")).otherwise(0.0).alias("slope"), F.min("h").alias("h_min"), F.max("h").alias("h_max")
    )


def level_winners(levels: DataFrame) -> DataFrame:
    """Number of levels each model wins (ties to the first name)."""
    best = levels.groupBy("level_idx").agg(F.min(F.struct("wrmsse", "model")).alias("_b"))
    return best.groupBy(F.col("_b.model").alias("model")).agg(F.count("*").alias("levels_won"))


def bias_by_segment(inp: ScoringInputs, column: str) -> DataFrame:
    """(mean forecast - mean truth) / mean truth per (model, attribute value)."""
    long = inp.long.dropna(subset=["y", "y_hat"])
    per = long.groupBy("model", "unique_id").agg(F.sum("y").alias("_y"), F.sum("y_hat").alias("_f"), F.count("*").alias("_n"))
    joined = per.join(inp.statics.select("unique_id", F.col(column).alias("segment")), "unique_id")
    mean_y, mean_f = F.sum("_y") / F.sum("_n"), F.sum("_f") / F.sum("_n")
    return joined.groupBy("model", "segment").agg(ratio(mean_f - mean_y, mean_y).alias("bias"))


def network_totals(cv: DataFrame, models: Sequence[str]) -> DataFrame:
    """Sum of the truth and of every forecast per (cutoff, day)."""
    return cv.groupBy("cutoff", "ds").agg(*[F.sum(c).alias(c) for c in ("y", *models)])


def abs_error_by_h(cv: DataFrame, models: Sequence[str]) -> DataFrame:
    """Mean absolute error per horizon step, one column per model."""
    gap = lambda m: F.abs(F.col(f"`{m}`") - F.col("y"))
    return cv.groupBy(F.datediff("ds", "cutoff").alias("h")).agg(*[F.avg(gap(m)).alias(m) for m in models])


def hero_windows(panel: DataFrame, cv: DataFrame, statics: DataFrame, model: str, baseline: str, prefer: str | None = None) -> DataFrame:
    """The series with most active days (of a preferred category if any) with its fold windows.

    One row per backtest day with truth, forecast, baseline and both fold errors.
    """
    active = panel.where(F.col("y") > 0).groupBy("unique_id").agg(F.count("*").alias("_days"))
    active = active.join(statics.select("unique_id", "cat_id"), "unique_id", "left")
    preferred = F.coalesce((F.col("cat_id") == prefer).cast("int"), F.lit(0)) if prefer else F.lit(0)
    hero = active.orderBy(preferred.desc(), F.desc("_days"), "unique_id").limit(1)
    by_fold = W.partitionBy("unique_id", "cutoff")
    off = lambda c: F.sqrt(F.avg(F.pow(F.col(f"`{c}`") - F.col("y"), 2)).over(by_fold))
    return keep_series(cv, hero).select(
        "unique_id", "cutoff", "ds", "y", F.col(f"`{model}`").alias("forecast"), F.col(f"`{baseline}`").alias("baseline"),
        off(model).alias("rmse_forecast"), off(baseline).alias("rmse_baseline"),
    )


def insight_facts(
    headline: DataFrame,
    bias_table: DataFrame,
    pvalues: DataFrame,
    star: DataFrame,
    chain: DataFrame,
    per_fold_fva: DataFrame,
) -> DataFrame:
    """The report's findings as rows ``fact, subject, value``. All inputs are model-sized."""
    named = lambda f: F.lit(f).alias("fact")
    best = headline.agg(F.min(F.struct("wrmsse", "model")).alias("b"), F.max(F.struct("wrmsse", "model")).alias("w"))
    gap = best.select(named("gap_best_to_worst"), F.col("b.model").alias("subject"), ratio(F.col("w.wrmsse") - F.col("b.wrmsse"), F.col("b.wrmsse")).alias("value"))
    biased = bias_table.agg(F.max(F.struct("bias_sq", "model", "bias")).alias("x")).select(named("most_biased"), "x.model", "x.bias")
    pair = (
        pvalues.where(F.col("model_a") != F.col("model_b"))
        .agg(F.min(F.struct("p_value", "model_a", "model_b")).alias("x"))
        .select(named("strongest_pair"), F.concat_ws(" over ", "x.model_a", "x.model_b"), "x.p_value")
    )
    adder = star.where(F.col("fva_abs") > 0).agg(F.max(F.struct("fva_abs", "model")).alias("x")).select(named("best_adder"), "x.model", "x.fva_abs")
    destroyer = star.where(F.col("fva_abs") < 0).agg(F.min(F.struct("fva_abs", "model")).alias("x")).select(named("worst_destroyer"), "x.model", "x.fva_abs")
    steps = chain.where(~F.col("is_baseline")).agg(F.sum("fva_abs").alias("n"), F.count(F.when(F.col("fva_abs") > 0, 1)).alias("up"))
    net = steps.select(named("chain_net"), F.concat(F.col("up").cast("string"), F.lit(" steps added value")), "n")
    share = per_fold_fva.groupBy("model").agg(F.avg((F.col("fva_abs") > 0).cast("double")).alias("s"))
    steady = share.agg(F.min(F.struct(-F.col("s"), F.col("model"), F.col("s").alias("v"))).alias("x")).select(named("most_consistent"), "x.model", "x.v")
    parts = [biased, pair, adder, destroyer, net, steady]
    out = gap
    for p in parts:
        out = out.union(p)
    return out.where(F.col("value").isNotNull())

