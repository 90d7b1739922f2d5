"""Forecast reconciliation over the sparse summing edges.

A horizon is held as columns ``k1..kh`` of one row per node or bottom series. The normal
equations ``S' W^-1 S b = S' W^-1 y`` are solved directly in two passes over blocks of bottom series (``border``).
Where the border of the blocks is too large for that, conjugate gradients take over, whose products with S
and S' are joins with the edges and grouped sums. No matrix with a series-sized side exists and
no node's rows are gathered in one task; what reaches the driver has the size of the horizon, of
the residual window (days) or of a border of checked size, never of the panel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.operators import border as bd
from demandloom.operators.erm_l1 import Lasso, l1_regressions
from demandloom.session import settle

TINY = 1e-12
VAR_FLOOR = bd.VAR_FLOOR


def bottom_up(forecast: DataFrame, edges: DataFrame, model: str, out: str = "BottomUp") -> DataFrame:
    """Every node is the sum of its bottom forecasts."""
    by = [c for c in ("cutoff", "ds") if c in forecast.columns]
    joined = forecast.join(edges, forecast["unique_id"] == edges["bottom_id"])
    return joined.groupBy("level_idx", F.col("node").alias("unique_id"), *by).agg(F.sum(F.col(f"`{model}`")).alias(out))


def _cols(h: int) -> list[str]:
    return [f"k{j}" for j in range(1, h + 1)]


def _sum_up(bottom: DataFrame, edges: DataFrame, h: int) -> DataFrame:
    """S v: bottom rows to node rows."""
    return edges.select("bottom_id", "node_id").join(bottom, "bottom_id").groupBy("node_id").agg(*[F.sum(c).alias(c) for c in _cols(h)])


def _sum_down(nodes: DataFrame, edges: DataFrame, h: int) -> DataFrame:
    """S' v: node rows to bottom rows."""
    return edges.select("bottom_id", "node_id").join(nodes, "node_id").groupBy("bottom_id").agg(*[F.sum(c).alias(c) for c in _cols(h)])


Weigh = Callable[[DataFrame], DataFrame]  # node rows -> node rows times W^-1


def diagonal_weights(weights: DataFrame, h: int) -> Weigh:
    """W^-1 for a diagonal W given as ``node_id, w`` (the variances)."""

    def apply(nodes: DataFrame) -> DataFrame:
        scaled = nodes.join(weights, "node_id")
        return scaled.select("node_id", *[(F.col(c) / F.greatest("w", F.lit(TINY))).alias(c) for c in _cols(h)])

    return apply


def _totals(df: DataFrame, terms: Sequence[Column]) -> np.ndarray:
    row = df.agg(*[F.coalesce(F.sum(t), F.lit(0.0)).alias(f"t{i}") for i, t in enumerate(terms)]).first()
    return np.array(row, dtype=float)


def solve_bottom(
    base: DataFrame, edges: DataFrame, weigh: Weigh, diagonal: DataFrame, h: int, *, tol: float = 1e-9, max_iter: int = 1000
) -> DataFrame:
    """Reconciled bottom forecasts ``bottom_id, k1..kh`` by preconditioned conjugate gradients.

    Starts from the base forecasts of the bottom level. ``diagonal`` (``bottom_id, m``) is the
    diagonal of the system, or near it. Step lengths are one number per horizon step. The state
    is checkpointed in every iteration. Raises if the tolerance isn't reached in ``max_iter`` steps.
    """
    ks = _cols(h)
    own = edges.where(F.col("is_bottom")).select("bottom_id", "node_id").join(base, "node_id").select("bottom_id", *ks)
    gap = base.join(_sum_up(own, edges, h).select("node_id", *[F.col(c).alias(f"u_{c}") for c in ks]), "node_id")
    gap = gap.select("node_id", *[(F.col(c) - F.col(f"u_{c}")).alias(c) for c in ks])
    r0 = _sum_down(weigh(gap), edges, h).select("bottom_id", *[F.col(c).alias(f"r_{c}") for c in ks])
    start = own.join(r0, "bottom_id").join(diagonal, "bottom_id")
    state = settle(start.select("*", *[(F.col(f"r_{c}") / F.col("m")).alias(f"p_{c}") for c in ks]))
    rz = _totals(state, [F.col(f"r_{c}") * F.col(f"p_{c}") for c in ks])
    scaled = _sum_down(weigh(base), edges, h).join(diagonal, "bottom_id")
    limit = tol * tol * np.maximum(_totals(scaled, [F.col(c) * F.col(c) / F.col("m") for c in ks]), TINY)
    for _ in range(max_iter):
        if np.all(rz <= limit):
            break
        direction = state.select("bottom_id", *[F.col(f"p_{c}").alias(c) for c in ks])
        image = _sum_down(weigh(_sum_up(direction, edges, h)), edges, h)
        both = settle(state.join(image.select("bottom_id", *[F.col(c).alias(f"a_{c}") for c in ks]), "bottom_id"))
        pap = _totals(both, [F.col(f"p_{c}") * F.col(f"a_{c}") for c in ks])
        alpha = np.where(pap > 0, rz / np.where(pap > 0, pap, 1.0), 0.0)
        new_r = {c: F.col(f"r_{c}") - float(a) * F.col(f"a_{c}") for c, a in zip(ks, alpha, strict=True)}
        rz_next = _totals(both, [new_r[c] * new_r[c] / F.col("m") for c in ks])
        beta = np.where(rz > 0, rz_next / np.where(rz > 0, rz, 1.0), 0.0)
        state = both.select(
            "bottom_id",
            "m",
            *[(F.col(c) + float(a) * F.col(f"p_{c}")).alias(c) for c, a in zip(ks, alpha, strict=True)],
            *[new_r[c].alias(f"r_{c}") for c in ks],
            *[(new_r[c] / F.col("m") + float(b) * F.col(f"p_{c}")).alias(f"p_{c}") for c, b in zip(ks, beta, strict=True)],
        )
        rz = rz_next
    else:
        if not np.all(rz <= limit):
            raise RuntimeError(f"reconciliation hasn't converged after {max_iter} iterations")
    return settle(state.select("bottom_id", *ks))


def system_diagonal(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """Diagonal of S' W^-1 S for a diagonal W: per bottom series the sum of 1 / w over its nodes."""
    joined = edges.select("bottom_id", "node_id").join(weights, "node_id")
    return settle(joined.groupBy("bottom_id").agg(F.sum(1 / F.greatest("w", F.lit(TINY))).alias("m")))


# --- shrunken covariance in low-rank form ----------------------------------------------------


def _partial_matrix(rows: DataFrame, fn: Callable[[pd.DataFrame], np.ndarray], side: int) -> np.ndarray:
    """Sum over all rows of a (days x side) matrix: partial sums per task, then per day.

    ``fn`` maps a batch to its matrix. Only (days x side) numbers come to the driver.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                part = fn(pdf)
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"t": np.arange(len(total)), "v": [np.asarray(r, dtype=float).tobytes() for r in total]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"t": [int(pdf["t"].iloc[0])], "v": [np.sum([np.frombuffer(v) for v in pdf["v"]], axis=0).tobytes()]})

    parts = rows.mapInPandas(partial, "t int, v binary")
    merged = parts.groupBy("t").applyInPandas(merge, "t int, v binary").orderBy("t").collect()
    return np.array([np.frombuffer(r["v"]) for r in merged]).reshape(len(merged), side)


def standardised_residuals(base: DataFrame) -> DataFrame:
    """``node_id, x array(T), d``: centred residuals over their standard deviation, and the variance.

    Days before a series began are NaN and count as no residual. A node without variance gets zeros.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            actual, fitted = (np.array(pdf[c].tolist()).reshape(len(pdf), -1) for c in ("actual", "fitted"))
            x, var = bd.standardise(actual, fitted)
            yield pd.DataFrame({"node_id": pdf["node_id"], "x": [list(map(float, r)) for r in x], "d": var})

    return base.select("node_id", "actual", "fitted").mapInPandas(run, "node_id string, x array<double>, d double")


def shrinkage_intensity(gram: np.ndarray, trace: float, fourth: float) -> float:
    """Share of the diagonal target from the (days x days) Gram matrix of standardised residuals.

    ``trace`` (squared correlations of nodes with themselves) and ``fourth`` take the diagonal out again;
    a constant node adds nothing to either.

    Uses that sums over all pairs of series equal sums over all pairs of days.
    """
    days = len(gram)
    squares = float((gram**2).sum()) / days**2
    off = squares - trace
    spread = float((np.diag(gram) ** 2).sum()) - days * squares - fourth
    if off <= 0:
        return 1.0
    return float(np.clip(days / (days - 1) ** 3 * spread / off, 0.0, 1.0))


def shrunk_weights(residuals: DataFrame, h: int) -> tuple[Weigh, float]:
    """W^-1 for W = lam D + (1 - lam) R R' / T by the Woodbury identity, and lam."""
    ks = _cols(h)
    days = len(residuals.select("x").first()[0])
    gram = _partial_matrix(residuals, lambda pdf: (lambda x: x.T @ x)(np.array(pdf["x"].tolist())), days)
    # a node's correlation with itself: 1 with all days, less with missing ones, 0 without variance
    own = residuals.withColumn("_r", F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v) / days)
    quartic = F.aggregate("x", F.lit(0.0), lambda a, v: a + (v * v - F.col("_r")) * (v * v - F.col("_r")))
    trace, fourth = own.agg(F.sum(F.col("_r") * F.col("_r")), F.sum(quartic)).first()
    lam = max(shrinkage_intensity(gram, trace, fourth), 1e-4)
    if lam >= 1.0:
        return diagonal_weights(residuals.select("node_id", F.col("d").alias("w")), h), 1.0
    inner = np.linalg.inv(gram + lam * days / (1 - lam) * np.eye(days))

    def apply(nodes: DataFrame) -> DataFrame:
        rows = settle(nodes.join(residuals, "node_id"))

        def project(pdf: pd.DataFrame) -> np.ndarray:
            u = pdf[ks].to_numpy() / np.sqrt(pdf["d"].to_numpy())[:, None]
            return np.array(pdf["x"].tolist()).T @ u

        c = inner @ _partial_matrix(rows, project, h)

        def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                root = np.sqrt(pdf["d"].to_numpy())[:, None]
                x = np.array(pdf["x"].tolist()).reshape(len(pdf), -1)
                out = (pdf[ks].to_numpy() / root - (x @ c if len(pdf) else 0.0)) / lam / root
                yield pd.DataFrame(out, columns=ks).assign(node_id=pdf["node_id"].to_numpy())[["node_id", *ks]]

        return rows.mapInPandas(back, "node_id string, " + ", ".join(f"{k} double" for k in ks))

    return apply, lam


# --- methods ---------------------------------------------------------------------------------


def _wide_columns(h: int) -> list[Column]:
    return [F.element_at("y_hat", j).alias(f"k{j}") for j in range(1, h + 1)]


def _wide(base: DataFrame, h: int) -> DataFrame:
    return base.select("node_id", *_wide_columns(h))


def _weighted(base: DataFrame, edges: DataFrame, method: str) -> tuple[DataFrame, dict[str, bd.Shrinkage] | None]:
    """Base rows ``fold, node_id, y, w[, x]`` with the variances of a method, and its shrinkage by fold."""
    if method in ("ols", "wls_struct"):
        rows = bd.pack_rows(base, lambda pdf: {"w": 1.0}, ", w double", history=False)
        if method == "wls_struct":
            there = edges.where(F.col("is_bottom")).select("bottom_id", "node_id").join(base.select("fold", "node_id"), "node_id")
            size = edges.select("bottom_id", "node_id").join(there.select("fold", "bottom_id"), "bottom_id")
            size = size.groupBy("fold", "node_id").agg(F.count("*").cast("double").alias("w"))
            rows = rows.drop("w").join(size, ["fold", "node_id"])
        return rows, None
    if method == "wls_var":

        def variance(pdf: pd.DataFrame) -> dict:
            gap = np.array(pdf["actual"].tolist()) - np.array(pdf["fitted"].tolist())
            gap = gap.reshape(len(pdf), -1)
            known = np.isfinite(gap)
            return {"w": np.maximum((np.where(known, gap, 0.0) ** 2).sum(axis=1) / np.maximum(known.sum(axis=1), 1), VAR_FLOOR)}

        return _of_one_length(base, variance, ", w double"), None
    if method == "mint_shrink":

        def residuals(pdf: pd.DataFrame) -> dict:
            actual, fitted = (np.array(pdf[c].tolist()).reshape(len(pdf), -1) for c in ("actual", "fitted"))
            x, d = bd.standardise(actual, fitted)
            return {"w": d, "x": [r.tobytes() for r in x]}

        nodes = edges.select("node_id").distinct().count()
        return bd.shrinkage(_of_one_length(base, residuals, ", w double, x binary"), nodes, shrinkage_intensity)
    raise ValueError(f"unknown method {method!r}")


def _of_one_length(base: DataFrame, keep: Callable[[pd.DataFrame], dict], extra: str) -> DataFrame:
    """``pack_rows`` with ``keep`` applied fold by fold, as histories of folds differ in length."""

    def each(pdf: pd.DataFrame) -> dict:
        parts = [pd.DataFrame(keep(part), index=part.index) for _, part in pdf.groupby("fold", sort=False)]
        return pd.concat(parts).loc[pdf.index].to_dict("series") if parts else keep(pdf)

    return bd.pack_rows(base, each, extra)


NO_HISTORY = ("BU", "MinT_OLS", "MinT_WLS_struct")  # methods that read no fitted values
TRACE_METHODS = {"MinT_OLS": "ols", "MinT_WLS_struct": "wls_struct", "MinT_WLS_var": "wls_var", "MinT_shrink": "mint_shrink"}


Weighted = tuple[DataFrame, dict[str, bd.Shrinkage] | None]


def weighted(base: DataFrame, edges: DataFrame, method: str) -> Weighted:
    """The base forecasts with the variances of a method, for ``recon_mintrace`` and ``mintrace_gradient`` in common."""
    return _weighted(bd.with_fold(base), bd.with_block(edges), method)


def recon_mintrace(base: DataFrame, edges: DataFrame, h: int, method: str, *, limit: int | None = None, given: Weighted | None = None) -> DataFrame:
    """Reconciled bottom forecasts ``[fold,] bottom_id, k1..kh``.

    ``base`` has ``[fold,] node_id, y_hat, fitted, actual`` (arrays), ``edges`` ``bottom_id, node_id,
    is_bottom[, block]``. Methods: ols, wls_struct, wls_var, mint_shrink. Folds are solved together, directly (``border``);
    where the border is too large (``limit``) each fold is solved by conjugate gradients.
    """
    edges, folded = bd.with_block(edges), bd.with_fold(base)
    rows, shrink = given or _weighted(folded, edges, method)
    direct = bd.solve(bd.block_rows(rows, edges), h, shrink, limit=limit)
    bottom = edges.where(F.col("is_bottom")).select("bottom_id", "node_id")
    if direct is not None:
        out = direct.join(bottom, "node_id").select("fold", "bottom_id", *_cols(h))
    else:
        out, folded = None, settle(folded)
        for r in folded.select("fold").distinct().collect() or [{"fold": ""}]:
            some = _iterated(folded.where(F.col("fold") == r["fold"]).drop("fold"), edges, h, method)
            some = some.select(F.lit(r["fold"]).alias("fold"), "bottom_id", *_cols(h))
            out = some if out is None else out.unionByName(some)
    return out if "fold" in base.columns else out.drop("fold")


def mintrace_gradient(base: DataFrame, edges: DataFrame, solution: DataFrame, h: int, method: str, *, given: Weighted | None = None) -> DataFrame:
    """How far a solution is from the condition S' W^-1 (S b - y) = 0 of its method, per bottom series and step, as a share."""
    edges, folded = bd.with_block(edges), bd.with_fold(base)
    rows, shrink = given or _weighted(folded, edges, method)
    out = bd.normal_gradient(bd.with_fold(solution), rows, edges, h, shrink)
    return out if "fold" in base.columns else out.drop("fold")


def _iterated(base: DataFrame, edges: DataFrame, h: int, method: str) -> DataFrame:
    """One fold by conjugate gradients: no matrix of the border."""
    there = edges.where(F.col("is_bottom")).join(base.select("node_id"), "node_id", "left_semi").select("bottom_id")
    edges = settle(edges.join(there, "bottom_id", "left_semi").join(base.select("node_id"), "node_id", "left_semi"))
    if method in ("ols", "wls_struct"):
        size = F.max(F.lit(1.0)) if method == "ols" else F.count("*").cast("double")
        weights = edges.groupBy("node_id").agg(size.alias("w"))
    elif method == "wls_var":
        gap = F.filter(F.zip_with("actual", "fitted", lambda a, f: (a - f) * (a - f)), lambda v: ~F.isnan(v))
        var = F.aggregate(gap, F.lit(0.0), lambda a, v: a + v) / F.greatest(F.size(gap), F.lit(1))
        weights = base.select("node_id", F.greatest(var, F.lit(VAR_FLOOR)).alias("w"))
    else:
        residuals = settle(standardised_residuals(base))
        weigh, _ = shrunk_weights(residuals, h)
        diagonal = system_diagonal(edges, residuals.select("node_id", F.col("d").alias("w")))
        return solve_bottom(settle(_wide(base, h)), edges, weigh, diagonal, h)
    weights = settle(weights)
    return solve_bottom(settle(_wide(base, h)), edges, diagonal_weights(weights, h), system_diagonal(edges, weights), h)


def recon_erm(base: DataFrame, edges: DataFrame, h: int, lam: float | None = 0.01, *, around_bottom_up: bool = False, certificate: bool = False) -> DataFrame:
    """Empirical-risk reconciliation: bottom actuals regressed on all fitted node values.

    The ridge problem is solved in its dual form, with a (days x days) kernel in place of a
    (nodes x nodes) matrix: b = B' (K + lam I)^-1 Y y_hat. Without a penalty (``None``) the pseudo-inverse
    of the kernel takes its place, which gives the least-squares weights of smallest norm. With ``around_bottom_up`` the
    regression explains what the bottom forecasts leave over, so a strong penalty falls back to
    plain bottom-up. With ``certificate`` (no penalty only) ``gradient`` is the length of the slope of a series' squared error
    in its weights, relative to the slope without weights.
    """
    ks = _cols(h)
    known = lambda c: F.transform(c, lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0))).alias(c)  # noqa: E731  no sale before a series began
    rows = settle(base.select("node_id", known("fitted"), known("actual")).join(_wide(base, h), "node_id"))
    days = len(rows.select("fitted").first()[0])
    kernel = _partial_matrix(rows, lambda pdf: (lambda x: x.T @ x)(np.array(pdf["fitted"].tolist())), days)
    ahead = _partial_matrix(rows, lambda pdf: np.array(pdf["fitted"].tolist()).T @ pdf[ks].to_numpy(), h)
    rest = None
    if lam is None:
        inverse = np.linalg.pinv(kernel, rcond=days * np.finfo(float).eps, hermitian=True)
        coef = inverse @ ahead
        if certificate:
            rest = base.sparkSession.sparkContext.broadcast((np.eye(days) - inverse @ kernel, kernel))
    else:
        ridge = lam * max(float(np.trace(kernel)) / days, TINY)
        coef = np.linalg.solve(kernel + ridge * np.eye(days), ahead)
    bottom = edges.where(F.col("is_bottom")).select("bottom_id", "node_id").join(rows, "node_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            target = np.array(pdf["actual"].tolist()).reshape(len(pdf), days if len(pdf) else 0)
            out = np.zeros((0, h))
            if len(pdf):
                fitted, own = np.array(pdf["fitted"].tolist()), pdf[ks].to_numpy()
                out = own + (target - fitted) @ coef if around_bottom_up else target @ coef
            out = pd.DataFrame(out, columns=ks).assign(bottom_id=pdf["bottom_id"].to_numpy())[["bottom_id", *ks]]
            if rest is not None:
                left, kernel_ = rest.value
                over = target @ left if len(pdf) else np.zeros((0, 0))
                size = [np.sqrt(max(float(v @ kernel_ @ v), 0.0)) for v in (*over, *target)]
                out["gradient"] = [a / max(b, TINY) for a, b in zip(size[: len(pdf)], size[len(pdf) :])]
            yield out

    schema = "bottom_id string, " + ", ".join(f"{k} double" for k in ks)
    return bottom.mapInPandas(run, schema + (", gradient double" if rest is not None else ""))


def recon_erm_l1(base: DataFrame, edges: DataFrame, h: int, lam: float = 0.01, *, certificate: bool = False) -> DataFrame:
    """Empirical-risk reconciliation around bottom-up with an L1 penalty.

    What the bottom forecast of a series leaves over is regressed on the fitted values of all nodes; few weights are
    nonzero. The loss is that of the series itself, so series are solved apart (``erm_l1``). With ``certificate`` the relative
    duality ``gap``, the nodes ``alive`` after screening and ``used`` by a weight are returned too.
    """

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fitted, actual = (np.array(pdf[c].tolist()).reshape(len(pdf), -1) for c in ("fitted", "actual"))
            fitted, actual = (np.where(np.isfinite(v), v, 0.0) for v in (fitted, actual))  # no sale before a series began
            own = [np.asarray(v, dtype=float).tobytes() for v in pdf["y_hat"]]
            yield pd.DataFrame({"node_id": pdf["node_id"], "x": [v.tobytes() for v in fitted], "r": [v.tobytes() for v in actual - fitted], "y": own})

    nodes = settle(base.select("node_id", "fitted", "actual", "y_hat").mapInPandas(packed, "node_id string, x binary, r binary, y binary"))
    series = edges.where(F.col("is_bottom")).select("bottom_id", "node_id").join(nodes.select("node_id", "r", F.col("y").alias("own")), "node_id")
    out = l1_regressions(nodes, series.drop("node_id"), lam, h)
    return out if certificate else out.select("bottom_id", *_cols(h))


def _one_fold(solve: Callable[[DataFrame, DataFrame, int], DataFrame]) -> Callable[[DataFrame, DataFrame, int], DataFrame]:
    """A method that knows no folds, applied to each of them (a few)."""

    def run(base: DataFrame, edges: DataFrame, h: int) -> DataFrame:
        if "fold" not in base.columns:
            return solve(base, edges, h)
        out = None
        for r in base.select("fold").distinct().orderBy("fold").collect():
            part = solve(base.where(F.col("fold") == r["fold"]).drop("fold"), edges, h).withColumn("fold", F.lit(r["fold"]))
            out = part if out is None else out.unionByName(part)
        return out

    return run


def _bottom_base(base: DataFrame, edges: DataFrame, h: int) -> DataFrame:
    """The base forecasts of the bottom series as they are."""
    keys = [c for c in ("fold",) if c in base.columns]
    own = edges.where(F.col("is_bottom")).select("bottom_id", "node_id")
    return own.join(base.select(*keys, "node_id", *_wide_columns(h)), "node_id").select(*keys, "bottom_id", *_cols(h))


METHODS = {
    **{name: (lambda b, e, h, m=m: recon_mintrace(b, e, h, m)) for name, m in TRACE_METHODS.items()},
    "ERM_closed": _one_fold(lambda b, e, h: recon_erm(b, e, h, None)),
    "ERM_reg_bu": _one_fold(lambda b, e, h: recon_erm_l1(b, e, h)),
    "BU": _bottom_base,
}


def reconcile_bottom(base: DataFrame, edges: DataFrame, h: int, method: str) -> DataFrame:
    """Bottom forecasts ``[fold,] bottom_id, k1..kh`` of one method."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}, use one of {sorted(METHODS)}")
    return METHODS[method](base, edges, h)


def reconcile(base: DataFrame, edges: DataFrame, h: int, method: str, cutoff: Column) -> DataFrame:
    """Bottom forecasts of one method in long form: ``unique_id, ds, <method>``."""
    values = F.posexplode(F.array(*_cols(h))).alias("_k", method)
    wide = reconcile_bottom(base, edges, h, method)
    return wide.select(F.col("bottom_id").alias("unique_id"), values).select("unique_id", F.date_add(cutoff, F.col("_k") + 1).alias("ds"), method)
