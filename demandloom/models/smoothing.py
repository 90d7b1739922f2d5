"""Per-series Theta and exponential smoothing on one numpy array.

Both are small: a series has at most one value per day. The smoothing recursions run over time
once for a whole grid of parameters, so no optimiser is needed.
"""

from __future__ import annotations

import numpy as np

_GRID = np.linspace(0.02, 0.98, 33)
_EDGE = 1e-4  # alpha and gamma are at least that far inside their open bounds
_STARTS = 4  # local minima of the grid that are refined, per error type
_GAIN, _FINE = 1e-6, 1e-4  # a window is done when it is this small and gains no more than that
_SEASONAL_TEST = 1.645  # one-sided 5 % normal quantile of the autocorrelation test


def seasonal_naive(y: np.ndarray, h: int, season: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Last season tiled; the mean where the history is shorter, 0 without history."""
    n = len(y)
    fitted = np.full(n, np.nan)
    fitted[season:] = y[: max(n - season, 0)]
    if n < season:
        return np.full(h, float(np.mean(y)) if n else 0.0), fitted
    return np.resize(y[-season:], h), fitted


def mean_model(y: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
    level = float(np.mean(y)) if len(y) else 0.0
    return np.full(h, level), np.full(len(y), level)


def _is_seasonal(y: np.ndarray, season: int) -> bool:
    n = len(y)
    if n < 2 * season:
        return False
    d = y - y.mean()
    power = float(d @ d)
    if power <= 0:
        return False
    acf = np.array([d[k:] @ d[:-k] / power for k in range(1, season + 1)])
    return abs(acf[-1]) > _SEASONAL_TEST * np.sqrt((1 + 2 * float(acf[:-1] @ acf[:-1])) / n)


def _seasonal_indices(y: np.ndarray, season: int) -> tuple[np.ndarray, bool]:
    """Classical decomposition: (index per phase, multiplicative?)."""
    n = len(y)
    kernel = np.ones(season) / season if season % 2 else np.r_[0.5, np.ones(season - 1), 0.5] / season
    half = len(kernel) // 2
    trend = np.convolve(y, kernel, mode="valid")
    centre = y[half : half + len(trend)]
    phase = (np.arange(n) % season)[half : half + len(trend)]
    if np.all(y > 0):
        idx = np.array([np.mean((centre / trend)[phase == p]) for p in range(season)])
        idx /= idx.mean()
        if np.all(idx >= 0.01):
            return idx, True
    idx = np.array([np.mean((centre - trend)[phase == p]) for p in range(season)])
    return idx - idx.mean(), False


def _ses(y: np.ndarray, alphas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared error and final level of simple smoothing for every alpha at once."""
    level = np.full(len(alphas), y[0])
    sse = np.zeros(len(alphas))
    for value in y[1:]:
        gap = value - level
        sse += gap * gap
        level = level + alphas * gap
    return sse, level


def theta(y: np.ndarray, h: int, season: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Theta method: deseasonalise if seasonal, smooth, add half of the linear trend."""
    y = np.asarray(y, dtype=float)
    n = len(y)
    if n < 3:
        return np.full(h, float(y[-1]) if n else 0.0), np.full(n, np.nan)
    seasonal = _is_seasonal(y, season)
    idx, times = _seasonal_indices(y, season) if seasonal else (np.zeros(season), False)
    pattern = idx[np.arange(n + h) % season]
    flat = (y / pattern[:n] if times else y - pattern[:n]) if seasonal else y
    sse, _ = _ses(flat, _GRID)
    best = _GRID[int(np.argmin(sse))]
    fine = np.clip(best + np.linspace(-0.03, 0.03, 13), 0.001, 0.999)
    sse, _ = _ses(flat, fine)
    alpha = float(fine[int(np.argmin(sse))])
    levels = np.empty(n)
    levels[0] = flat[0]
    for t in range(1, n):
        levels[t] = levels[t - 1] + alpha * (flat[t] - levels[t - 1])
    time = np.arange(n)
    drift = float(np.polyfit(time, flat, 1)[0]) / 2
    steps = np.arange(h)
    ahead = levels[-1] + drift * (steps + (1 - (1 - alpha) ** n) / alpha)
    inside = np.r_[np.nan, levels[:-1] + drift * (1 - (1 - alpha) ** np.arange(1, n)) / alpha]
    if seasonal:
        ahead = ahead * pattern[n:] if times else ahead + pattern[n:]
        inside = inside * pattern[:n] if times else inside + pattern[:n]
    return ahead, inside


def _ses_many(flat: np.ndarray, sizes: np.ndarray, alphas: np.ndarray) -> np.ndarray:
    """Squared errors of simple smoothing for rows of series (zeros after their end) and their own alphas."""
    level = np.repeat(flat[:, :1], alphas.shape[1], axis=1)
    sse = np.zeros(alphas.shape)
    for t in range(1, flat.shape[1]):
        gap = flat[:, t, None] - level
        gap[sizes <= t] = 0.0
        sse += gap * gap
        level += alphas * gap
    return sse


def theta_batch(many: list[np.ndarray], h: int, season: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """``theta`` of many series: the recursions over time run once for all of them."""
    many = [np.asarray(y, dtype=float) for y in many]
    out: list = [theta(y, h, season) if len(y) < 3 else None for y in many]
    todo = [k for k, o in enumerate(out) if o is None]
    if not todo:
        return out
    sizes = np.array([len(many[k]) for k in todo])
    flat = np.zeros((len(todo), sizes.max()))
    patterns = []
    for row, k in enumerate(todo):
        y, n = many[k], sizes[row]
        seasonal = _is_seasonal(y, season)
        idx, times = _seasonal_indices(y, season) if seasonal else (np.zeros(season), False)
        pattern = idx[np.arange(n + h) % season] if seasonal else None
        patterns.append((pattern, times))
        flat[row, :n] = y if pattern is None else y / pattern[:n] if times else y - pattern[:n]
    best = _GRID[np.argmin(_ses_many(flat, sizes, np.tile(_GRID, (len(todo), 1))), axis=1)]
    fine = np.clip(best[:, None] + np.linspace(-0.03, 0.03, 13), 0.001, 0.999)
    alphas = fine[np.arange(len(todo)), np.argmin(_ses_many(flat, sizes, fine), axis=1)]
    levels = flat.copy()
    for t in range(1, flat.shape[1]):
        levels[:, t] = levels[:, t - 1] + alphas * (flat[:, t] - levels[:, t - 1])
    for row, k in enumerate(todo):
        n, alpha, (pattern, times) = sizes[row], alphas[row], patterns[row]
        drift = float(np.polyfit(np.arange(n), flat[row, :n], 1)[0]) / 2
        ahead = levels[row, n - 1] + drift * (np.arange(h) + (1 - (1 - alpha) ** n) / alpha)
        inside = np.r_[np.nan, levels[row, : n - 1] + drift * (1 - (1 - alpha) ** np.arange(1, n)) / alpha]
        if pattern is not None:
            ahead = ahead * pattern[n:] if times else ahead + pattern[n:]
            inside = inside * pattern[:n] if times else inside + pattern[:n]
        out[k] = (ahead, inside)
    return out


def weekday_median(y: np.ndarray, h: int, season: int = 7, seasons: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Median of the last ``seasons`` values of the same phase; the mean where there is none yet, 0 without history.

    A median of sums isn't the sum of medians, so forecasts of a hierarchy's nodes disagree and need reconciling.
    """
    y = np.asarray(y, dtype=float)
    n = len(y)
    fitted = np.full(n, np.nan)
    if not n:
        return np.zeros(h), fitted
    back = np.full((n + h, seasons), np.nan)
    for j in range(1, seasons + 1):
        at = np.arange(n + h) - j * season
        ok = (at >= 0) & (at < n)
        back[ok, j - 1] = y[at[ok]]
    # beyond one season ahead the same phases serve again
    for k in range(n + season, n + h):
        back[k] = back[k - season]
    back.sort(axis=1)  # NaN last
    known = np.isfinite(back).sum(axis=1)
    low, high = np.maximum(known - 1, 0) // 2, known // 2
    rows = np.arange(n + h)
    middle = np.where(known > 0, (back[rows, low] + back[rows, np.where(known > 0, high, 0)]) / 2, np.nan)
    fitted[:] = middle[:n]
    return np.where(np.isfinite(middle[n:]), middle[n:], float(y.mean())), fitted


def _seasonal_pass(y: np.ndarray, season: int, alpha: np.ndarray, gamma: np.ndarray, level0: float, season0: np.ndarray):
    """Level + additive season recursion for all (alpha, gamma): errors for both error types.

    The relative errors are those of positive data; they stay zero for other data.
    """
    k, positive = len(alpha), bool(np.all(y > 0))
    level = np.full(k, level0)
    states = np.repeat(season0[:, None], k, axis=1)
    additive, relative, log_mean = np.zeros(k), np.zeros(k), np.zeros(k)
    fitted = np.empty((len(y), k)) if k == 1 else None
    for t, value in enumerate(y):
        p = t % season
        mean = level + states[p]
        gap = value - mean
        if fitted is not None:
            fitted[t] = mean
        additive += gap * gap
        if positive:
            size = np.maximum(np.abs(mean), 1e-8)
            relative += (gap / size) ** 2
            log_mean += np.log(size)
        level = level + alpha * gap
        states[p] = states[p] + gamma * gap
    return additive, relative, log_mean, level, states, fitted


def _region(a: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, gamma) of points of the unit square: gamma is the share ``s`` of what alpha leaves of 1."""
    alpha = np.clip(a, _EDGE, 1 - _EDGE)
    return alpha, np.maximum(np.clip(s, 0, 1) * (1 - alpha), _EDGE)


def _ets_scores(y: np.ndarray, season: int, alpha: np.ndarray, gamma: np.ndarray, level0: float, season0: np.ndarray) -> list[np.ndarray]:
    """n log of the likelihood's variance per point: additive errors, and relative ones for positive data."""
    n = len(y)
    add, rel, log_mean, *_ = _seasonal_pass(y, season, alpha, gamma, level0, season0)
    scores = [n * np.log(np.maximum(add, 1e-12) / n)]
    if np.all(y > 0):
        scores.append(n * np.log(np.maximum(rel, 1e-12) / n) + 2 * log_mean)
    return scores


def _low_points(score: np.ndarray) -> np.ndarray:
    """Flat positions of the best local minima of a grid, best first."""
    padded = np.pad(score, 1, constant_values=np.inf)
    rows, cols = score.shape
    around = [padded[1 + i : 1 + i + rows, 1 + j : 1 + j + cols] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    low = np.flatnonzero((score <= np.min(around, axis=0)).ravel())
    return low[np.argsort(score.ravel()[low], kind="stable")][:_STARTS]


def _ets_search(y: np.ndarray, season: int, level0: float, season0: np.ndarray) -> tuple[float, float]:
    """Best (alpha, gamma) of the admissible region alpha, gamma > 0, alpha + gamma <= 1.

    A grid over the whole region, then windows around its local minima of each error type. A window whose best
    point is at its edge moves there; else it shrinks, until that no longer improves the criterion.
    """
    axes = np.linspace(0, 1, 21), np.linspace(0, 1, 17)
    a, s = (g.ravel() for g in np.meshgrid(*axes, indexing="ij"))
    found = []  # error type, criterion, place in the unit square, half width of the window
    for kind, score in enumerate(_ets_scores(y, season, *_region(a, s), level0, season0)):
        for at in _low_points(score.reshape(21, 17)):
            found.append([kind, float(score[at]), a[at], s[at], 1 / 20, 1 / 16])
    da, ds = (g.ravel() for g in np.meshgrid(np.linspace(-1, 1, 9), np.linspace(-1, 1, 9), indexing="ij"))
    active = list(found)
    while active:
        a = np.clip(np.concatenate([f[2] + f[4] * da for f in active]), 0, 1)
        s = np.clip(np.concatenate([f[3] + f[5] * ds for f in active]), 0, 1)
        scores = _ets_scores(y, season, *_region(a, s), level0, season0)
        going = []
        for k, f in enumerate(active):
            score = scores[f[0]][81 * k : 81 * (k + 1)]
            at = int(np.argmin(score))
            gain = f[1] - float(score[at])
            inside = max(abs(da[at]), abs(ds[at])) < 1
            if gain > 0:
                f[1:4] = float(score[at]), a[81 * k + at], s[81 * k + at]
            if gain <= 0 or inside:
                f[4:6] = f[4] / 4, f[5] / 4
            if gain > _GAIN or max(f[4:6]) > _FINE:
                going.append(f)
        active = going
    best = min(found, key=lambda f: f[1])
    alpha, gamma = _region(np.array([best[2]]), np.array([best[3]]))
    return float(alpha[0]), float(gamma[0])


def ets(y: np.ndarray, h: int, season: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Exponential smoothing, no trend, additive season; the error type is chosen by AICc.

    Additive and multiplicative errors share the state recursion and have as many parameters, so one pass over the
    parameter grid serves both likelihoods and these alone decide. Data with zeros allow additive errors only.
    """
    y = np.asarray(y, dtype=float)
    n = len(y)
    if n < 2 * season:
        return seasonal_naive(y, h, season)
    level0 = float(y[: 2 * season].mean())
    season0 = (y[:season] + y[season : 2 * season]) / 2 - level0
    alpha, gamma = _ets_search(y, season, level0, season0)
    *_, level, states, fitted = _seasonal_pass(y, season, np.array([alpha]), np.array([gamma]), level0, season0)
    phases = (n + np.arange(h)) % season
    return level[0] + states[phases, 0], fitted[:, 0]
