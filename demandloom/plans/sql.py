"""Building blocks of the SQL counterparts: named CTEs with their dependencies."""

from __future__ import annotations

STATIC = "item_id, dept_id, cat_id, store_id, state_id"

_LINES = """
  SELECT p_type || '-' || CAST(CAST(ceil(CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) / 5.0) AS INTEGER) AS VARCHAR) AS item_id,
         p_type AS dept_id,
         CASE WHEN p_type IN ('LARGE', 'MEDIUM', 'SMALL') THEN 'SIZE' ELSE 'TIER' END AS cat_id,
         n_name AS store_id, r_name AS state_id, CAST(l_shipdate AS DATE) AS ds, l_quantity AS qty,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def _dense(source: str, statics: str) -> str:
    keys = ", ".join(["unique_id", *[c.strip() for c in statics.split(",")]])
    g = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
    out = ", ".join(f"g.{k.strip()}" for k in keys.split(","))
    return f"""
  SELECT {out}, g.ds, coalesce(f.y, 0.0) AS y, coalesce(f.cents, 0) AS cents,
         CAST(floor(date_diff('day', DATE '1995-01-02', g.ds) / 7.0) AS INTEGER) AS wk
  FROM (SELECT {g}, d.ds FROM (SELECT {keys}, min(ds) AS first_ds FROM {source} GROUP BY {keys}) s
        JOIN days d ON d.ds >= s.first_ds) g
  LEFT JOIN {source} f ON g.unique_id = f.unique_id AND g.ds = f.ds"""


def _priced(source: str) -> str:
    return f"""
  SELECT * EXCLUDE (cents), CAST(sum(cents) OVER w AS DOUBLE) / 1e2 / nullif(sum(y) OVER w, 0) AS sell_price
  FROM {source} WINDOW w AS (PARTITION BY unique_id, wk)"""


BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {
    "lines": ((), _LINES),
    "last_day": ((), "SELECT CAST(max(l_shipdate) AS DATE) AS last_ds FROM lineitem"),
    "days": (
        ("last_day",),
        "SELECT CAST(unnest(generate_series((SELECT min(l_shipdate) FROM lineitem), CAST((SELECT last_ds FROM last_day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS ds",
    ),
    "facts": (
        ("lines",),
        f"SELECT item_id || '_' || store_id AS unique_id, {STATIC}, ds, sum(qty) AS y, CAST(sum(cents) AS BIGINT) AS cents FROM lines GROUP BY {STATIC}, ds",
    ),
    "facts_small": (
        ("lines",),
        "SELECT dept_id || '_' || state_id AS unique_id, dept_id AS item_id, dept_id, cat_id, state_id AS store_id, state_id, ds, sum(qty) AS y, CAST(sum(cents) AS BIGINT) AS cents FROM lines GROUP BY dept_id, cat_id, state_id, ds",
    ),
    "dense": (("facts", "days"), _dense("facts", STATIC)),
    "panel": (("dense",), _priced("dense")),
    "dense_small": (("facts_small", "days"), _dense("facts_small", STATIC)),
    "small": (("dense_small",), _priced("dense_small")),
    "statics": (("facts",), f"SELECT DISTINCT unique_id, {STATIC} FROM facts"),
    "calendar": (
        ("days",),
        """SELECT ds, CASE strftime(ds, '%m-%d') WHEN '01-01' THEN 'NewYear' WHEN '07-04' THEN 'Independence' WHEN '12-25' THEN 'Christmas' ELSE 'none' END AS event_name_1,
                  CAST(day(ds) <= 10 AS INTEGER) AS snap_AFRICA, CAST(day(ds) > 10 AND day(ds) <= 20 AS INTEGER) AS snap_AMERICA, CAST(day(ds) > 20 AS INTEGER) AS snap_ASIA FROM days""",
    ),
    "folds": (
        ("last_day",),
        "SELECT CAST(w AS INTEGER) AS fold, last_ds - CAST(28 + (2 - w) * 28 AS INTEGER) AS cutoff FROM last_day, range(3) t(w)",
    ),
    "train": (("panel", "folds"), "SELECT * FROM panel WHERE ds <= (SELECT min(cutoff) FROM folds)"),
    "steps": (
        ("train",),
        """SELECT unique_id, ds, y * coalesce(sell_price, 0) AS rev, y - lag(y) OVER (PARTITION BY unique_id ORDER BY ds) AS d,
                  row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS rn FROM train""",
    ),
    "per_series": (
        ("steps",),
        "SELECT unique_id, sum(rev) FILTER (WHERE rn <= 28) AS tail_revenue, avg(d * d) AS scale, avg(abs(d)) AS mae_scale FROM steps GROUP BY unique_id",
    ),
    "comp": (
        ("per_series",),
        "SELECT unique_id, tail_revenue / (SELECT sum(tail_revenue) FROM per_series) AS weight, scale FROM per_series WHERE scale IS NULL OR scale <> 0",
    ),
    "nscale": (("per_series",), "SELECT unique_id, mae_scale AS naive_scale FROM per_series WHERE mae_scale > 0"),
    "mse": (("long",), "SELECT model, unique_id, avg((y_hat - y) * (y_hat - y)) AS mse FROM long GROUP BY model, unique_id"),
    "rmsse": (("mse", "comp"), "SELECT model, unique_id, weight, scale, sqrt(mse / scale) AS rmsse FROM mse JOIN comp USING (unique_id)"),
    "scores": (("rmsse",), "SELECT model, coalesce(sum(weight * rmsse), 0.0) AS wrmsse FROM rmsse GROUP BY model"),
    "psm": (
        ("long", "nscale"),
        """SELECT p.*, mae / naive_scale AS mase FROM (SELECT model, unique_id, sqrt(avg((y_hat - y) * (y_hat - y))) AS rmse, avg(abs(y_hat - y)) AS mae,
                  avg(2 * abs(y_hat - y) / greatest(abs(y) + abs(y_hat), 1e-9)) AS smape, avg(y_hat - y) AS bias, count(*) AS n_obs
           FROM long GROUP BY model, unique_id) p LEFT JOIN nscale USING (unique_id)""",
    ),
}


for _suffix, _panel in (("", "panel"), ("_s", "small")):
    BLOCKS[f"hist{_suffix}"] = (
        (_panel, "folds"),
        f"""SELECT cutoff, unique_id, y, row_number() OVER (PARTITION BY cutoff, unique_id ORDER BY ds DESC) AS rn,
                   avg(y) OVER (PARTITION BY cutoff, unique_id) AS mean_y, count(*) OVER (PARTITION BY cutoff, unique_id) AS n
            FROM {_panel} JOIN folds ON ds <= cutoff QUALIFY rn <= 7""",
    )
    BLOCKS[f"cv0{_suffix}"] = (
        (f"hist{_suffix}",),
        f"""SELECT p.unique_id, p.ds, f.cutoff, p.y, a.y AS Naive, CASE WHEN a.n < 7 THEN a.mean_y ELSE s.y END AS SeasonalNaive
            FROM {_panel} p JOIN folds f ON p.ds > f.cutoff AND p.ds <= f.cutoff + 28
            JOIN hist{_suffix} a ON a.cutoff = f.cutoff AND a.unique_id = p.unique_id AND a.rn = 1
            LEFT JOIN hist{_suffix} s ON s.cutoff = f.cutoff AND s.unique_id = p.unique_id AND s.rn = 7 - (date_diff('day', f.cutoff, p.ds) - 1) % 7""",
    )
    BLOCKS[f"cv{_suffix}"] = ((f"cv0{_suffix}",), f"SELECT *, 0.0 + Naive * 0.5 + SeasonalNaive * 0.5 AS Ensemble FROM cv0{_suffix}")
    BLOCKS[f"long{_suffix}"] = (
        (f"cv{_suffix}",),
        " UNION ALL ".join(f"SELECT unique_id, ds, cutoff, y, '{_m}' AS model, {_m} AS y_hat FROM cv{_suffix}" for _m in ("Naive", "SeasonalNaive", "Ensemble")),
    )


def R(expr: str, digits: int = 6) -> str:
    """Rounded double without a negative zero."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"


def rounded(source: str, *plain: str, digits: int = 6, **doubles: int) -> str:
    """SELECT list: plain columns followed by rounded ones."""
    cols = [*plain, *[f"{R(c, d)} AS {c}" for c, d in doubles.items()]]
    return f"SELECT {', '.join(cols)} FROM {source}"


def sql(select: str, *needs: str, **extra: str) -> str:
    """A statement with the needed blocks (and their dependencies) as CTEs.

    ``extra`` adds statement-local CTEs after the blocks, in order.
    """
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in BLOCKS[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for n in needs:
        visit(n)
    parts = [f"{n} AS MATERIALIZED ({BLOCKS[n][1]})" for n in order]
    parts += [f"{n} AS MATERIALIZED ({body})" for n, body in extra.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + select
