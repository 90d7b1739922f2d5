"""Column expressions shared by the operators. All stay JVM-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("unique_id", "ds", "cutoff")
STATICS = ("item_id", "dept_id", "cat_id", "store_id", "state_id")


def need(df: DataFrame, *cols: str) -> None:
    """Raise when a required column is absent."""
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives null for a zero denominator (ANSI mode would raise)."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column; ``special`` overrides the digits of single columns."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), special.get(f.name, digits)).alias(f.name)
            if f.dataType.typeName() in ("double", "float")
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def revenue(df: DataFrame, y: str = "y", price: str | None = "sell_price") -> Column:
    """Units times price with a missing price as 0, or units where the frame has no price."""
    if price and price in df.columns:
        return F.col(y) * F.coalesce(F.col(price), F.lit(0.0))
    return F.col(y)


def smape_term(y: Column, y_hat: Column, floor: float) -> Column:
    """2|e| / max(|y|+|y_hat|, floor)."""
    return 2 * F.abs(y_hat - y) / F.greatest(F.abs(y) + F.abs(y_hat), F.lit(floor))


def week_of_year(ds: Column) -> Column:
    """(day of year - weekday + 10) div 7 with Monday = 0; differs from ISO around new year."""
    return F.floor((F.dayofyear(ds) - F.weekday(ds) + 10) / 7).cast("int")


def draw_number(*parts: Column) -> Column:
    """A 32-bit number derived from the parts through md5: the same on any engine."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def draw_index(n: int, *parts: Column) -> Column:
    """A number from 0 to n - 1 from 64 bits of the parts' md5: the same on any engine, even for any n there is."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    wide = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    return (wide % F.lit(n).cast("decimal(20,0)")).cast("bigint")


def weighted(value: Column, weight: Column) -> Column:
    """Aggregate: weighted mean over the rows of the group, null values adding nothing."""
    total = F.sum(weight)
    return F.when(total > 0, F.coalesce(F.sum(value * weight), F.lit(0.0)) / total).otherwise(
        F.coalesce(F.sum(value * weight), F.lit(0.0))
    )


def forecast_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Forecast columns of a wide backtest frame: all but the keys and the truth."""
    skip = {"unique_id", "ds", "y", "cutoff", *exclude}
    return [c for c in df.columns if c not in skip]
