"""The panels, backtests and scoring bundle a registered query starts from."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.operators.folds import baseline_cv, cutoffs, ensemble
from demandloom.operators.hierarchy import roll_up
from demandloom.operators.reshape import static_attributes
from demandloom.operators.scoring import ScoringInputs
from demandloom.session import settle, stored
from demandloom.sources import tpch_panel as tp

H = 28
WINDOWS = 3
MODELS = ["Naive", "SeasonalNaive", "Ensemble"]
REGIONS = ("AFRICA", "AMERICA", "ASIA")


@dataclass
class Data:
    """Lazily built inputs over one set of tables (whole tables, whole history)."""

    spark: SparkSession
    sf_dir: str

    @cached_property
    def days(self) -> DataFrame:
        return tp.ship_days(self.spark, self.sf_dir)

    @cached_property
    def end(self) -> Column:
        """Last ship date, read from one column of the line items."""
        return tp.last_ship_day(self.spark, self.sf_dir)

    @cached_property
    def facts(self) -> DataFrame:
        return tp.sales_facts(self.spark, self.sf_dir)

    def keep(self) -> Data:
        """The same inputs from facts that are summed up once and written, for queries that read them several times."""
        self.facts = stored(self.facts)
        return self

    @cached_property
    def panel(self) -> DataFrame:
        """Item x store."""
        return tp.priced_panel(self.facts, self.end)

    @cached_property
    def small(self) -> DataFrame:
        """Part type x region."""
        return tp.priced_panel(tp.small_facts(self.spark, self.sf_dir), self.end)

    @cached_property
    def statics(self) -> DataFrame:
        return static_attributes(self.facts)

    @cached_property
    def calendar(self) -> DataFrame:
        return tp.calendar(self.days)

    @cached_property
    def small_calendar(self) -> DataFrame:
        """The small panel with its day attributes (one calendar row per day: broadcast)."""
        return self.small.join(F.broadcast(self.calendar), "ds", "left")

    @cached_property
    def points(self) -> list[Column]:
        return cutoffs(None, H, WINDOWS, end=self.end)

    @cached_property
    def cv(self) -> DataFrame:
        """Three folds of Naive, SeasonalNaive and their mean over the item x store panel."""
        base = baseline_cv(self.panel, H, WINDOWS, end=self.end)
        return ensemble(base, ["Naive", "SeasonalNaive"], out="Ensemble")

    @cached_property
    def node_cv(self) -> DataFrame:
        """The backtest of every node of the hierarchy, ``unique_id`` = level and node; forecasts are sums, as the models are linear."""
        placed = self.cv.join(self.statics, "unique_id")
        rows = settle(roll_up(placed, ["y", *MODELS], ["cutoff", "ds"]))
        key = F.concat_ws(":", F.col("level_idx").cast("string"), "node").alias("unique_id")
        return rows.select(key, "level", "cutoff", "ds", "y", *MODELS)

    @cached_property
    def small_cv(self) -> DataFrame:
        """The same backtest over the part type x region panel."""
        base = baseline_cv(self.small, H, WINDOWS, end=self.end)
        return ensemble(base, ["Naive", "SeasonalNaive"], out="Ensemble")

    @cached_property
    def small_statics(self) -> DataFrame:
        return static_attributes(tp.small_facts(self.spark, self.sf_dir))

    @cached_property
    def small_scoring(self) -> ScoringInputs:
        return ScoringInputs.build(self.small_cv, self.small, self.small_statics, F.date_add(self.points[0], 1))

    @cached_property
    def scoring(self) -> ScoringInputs:
        return ScoringInputs.build(self.cv, self.panel, self.statics, F.date_add(self.points[0], 1))
