"""Panel forecasting and forecast evaluation as Spark DataFrame operators."""

__version__ = "0.1.0"
