"""Periodic time series on Spark: profiles, de-seasonalised forecasts, synthetic series."""

from meterloom.plans import decompose, generate, train_activity
from meterloom.session import configure, get_spark, stage

__all__ = ["configure", "decompose", "generate", "get_spark", "stage", "train_activity"]
