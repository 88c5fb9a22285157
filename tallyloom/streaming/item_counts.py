"""Extension: item counts over an unbounded table of events, by windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_support(events: DataFrame, ts: str = "ts", item: str = "event_type", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, item, support): events of each item in each window; a window's rows are final once the watermark has passed it."""
    x = events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), F.col(item).alias("item")).agg(F.count("*").alias("support"))
    return x.select(F.col("w.start").alias("start"), "item", "support")
