"""Monthly category sums of a stream of facts. The batch operators need whole periods; a period is given out once the watermark has passed its end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_sums(events: DataFrame, categories: Sequence[str], time: str = "ts", entity: str = "entity", late: str = "1 hour") -> DataFrame:
    """(entity, day, categories): sums of each day and entity, of events no later than ``late`` behind the newest; append mode gives each day once."""
    sums = [F.sum(F.when(F.col("category") == c, F.coalesce("value", F.lit(0.0)))).alias(c.lower()) for c in categories]
    days = events.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w"), entity).agg(*sums)
    return days.select(entity, F.col("w.start").cast("date").alias("day"), *(c.lower() for c in categories))
