"""Reports over event time: tumbling, sliding and session windows, closed by a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _closed(events: DataFrame, time: str, late: str, window: Column, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """A row for each window and key, once the watermark has passed the window's end."""
    grouped = events.withWatermark(time, late).groupBy(window.alias("_w"), *keys)
    made = grouped.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])
    return made.select(F.unix_micros("_w.start").alias("start_us"), F.unix_micros("_w.end").alias("end_us"), *keys, "n", *sums)


def tumbling(events: DataFrame, time: str, size: str, keys: list[str], sums: dict[str, Column], late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Windows of one size; with `slide`, one begins at each multiple of it.  Rows later than `late` after the newest
    one don't count (Spark tells how many: `late_rows`); rows without a time are in no window."""
    return _closed(events, time, late, F.window(time, size, slide or size), keys, sums)


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], sums: dict[str, Column], late: str = "10 minutes") -> DataFrame:
    """Windows of a key's events that follow each other within `gap`."""
    return _closed(events, time, late, F.session_window(time, gap), keys, sums)


def late_rows(query) -> int:
    """Rows that a finished query's watermark dropped."""
    return sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)
