"""Sessions of a stream of plays, with late rows up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DELAY = "10 minutes"


def sessions(plays: DataFrame, who: str, ts: str = "ts", gap: str = "30 minutes", delay: str = DELAY) -> DataFrame:
    """Sessions as a stream: who, start, end, plays; a session appears when the watermark has passed its end.

    Times without a zone are taken in the session's zone. Rows later than the
    watermark are dropped, as on any stream.
    """
    timed = plays.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    own = timed.groupBy(who, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("plays"), F.min(ts).alias("start"), F.max(ts).alias("end"))
    return own.select(who, "start", "end", "plays")


def skip_rates(plays: DataFrame, who: str, ts: str = "ts", every: str = "1 hour", delay: str = DELAY) -> DataFrame:
    """Plays and skips by window as a stream; ``plays`` has is_skip."""
    timed = plays.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return timed.groupBy(who, F.window(ts, every).alias("w")).agg(F.count("*").alias("plays"), F.sum(F.col("is_skip").cast("long")).alias("skips"))
