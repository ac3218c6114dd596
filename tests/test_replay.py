"""Replayed streams against batches."""

import datetime

from pyspark.sql import functions as F

from affinity.operators import temporal
from affinity.streaming import replay, sessions

START = datetime.datetime(2024, 3, 5, 12)


def plays(spark, minutes):
    rows = [(who, START + datetime.timedelta(minutes=m)) for who, own in minutes.items() for m in own]
    return spark.createDataFrame(rows, "who string, ts timestamp_ntz")


def test_sessions_go_on_over_restarts(spark):
    """Sessions that are open when the query stops are the same as without a stop."""
    rows = plays(spark, {"a": [0, 10, 39, 80, 81, 111.5, 400], "b": [k * 20 for k in range(30)], "c": [599]})
    stream = replay.replayed(rows, "ts", lambda s: sessions.sessions(s, "who"), 5)
    got = sorted((r.who, r.start, r.end, r.plays) for r in stream.select("who", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "plays").collect())
    assert got == sorted((r.who, r.start, r.end, r.plays) for r in temporal.sessions(rows, "who").collect())
    assert [r[3] for r in got if r[0] == "b"] == [30] and len([r for r in got if r[0] == "a"]) == 4


def test_nothing(spark):
    assert replay.replayed(plays(spark, {}), "ts", lambda s: sessions.sessions(s, "who")).count() == 0
