"""Queries over histories: calendars, shares, drift, sessions (operators that the reference only specifies)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.operators import layers, temporal
from affinity.plans.registry import Registry, table
from affinity.streaming import replay
from affinity.streaming import sessions as stream_sessions

REGISTRY = Registry()
CALENDAR_SQL = """h AS (SELECT l_shipdate AS ts, l_quantity::BIGINT AS seconds, p_type AS genre, p_brand AS brand, l_partkey AS item, date_trunc('month', l_shipdate)::DATE AS month, year(l_shipdate)::INTEGER AS year
    FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a history of plays."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("genre"), F.col("p_brand").alias("brand"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").cast("long").alias("seconds"))
    return temporal.calendar(lines.join(part, F.col("item") == F.col("p_partkey")).drop("p_partkey"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with calendar fields."""
    return temporal.calendar(table(spark, sf_dir, "events"))


@REGISTRY.add("SELECT (dayofweek(ts) + 1)::INTEGER AS dow, hour(ts)::INTEGER AS hour, sum(event_id)::BIGINT AS event_id FROM events GROUP BY ALL")
def heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by day of week and hour."""
    return temporal.heatmap(events(spark, sf_dir), "event_id")


@REGISTRY.add("""SELECT CASE WHEN hour(ts) BETWEEN 6 AND 11 THEN 'morning' WHEN hour(ts) BETWEEN 12 AND 16 THEN 'afternoon' WHEN hour(ts) BETWEEN 17 AND 21 THEN 'evening' ELSE 'night' END AS daypart, event_type, count(*) AS n FROM events GROUP BY ALL""")
def daypart_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types by part of the day."""
    return events(spark, sf_dir).groupBy(temporal.daypart(F.col("hour")).alias("daypart"), "event_type").agg(F.count("*").alias("n"))


@REGISTRY.add("SELECT (year(o_orderdate) // 10 * 10)::INTEGER AS decade, count(*) AS n FROM orders GROUP BY ALL")
def decade_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks by decade."""
    from affinity.functions import text

    return table(spark, sf_dir, "orders").groupBy(text.decade(F.year("o_orderdate")).alias("decade")).agg(F.count("*").alias("n"))


@REGISTRY.add(f"""WITH {CALENDAR_SQL}, i AS (SELECT brand, item, sum(seconds)::BIGINT AS s FROM h GROUP BY ALL)
SELECT brand, g AS genres, t AS seconds, item AS top_item FROM (SELECT brand, count(DISTINCT genre) AS g, sum(seconds)::BIGINT AS t FROM h GROUP BY brand)
JOIN (SELECT brand, item FROM i QUALIFY row_number() OVER (PARTITION BY brand ORDER BY s DESC, item) = 1) USING (brand)""")
def producer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Producers with genres spanned, seconds and their top track."""
    own = history(spark, sf_dir)
    top = layers.top_item(own.groupBy("brand", "item").agg(F.sum("seconds").alias("seconds")), "brand", "item", "seconds").drop("top_seconds")
    return own.groupBy("brand").agg(F.count_distinct("genre").alias("genres"), F.sum("seconds").alias("seconds")).join(top, "brand")


@REGISTRY.add("SELECT event_id, (value * 1000)::BIGINT / 1000 AS seconds, event_type = 'error' OR (value * 1000)::BIGINT < 30000 AS is_skip FROM events")
def skip_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which plays count as skips: flagged, or under 30 seconds."""
    own = table(spark, sf_dir, "events").select("event_id", F.round(F.col("value") * 1000).cast("long").alias("ms_played"), (F.col("event_type") == "error").alias("skipped"))
    return temporal.skip_flags(own).select("event_id", "seconds", "is_skip")


@REGISTRY.add(f"""WITH {CALENDAR_SQL}, s AS (SELECT year, genre, sum(seconds)::BIGINT AS seconds FROM h GROUP BY ALL)
SELECT year, genre, seconds, seconds / sum(seconds) OVER (PARTITION BY year) AS share FROM s""")
def yearly_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each genre's share of its year."""
    return temporal.shares(history(spark, sf_dir), "year", "genre", "seconds")


@REGISTRY.add(f"""WITH {CALENDAR_SQL}, s AS (SELECT month, genre, sum(seconds)::DOUBLE AS x FROM h GROUP BY ALL),
m AS (SELECT month, sum(x * x) AS sq, lag(month) OVER (ORDER BY month) AS before FROM s GROUP BY month),
c AS (SELECT m.month, sum(a.x * b.x) AS xy FROM m JOIN s a ON a.month = m.month JOIN s b ON b.month = m.before AND b.genre = a.genre GROUP BY m.month)
SELECT m.month, round(CASE WHEN o.sq IS NOT NULL THEN 1 - coalesce(xy, 0) / sqrt(m.sq * o.sq) END, 9) AS distance FROM m LEFT JOIN m o ON o.month = m.before LEFT JOIN c ON c.month = m.month""")
def monthly_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each month's genres lie from the month before."""
    return temporal.drift(history(spark, sf_dir), "month", "genre", "seconds").withColumn("distance", F.round("distance", 9))


@REGISTRY.add(f"""WITH {CALENDAR_SQL}, m AS (SELECT DISTINCT item, month, year(month) * 12 + month(month) AS k FROM h),
g AS (SELECT *, k - lag(k) OVER (PARTITION BY item ORDER BY k) AS gap FROM m),
a AS (SELECT item, count(*) AS months, min(month) AS first_month, max(month) AS last_month, max(k) - min(k) + 1 AS reach, coalesce(max(gap), 0)::INTEGER AS max_gap FROM g GROUP BY item)
SELECT item, months, first_month, last_month, max_gap, CASE WHEN reach <= 3 THEN 'one-season' WHEN reach <= 12 THEN 'spike' WHEN max_gap > 6 THEN 'revival' ELSE 'perennial' END AS kind FROM a""")
def artist_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's kind of life: spike, perennial, revival, one season."""
    return temporal.lifecycle(history(spark, sf_dir), "item")


@REGISTRY.add(f"WITH {CALENDAR_SQL} SELECT month(ts)::INTEGER AS month_of_year, genre, sum(seconds)::BIGINT AS seconds FROM h GROUP BY ALL")
def seasonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genres by month of the year."""
    return history(spark, sf_dir).groupBy(F.month("ts").alias("month_of_year"), "genre").agg(F.sum("seconds").alias("seconds"))


def _sessions_sql(minutes: int) -> str:
    return f"""n AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL {minutes} MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM n)"""


@REGISTRY.add(f"WITH {_sessions_sql(30)} SELECT user_id, min(ts) AS start, max(ts) AS end, count(*) AS plays FROM s GROUP BY user_id, session")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with gaps of at most 30 minutes."""
    return temporal.sessions(table(spark, sf_dir, "events"), "user_id")


@REGISTRY.add(f"WITH {_sessions_sql(30)} SELECT user_id, min(ts) AS start, max(ts) AS end, count(*) AS plays FROM s GROUP BY user_id, session")
def sessions_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a stream that stops and goes on from its checkpoint three times."""
    rows = table(spark, sf_dir, "events").select("user_id", "ts")
    found = replay.replayed(rows, "ts", lambda stream: stream_sessions.sessions(stream, "user_id"))
    return found.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "plays")


@REGISTRY.add(f"""WITH {_sessions_sql(240)}, o AS (SELECT DISTINCT user_id, session, event_type AS m FROM s)
SELECT a.m AS src, b.m AS dst, count(*) AS weight FROM o a JOIN o b ON a.user_id = b.user_id AND a.session = b.session AND a.m < b.m GROUP BY ALL""")
def session_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What meets in one session, with gaps of at most four hours."""
    return temporal.cooccurrence(temporal.session_ids(table(spark, sf_dir, "events"), "user_id", minutes=240), "user_id", "event_type")


@REGISTRY.add(f"""WITH {CALENDAR_SQL} SELECT item, sum(seconds)::BIGINT AS seconds, max(ts) AS last FROM h GROUP BY item HAVING max(ts) < TIMESTAMP '2001-01-01' AND sum(seconds) >= 600""")
def anti_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items once much played and not since."""
    return temporal.dormant(history(spark, sf_dir), "item", "seconds", F.lit("2001-01-01").cast("timestamp_ntz"), 600)


@REGISTRY.add("SELECT p_partkey AS item FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01')")
def emerging_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items without an early history."""
    old = history(spark, sf_dir).where(F.col("ts") < F.lit("1996-01-01").cast("timestamp_ntz"))
    return temporal.emerging(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item")), old, "item")


@REGISTRY.add("""WITH r AS (SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-30 18:00:00'),
s AS (SELECT CASE WHEN hour(ts) BETWEEN 6 AND 11 THEN 'morning' WHEN hour(ts) BETWEEN 12 AND 16 THEN 'afternoon' WHEN hour(ts) BETWEEN 17 AND 21 THEN 'evening' ELSE 'night' END AS slot, user_id, count(*) AS n
    FROM events WHERE user_id NOT IN (SELECT user_id FROM r) GROUP BY ALL)
SELECT slot, user_id, n FROM s QUALIFY row_number() OVER (PARTITION BY slot ORDER BY n DESC, user_id) = 1""")
def mood_time_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part of the day who is most active and wasn't seen lately."""
    own = events(spark, sf_dir).select(temporal.daypart(F.col("hour")).alias("slot"), "user_id", "ts", F.lit(1).cast("long").alias("n"))
    recent = own.where(F.col("ts") >= F.lit("2024-01-30 18:00:00").cast("timestamp_ntz")).select("user_id")
    return temporal.slot_match(own, "slot", "user_id", "n", recent)


@REGISTRY.add(f"""WITH {CALENDAR_SQL}, s AS (SELECT genre, item, sum(seconds)::BIGINT AS seconds FROM h GROUP BY ALL)
SELECT genre, item, seconds, row_number() OVER (PARTITION BY genre ORDER BY seconds DESC, item)::INTEGER AS rank FROM s QUALIFY rank <= 5""")
def top5_per_genre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five items of most seconds in each genre."""
    sums = history(spark, sf_dir).groupBy("genre", "item").agg(F.sum("seconds").alias("seconds"))
    return layers.ranked(sums, [F.desc("seconds"), F.col("item")], 5, ["genre"])


@REGISTRY.add("SELECT user_id, sum(CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'error' THEN -1.0 ELSE 0.0 END)::DOUBLE AS weight FROM events GROUP BY user_id")
def reason_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of plays by weight: finished counts for, skipped against."""
    reason = F.when(F.col("event_type") == "purchase", "endplay").when(F.col("event_type") == "error", "fwdbtn").otherwise("other")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(temporal.reason_weight(reason)).alias("weight"))


@REGISTRY.add("SELECT event_id, year(ts)::INTEGER AS year, date_trunc('month', ts)::DATE AS month, week(ts)::INTEGER AS week, (dayofweek(ts) + 1)::INTEGER AS dow, hour(ts)::INTEGER AS hour, ts::DATE AS date FROM events")
def calendar_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar fields of events."""
    return events(spark, sf_dir).select("event_id", "year", "month", "week", "dow", "hour", "date")
