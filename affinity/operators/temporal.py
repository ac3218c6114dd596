"""Time-based operators over a history of plays (ts, item, seconds, ...). Calendar fields are of the session's zone."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SKIP_MS, DEEP_SHARE = 30_000, 0.8
SESSION_GAP = "30 minutes"
#: Reasons to end a play, and their weights.
REASONS = {"endplay": 1.0, "trackdone": 1.0, "fwdbtn": -1.0}


def calendar(history: DataFrame, ts: str = "ts") -> DataFrame:
    """Adds year, month (first day), week, dow (Sunday 1), hour, date."""
    t = F.col(ts)
    fields = {"year": F.year(t), "month": F.trunc(t.cast("date"), "month"), "week": F.weekofyear(t), "dow": F.dayofweek(t), "hour": F.hour(t), "date": t.cast("date")}
    return history.withColumns(fields)


def daypart(hour: Column) -> Column:
    """morning from 6, afternoon from 12, evening from 17, night from 22."""
    return F.when(hour.between(6, 11), "morning").when(hour.between(12, 16), "afternoon").when(hour.between(17, 21), "evening").otherwise("night")


def skip_flags(history: DataFrame, ms: str = "ms_played", duration: str | None = None, skipped: str = "skipped") -> DataFrame:
    """Adds seconds, is_skip (flagged or under 30 s) and, given a duration, is_deep (over four fifths)."""
    out = history.withColumn("seconds", F.col(ms) / 1000).withColumn("is_skip", F.coalesce(F.col(skipped), F.lit(False)) | (F.col(ms) < SKIP_MS))
    return out if duration is None else out.withColumn("is_deep", F.col(ms) > F.col(duration) * DEEP_SHARE)


def reason_weight(reason: Column) -> Column:
    """The weight of a reason to end a play; 0 for others."""
    out = F.lit(0.0)
    for name, weight in REASONS.items():
        out = F.when(reason == name, weight).otherwise(out)
    return out


def heatmap(history: DataFrame, value: str) -> DataFrame:
    """Summed value by dow and hour."""
    return history.groupBy("dow", "hour").agg(F.sum(value).alias(value))


def shares(history: DataFrame, period: str, group: str, value: str) -> DataFrame:
    """Summed value by period and group, with its share of the period: the sums are joined back by period."""
    sums = history.groupBy(period, group).agg(F.sum(value).alias(value))
    whole = sums.groupBy(period).agg(F.sum(value).alias("whole"))
    return sums.join(whole, period).select(period, group, value, (F.col(value) / F.col("whole")).alias("share"))


def drift(history: DataFrame, period: str, group: str, value: str) -> DataFrame:
    """Cosine distance of each period's group vector from the one before: period, distance (null for the first)."""
    sums = history.groupBy(period, group).agg(F.sum(value).cast("double").alias("x"))
    periods = sums.groupBy(period).agg(F.sum(F.col("x") * F.col("x")).alias("sq"))
    periods = periods.withColumn("before", F.lag(period).over(Window.orderBy(period)))  # one row for each period
    a, b = sums.alias("a"), sums.select(F.col(period).alias("before"), group, F.col("x").alias("y"))
    inner = a.join(periods.select(period, "before"), period).join(b, ["before", group]).groupBy(period).agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    old = periods.select(F.col(period).alias("before"), F.col("sq").alias("sq_before"))
    out = periods.join(old, "before", "left").join(inner, period, "left")
    return out.select(period, F.when(F.col("sq_before").isNotNull(), 1 - F.coalesce("xy", F.lit(0.0)) / F.sqrt(F.col("sq") * F.col("sq_before"))).alias("distance"))


def lifecycle(history: DataFrame, item: str, month: str = "month", span: int = 12, gap: int = 6) -> DataFrame:
    """Each item's kind by the months in which it is played: item, months, first_month, last_month, max_gap, kind.

    one-season: all within 3 months; spike: within ``span``; revival: a gap of
    more than ``gap`` months; else perennial. The thresholds are ours.
    """
    number = F.year(month) * 12 + F.month(month)
    own = history.select(item, F.col(month).alias("m"), number.alias("k")).distinct()
    own = own.withColumn("gap", F.col("k") - F.lag("k").over(Window.partitionBy(item).orderBy("k")))
    out = own.groupBy(item).agg(F.count("*").alias("months"), F.min("m").alias("first_month"), F.max("m").alias("last_month"), (F.max("k") - F.min("k") + 1).alias("reach"), F.coalesce(F.max("gap"), F.lit(0)).alias("max_gap"))
    kind = F.when(F.col("reach") <= 3, "one-season").when(F.col("reach") <= span, "spike").when(F.col("max_gap") > gap, "revival").otherwise("perennial")
    return out.select(item, "months", "first_month", "last_month", "max_gap", kind.alias("kind"))


def sessions(history: DataFrame, who: str, ts: str = "ts", gap: str = SESSION_GAP) -> DataFrame:
    """Sessions of plays that follow one another within a gap: who, start, end (of the last play), plays."""
    own = history.groupBy(who, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("plays"), F.min(ts).alias("start"), F.max(ts).alias("end"))
    return own.select(who, "start", "end", "plays")


def session_ids(history: DataFrame, who: str, ts: str = "ts", minutes: int = 30) -> DataFrame:
    """Adds ``session``, numbered from 1 for each: a new one after more than so many minutes."""
    order = Window.partitionBy(who).orderBy(ts)
    late = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(order).cast("timestamp")) > minutes * 60_000_000
    return history.withColumn("new", F.coalesce(late.cast("int"), F.lit(1))).withColumn("session", F.sum("new").over(order)).drop("new")


def cooccurrence(sessions: DataFrame, who: str, item: str) -> DataFrame:
    """In how many sessions two items meet: src, dst, weight."""
    own = sessions.select(F.struct(who, "session").alias("g"), F.col(item).alias("m")).distinct()
    return own.withColumnRenamed("m", "src").join(own.withColumnRenamed("m", "dst"), "g").where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def dormant(history: DataFrame, item: str, value: str, since: Column, least: float) -> DataFrame:
    """Items of at least so much value that haven't been played since: item, value, last."""
    out = history.groupBy(item).agg(F.sum(value).alias(value), F.max("ts").alias("last"))
    return out.where((F.col("last") < since) & (F.col(value) >= least))


def emerging(current: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """Current keys without history."""
    return current.select(key).distinct().join(history.select(key).distinct(), key, "left_anti")


def slot_match(history: DataFrame, slot: str, item: str, value: str, recent: DataFrame) -> DataFrame:
    """For each slot the item of most value that wasn't played recently (item), the least of equals: slot, item, value."""
    sums = history.join(recent.select(item).distinct(), item, "left_anti").groupBy(slot, item).agg(F.sum(value).alias(value))
    best = F.min(F.struct((-F.col(value)).alias("v"), F.col(item).alias("i"))).alias("b")
    return sums.groupBy(slot).agg(best).select(slot, F.col("b.i").alias(item), (-F.col("b.v")).alias(value))


def with_metadata(history: DataFrame, tracks: DataFrame, item: str = "item") -> DataFrame:
    """A history with the columns of known items; plays of unknown ones stay, with nulls."""
    return history.join(tracks, item, "left")


def session_vectors(sessions: DataFrame, who: str, vectors: DataFrame, item: str = "item") -> DataFrame:
    """The mean vector of each session's items: who, session, vector.

    ``vectors`` has (item, vector). Means are taken by element, so no session's
    vectors are gathered.
    """
    each = sessions.join(vectors, item).select(who, "session", F.posexplode("vector").alias("i", "x"))
    means = each.groupBy(who, "session", "i").agg(F.avg("x").alias("x"))
    return means.groupBy(who, "session").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vector"))


def listening_modes(session_vectors: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Sessions (who, session, vector) clustered by k-means: who, session, vector, mode."""
    own = session_vectors.withColumn("features", array_to_vector("vector"))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="mode").fit(own)
    return model.transform(own).drop("features")


# Descriptors at the two ends of the compass's axes.
COMPASS = {
    "energy": (["club", "electronic", "trap"], ["calm", "acoustic", "cozy"]),
    "valence": (["romantic", "love"], ["sad", "melancholy"]),
}


def compass(tracks: DataFrame, mode: str, modern: int = 2000) -> DataFrame:
    """Where each mode's tracks point: mode, energy, valence, era, spread, n.

    An axis is the mean, over tracks, of the descriptors at its one end less those
    at the other; ``era`` the share of tracks from ``modern`` on among those with a
    year; ``spread`` the number of macro genres. ``tracks`` has mode, descriptors,
    macros (lists) and release_year.
    """
    hits = lambda names: F.size(F.array_intersect("descriptors", F.array(*map(F.lit, names))))
    axes = [F.avg((hits(high) - hits(low)).cast("double")).alias(axis) for axis, (high, low) in COMPASS.items()]
    era = F.avg(F.when(F.col("release_year").isNotNull(), (F.col("release_year") >= modern).cast("double"))).alias("era")
    genres = tracks.select(mode, F.explode("macros").alias("macro")).groupBy(mode).agg(F.count_distinct("macro").alias("spread"))
    return tracks.groupBy(mode).agg(*axes, era, F.count("*").alias("n")).join(genres, mode, "left").withColumn("spread", F.coalesce("spread", F.lit(0)))


def recency_curve(history: DataFrame, value: str, now: Column) -> DataFrame:
    """Value by whole weeks before a moment: weeks, value; what is later isn't counted."""
    weeks = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / F.lit(7 * 86_400_000_000)).cast("long")
    return history.withColumn("weeks", weeks).where("weeks >= 0").groupBy("weeks").agg(F.sum(value).alias(value))
