"""Orders over whole tables without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinity.operators.session import cut


def summed_before(rows: DataFrame, by: list[Column], value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all earlier rows of an order.

    Rows are put into ranges of the order; each range is summed by itself, and
    the ranges' totals (a row for each) give where it starts.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = cut(rows.withColumn("_value", value).repartitionByRange(parts, *by).withColumn("_range", F.spark_partition_id()))
    totals = held.groupBy("_range").agg(F.sum("_value").alias("_sum"))
    starts = totals.withColumn("_start", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.sum("_value").over(Window.partitionBy("_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1))
    both = held.join(F.broadcast(starts.select("_range", "_start")), "_range")  # a row for each range
    return both.withColumn(name, F.col("_start") + F.coalesce(inside, F.lit(0))).drop("_range", "_start", "_value")


def numbered(rows: DataFrame, by: list[Column], name: str, first: int = 1) -> DataFrame:
    """Adds each row's place in an order, from ``first`` on."""
    return summed_before(rows, by, F.lit(1).cast("long"), name).withColumn(name, (F.col(name) + first).cast("long"))


def lowest_by_hash(rows: DataFrame, key: Column, groups: list[str], most: Column) -> DataFrame:
    """Of each group the rows of lowest MD5 of ``key``, exactly ``most`` of them (fewer where there are fewer).

    Rows are counted by the leading 16 bits of the hash first; only those of the
    bucket in which the last one lies are put in order.
    """
    drawn = rows.withColumn("_most", most).withColumn("_hash", F.md5(key.cast("binary")))
    drawn = drawn.withColumn("_bucket", F.substring("_hash", 1, 4))
    counts = drawn.groupBy(*groups, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))  # 65536 rows for each group at most
    both = drawn.join(counts, [*groups, "_bucket"]).where(F.col("_before") < F.col("_most"))
    whole = both.where(F.col("_before") + F.col("_n") <= F.col("_most"))
    cut_by = Window.partitionBy(*groups, "_bucket").orderBy("_hash", *[c for c in rows.columns if c not in groups])
    part = both.where(F.col("_before") + F.col("_n") > F.col("_most")).withColumn("_row", F.row_number().over(cut_by))
    part = part.where(F.col("_before") + F.col("_row") <= F.col("_most"))
    return whole.select(*rows.columns).unionByName(part.select(*rows.columns))


def drawn(*parts: Column) -> Column:
    """A number of 32 bits that follows from its parts alone."""
    key = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")
