"""What the operators of this subpackage share: session folders, tables, SQL pieces."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of a word in most contracts: space and the controls 09 to 0D.
BLANKS = " \t\n\x0b\f\r"
#: The same as a regular-expression class, for Java and for DuckDB.
BLANK_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that the driver and all executors see.

    It is what the cluster names in spark.checkpoint.dir, else the session's own
    checkpoint folder, else a folder in the warehouse. No setting is changed.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if named or current.isDefined():
        return named or current.get()
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/affinity-tables"


def materialize(df: DataFrame) -> DataFrame:
    """Write a result as a table in the shared folder and read it again.

    Cuts the lineage: a lost executor costs no recomputation of what came
    before. The tables of an application lie in one folder named after it; they
    go when the driver's process ends, and what a killed driver leaves is told
    by the folder's name.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/affinity-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(discard, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it and the session still exist."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended already
        return


#: A key with more than one in so many of all rows is hot: there are fewer of these than this number.
HOT_SHARE = 1000


def hot_keys(counted: DataFrame, weight: str) -> DataFrame:
    """The keys of hot groups: the rows of ``counted`` (one for each key) that hold over a thousandth of all ``weight``.

    There are fewer than ``HOT_SHARE``, so they can be sent to every executor.
    """
    total = counted.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    return counted.where(F.col(weight) * HOT_SHARE > F.lit(total))


def met(many: DataFrame, few: DataFrame, hot: DataFrame, keys: list[str], spread: Column) -> DataFrame:
    """The inner join of ``many`` with ``few`` by ``keys`` in one pass over ``many``.

    Rows of ``many`` whose keys are hot (from ``hot_keys``) get the rows of ``few`` from a
    broadcast table; for the shuffle they are dealt out by ``spread`` and meet nothing.
    """
    columns = [c for c in few.columns if c not in keys]
    named = F.broadcast(hot.select(*keys))  # fewer than HOT_SHARE rows
    at_hand = few.join(named, keys, "left_semi").groupBy(*keys).agg(F.collect_list(F.struct(F.lit(1).alias("is"), *columns)).alias("near"))
    far = few.join(named, keys, "left_anti").withColumnsRenamed({k: f"far_{k}" for k in keys}).select(*[f"far_{k}" for k in keys], F.lit(0).alias("far_part"), F.struct(F.lit(1).alias("is"), *columns).alias("far"))
    flagged = many.join(F.broadcast(at_hand), keys, "left")
    part = F.when(F.col("near").isNull(), 0).otherwise(F.pmod(spread, F.lit(1 << 20)).cast("int") + 1)
    flagged = flagged.withColumn("part", part)
    on = F.col("part") == F.col("far_part")
    for k in keys:
        on = on & (F.col(k) == F.col(f"far_{k}"))
    both = flagged.join(far, on, "left").where("near IS NOT NULL OR far IS NOT NULL")
    every = both.withColumn("m", F.explode(F.when(F.col("near").isNotNull(), F.col("near")).otherwise(F.array("far"))))
    return every.select(*many.columns, *[F.col("m")[c].alias(c) for c in columns])


def row_of(df: DataFrame) -> Column:
    """All columns of a row as one struct, whatever their names."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns])


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, also where body uses it in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, combine) -> Column:
    """``combine`` over every leading part of an array: running sums, or running maxima.

    Each step doubles how many values a place has combined, so n values cost n log n.
    """

    def step(a: Column, w: Column) -> Column:
        rest = F.size(a) - w
        return F.concat(F.slice(a, 1, w), F.zip_with(F.slice(a, 1, rest), F.slice(a, w + 1, rest), combine))

    return let(values, lambda v: F.aggregate(F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda w: w < F.size(v)), v, step))


def blank_words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; none for null or blank text."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[\x20\x09-\x0D]+", -1)
    )


def text_slices(batch: pa.RecordBatch, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut a record batch with a ``text`` column into runs of at most about ``most`` bytes of text.

    A single longer text makes a run of its own: texts are never cut.
    """
    sizes = pc.binary_length(batch.column(batch.schema.get_field_index("text"))).to_pylist()
    first = total = 0
    for i, size in enumerate(sizes):
        size = size or 0
        if i > first and total + size > most:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield batch.slice(first)


#: DuckDB CTEs (recursive): the 256 entries of the reflected CRC-32 table, polynomial EDB88320.
CRC_CTES = """crc_steps(b, c, k) AS (
    SELECT b::UBIGINT, b::UBIGINT, 0 FROM range(256) r(b)
    UNION ALL
    SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1
    FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM crc_steps WHERE k = 8)"""

#: DuckDB expression: the CRC-32 of bytes given as the hexadecimal string ``hx``, beside ``crc_table``.
CRC_OF_HX = """xor(list_reduce(
    [('0x' || hx[2 * i + 1:2 * i + 2])::UBIGINT for i in range(length(hx) // 2)],
    lambda a, x: xor(a >> 8, t[(xor(a, x) & 255)::BIGINT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT)::BIGINT"""
