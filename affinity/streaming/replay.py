"""A table replayed as a stream: written piece by piece in the order of time, each piece read by a restarted query."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.operators.session import scratch

#: How far after the last row the closing row lies, so that the watermark passes all that is open.
BEYOND = timedelta(days=30)


def replayed(rows: DataFrame, ts: str, apply: Callable[[DataFrame], DataFrame], pieces: int = 4) -> DataFrame:
    """What a streaming query gives for rows that arrive in ``pieces`` of equal time.

    Source files, results and the query's checkpoint lie in the shared folder. After each
    piece the query takes what is there, stops, and the next run goes on from its
    checkpoint. A closing row, null but for its time, lets the watermark pass all open
    windows; ``apply`` leaves its own group open. A table without times is applied as a batch.
    """
    spark = rows.sparkSession
    low, high = rows.agg(F.min(ts), F.max(ts)).first()
    if low is None:
        return apply(rows)
    source, sink, marks = (f"{scratch(spark)}/{x}" for x in ("source", "sink", "marks"))
    kind = rows.schema[ts].dataType
    for k in range(pieces):
        begin, end = (F.lit(low + (high - low) * i / pieces).cast(kind) for i in (k, k + 1))
        last = k == pieces - 1
        piece = rows.where((F.col(ts) >= begin) & (F.lit(True) if last else F.col(ts) < end))
        if last:
            closing = [F.lit(high + BEYOND if f.name == ts else None).cast(f.dataType).alias(f.name) for f in rows.schema]
            piece = piece.unionByName(spark.range(1).select(*closing))
        piece.write.mode("append").parquet(source)
        stream = apply(spark.readStream.schema(rows.schema).parquet(source))
        query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", marks).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)
