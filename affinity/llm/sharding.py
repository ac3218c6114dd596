"""Consistent hashing with bounded loads: equal shards from a ring of virtual nodes.

Method: every shard has ``vnodes`` points on a 32-bit ring; a key belongs to the
arc that ends at the next point clockwise. Each shard holds a fixed number of
keys. Keys that a full shard can't take continue clockwise to the next shard,
so balance is guaranteed: counts differ by one at most (``slack=0``), or stay
under ``(1 + slack)`` times the mean.

Only arcs, not keys, take part in the placement: all keys of an arc meet the
shards in the same order, so the rounds run over ``shards * vnodes`` counts, a
size that parameters alone fix. Keys then find their place by their rank in
their arc. Keys of an arc are ranked in cells of it, so that no window holds a
large share of the rows. One narrow shuffle (no texts) in all.

Null text counts as no bytes, a row without a key is placed by its text; equal keys
share an arc and rows that are alike in all columns are interchangeable. An empty
table gives an empty result. Only DataFrame functions are used.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinity.llm.common import CRC_CTES, CRC_OF_HX

RING_BITS = 32
#: Keys of an arc are ranked in so many cells.
CELLS = 16


def ring_position(name: Column) -> Column:
    """A point of the ring: the first 32 bits of the MD5 of a string."""
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long")


def ring_points(shards: int, vnodes: int) -> list[int]:
    """The sorted ring positions of all virtual nodes."""
    names = (f"{s}:{v}" for s in range(shards) for v in range(vnodes))
    return sorted(int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in names)


def _constants(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def arc_of(position: Column, shards: int, vnodes: int) -> Column:
    """The arc of a ring position: how many points lie before it, found by its leading byte first."""
    points = ring_points(shards, vnodes)
    low = [sum(p >> (RING_BITS - 8) < c for p in points) for c in range(257)]
    byte = F.shiftright(position, RING_BITS - 8).cast("int")
    below = F.element_at(_constants(low), byte + 1)
    inside = F.slice(_constants(points), (below + 1).cast("int"), (F.element_at(_constants(low), byte + 2) - below).cast("int"))
    return ((below + F.size(F.filter(inside, lambda p: p < position))) % len(points)).cast("int")


def arcs(spark, shards: int, vnodes: int) -> DataFrame:
    """Every arc with its shards in clockwise order: arc, prefs."""
    name = F.concat_ws(":", F.expr(f"id div {vnodes}").cast("string"), (F.col("id") % vnodes).cast("string"))
    points = spark.range(shards * vnodes).select(F.expr(f"id div {vnodes}").cast("int").alias("owner"), ring_position(name).alias("at"))
    points = points.withColumn("arc", F.row_number().over(Window.orderBy("at", "owner")) - 1)
    after = Window.orderBy("arc").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everywhere = Window.orderBy("arc").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def ahead(s: int) -> Column:
        own = F.when(F.col("owner") == s, F.col("arc"))
        return F.struct(F.coalesce(F.min(own).over(after), F.min(own).over(everywhere) + shards * vnodes).alias("at"), F.lit(s).alias("s"))

    return points.select("arc", F.transform(F.array_sort(F.array(*map(ahead, range(shards)))), lambda x: x["s"]).alias("prefs"))


def place_arcs(counts: DataFrame, shards: int, vnodes: int, slack: float = 0.0) -> DataFrame:
    """Deal the keys of arcs to shards of bounded load.

    ``counts`` has (arc, n). Returns for each arc its ``runs``: ranks from
    ``first`` on, ``n`` of them, lie in ``shard`` from ``slot`` on. In round r
    every arc offers the keys that it still has to its r-th shard, which takes
    them in ring order as far as it has room.
    """
    before = Window.orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.orderBy("arc").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    state = arcs(counts.sparkSession, shards, vnodes).join(counts, "arc", "left").select("arc", "prefs", F.coalesce("n", F.lit(0)).alias("rest"))
    total = F.sum("rest").over(everywhere)
    if slack > 0:
        room = [F.ceil(total * (1 + slack) / shards)] * shards
    else:
        room = [F.floor(total / shards) + F.when(total % shards > s, 1).otherwise(0) for s in range(shards)]
    state = state.withColumn("room", F.array(*room).cast("array<long>"))
    state = state.select("*", F.col("room").alias("free"), F.lit(0).cast("long").alias("rank"))
    for r in range(shards):
        state = state.withColumn("s", F.col("prefs")[r])
        ahead = [F.coalesce(F.sum(F.when(F.col("s") == s, F.col("rest"))).over(before), F.lit(0)) for s in range(shards)]
        state = state.withColumn("ahead", F.array(*ahead)[F.col("s")])
        state = state.withColumn("taken", F.greatest(F.lit(0), F.least("rest", F.col("free")[F.col("s")] - F.col("ahead"))).cast("long"))
        slot = F.col("room")[F.col("s")] - F.col("free")[F.col("s")] + F.least("ahead", F.col("free")[F.col("s")])
        run = F.struct(F.col("rank").alias("first"), F.col("taken").alias("n"), F.col("s").alias("shard"), slot.alias("slot"))
        state = state.withColumn(f"run{r}", run)
        taken = [F.coalesce(F.sum(F.when(F.col("s") == s, F.col("taken"))).over(everywhere), F.lit(0)) for s in range(shards)]
        state = state.withColumn("free", F.zip_with("free", F.array(*taken), lambda a, b: a - b))
        state = state.withColumn("rank", F.col("rank") + F.col("taken")).withColumn("rest", F.col("rest") - F.col("taken"))
    runs = F.filter(F.array(*[f"run{r}" for r in range(shards)]), lambda x: x["n"] > 0)
    return state.select("arc", runs.alias("runs"))


def shard(docs: DataFrame, shards: int, vnodes: int = 64, slack: float = 0.0) -> DataFrame:
    """Put every document into a shard: doc_id, size, text_crc32, arc, shard, slot.

    ``slot`` numbers the documents of a shard from 0 without gaps.
    """
    # Rows without an id are placed by their text, so that they don't all lie at one point.
    position = ring_position(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit(":"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("string"))))
    keyed = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        position.alias("at"),
    )
    keyed = keyed.select("*", arc_of(F.col("at"), shards, vnodes).alias("arc"), (F.col("at") % CELLS).cast("int").alias("cell"))
    cells = keyed.groupBy("arc", "cell").agg(F.count("*").alias("n"))
    runs = place_arcs(cells.groupBy("arc").agg(F.sum("n").alias("n")), shards, vnodes, slack)
    earlier = Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("arc", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")).join(F.broadcast(runs), "arc")
    own = Window.partitionBy("arc", "cell").orderBy("at", "doc_id", "text_crc32", "size")
    ranked = keyed.withColumn("own", F.row_number().over(own) - 1)
    # shards * vnodes * CELLS rows at most, whatever the input.
    placed = ranked.join(F.broadcast(cells), ["arc", "cell"]).withColumn("rank", F.col("offset") + F.col("own"))
    run = F.element_at(F.filter("runs", lambda x: (x["first"] <= F.col("rank")) & (F.col("rank") < x["first"] + x["n"])), 1)
    placed = placed.withColumn("run", run)
    return placed.select(
        "doc_id", "size", "text_crc32", "arc", F.col("run.shard").alias("shard"), (F.col("run.slot") + F.col("rank") - F.col("run.first")).alias("slot")
    )


def shard_sql(shards: int, vnodes: int) -> str:
    """DuckDB SQL of ``shard`` with no slack over ``documents``, with the columns of the query."""
    n = shards * vnodes
    position = lambda x: f"('0x' || substr(md5({x}), 1, 8))::BIGINT"
    each = range(shards)
    ctes = [
        CRC_CTES,
        f"points AS (SELECT i // {vnodes} AS owner, {position(f"(i // {vnodes})::VARCHAR || ':' || (i % {vnodes})::VARCHAR")} AS pos FROM range({n}) r(i))",
        "numbered AS (SELECT owner, pos, row_number() OVER (ORDER BY pos, owner) - 1 AS arc FROM points)",
        "ahead AS (SELECT a.arc, s.owner, coalesce((SELECT min(b.arc) FROM numbered b WHERE b.owner = s.owner AND b.arc >= a.arc), "
        f"(SELECT min(b.arc) + {n} FROM numbered b WHERE b.owner = s.owner)) AS d FROM numbered a, (SELECT DISTINCT owner FROM points) s)",
        "prefs AS (SELECT arc, list(owner ORDER BY d) AS prefs FROM ahead GROUP BY arc)",
        "hexed AS (SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, hex(encode(coalesce(text, ''))) AS hx FROM documents)",
        f"counted AS (SELECT doc_id, size, CASE WHEN hx = '' THEN 0 ELSE {CRC_OF_HX} END AS crc FROM hexed, crc_table)",
        f"summed AS (SELECT doc_id, size, crc, {position("coalesce(doc_id::VARCHAR, ':' || crc)")} AS pos FROM counted)",
        f"keyed AS (SELECT s.*, (SELECT count(*) FROM points p WHERE p.pos < s.pos) % {n} AS arc FROM summed s)",
        f"ranked AS (SELECT *, row_number() OVER (PARTITION BY arc ORDER BY pos % {CELLS}, pos, doc_id, crc, size) - 1 AS rank FROM keyed)",
        "r0 AS MATERIALIZED (SELECT p.arc, prefs, count(k.arc) AS rest, 0::BIGINT AS rank FROM prefs p LEFT JOIN keyed k ON k.arc = p.arc GROUP BY p.arc, prefs)",
        f"f0 AS MATERIALIZED (SELECT s, n // {shards} + CASE WHEN n % {shards} > s THEN 1 ELSE 0 END AS room FROM (SELECT sum(rest) AS n FROM r0), range({shards}) t(s))",
        "g0 AS MATERIALIZED (SELECT s, room, room AS free FROM f0)",
    ]
    for r in each:
        ctes += [
            f"a{r} AS MATERIALIZED (SELECT t.arc, t.prefs, t.rest, t.rank, g.s, g.room, g.free, coalesce(sum(t.rest) OVER (PARTITION BY g.s ORDER BY t.arc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM r{r} t JOIN g{r} g ON g.s = t.prefs[{r + 1}])",
            f"b{r} AS MATERIALIZED (SELECT *, greatest(0, least(rest, free - ahead)) AS taken FROM a{r})",
            f"r{r + 1} AS MATERIALIZED (SELECT arc, prefs, rest - taken AS rest, rank + taken AS rank FROM b{r})",
            f"g{r + 1} AS MATERIALIZED (SELECT g.s, g.room, g.free - coalesce(sum(b.taken), 0) AS free FROM g{r} g LEFT JOIN b{r} b ON b.s = g.s GROUP BY g.s, g.room, g.free)",
        ]
    runs = " UNION ALL ".join(f"SELECT arc, rank AS first, taken AS n, s, room - free + least(ahead, free) AS slot FROM b{r} WHERE taken > 0" for r in each)
    return (
        "WITH RECURSIVE " + ",\n".join(ctes) + f",\nruns AS ({runs})\nSELECT k.doc_id, k.size::BIGINT AS size, k.crc AS text_crc32, 'rows' AS law, "
        "u.s::INTEGER AS shard, (u.slot + k.rank - u.first)::BIGINT AS slot, NULL::INTEGER AS grown_shard\n"
        "FROM ranked k JOIN runs u ON u.arc = k.arc AND k.rank >= u.first AND k.rank < u.first + u.n"
    )
