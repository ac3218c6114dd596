"""Typed edge layers of an affinity graph, and operations on edge tables.

An edge table has (src, dst, type, weight) and more columns as they come;
undirected layers keep ``src < dst``. Layers stay apart until ``collapse``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinity.operators.session import written

MIN_LISTENING = 60
MIN_MATCH = 0.15
#: Which layer gives a collapsed edge its type: the first present, but for influence, which replaces all.
PRECEDENCE = ["collab", "production", "similarity"]
#: Members and pairs that a task of a join by group has about; members of one piece of a group; members of a block at most, groups compared at once; pairs for each member of a group from which groups are crowds.
TASK_MEMBERS, TASK_PAIRS, PIECE, BLOCK, GROUPS_AT_ONCE, CROWD = 1 << 19, 1 << 20, 4096, 8192, 1024, 8
#: Members of groups that a block lists at most.
LISTED = 1 << 18


def listening(plays: DataFrame, who: str, what: str, seconds: str, least: float = 1) -> DataFrame:
    """Summed seconds by (who, what): src, dst, weight; plays under ``least`` don't count."""
    return plays.where(F.col(seconds) >= least).groupBy(F.col(who).alias("src"), F.col(what).alias("dst")).agg(F.sum(seconds).alias("weight"))


def pairs(members: DataFrame, group: str, member: str, max_group: int | None = None) -> DataFrame:
    """Unordered pairs of distinct members by group, counted over groups: src, dst, weight.

    Members are made distinct first, so a pair counts once a group; ``max_group`` leaves
    larger groups out where pairs of a crowd mean nothing (off by default: nothing is
    dropped unasked). Groups are counted first. Mostly they are joined with themselves,
    large ones piece by piece, over as many tasks as members and pairs need, so that a
    task's memory is bounded. Where the groups hold more pairs than the members have,
    these are summed in each task first if groups are small (few members that meet in many
    groups), and if groups are crowds, blocks of members are compared instead, each pair
    once for each slice of the groups that a block can list.
    """
    own = members.select(F.col(group).alias("g"), F.col(member).alias("m")).where("g IS NOT NULL AND m IS NOT NULL")
    least = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), own.sparkSession.sparkContext.defaultParallelism)
    parts = max(least, -(-own.count() // TASK_MEMBERS))
    own = written(own.repartition(parts, "g", "m").distinct())
    sizes = own.repartition(parts, "g").groupBy("g").agg(F.count("*").alias("n"))
    if max_group is not None:
        own = own.join(sizes.where(F.col("n") <= max_group).select("g"), "g", "left_semi")
        sizes = sizes.where(F.col("n") <= max_group)
    found = sizes.agg(F.max("n").alias("most"), F.sum("n").alias("rows"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).first()
    if found["most"] is None:
        return own.select(F.col("m").alias("src"), F.col("m").alias("dst"), F.lit(0).cast("long").alias("weight")).limit(0)
    known = own.agg(F.count_distinct("m")).first()[0] if found["pairs"] > TASK_PAIRS else None
    again = known is not None and found["pairs"] > known * (known - 1) / 2
    if again and found["pairs"] > CROWD * found["rows"]:
        return _block_pairs(own, known, found["rows"], least)
    tasks = max(parts, int(-(-found["pairs"] // TASK_PAIRS)))
    if found["most"] <= PIECE:
        dealt = own.repartition(tasks, "g")
        both = dealt.withColumnRenamed("m", "src").join(dealt.withColumnRenamed("m", "dst"), "g").where("src < dst")
    else:
        pieces = own.join(sizes.select("g", F.ceil(F.col("n") / PIECE).cast("int").alias("pieces")), "g").withColumn("piece", F.pmod(F.xxhash64("m"), F.col("pieces")).cast("int"))
        one = pieces.select("g", F.col("m").alias("a"), F.col("piece").alias("i"), F.explode(F.sequence("piece", F.col("pieces") - 1)).alias("j"))
        two = pieces.select("g", F.col("m").alias("b"), F.col("piece").alias("j"), F.explode(F.sequence(F.lit(0), "piece")).alias("i"))
        both = one.repartition(tasks, "g", "i", "j").join(two.repartition(tasks, "g", "i", "j"), ["g", "i", "j"])
        both = both.where("i < j OR a < b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    both = both.select("src", "dst")
    if not again:
        both = both.repartition(tasks, "src", "dst")
    return both.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def _block_pairs(own: DataFrame, members: int, rows: int, least: int) -> DataFrame:
    """Pairs of members (g, m; distinct; so many rows) by their common groups, block by block; only blocks are shuffled, and sums where groups are sliced."""
    blocks = min(members, max(-(-members // BLOCK), int(np.ceil(np.sqrt(6 * least)))))
    slices = -(-rows // (blocks * LISTED))
    kind = own.schema["m"].dataType.simpleString()
    listed = own.groupBy("m", F.pmod(F.xxhash64("g", F.lit("slice")), F.lit(slices)).cast("int").alias("s")).agg(F.collect_list("g").alias("gs"))
    packed = listed.groupBy("s", F.pmod(F.xxhash64("m"), F.lit(blocks)).cast("int").alias("j")).agg(F.collect_list(F.struct("m", "gs")).alias("right"))
    left = packed.select("s", F.col("j").alias("i"), F.col("right").alias("left"), F.explode(F.sequence("j", F.lit(blocks - 1))).alias("j"))
    both = left.join(packed.hint("merge"), ["s", "j"]).select("i", "j", "left", "right").repartition(slices * blocks * (blocks + 1) // 2)
    found = both.mapInArrow(_common_groups, f"src {kind}, dst {kind}, weight long")
    return found if slices == 1 else found.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def _common_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each two blocks of members the pairs with a common group and the number of these."""

    def flags(rows: np.ndarray, codes: np.ndarray, n: int, first: int) -> np.ndarray:
        out = np.zeros((n, GROUPS_AT_ONCE), np.float32)
        inside = slice(*np.searchsorted(codes, [first, first + GROUPS_AT_ONCE]))  # codes ascend
        out[rows[inside], codes[inside] - first] = 1
        return out

    for batch in batches:
        for i, j, one, two in zip(*(batch.column(c) for c in range(4)), strict=True):
            sides = [x.values for x in (one, two)]
            lists = [x.field("gs") for x in sides]
            groups = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
            codes = np.split(groups.indices.to_numpy(), [len(lists[0].flatten())])
            rows = [np.repeat(np.arange(len(x)), pc.list_value_length(x).to_numpy()) for x in lists]
            orders = [np.argsort(x, kind="stable") for x in codes]
            codes, rows = ([x[order] for x, order in zip(y, orders, strict=True)] for y in (codes, rows))
            names = pa.concat_arrays([x.field("m") for x in sides]).dictionary_encode()
            order = pc.sort_indices(names.dictionary)
            place = np.empty(len(order), np.int64)
            place[order.to_numpy()] = np.arange(len(order))
            a, b = np.split(place[names.indices.to_numpy()], [len(sides[0])])
            names = names.dictionary.take(order)
            step = max(1, (1 << 21) // max(len(b), GROUPS_AT_ONCE))
            for start in range(0, len(a), step):
                own = a[start : start + step]
                mine = (rows[0] >= start) & (rows[0] < start + step)
                common = np.zeros((len(own), len(b)), np.float32)
                for first in range(0, len(groups.dictionary), GROUPS_AT_ONCE):
                    common += flags(rows[0][mine] - start, codes[0][mine], len(own), first) @ flags(rows[1], codes[1], len(b), first).T
                keep = common > 0
                if i == j:
                    keep &= own[:, None] < b[None, :]
                row, column = np.nonzero(keep)
                x, y = own[row], b[column]
                columns = [names.take(pa.array(np.minimum(x, y))), names.take(pa.array(np.maximum(x, y))), pa.array(common[row, column].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["src", "dst", "weight"])


def similarity(directed: DataFrame, library: DataFrame, floor: float = MIN_MATCH) -> DataFrame:
    """Directed matches between library members, at or above a floor, as undirected edges of the larger match.

    ``directed`` has (src, dst, match), ``library`` has (node).
    """
    own = directed.where(F.col("match") >= floor).join(library.withColumnRenamed("node", "src"), "src", "left_semi")
    return symmetrized(own.join(library.withColumnRenamed("node", "dst"), "dst", "left_semi"))


def symmetrized(directed: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Undirected edges with the larger match of both directions: src, dst, weight; self edges go.

    ``excluded`` has undirected (src, dst) to leave out.
    """
    edges = directed.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    edges = edges.agg(F.max("match").alias("weight"))
    return edges if excluded is None else edges.join(excluded, ["src", "dst"], "left_anti")


def unknown_pairs(edges: DataFrame, known: DataFrame) -> DataFrame:
    """The edges whose unordered pair isn't among the known ones."""
    pair = lambda d: d.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct()
    keyed = edges.withColumns({"lo": F.least("src", "dst"), "hi": F.greatest("src", "dst")})
    return keyed.join(pair(known), ["lo", "hi"], "left_anti").drop("lo", "hi")


def influence(curated: DataFrame, generated: DataFrame) -> DataFrame:
    """Curated edges, then generated ones of pairs that no curated edge has."""
    return curated.unionByName(unknown_pairs(generated, curated), allowMissingColumns=True)


def resolved(edges: DataFrame, names: DataFrame, required: bool = True) -> DataFrame:
    """Replace endpoint ids by names (id, name); unresolved edges go, or keep the id if not ``required``."""
    how = "inner" if required else "left"
    out = edges
    for end in ("src", "dst"):
        own = names.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name"))
        out = out.join(own, end, how).withColumn(end, F.coalesce(f"{end}_name", end)).drop(f"{end}_name")
    return out.select(*edges.columns)


def collapse(edges: DataFrame) -> DataFrame:
    """One edge for each pair, as a simple graph holds it: src, dst, type, weight.

    Weights of collab, production and similarity add up under the first type
    present; where the type isn't similarity, a similarity counts once for each
    of its ``directions`` (1 if there is no such column). An influence edge
    replaces all others, with weight 1.
    """
    times = F.col("directions") if "directions" in edges.columns else F.lit(1)
    has = lambda t: F.max(F.when(F.col("type") == t, 1).otherwise(0))
    other = F.sum(F.when(F.col("type").isin(*PRECEDENCE[:2]), F.col("weight")).otherwise(0))
    once = F.sum(F.when(F.col("type") == "similarity", F.col("weight")).otherwise(0))
    twice = F.sum(F.when(F.col("type") == "similarity", F.col("weight") * times).otherwise(0))
    grouped = edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    grouped = grouped.agg(*[has(t).alias(t) for t in [*PRECEDENCE, "influence"]], other.alias("other"), once.alias("once"), twice.alias("twice"))
    mixed = F.col("collab") + F.col("production") > 0
    kind = F.when(F.col("influence") == 1, "influence").when(F.col("collab") == 1, "collab").when(F.col("production") == 1, "production").otherwise("similarity")
    weight = F.when(F.col("influence") == 1, F.lit(1)).when(mixed, F.col("other") + F.col("twice")).otherwise(F.col("once"))
    return grouped.select("src", "dst", kind.alias("type"), weight.alias("weight"))


def influence_endpoint(node: Column, known: Column) -> Column:
    """The id of an influence edge's end: an artist if the graph knows it, else a concept."""
    return F.when(known, F.concat(F.lit("artist::"), node)).otherwise(F.concat(F.lit("concept::"), node))


def pruned(edges: DataFrame, least: float = MIN_LISTENING) -> DataFrame:
    """Edges without listening edges under a weight; nodes that this isolates are those no edge names."""
    return edges.where((F.col("type") != "listening") | (F.col("weight") >= least))


def endpoints(edges: DataFrame) -> DataFrame:
    """All nodes that an edge names: node."""
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes (node, ...) that no edge names."""
    return nodes.join(endpoints(edges), "node", "left_anti")


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes (node, ...) that some edge names."""
    return nodes.join(endpoints(edges), "node", "left_semi")


def normalized(edges: DataFrame) -> DataFrame:
    """Adds ``norm_weight``, the weight over the largest of its type; a largest of 0 counts as 1.

    The largest are aggregated and joined back, so no type is gathered in one task.
    """
    top = edges.groupBy("type").agg(F.max("weight").alias("top"))
    top = top.select("type", F.when(F.col("top") == 0, 1).otherwise(F.col("top")).alias("top"))
    return edges.join(F.broadcast(top), "type").withColumn("norm_weight", F.col("weight") / F.col("top")).drop("top")  # one row for each type


def in_degree(directed: DataFrame) -> DataFrame:
    """How often each node is a target: node, in_degree."""
    return directed.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))


def degrees(edges: DataFrame) -> DataFrame:
    """The number of edges of each node: node, degree."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def tag_index(tagged: DataFrame, node: str, tag: str) -> DataFrame:
    """The sorted nodes of each tag: tag, nodes."""
    return tagged.groupBy(F.col(tag).alias("tag")).agg(F.array_sort(F.collect_set(node)).alias("nodes"))


def top_item(plays: DataFrame, who: str, item: str, seconds: str) -> DataFrame:
    """The item of most seconds for each, the least item of equals: who, top_item, top_seconds."""
    best = F.min(F.struct((-F.col(seconds)).alias("s"), F.col(item).alias("i")))
    return plays.groupBy(who).agg(best.alias("b")).select(who, F.col("b.i").alias("top_item"), (-F.col("b.s")).alias("top_seconds"))


def node_attributes(plays: DataFrame, who: str, item: str, seconds: str, *labels: str) -> DataFrame:
    """Totals and sorted distinct labels of each node."""
    sets = [F.array_sort(F.collect_set(c)).alias(f"{c}_set") for c in labels]
    return plays.groupBy(who).agg(F.sum(seconds).alias("total_seconds"), F.count_distinct(item).alias("item_count"), *sets)


def share(totals: DataFrame, value: str) -> DataFrame:
    """Adds ``share``, the percentage of the sum of all; a sum of 0 counts as 1."""
    whole = totals.agg(F.sum(value).alias("whole")).select(F.when(F.col("whole") == 0, 1).otherwise(F.col("whole")).alias("whole"))
    return totals.withColumn("share", F.col(value) * 100.0 / whole.scalar())


def rolled_up(values: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """Sums by (outer, inner), by outer, and of all: the levels of a tree, nulls standing for all."""
    return values.rollup(outer, inner).agg(F.sum(value).alias(value))


def ranked(rows: DataFrame, by: list[Column], most: int, within: list[str] | None = None, name: str = "rank") -> DataFrame:
    """The first ``most`` rows in an order, of each group if ``within`` is given."""
    if not within:
        return rows.orderBy(*by).limit(most)
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*by))).where(F.col(name) <= most)


def genre_profile(tracks: DataFrame) -> DataFrame:
    """Tracks (macros, played_seconds, release_year) by genre: genre, track_count, seconds, average_year."""
    each = tracks.select(F.explode("macros").alias("genre"), "played_seconds", "release_year")
    return each.groupBy("genre").agg(F.count("*").alias("track_count"), F.sum("played_seconds").alias("seconds"), F.avg("release_year").alias("average_year"))
