"""Traversals: best-first reach, neighbourhoods, property filters, hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.operators.session import cut

# Labels that end a walk up the genres.
STOP_LABELS = ["music genre", "music", "art", "genre", "popular music", "entertainment"]
MAX_HOPS = 6
#: Labels that a task walks up about.
TASK_LABELS = 1 << 16


def best_first(seeds: DataFrame, edges: DataFrame, most: int, max_rounds: int = 200) -> DataFrame:
    """The ``most`` nodes that a best-first crawl visits: node, priority, depth, via.

    ``seeds`` has (node), at priority 1 and depth 0; ``edges`` (src, dst, match)
    with match at most 1. A child's priority is its parent's times the match, so
    priorities only fall along a path and the crawl's order is by each node's
    best priority. Relaxed until nothing changes (a graph that takes more rounds is
    an error, not a partial result); equals are ordered by name, then depth, then via.
    """
    best = cut(seeds.select("node", F.lit(1.0).alias("priority"), F.lit(0).alias("depth"), F.col("node").alias("via")).distinct())
    return relaxed(best, edges, max_rounds).orderBy(F.desc("priority"), "node").limit(most)


def relaxed(best: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Nodes (node, priority, depth, via) with all that edges lead to from them, each by its best way."""
    order = lambda: F.min(F.struct((-F.col("priority")).alias("p"), "depth", "via")).alias("b")
    front = best
    for _ in range(max_rounds):
        reached = front.join(edges.withColumnRenamed("src", "node"), "node")
        reached = reached.select(F.col("dst").alias("node"), (F.col("priority") * F.col("match")).alias("priority"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("via"))
        new = best.unionByName(reached).groupBy("node").agg(order())
        new = cut(new.select("node", (-F.col("b.p")).alias("priority"), F.col("b.depth").alias("depth"), F.col("b.via").alias("via")))
        front = new.join(best, ["node", "priority", "depth", "via"], "left_anti")
        best = new
        if front.isEmpty():
            return best
    raise RuntimeError(f"still changing after {max_rounds} rounds")


def crawl(spark: SparkSession, seeds: DataFrame, edges: DataFrame, most: int, folder: str, every: int | None = None) -> DataFrame:
    """A best-first crawl that keeps its state in a folder and goes on from there: node, priority, depth, via.

    The state is what was visited (``universe``) and what was seen beside it
    (``frontier``), written after every ``every`` visits and at the end, each time
    to a new numbered folder whose frontier comes last: a state without one was
    broken off and isn't taken. A later call with a larger ``most`` resumes, and gives
    what one crawl to ``most`` would have given.
    """
    done, number = load_state(spark, folder)
    visited = 0 if done is None else done[0].count()
    front = done[1] if done is not None else seeds.select("node", F.lit(1.0).alias("priority"), F.lit(0).alias("depth"), F.col("node").alias("via")).distinct()
    universe = done[0] if done is not None else front.limit(0)
    while visited < most:
        goal = min(most, visited + (every or most))
        # Of what is known, the best are next; what they lead to may come before others.
        known = cut(universe.withColumn("seen", F.lit(True)).unionByName(front.withColumn("seen", F.lit(False))))
        every_node = relaxed(known.drop("seen"), edges)
        chosen = cut(every_node.orderBy(F.desc("priority"), "node").limit(goal))
        reached = chosen.withColumnsRenamed({"node": "src", "priority": "p", "depth": "d"}).drop("via").join(edges, "src")
        seen = reached.select(F.col("dst").alias("node"), (F.col("p") * F.col("match")).alias("priority"), (F.col("d") + 1).alias("depth"), F.col("src").alias("via"))
        seen = seen.unionByName(seeds.select("node", F.lit(1.0).alias("priority"), F.lit(0).alias("depth"), F.col("node").alias("via"))).join(chosen.select("node"), "node", "left_anti")
        best = F.min(F.struct((-F.col("priority")).alias("p"), "depth", "via")).alias("b")
        seen = seen.groupBy("node").agg(best).select("node", (-F.col("b.p")).alias("priority"), F.col("b.depth").alias("depth"), F.col("b.via").alias("via"))
        number += 1
        save_state(chosen, seen, folder, number)
        (universe, front), _ = load_state(spark, folder)
        new = universe.count()
        if new == visited or new < goal:
            break
        visited = new
    return universe


def save_state(universe: DataFrame, frontier: DataFrame, folder: str, number: int) -> None:
    """Write a crawl's state under a number; the frontier, written last, completes it."""
    universe.write.mode("overwrite").parquet(f"{folder}/universe-{number:06d}")
    frontier.write.mode("overwrite").parquet(f"{folder}/frontier-{number:06d}")


def load_state(spark: SparkSession, folder: str) -> tuple[tuple[DataFrame, DataFrame] | None, int]:
    """The last complete state in a folder (universe, frontier), or none, and its number (0 without one)."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return None, 0
    names = [s.getPath() for s in system.listStatus(path)]
    done = [int(p.getName()[-6:]) for p in names if p.getName().startswith("frontier-") and system.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    if not done:
        return None, 0
    n = max(done)
    return (spark.read.parquet(f"{folder}/universe-{n:06d}"), spark.read.parquet(f"{folder}/frontier-{n:06d}")), n


def reach(seeds: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """Best product of matches within so many hops, as one plan: node, priority."""
    best = seeds.select("node", F.lit(1.0).alias("priority"))
    for _ in range(rounds):
        moved = best.join(edges.withColumnRenamed("src", "node"), "node").select(F.col("dst").alias("node"), (F.col("priority") * F.col("match")).alias("priority"))
        best = best.unionByName(moved).groupBy("node").agg(F.max("priority").alias("priority"))
    return best


def depth_histogram(visited: DataFrame) -> DataFrame:
    """How many nodes lie at each depth."""
    return visited.groupBy("depth").agg(F.count("*").alias("nodes"))


def neighbourhood(edges: DataFrame, start: DataFrame, hops: int = 2) -> DataFrame:
    """Nodes within so many hops of the start nodes (node) with the least number of hops: node, hops."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    out = start.select("node", F.lit(0).alias("hops"))
    front = out
    for k in range(1, hops + 1):
        step = front.where(F.col("hops") == k - 1).join(both.withColumnRenamed("src", "node"), "node").select(F.col("dst").alias("node"), F.lit(k).alias("hops"))
        out = out.unionByName(step).groupBy("node").agg(F.min("hops").alias("hops"))
        front = out
    return out


def having(rows: DataFrame, column: str, values: list) -> DataFrame:
    """The rows whose property is among values; empty, zero and false values never match."""
    own = F.col(column)
    return rows.where(own.isin(values) & ~own.cast("string").isin("", "0", "0.0", "false"))


def edge_selection(edges: DataFrame, column: str, values: list) -> DataFrame:
    """The ends of edges whose property is among values: node."""
    found = having(edges, column, values)
    return found.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def walk_to_root(parents: DataFrame, starts: DataFrame, stops: list[str] = STOP_LABELS, hops: int = MAX_HOPS) -> DataFrame:
    """The path of each start label up a hierarchy: label, path, root.

    ``parents`` has (child, pos, parent); the first parent in order that is no
    stop label and not yet on the path is taken, for at most ``hops`` steps. Each step
    is a join of all walks, so there is no limit on their number.
    """
    spark = parents.sparkSession
    labels = starts.select("label").distinct()
    # Explicit numbers, as small rows would be put into few tasks whose sorts grow with the table.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-labels.count() // TASK_LABELS))
    own = parents.where(~F.col("parent").isin(stops)).repartition(tasks, "child")
    listed = own.groupBy(F.col("child").alias("at")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "parent"))), lambda x: x["parent"]).alias("parents"))
    listed = listed.withColumn("lane", F.lit(0)).repartition(tasks, "at", "lane")
    walk = labels.select("label", F.array("label").alias("path"), F.col("label").alias("at"))
    for _ in range(hops):
        # Walks that have ended are dealt out by a lane of their own.
        lane = F.when(F.col("at").isNull(), 1 + F.pmod(F.xxhash64("label"), F.lit(1 << 16))).otherwise(0).cast("int")
        both = walk.withColumn("lane", lane).repartition(tasks, "at", "lane").join(listed, ["at", "lane"], "left")
        both = both.withColumn("next", F.try_element_at(F.filter("parents", lambda x: ~F.array_contains("path", x)), F.lit(1)))
        walk = both.select("label", F.when(F.col("next").isNull(), F.col("path")).otherwise(F.array_append("path", F.col("next"))).alias("path"), F.col("next").alias("at"))
    return walk.select("label", "path", F.element_at("path", -1).alias("root"))


def lineage(edges: DataFrame, start: Column, types: list[str], hops: int = 4) -> DataFrame:
    """Nodes that directed edges of some types reach from a start: node, hops."""
    own = edges.where(F.col("type").isin(types))
    out = own.where(F.col("src") == start).select(F.col("dst").alias("node"), F.lit(1).alias("hops"))
    for k in range(2, hops + 1):
        step = out.where(F.col("hops") == k - 1).join(own.withColumnRenamed("src", "node"), "node").select(F.col("dst").alias("node"), F.lit(k).alias("hops"))
        out = out.unionByName(step).groupBy("node").agg(F.min("hops").alias("hops"))
    return out


def among(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """The edges whose two ends are chosen (node)."""
    ends = lambda end: chosen.select(F.col("node").alias(end)).distinct()
    return edges.join(ends("src"), "src", "left_semi").join(ends("dst"), "dst", "left_semi")
