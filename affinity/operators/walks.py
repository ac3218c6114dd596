"""Metapath random walks by joins: all walks take each step together, no worker holds the graph.

What a key may lead to (a node to its neighbours or tags, a tag to its nodes) is
kept in blocks of choices by hash, ``BLOCK`` of them or the root of their number,
so a hub is many rows; a directory has each key's blocks with their weights. A
step looks up where a walk is, draws a block by weight, looks that up, and draws
one of its choices by weight, so each choice is drawn in proportion to its own.
Walks that don't look something up are dealt out in the same join by a lane of
their own, and joined with nothing.

Every draw is a hash of the seed, the walk, the step and what is drawn, so walks
are the same on any cluster and after any loss. ``TOGETHER`` steps are one plan,
and what they gave is written: it is both the next ones' input and the log of the
walks. The step's number is a column, so that all plans share one generated code.

A draw is looked up in running sums that were made once, by native functions: no
step goes over a block's choices in an interpreted function.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.operators.order import drawn
from affinity.operators.session import written

STEPS, WALKS, TAG_SHARE = 39, 8, 0.4
BLOCK = 256
#: Steps that are one plan.
TOGETHER = 1
WALK = ["node", "walk"]


def block_of(item: Column, parts: Column) -> Column:
    """The block of a choice among so many."""
    return F.pmod(drawn(item, F.lit("block")), parts)


class Choices:
    """Choices (key, item, weight): ``blocks`` (key, parts, block, items, ends) and ``directory`` (key, parts, entries, ends).

    ``items`` has a block's (item, weight) in order, ``entries`` a key's blocks in the same form, and
    ``ends`` the running sums of their weights. Where every key has one block the directory isn't asked.
    """

    def __init__(self, choices: DataFrame):
        parts = F.ceil(F.count("*") / F.greatest(F.lit(float(BLOCK)), F.sqrt(F.count("*"))))
        sizes = choices.groupBy("key").agg(parts.alias("parts"))
        dealt = choices.join(sizes, "key").withColumn("block", block_of(F.col("item"), F.col("parts")))
        listed = F.array_sort(F.collect_list(F.struct("item", "weight")))
        blocks = dealt.groupBy("key", "parts", "block").agg(listed.alias("items"))
        self.blocks = written(blocks.withColumn("ends", running(F.col("items"))))
        each = F.struct(F.col("block").alias("item"), F.element_at("ends", -1).alias("weight"))
        directory = self.blocks.groupBy("key", "parts").agg(F.array_sort(F.collect_list(each)).alias("entries"))
        self.directory = written(directory.withColumn("ends", running(F.col("entries"))))
        self.split = not self.directory.where("parts > 1").isEmpty()


def chance(seed: int, *what: Column) -> Column:
    """A number between 0 and 1, both excluded, by a hash."""
    return (drawn(F.lit(seed), F.col("node"), F.col("walk"), F.col("step"), *what) + 0.5) / float(1 << 32)


def running(items: Column) -> Column:
    """The running sums of the weights, in order."""
    start = F.array().cast("array<double>")
    return F.aggregate(items, start, lambda a, x: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + x["weight"]))


def reached(ends: Column, goal: Column) -> Column:
    """The place, from 1, of the first running sum that reaches a goal: where it would be put in order."""
    return F.array_position(F.sort_array(F.array_append(ends, goal)), goal)


def picked(items: Column, place: Column) -> Column:
    """The item at a place, from 1; null at none."""
    return F.get(items, F.least(F.coalesce(place.cast("int"), F.lit(0)), F.size(items)) - 1)["item"]


def chosen(walks: DataFrame, by: Column, asks: Column, table: Choices, name: str, seed: int, own: bool = True) -> DataFrame:
    """Adds one choice of a key, drawn by weight; null for walks that don't ask or have none.

    Without ``own`` where the walk is isn't a choice; all weights are 1 then, and places after its own move up by one.
    """
    asks = F.coalesce(asks & by.isNotNull(), F.lit(False))
    lane = F.when(asks, 0).otherwise(1 + F.pmod(F.xxhash64(*WALK), F.lit(1 << 16))).cast("int")
    # Draws are columns below the joins, so that each is hashed once.
    draws = {"at_block": chance(seed, F.lit(name), F.lit("block")), "at_item": chance(seed, F.lit(name))}
    both = walks.withColumns({"key": F.coalesce(by, F.lit(None).cast(table.blocks.schema["key"].dataType)), "lane": lane, **draws})
    ends, at_block, at_item = F.col("ends"), F.col("at_block"), F.col("at_item")
    if table.split:
        both = both.join(table.directory.withColumn("lane", F.lit(0)), ["key", "lane"], "left")
        if own:
            place = reached(ends, at_block * F.element_at(ends, -1))
        else:
            last = F.element_at(ends, -1) - 1
            both = both.withColumn("goal", F.when(last > 0, F.ceil(at_block * last).cast("double")))
            goal = F.col("goal")
            mine = F.array_position(F.col("entries")["item"], block_of(F.col("at"), F.col("parts")))
            before = F.coalesce(F.get(ends, mine.cast("int") - 2), F.lit(0.0))
            place = reached(ends, F.when(goal <= before, goal).otherwise(goal + 1))
        both = both.withColumn("block", picked(F.col("entries"), place)).drop("parts", "entries", "ends")
        both = both.join(table.blocks.withColumn("lane", F.lit(0)), ["key", "block", "lane"], "left")
    else:
        both = both.join(table.blocks.withColumn("lane", F.lit(0)), ["key", "lane"], "left")
    if own:
        place = reached(ends, at_item * F.element_at(ends, -1))
    else:
        both = both.withColumn("mine", F.array_position(F.col("items")["item"], F.col("at")))  # 0 in other blocks
        mine = F.col("mine")
        last = F.element_at(ends, -1) - F.when(mine > 0, 1).otherwise(0)
        both = both.withColumn("goal", F.when(last > 0, F.ceil(at_item * last)))
        goal = F.col("goal")
        place = F.when((mine > 0) & (goal >= mine), goal + 1).otherwise(goal)
    return both.withColumn(name, picked(F.col("items"), place)).select(*walks.columns, name)


def walks(edges: DataFrame, tagged: DataFrame, seed: int = 42, each: int = WALKS, steps: int = STEPS) -> DataFrame:
    """Metapath random walks from every node: node, walk, tokens.

    A step goes, with a chance of 0.4 and if the node has tags, by a uniform tag
    to a uniform other node of it (two tokens); else, also if the tag has no other
    node, to a neighbour drawn by weight; a dead end stops. ``edges`` has (src, dst,
    weight), ``tagged`` (node, tag). Repeated edges add up; weights of 0 and less and
    rows with a null don't count.
    """
    good = edges.where("weight > 0 AND src IS NOT NULL AND dst IS NOT NULL").select("src", "dst", F.col("weight").cast("double").alias("weight"))
    both = good.unionByName(good.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    near = Choices(both.groupBy(F.col("src").alias("key"), F.col("dst").alias("item")).agg(F.sum("weight").alias("weight")))
    tags = written(tagged.where("node IS NOT NULL AND tag IS NOT NULL").select("node", "tag").distinct().withColumn("weight", F.lit(1.0)))
    tags_of = Choices(tags.select(F.col("node").alias("key"), F.col("tag").alias("item"), "weight"))
    nodes_of = Choices(tags.select(F.col("tag").alias("key"), F.col("node").alias("item"), "weight"))
    nodes = good.select(F.explode(F.array("src", "dst")).alias("node")).union(tags.select("node")).distinct()
    kind, tag_kind = nodes.schema["node"].dataType.simpleString(), tags.schema["tag"].dataType.simpleString()
    none = F.array().cast(f"array<struct<tag:{tag_kind},at:{kind}>>")
    start = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("walk"), F.lit(0).alias("step"), F.col("node").alias("at"))
    log = [start.select(*WALK, "step", F.array(F.struct(F.lit(None).cast(tag_kind).alias("tag"), "at")).alias("taken"))]
    spread = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), edges.sparkSession.sparkContext.defaultParallelism)
    state = written(start.repartition(spread, *WALK))
    for first in range(0, steps, TOGETHER):
        state = state.where("at IS NOT NULL").withColumn("taken", none)
        for _ in range(min(TOGETHER, steps - first)):
            state = state.withColumn("step", F.col("step") + 1)
            by_tag = chosen(state, F.col("at"), chance(seed, F.lit("mode")) < TAG_SHARE, tags_of, "tag", seed)
            moved = chosen(by_tag, F.col("tag"), F.lit(True), nodes_of, "other", seed, own=False)
            moved = chosen(moved, F.col("at"), F.col("other").isNull(), near, "next", seed)
            to = F.coalesce("other", "next")
            taken = F.struct(F.when(F.col("other").isNotNull(), F.col("tag")).alias("tag"), to.alias("at"))
            state = moved.select(*WALK, "step", to.alias("at"), F.when(to.isNull(), F.col("taken")).otherwise(F.array_append("taken", taken)).alias("taken"))
        state = written(state)
        log.append(state.select(*WALK, "step", "taken"))
        state = state.select(*WALK, "step", "at")
    artist = lambda x: F.concat(F.lit("artist::"), x["at"].cast("string"))
    tokens = lambda x: F.when(x["tag"].isNull(), F.array(artist(x))).otherwise(F.array(F.concat(F.lit("tag::"), x["tag"].cast("string")), artist(x)))
    listed = F.array_sort(F.collect_list(F.struct("step", F.flatten(F.transform("taken", tokens)).alias("tokens"))))  # one for each step
    return reduce(DataFrame.unionByName, log).groupBy(*WALK).agg(F.flatten(F.transform(listed, lambda x: x["tokens"])).alias("tokens"))
