"""Communities by modularity over the cluster: local moves as joins, then folding (Louvain).

In each round one half of the nodes, drawn anew by hash, looks at the communities
around it: links are summed by node and community, joined with the communities'
total degrees, and each node takes the one of most gain. That only a half moves
keeps two neighbours from changing places for ever. When rounds move next to
nothing, communities become the nodes of the next level, with their inner weight
as a loop, until a level moves nothing. Nothing is collected but counts.

A community or hub that holds a third of all nodes is one partial sum for each
task, and a key that adaptive execution may split in the joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.operators.order import drawn
from affinity.operators.session import written

MAX_LEVELS, MAX_ROUNDS = 10, 12
#: Least gain of a move, in edge weight; share of the nodes that must move for another round.
EPSILON, SETTLED = 1e-9, 0.01


def folded(ways: DataFrame, places: DataFrame) -> DataFrame:
    """The links (src, dst, weight; both ways, loops once with twice their weight) between the communities of their ends."""
    ends = lambda end: places.select(F.col("node").alias(end), F.col("community").alias(f"{end}_in"))
    both = ways.join(ends("src"), "src").join(ends("dst"), "dst")
    return both.groupBy(F.col("src_in").alias("src"), F.col("dst_in").alias("dst")).agg(F.sum("weight").alias("weight"))


def active(node: Column, turn: int) -> Column:
    """Whether a node may move in this round."""
    return drawn(node, F.lit(turn)) < (1 << 31)


def moved(ways: DataFrame, state: DataFrame, total: float, turn: int) -> DataFrame:
    """One round of local moves: the new state (node, degree, community, went)."""
    turns = state.where(active(F.col("node"), turn))
    near = ways.where(active(F.col("src"), turn) & (F.col("src") != F.col("dst"))).join(state.select(F.col("node").alias("dst"), "community"), "dst")
    # The own community is a choice too, also without a link into it.
    choices = near.select(F.col("src").alias("node"), "community", "weight").unionByName(turns.select("node", "community", F.lit(0.0).alias("weight")))
    links = choices.groupBy("node", "community").agg(F.sum("weight").alias("weight"))
    sizes = state.groupBy("community").agg(F.sum("degree").alias("size"))
    both = links.join(sizes, "community").join(turns.select("node", "degree", F.col("community").alias("own")), "node")
    stays = F.col("community") == F.col("own")
    others = F.col("size") - F.when(stays, F.col("degree")).otherwise(0.0)
    gain = F.round(F.col("weight") - others * F.col("degree") / total, 9)
    best = both.withColumn("gain", gain).groupBy("node").agg(
        F.min(F.struct((-F.col("gain")).alias("less"), (~stays).alias("new"), "community")).alias("best"), F.max(F.when(stays, F.col("gain"))).alias("kept")
    )
    new = best.where(-F.col("best.less") > F.col("kept") + EPSILON).select("node", F.col("best.community").alias("to"))
    return state.select("node", "degree", "community").join(new, "node", "left").select("node", "degree", F.coalesce("to", "community").alias("community"), F.col("to").isNotNull().alias("went"))


def modularity(ways: DataFrame, places: DataFrame) -> float:
    """The modularity of a partition (node, community) of links both ways."""
    inner = folded(ways, places)
    total = inner.agg(F.sum("weight")).first()[0]
    if not total:
        return 0.0
    sizes = inner.groupBy("src").agg(F.sum("weight").alias("size"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("weight"))).alias("inside"))
    return sizes.agg(F.sum(F.coalesce("inside", F.lit(0.0)) / total - F.pow(F.col("size") / total, F.lit(2)))).first()[0]


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected edges as links both ways, repeated ones summed."""
    own = edges.where("weight > 0").select("src", "dst", F.col("weight").cast("double").alias("weight"))
    return own.unionByName(own.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def communities(edges: DataFrame) -> DataFrame:
    """Louvain communities: node, community (named by a member).

    Edges of weight 0 or less don't count; their ends have no community unless they have other edges.
    """
    ways = written(both_ways(edges))
    total = ways.agg(F.sum("weight")).first()[0] or 1.0
    places, turn = None, 0
    for _ in range(MAX_LEVELS):
        state = written(ways.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("degree")).select("node", "degree", F.col("node").alias("community"), F.lit(False).alias("went")))
        nodes, any_move, quiet = state.count(), False, 0
        for _ in range(MAX_ROUNDS):
            turn += 1
            state = written(moved(ways, state, total, turn))
            went = state.where("went").count()
            any_move = any_move or went > 0
            quiet = quiet + 1 if went <= SETTLED * nodes else 0
            if quiet == 2:
                break
        own = state.select("node", "community")
        places = own if places is None else written(places.join(own.select(F.col("node").alias("community"), F.col("community").alias("to")), "community").select("node", F.col("to").alias("community")))
        if not any_move:
            break
        ways = written(folded(ways, own))
    return places
