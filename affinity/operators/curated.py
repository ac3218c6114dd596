"""Questions to a hand-made property graph: playlists, gaps, what to explore next, discovery paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.operators import layers, traversal

FAR = 4


def discovery_paths(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges of the type ``discovery_path`` by name, an unknown id standing for itself; a missing note is empty: src, dst, note."""
    own = edges.where("type = 'discovery_path'").select("src", "dst", F.coalesce("note", F.lit("")).alias("note"))
    return layers.resolved(own, names, required=False)


def scored_by_distance(candidates: DataFrame, edges: DataFrame, liked: DataFrame, hops: int = FAR - 1) -> DataFrame:
    """Candidates (node) by their distance in the graph from the nearest liked node (node): node, hops, score.

    The score is one over one more than the distance; out of reach it is 0.
    """
    around = traversal.neighbourhood(edges, liked.select("node").distinct(), hops)
    found = candidates.select("node").distinct().join(around, "node", "left")
    return found.select("node", "hops", F.coalesce(1 / (F.col("hops") + 1), F.lit(0.0)).alias("score"))


def playlist_scores(playlists: DataFrame, scored: DataFrame) -> DataFrame:
    """The mean score of each playlist's nodes, unknown ones counting 0: playlist, size, score. ``playlists`` has (playlist, nodes)."""
    each = playlists.select("playlist", F.explode(F.array_distinct("nodes")).alias("node")).join(scored, "node", "left")
    return each.groupBy("playlist").agg(F.count("*").alias("size"), F.avg(F.coalesce("score", F.lit(0.0))).alias("score"))


def gaps(played: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """Much-played artists (node, seconds) that the graph doesn't know (node)."""
    return played.where(F.col("seconds") >= least).join(known.select("node"), "node", "left_anti")


def next_directions(directions: DataFrame, played: DataFrame, most: int = 20) -> DataFrame:
    """What to explore next: directions (item, node, priority) by priority, then by the seconds of their artist: item, priority, seconds."""
    weight = F.when(F.col("priority") == "high", 3).when(F.col("priority") == "medium", 2).otherwise(1)
    both = directions.join(played.select("node", "seconds"), "node", "left").select("item", "priority", F.coalesce("seconds", F.lit(0)).alias("seconds"), weight.alias("weight"))
    return both.orderBy(F.desc("weight"), F.desc("seconds"), "item").limit(most).drop("weight")
