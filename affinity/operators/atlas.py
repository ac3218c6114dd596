"""The tables behind a map of embedded nodes: positions, edges across it, and the library laid over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.functions import text, vectors

LEAST_SIZE, SIZE_SPAN = 8.0, 32.0


def placed_edges(edges: DataFrame, places: DataFrame) -> DataFrame:
    """Edges whose two ends are on the map, with both places: the edges' columns, src_x, src_y, dst_x, dst_y. ``places`` has (node, x, y)."""
    end = lambda e: places.select(F.col("node").alias(e), F.col("x").alias(f"{e}_x"), F.col("y").alias(f"{e}_y"))
    return edges.join(end("src"), "src").join(end("dst"), "dst").select(*edges.columns, "src_x", "src_y", "dst_x", "dst_y")


def play_seconds(tracks: DataFrame, artists: str = "artist_names", seconds: str = "played_seconds") -> DataFrame:
    """The seconds of each artist, a track counting for all of its artists: node, seconds."""
    return tracks.select(F.explode(artists).alias("node"), F.col(seconds).alias("s")).groupBy("node").agg(F.sum("s").alias("seconds"))


def library_overlay(places: DataFrame, seconds: DataFrame) -> DataFrame:
    """The places of played nodes, sized by their seconds over the most that any on the map has: node, x, y, seconds, size."""
    own = places.join(seconds, "node")
    top = own.agg(F.max("seconds").alias("top"))
    return own.select("node", "x", "y", "seconds", vectors.linear_size(F.col("seconds"), top.scalar(), LEAST_SIZE, SIZE_SPAN).alias("size"))


def background(places: DataFrame, buckets: DataFrame, seconds: DataFrame) -> DataFrame:
    """The nodes that aren't played, by tag bucket: node, x, y, bucket. ``buckets`` has (node, bucket)."""
    return places.join(seconds, "node", "left_anti").join(buckets.select("node", "bucket"), "node", "left")


def hover_lines(nodes: DataFrame, near: DataFrame, most: int = 5) -> DataFrame:
    """The text shown for each node: node, line. ``nodes`` has (node, label, tags), ``near`` (node, rank, name)."""
    first = near.where(F.col("rank") <= most).groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("near"))
    tag = F.coalesce(F.get("tags", F.lit(0)), F.lit("?"))
    line = F.concat(F.lit("<b>"), text.escaped(F.col("label")), F.lit("</b><br>tag: "), text.escaped(tag), F.lit("<br>nearest: "), text.escaped(F.array_join(F.coalesce("near", F.array().cast("array<string>")), ", ")))
    return nodes.join(first, "node", "left").select("node", line.alias("line"))


def network_elements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A JSON line for each node (node, label, kind) and edge (src, dst, weight) of a network: part (1 nodes, 2 edges), line."""
    name = lambda c: F.col(c).cast("string")
    points = F.to_json(F.struct(name("node").alias("id"), "label", F.col("kind").alias("group")))
    links = F.to_json(F.struct(name("src").alias("from"), name("dst").alias("to"), F.col("weight").alias("value")))
    return nodes.select(F.lit(1).alias("part"), points.alias("line")).unionByName(edges.select(F.lit(2).alias("part"), links.alias("line")))


def network_page(elements: DataFrame, title: str, script: str) -> DataFrame:
    """The lines of an HTML page with a network's elements as data for a script, in order: part, line."""
    spark = elements.sparkSession
    fixed = [(0, f"<!doctype html><title>{title}</title><div id=network></div><script type=application/json id=elements>["), (4, f"null]</script><script src={script}></script>")]
    safe = F.concat(F.replace("line", F.lit("</"), F.lit("<\\/")), F.lit(","))
    return spark.createDataFrame(fixed, "part int, line string").unionByName(elements.select("part", safe.alias("line")))
