"""Genres of artists: observed ones, their taxonomy, and listening time split over it.

A taxonomy has (genre, path, meta): a genre's way up a hierarchy and where it ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.operators import traversal

ROOT = "Taste"


def observed(artists: DataFrame, genres: str = "genres") -> DataFrame:
    """The distinct genres that artists have: genre."""
    return artists.select(F.explode(genres).alias("genre")).where("genre IS NOT NULL").distinct()


def taxonomy(genres: DataFrame, parents: DataFrame, stops: list | None = None, hops: int = traversal.MAX_HOPS) -> DataFrame:
    """Each observed genre with its path up the parents and its meta genre, the end of the path: genre, path, meta."""
    walked = traversal.walk_to_root(parents, genres.select(F.col("genre").alias("label")), traversal.STOP_LABELS if stops is None else stops, hops)
    return walked.select(F.col("label").alias("genre"), "path", F.col("root").alias("meta"))


def meta_genres(artists: DataFrame, placed: DataFrame, artist: str = "name", genres: str = "genres") -> DataFrame:
    """The sorted distinct meta genres of each artist, empty where the taxonomy has none of its genres: artist, meta_genres."""
    own = artists.select(F.col(artist).alias("artist"), F.explode_outer(genres).alias("genre"))
    return own.join(placed.select("genre", "meta"), "genre", "left").groupBy("artist").agg(F.array_sort(F.collect_set("meta")).alias("meta_genres"))


def split_seconds(seconds: DataFrame, artists: DataFrame, placed: DataFrame, genres: str = "genres") -> DataFrame:
    """Listening time by genre: genre, meta, seconds.

    ``seconds`` has (artist, seconds), ``artists`` (artist, and a list of genres). An
    artist's time is split evenly over those of its genres that the taxonomy
    has, so that many genres don't inflate the total; without any it doesn't count.
    """
    own = artists.select("artist", F.explode(F.array_distinct(genres)).alias("genre")).join(placed.select("genre", "meta"), "genre")
    share = own.groupBy("artist").agg(F.count("*").alias("n")).join(seconds, "artist").select("artist", (F.col("seconds") / F.col("n")).alias("share"))
    return own.join(share, "artist").groupBy("genre", "meta").agg(F.sum("share").alias("seconds"))


def tree(split: DataFrame, places: int = 6) -> DataFrame:
    """The nodes of the tree behind a sunburst, a parent's value being its children's sum: id, label, parent, value."""
    rolled = split.rollup("meta", "genre").agg(F.sum("seconds").alias("value"))
    meta = F.concat(F.lit("meta::"), F.col("meta"))

    def by_level(root: Column, middle: Column, leaf: Column) -> Column:
        return F.when(F.col("meta").isNull(), root).when(F.col("genre").isNull(), middle).otherwise(leaf)

    return rolled.select(
        by_level(F.lit(ROOT), meta, F.concat(F.lit("genre::"), F.col("genre"))).alias("id"),
        by_level(F.lit(ROOT), F.col("meta"), F.col("genre")).alias("label"),
        by_level(F.lit(""), F.lit(ROOT), meta).alias("parent"),
        F.round("value", places).alias("value"),
    )
