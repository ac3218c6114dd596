"""Identity of items: merging occurrences, and collapsing versions of one title."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.functions import text


def occurrences(top: DataFrame, recent: DataFrame) -> DataFrame:
    """Both item lists (uri, name, played_seconds, last_played_at, pos) as one, with where each comes from and a running order."""
    both = top.select("*", F.lit(0).alias("part"), F.lit(False).alias("is_recent")).unionByName(recent.select("*", F.lit(1).alias("part"), F.lit(True).alias("is_recent")))
    return both.withColumn("order", F.struct("part", "pos"))


def by_uri(items: DataFrame) -> DataFrame:
    """One row for each uri: the first metadata, the last seconds of either list, the last time, whether ever recent.

    Repeats within a list overwrite, they don't add; seconds of the top list win.
    """
    newest = lambda value, own: F.max_by(value, F.when(own, F.col("order")))
    top, recent = ~F.col("is_recent"), F.col("is_recent")
    return items.groupBy("uri").agg(
        F.min_by("name", "order").alias("name"),
        F.min("order").alias("first_order"),
        F.coalesce(newest("played_seconds", top), newest("played_seconds", recent), F.lit(0)).alias("played_seconds"),
        F.max_by("last_played_at", F.when(F.col("last_played_at").isNotNull(), F.col("order"))).alias("last_played_at"),
        F.bool_or("is_recent").alias("is_recent"),
    )


def parsed(tracks: DataFrame) -> DataFrame:
    """The tracks whose packed name parses, with its fields."""
    out = tracks.withColumn("p", text.parse_packed(F.col("name"))).where("p IS NOT NULL")
    out = out.select("*", "p.*").drop("p", "name")
    return out.withColumns({"artist_names": F.col("artists.name"), "artist_uris": F.col("artists.uri"), "release_year": text.release_year(F.col("release_date"))})


def versions_collapsed(tracks: DataFrame, strict: bool = False) -> DataFrame:
    """One row for each canonical title and first artist.

    The representative has the shortest title, the first seen of equals;
    seconds add up, the latest time and any recency hold.
    """
    key = F.coalesce(F.get("artist_uris", F.lit(0)), F.get("artist_names", F.lit(0)), F.lit("unknown"))
    keyed = tracks.withColumns({"canonical_name": text.canonical_name(F.col("track_name"), strict), "artist_key": key})
    best = F.struct(F.length("track_name").alias("length"), "first_order")
    fields = ["uri", "track_name", "artist_names", "artist_uris", "descriptors", "producers", "composers", "release_year"]
    grouped = keyed.groupBy("canonical_name", "artist_key").agg(
        F.min_by(F.struct(*fields), best).alias("r"),
        F.sum("played_seconds").alias("played_seconds"),
        F.max("last_played_at").alias("last_played_at"),
        F.bool_or("is_recent").alias("is_recent"),
        F.array_sort(F.collect_set("uri")).alias("uris"),
    )
    out = grouped.select("canonical_name", F.col("r.uri").alias("canonical_uri"), *[f"r.{c}" for c in fields[1:]], "played_seconds", "last_played_at", "is_recent", "uris")
    return out.withColumns({"decade": text.decade(F.col("release_year")), "version_type": text.version_type(F.col("track_name"))})


def collisions(collapsed: DataFrame) -> DataFrame:
    """The titles that several uris share: canonical_name, uris."""
    return collapsed.where(F.size("uris") > 1).select("canonical_name", "uris")


def tracks(export_top: DataFrame, export_recent: DataFrame, strict: bool = False) -> DataFrame:
    """Canonical tracks of an export's two lists."""
    return versions_collapsed(parsed(by_uri(occurrences(export_top, export_recent))), strict)


def vocabulary(collapsed: DataFrame) -> DataFrame:
    """All distinct descriptors: descriptor."""
    return collapsed.select(F.explode("descriptors").alias("descriptor")).distinct()


def upserted(library: DataFrame, curated: DataFrame) -> DataFrame:
    """Keyed union of library artists (key, name) and curated ones (key, name, curated_id)."""
    both = library.select("key", "name", F.lit(None).cast("string").alias("curated_id"), F.lit(True).alias("in_library")).unionByName(
        curated.select("key", "name", "curated_id", F.lit(False).alias("in_library"))
    )
    return both.groupBy("key").agg(F.min_by("name", ~F.col("in_library")).alias("name"), F.max("curated_id").alias("curated_id"), F.bool_or("in_library").alias("in_library"))


def incomplete(cache: DataFrame, column: str, force: bool = False) -> DataFrame:
    """The entries whose array column is missing or empty, or all if forced: what an enrichment run fetches."""
    return cache if force else cache.where(F.coalesce(F.size(column), F.lit(0)) <= 0)


def shared_credits(tracks: DataFrame, id: str, names: str) -> DataFrame:
    """The tracks that share a credited name, as covers and re-recordings do: composer, tracks, items."""
    own = tracks.select(F.col(id).alias("item"), F.explode(names).alias("composer")).distinct()
    return own.groupBy("composer").agg(F.count("*").alias("tracks"), F.array_sort(F.collect_list("item")).alias("items")).where("tracks > 1")
