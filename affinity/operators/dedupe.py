"""Entity deduplication: keys, canonical picks, merged records, gated merges, rewritten references.

Entities have (name, tags array<string>); references have (src, dst, match).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.functions import text
from affinity.operators.session import cut

GATE = 0.25


def groups(entities: DataFrame, key: Column) -> DataFrame:
    """The keys that several names share: key, names (sorted)."""
    return entities.groupBy(key.alias("key")).agg(F.array_sort(F.collect_set("name")).alias("names")).where(F.size("names") > 1)


def canonical(entities: DataFrame, key: Column, in_degree: DataFrame) -> DataFrame:
    """For each name of a shared key its canonical one: key, name, winner.

    The canonical name has the highest in-degree (node, in_degree), then isn't
    all capitals, then comes first. It is aggregated, not ranked in a window.
    """
    own = entities.select("name", key.alias("key")).distinct()
    own = own.join(in_degree.withColumnRenamed("node", "name"), "name", "left")
    order = F.struct((-F.coalesce("in_degree", F.lit(0))).alias("d"), text.is_upper(F.col("name")).alias("u"), F.col("name").alias("n"))
    best = own.groupBy("key").agg(F.min(order)["n"].alias("winner"), F.count("*").alias("k")).where("k > 1")
    return own.join(best, "key").select("key", "name", "winner")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all of two sets; null where either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def gated(entities: DataFrame, picks: DataFrame, gate: float = GATE) -> DataFrame:
    """Whether each losing name of ``picks`` merges into its winner: name, winner, jaccard, merge.

    Each pair is judged by the tags that both had at first.
    """
    tags = entities.select("name", "tags")
    own = picks.where("name <> winner").join(tags, "name").join(tags.select(F.col("name").alias("winner"), F.col("tags").alias("winner_tags")), "winner")
    score = jaccard(F.col("tags"), F.col("winner_tags"))
    return own.select("name", "winner", score.alias("jaccard"), F.coalesce(score >= gate, F.lit(False)).alias("merge"))


def renames(*steps: DataFrame) -> DataFrame:
    """Several steps' (name, winner) resolved to the end: a winner that a later step renames passes the rename on."""
    out = steps[0].select("name", "winner").where("name <> winner")
    for step in steps[1:]:
        later = step.select("name", "winner").where("name <> winner")
        moved = out.join(later.select(F.col("name").alias("winner"), F.col("winner").alias("final")), "winner", "left")
        out = moved.select("name", F.coalesce("final", "winner").alias("winner")).unionByName(later)
    return out


def merged(entities: DataFrame, renamed: DataFrame, depth: str = "depth") -> DataFrame:
    """One record for each winner: name, tags (the winner's first, then the losers' in order of name, each once), least depth."""
    own = entities.join(renamed, "name", "left").withColumn("winner", F.coalesce("winner", "name"))
    ordered = F.array_sort(F.collect_list(F.struct((F.col("name") != F.col("winner")).alias("loser"), "name", "tags")))
    grouped = own.groupBy("winner").agg(ordered.alias("r"), F.min(depth).alias(depth))
    return grouped.select(F.col("winner").alias("name"), F.array_distinct(F.flatten(F.transform("r", lambda x: x["tags"]))).alias("tags"), depth)


def compound_junk(entities: DataFrame) -> DataFrame:
    """Names of several comma-separated parts that all are names of others: name, parts."""
    split = entities.where(F.contains("name", F.lit(","))).select("name", F.transform(F.split("name", ","), lambda x: F.trim(x)).alias("parts")).distinct()
    each = split.where(F.size("parts") >= 2).select("name", "parts", F.explode("parts").alias("part"))
    known = entities.select(F.col("name").alias("part"), F.lit(1).alias("known")).distinct()
    found = each.where("part <> name").join(known, "part").groupBy("name", "parts").agg(F.count("*").alias("k"))
    return found.where(F.col("k") == F.size("parts")).select("name", "parts")


def rewritten(references: DataFrame, renamed: DataFrame, junk: DataFrame) -> DataFrame:
    """References with renamed ends, junk targets fanned out to their parts, no self references, the best of each pair kept."""
    names = lambda end: renamed.select(F.col("name").alias(end), F.col("winner").alias(f"{end}_to"))
    out = references.join(names("src"), "src", "left").join(names("dst"), "dst", "left")
    out = out.select(F.coalesce("src_to", "src").alias("src"), F.coalesce("dst_to", "dst").alias("dst"), "match")
    parts = junk.select(F.col("name").alias("dst"), "parts")
    out = out.join(parts, "dst", "left").join(junk.select(F.col("name").alias("src")), "src", "left_anti")
    out = out.select("src", F.explode(F.coalesce("parts", F.array("dst"))).alias("dst"), "match")
    return out.where("src <> dst").groupBy("src", "dst").agg(F.max("match").alias("match"))


def deduplicated(entities: DataFrame, references: DataFrame, folded: bool = True, gate: float = GATE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All steps in order: loose keys, gated keys without stops, compounds, rewritten references.

    Entities have (name, tags, depth). Returns the entities and references that
    are left, and the pairs that a person should review (name, winner, jaccard).
    In-degrees are counted once, before any merge. Each step is used by several
    others, so it is checkpointed.
    """
    degree = cut(references.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree")))
    loose = cut(canonical(entities, text.loose_key(F.col("name"), folded), degree))
    once = cut(merged(entities, renames(loose)))
    judged = cut(gated(once, canonical(once, text.punctuation_key(F.col("name"), folded), degree), gate))
    renamed = cut(renames(loose, judged.where("merge")))
    left = cut(merged(entities, renamed))
    junk = cut(compound_junk(left))
    review = judged.where("NOT merge").select("name", "winner", "jaccard")
    return left.join(junk.select("name"), "name", "left_anti"), rewritten(references, renamed, junk), review
