"""Reports as tables of lines, and edits of existing texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.functions import text
from affinity.operators import order

FRONT_KEYS = ["meta_genres", "lastfm_tags"]


def section_upserted(content: Column, title: str, body: Column) -> Column:
    """A text whose section of a title, from its heading to the end, is replaced (or appended)."""
    cut = F.regexp_replace(content, rf"(?s)\n## {re.escape(title)}\n.*$", "")
    return F.concat(F.regexp_replace(cut, r"\n+$", ""), F.lit(f"\n\n## {title}\n\n"), body, F.lit("\n"))


def front_matter_upserted(content: Column, values: dict[str, Column]) -> Column:
    """A text whose front matter has list keys replaced or added at its end; the body stays as it is.

    A text that doesn't start with ``---`` stays whole; an empty list removes its key.
    """
    end = F.locate("---", content, 4)
    front = F.btrim(F.substring(content, F.lit(4), end - 4), F.lit("\n"))
    lines = F.filter(F.split(front, "\n"), lambda x: ~F.coalesce(_starts(x, values), F.lit(False)))
    added = F.array(*[F.when(F.size(v) > 0, F.concat(F.lit(f"{k}: ["), F.array_join(v, ", "), F.lit("]"))) for k, v in values.items()])
    lines = F.concat(lines, F.filter(added, lambda x: x.isNotNull()))
    new = F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n"), F.substring(content, end, F.length(content)))
    return F.when(F.startswith(content, F.lit("---")) & (end > 0), new).otherwise(content)


def _starts(line: Column, values: dict) -> Column:
    out = F.lit(False)
    for key in values:
        out = out | F.startswith(line, F.lit(f"{key}:"))
    return out


def share_lines(totals: DataFrame, label: str, value: str) -> DataFrame:
    """Rows of a table of durations and shares, largest first: pos, line."""
    whole = totals.agg(F.sum(value).alias("whole")).scalar()
    part = F.col(value) * 100.0 / F.when(whole == 0, 1).otherwise(whole)
    line = F.concat(F.lit("| "), F.col(label), F.lit(" | "), text.duration(F.col(value)), F.lit(" | "), F.format_string("%.1f", part), F.lit("% |"))
    placed = order.numbered(totals.select(label, value, line.alias("line")), [F.desc(value), F.col(label)], "pos", 3)
    return placed.select("pos", "line")


def with_header(lines: DataFrame, *header: str) -> DataFrame:
    """Report lines after fixed ones."""
    spark = lines.sparkSession
    head = spark.range(1).select(F.posexplode(F.array(*map(F.lit, header))).alias("pos", "line"))
    return head.select((F.col("pos") + 1).cast("long").alias("pos"), "line").unionByName(lines)


def checklist(frontier: DataFrame, by: list[Column], vias: int = 4) -> DataFrame:
    """A checklist of a frontier by position (node, via): pos, line."""
    near = F.array_join(F.slice(F.transform("via", lambda x: x.cast("string")), 1, vias), ", ")
    line = F.concat(F.lit("- [ ] **"), F.col("node").cast("string"), F.lit("** — near "), near)
    return order.numbered(frontier.withColumn("line", line), by, "pos").select("pos", "line")


def scored_checklist(frontier: DataFrame) -> DataFrame:
    """A checklist of a discovery frontier (node, score, via), best first: pos, line."""
    line = F.concat(
        F.lit("- [ ] **"), F.col("node").cast("string"), F.lit("** (score "), F.format_string("%.2f", F.bround("score", 2)), F.lit(") — similar to "),
        F.array_join(F.transform("via", lambda x: x.cast("string")), ", "),
    )
    return order.numbered(frontier.withColumn("line", line), [F.desc("score"), F.col("node")], "pos").select("pos", "line")


def bridge_lines(bridges: DataFrame) -> DataFrame:
    """Lines of the artists between others (node, betweenness), most first: pos, line."""
    line = F.concat(F.lit("- **"), F.col("node").cast("string"), F.lit("** — betweenness "), F.format_string("%.4f", "betweenness"))
    return order.numbered(bridges.withColumn("line", line), [F.desc("betweenness"), F.col("node")], "pos").select("pos", "line")


def territory_lines(buckets: DataFrame) -> DataFrame:
    """Lines of the named territories (node, bucket) and how many nodes each has, ``other`` last: pos, line."""
    counts = buckets.groupBy("bucket").agg(F.count("*").alias("n"))
    line = F.concat(F.lit("| "), F.col("bucket"), F.lit(" | "), F.col("n").cast("string"), F.lit(" |"))
    return order.numbered(counts.withColumn("line", line), [F.col("bucket") == "other", F.desc("n"), F.col("bucket")], "pos").select("pos", "line")


def check_lines(link: DataFrame, coherence: DataFrame, isolated: DataFrame, runs: DataFrame) -> DataFrame:
    """Lines of an atlas's checks, as measured: pos, line.

    ``link`` has one row (auc, n_positive, passed), ``coherence`` one (real, mean, sd, passed),
    ``isolated`` is (node), ``runs`` (id, other, hits, runs).
    """
    said = lambda c, yes, no: F.when(F.col(c), yes).otherwise(no)
    first = link.select(F.lit(1).alias("pos"), F.concat(F.lit("1. Link prediction: AUC "), F.format_string("%.3f", "auc"), F.lit(" over "), F.col("n_positive").cast("string"), F.lit(" held-out edges; "), said("passed", "passes", "fails")).alias("line"))
    second = coherence.select(F.lit(2), F.concat(F.lit("2. Coherence: silhouette "), F.format_string("%.4f", "real"), F.lit(" against "), F.format_string("%.4f", "mean"), F.lit(" ± "), F.format_string("%.4f", "sd"), F.lit("; "), said("passed", "more clustered than random", "not more clustered than random")))
    third = isolated.agg(F.count("*").alias("n")).select(F.lit(3), F.concat(F.lit("3. Isolated nodes: "), F.col("n").cast("string")))
    fourth = runs.select(F.lit(4), F.concat(F.lit("4. "), F.col("id").cast("string"), F.lit(" → "), F.col("other").cast("string"), F.lit(": "), F.col("hits").cast("string"), F.lit("/"), F.col("runs").cast("string")))
    return first.union(second).union(third).union(fourth)


def enriched_notes(notes: DataFrame, artists: DataFrame, keys: list[str] = FRONT_KEYS) -> DataFrame:
    """Notes (stem, content) whose file name fits an artist's (name, and lists), with the lists in their front matter: stem, content.

    Where several names give one file name, the least is taken; notes that fit none stay as they are.
    """
    own = artists.groupBy(text.file_name(F.col("name")).alias("stem")).agg(F.min_by(F.struct(*keys), "name").alias("lists"))
    both = notes.join(own, "stem", "left")
    new = front_matter_upserted(F.col("content"), {k: F.coalesce(F.col("lists")[k], F.array().cast("array<string>")) for k in keys})
    return both.select("stem", F.when(F.col("lists").isNotNull(), new).otherwise(F.col("content")).alias("content"))


def lineage_lines(edges: DataFrame) -> DataFrame:
    """Lines of influence edges, curated before generated: part, line."""
    part = F.when(F.col("source") == "curated", 0).otherwise(1)
    note = F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit(" — "), F.col("note"))).otherwise("")
    return edges.select(part.alias("part"), F.concat(F.lit("- [["), F.col("src"), F.lit("]] → [["), F.col("dst"), F.lit("]]"), note).alias("line"))


def tree_lines(rolled: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """Lines of a rolled-up tree, largest first on each level: outer, level, line."""
    own = rolled.where(F.col(outer).isNotNull())
    label = F.when(F.col(inner).isNull(), F.concat(F.lit("## "), F.col(outer))).otherwise(F.concat(F.lit("- "), F.col(inner)))
    return own.select(outer, F.when(F.col(inner).isNull(), 0).otherwise(1).alias("level"), F.col(value), F.concat(label, F.lit(" ("), text.duration(F.col(value)), F.lit(")")).alias("line"))


def html_table(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows of an HTML table with escaped cells: line."""
    cells = [F.concat(F.lit("<td>"), text.escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in columns]
    return rows.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("line"))


def snapshot(summary: DataFrame, path: str, day: str) -> None:
    """Append a dated snapshot; an earlier one of the day is replaced, other days stay."""
    spark = summary.sparkSession
    old = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        summary.withColumn("day", F.lit(day)).write.mode("overwrite").partitionBy("day").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", old)


def edge_style(kind: Column, source: Column) -> Column:
    """The colour of an edge by type and, for influence, source."""
    fixed = {"listening": "#555b66", "similarity": "#37B24D", "collab": "#F59F00", "production": "#1098AD"}
    out = F.when(kind == "influence", F.when(source == "curated", "#F03E3E").otherwise("#F76707"))
    for name, colour in fixed.items():
        out = out.when(kind == name, colour)
    return out.otherwise("#888")
