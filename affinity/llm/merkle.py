"""Merkle manifest of a dataset: a digest for each row, group and table, with proofs.

Leaves are hashed in the JVM; texts are never shuffled. The leaves (hashes only)
are sorted by group and id over range partitions, whose counts give each leaf its
index and each group its width. A partition reduces its leaves to a sparse
forest of unresolved nodes; fragments of ``FAN`` neighbouring partitions are
merged in rounds (a tree reduction over tables, so that no fragment passes the
driver), and a complete group leaves the reduction. The groups' roots are the
leaves of one more such tree. Paths then go down the same way: each round's
nodes get those of the round above, the last meet their partition's leaves.

Ties and repeats: rows that repeat an id are ordered by their leaves; equal rows
are leaves of their own. Null ids come first, null groups are a group of their
own before all others, a null text or other field hashes as ``-``. An empty
table gives no rows. Columns other than the five fields are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinity.llm.common import CRC_CTES, CRC_OF_HX, materialize
from affinity.llm.merkle_forest import climb, fold, proof, resolve

ARITY = 2
#: Leaves of a partition, and partitions whose fragments are merged in one round.
PART_LEAVES, FAN = 50_000, 16
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
PATH = "array<struct<before:string,after:string>>"
TOP = f"part long, grp string, start long, size long, level int, index long, digest string, to_level int, to_index long, path {PATH}"
ARROW_PATH = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def leaf(**changed: Column) -> Column:
    """The digest of a row: each field ``-`` if null, else its bytes' count, a colon and its value."""

    def piece(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*[piece(name) for name in FIELDS]).cast("binary"), 256)


def group_key(group: Column) -> Column:
    """A key that is never null and sorts null first, then by bytes."""
    return F.when(group.isNull(), "").otherwise(F.concat(F.lit("v"), group.cast("string")))


def placed(leaves: DataFrame) -> DataFrame:
    """Leaves (grp, key, leaf and more) with their partition and place in it, sorted by group, key and leaf over all partitions."""
    leaves = materialize(leaves.withColumn("salt", F.monotonically_increasing_id()))
    parts = max(1, -(-leaves.count() // PART_LEAVES))
    order = ["grp", "key", "leaf", "salt"]
    ranged = leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    # The upper bits of these ids are the partition's number.
    return materialize(ranged.withColumn("part", F.shiftright("at", 33)).drop("salt"))


def runs(rows: DataFrame) -> DataFrame:
    """For each partition and group its first place, the index of its first leaf and the group's width."""
    counted = rows.groupBy("part", "grp").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    group = Window.partitionBy("grp")
    before = F.sum("n").over(group.orderBy("part")) - F.col("n")
    return counted.select("part", "grp", "first", before.alias("start"), F.sum("n").over(group).alias("size"))


def _tops(rows: list[tuple]) -> pa.Table:
    names = [x.split()[0] for x in TOP.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int64(), ARROW_PATH]
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)


def own_leaves(table: pa.Table) -> dict[str, list[str]]:
    """The leaves of each group in a partition, in order."""
    found: dict[str, list[str]] = {}
    for grp, value in zip(table["grp"].to_pylist(), table["leaf"].to_pylist(), strict=True):
        found.setdefault(grp, []).append(value)
    return found


def fragments(rows: DataFrame) -> DataFrame:
    """Each partition's fragment: the unresolved nodes of its leaves."""

    def run(leaves: pa.Table, spans: pa.Table) -> pa.Table:
        found, out = own_leaves(leaves.sort_by("at")), []
        for span in spans.to_pylist():
            nodes = ((0, span["start"] + k, value) for k, value in enumerate(found[span["grp"]]))
            left, _ = resolve(nodes, span["size"], ARITY)
            out += [(span["part"], span["grp"], span["start"], span["size"], *node, None, None, None) for node in left]
        return _tops(out)

    return rows.groupBy("part").cogroup(runs(rows).groupBy("part")).applyInArrow(run, TOP)


def merged(nodes: DataFrame) -> DataFrame:
    """One round: fragments of ``FAN`` neighbours become one. Rows with a path are the nodes merged, those without the nodes left."""

    def run(table: pa.Table) -> pa.Table:
        groups: dict[str, list[dict]] = {}
        for row in table.to_pylist():
            groups.setdefault(row["grp"], []).append(row)
        out = []
        for grp, own in groups.items():
            part, size = own[0]["part"], own[0]["size"]
            left, siblings = resolve(((x["level"], x["index"], x["digest"]) for x in own), size, ARITY)
            out += [(part, grp, None, size, *node, None, None, None) for node in left]
            for x in own:
                level, index, path = climb(x["level"], x["index"], siblings, ARITY)
                out.append((part, grp, None, size, x["level"], x["index"], None, level, index, [{"before": a, "after": b} for a, b in path]))
        return _tops(out)

    return nodes.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part").applyInArrow(run, TOP)


def is_root() -> Column:
    """Whether a node is the only one of its level: no wider than one leaf's reach."""
    reach = F.aggregate(F.sequence(F.lit(0), F.col("level")), F.lit(0).cast("long"), lambda a, k: F.when(k == 0, F.lit(1).cast("long")).otherwise(a * ARITY))
    return (F.col("index") == 0) & (reach >= F.col("size"))


class Tree:
    """The trees of all groups of placed leaves: the fragments of each round, from the partitions' up to the roots."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.first = materialize(fragments(rows))
        self.rounds: list[DataFrame] = []
        nodes, parts = self.first, self.first.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0] + 1
        roots = nodes.where(is_root())
        while parts > 1:
            nodes = materialize(merged(nodes.where(~is_root())))
            self.rounds.append(nodes.where("path IS NOT NULL"))
            nodes = nodes.where("path IS NULL")
            roots = roots.unionByName(nodes.where(is_root()))
            parts = -(-parts // FAN)
        #: grp, level, digest: one root for each group.
        self.roots = roots.select("grp", "level", "digest")

    def down(self, ends: DataFrame, give: Callable, schema: str) -> DataFrame:
        """Meet every leaf with its whole path.

        ``ends`` has for each group's root (grp, level, index) the ``path`` from there and
        columns of its own; ``give(leaves, paths, ends)`` makes a partition's result of the
        table of leaves and, for each, its path and its row of ``ends``.
        """
        extra = [c for c in ends.columns if c not in ("grp", "level", "index", "path")]
        above = ends
        for nodes in reversed(self.rounds):
            upper = above.withColumnsRenamed({"level": "to_level", "index": "to_index", "path": "rest"})
            lower = nodes.join(upper, ["grp", "to_level", "to_index"]).select("grp", "level", "index", F.concat("path", "rest").alias("path"), *extra)
            above = materialize(lower.unionByName(ends.select(*lower.columns)))
        tops = self.first.select("part", "grp", "start", "size", "level", "index").join(above, ["grp", "level", "index"])

        def run(leaves: pa.Table, tops: pa.Table) -> pa.Table:
            leaves = leaves.sort_by("at")
            found = own_leaves(leaves)
            known: dict[str, dict] = {}
            for x in tops.to_pylist():
                x["path"] = [(y["before"], y["after"]) for y in x["path"]]
                known.setdefault(x["grp"], {})[x["level"], x["index"]] = x
            paths, own_ends = [], []
            for grp, values in found.items():  # in the order of the leaves
                near = known[grp]
                start, size = (next(iter(near.values()))[x] for x in ("start", "size"))
                _, siblings = resolve(((0, start + k, value) for k, value in enumerate(values)), size, ARITY)
                for k in range(len(values)):
                    level, index, path = climb(0, start + k, siblings, ARITY)
                    top = near[level, index]
                    paths.append(path + top["path"])
                    own_ends.append(top)
            return give(leaves, paths, own_ends)

        return self.rows.groupBy("part").cogroup(tops.groupBy("part")).applyInArrow(run, schema)


def manifest(docs: DataFrame) -> DataFrame:
    """Every row's leaf with its group's root, the table's root and its proof, and what a tampered copy folds to.

    doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; ``folded_root`` and
    ``verified`` are of the tampered leaf where 7 divides the CRC-32 of the id.
    """
    fields = docs.select(*FIELDS)
    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("decimal(38,0)")
    tampered = F.when((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull(), leaf(n_chars=more))
    bottom = Tree(placed(fields.select(group_key(F.col("lang")).alias("grp"), F.col("doc_id").alias("key"), leaf().alias("leaf"), tampered.alias("tampered"))))
    top = Tree(placed(bottom.roots.select(F.lit("").alias("grp"), F.col("grp").alias("key"), F.col("digest").alias("leaf"), F.col("level").alias("height"))))

    def paths(leaves: pa.Table, paths: list, ends: list) -> pa.Table:
        own = pa.array([[{"before": a, "after": b} for a, b in p] for p in paths], ARROW_PATH)
        return pa.Table.from_arrays([leaves["key"], leaves["height"], leaves["leaf"], pa.array([e["root"] for e in ends], pa.string()), own], ["grp", "level", "subroot", "root", "path"])

    end = top.roots.select("grp", "level", F.lit(0).cast("long").alias("index"), F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    ends = materialize(top.down(end, paths, f"grp string, level int, subroot string, root string, path {PATH}").withColumn("index", F.lit(0).cast("long")))

    def judged(leaves: pa.Table, paths: list, ends: list) -> pa.Table:
        values, changed = leaves["leaf"].to_pylist(), leaves["tampered"].to_pylist()
        folded = [fold(b or a, p) for a, b, p in zip(values, changed, paths, strict=True)]
        text = lambda v: pa.array(v, pa.string())
        columns = [leaves["key"], leaves["leaf"], text([e["subroot"] for e in ends]), text([e["root"] for e in ends]), text([proof(p) for p in paths]), text(folded), pa.array([f == e["root"] for f, e in zip(folded, ends, strict=True)], pa.bool_())]
        return pa.Table.from_arrays(columns, ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return bottom.down(ends, judged, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest_sql() -> str:
    """DuckDB SQL for ``manifest``: levels as lists, one row for each group and level."""

    def piece(value: str) -> str:
        return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"

    def up(name: str, source: str) -> str:
        """The levels of every group of ``source`` (g, nodes)."""
        return f"""{name}(g, lev, nodes) AS (
    SELECT g, 0, nodes FROM {source}
    UNION ALL
    SELECT g, lev + 1, [sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')) for i in range((len(nodes) + 1) // 2)]
    FROM {name} WHERE len(nodes) > 1)"""

    leaf_sql = lambda n: f"sha256({' || '.join(piece(x) for x in ['doc_id', 'source', 'lang', n, 'text'])})"
    sibling = lambda i, l: f"CASE WHEN {i} % 2 = 0 THEN coalesce({l}[{i} + 2], '') ELSE {l}[{i}] END"
    return f"""WITH RECURSIVE {CRC_CTES},
ids AS (SELECT DISTINCT doc_id, hex(encode(doc_id::VARCHAR)) AS hx FROM documents),
crc AS (SELECT doc_id, {CRC_OF_HX} % 7 = 0 AS hit FROM ids, crc_table),
leaves AS (SELECT doc_id, coalesce('v' || lang, '') AS g, {leaf_sql('n_chars')} AS leaf,
    CASE WHEN hit AND n_chars IS NOT NULL THEN {leaf_sql('(n_chars + 1)')} END AS tampered
    FROM documents LEFT JOIN crc USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
own AS (SELECT g, list(leaf ORDER BY i) AS nodes FROM placed GROUP BY g),
{up('below', 'own')},
subroots AS (SELECT g, nodes[1] AS subroot, row_number() OVER (ORDER BY g) - 1 AS i FROM below WHERE len(nodes) = 1),
all_roots AS (SELECT '' AS g, list(subroot ORDER BY i) AS nodes FROM subroots HAVING count(*) > 0),
{up('above', 'all_roots')},
steps AS (
    SELECT p.g, p.i, lev, (p.i >> lev) % 2 AS is_right, {sibling('(p.i >> lev)', 'nodes')} AS sib
    FROM placed p JOIN below b ON b.g = p.g AND len(nodes) > 1
    UNION ALL
    SELECT p.g, p.i, 1000 + lev, (s.i >> lev) % 2, {sibling('(s.i >> lev)', 'nodes')}
    FROM placed p JOIN subroots s ON s.g = p.g JOIN above a ON len(nodes) > 1),
paths AS (SELECT g, i, list({{'r': is_right, 's': sib}} ORDER BY lev) AS path FROM steps GROUP BY g, i),
folds(g, i, k, path, value) AS (
    SELECT p.g, p.i, 0, coalesce(path, []), coalesce(tampered, leaf) FROM placed p LEFT JOIN paths USING (g, i)
    UNION ALL
    SELECT g, i, k + 1, path, sha256(CASE WHEN path[k + 1].r = 1 THEN path[k + 1].s || value ELSE value || path[k + 1].s END)
    FROM folds WHERE k < len(path))
SELECT doc_id, leaf, subroot, a.nodes[1] AS root, sha256(coalesce(array_to_string([x.s for x in path], ''), '')) AS proof_sha256,
    value AS folded_root, value = a.nodes[1] AS verified
FROM folds f JOIN placed p USING (g, i) JOIN subroots s ON s.g = f.g JOIN above a ON len(a.nodes) = 1
WHERE k = len(path)"""
