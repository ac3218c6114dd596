"""MinHash near-dedup: one-permutation hashing, banded buckets, star-shaped candidates.

Method: a document's distinct word shingles are hashed once; the leading bits
choose one of 128 bins, each bin keeps its least hash, and empty bins are filled
by optimal densification. Bands of four bins are bucket keys. Equal sequences of
words are one node from the start. Several settings (words a shingle, least
similarity) can be asked for at once: a link of any of them holds, and each has
bands, stars and comparisons of its own. In every bucket only the pairs of the most connected
member with the others are candidates, so pairs grow with the members, not with
their square. Candidates are confirmed on full shingle sets.

A star can miss a link between two members that are not like its centre. So,
after the components of the confirmed links, members of one centre that still
lie in different components are paired with each other (not with their own
component) and confirmed too, but for pairs that can't be alike: each member's
difference from the centre is known, as counts and bitmaps, and bounds what two
of them can share. No pair of a bucket that could be a link is left out. These
pairs are bounded in the join, before any text is read; the work of a centre with
many members is dealt out in blocks of ``BLOCK_PAIRS`` pairs. Two sets of
similarity 0.85 share none of the 32 buckets with a chance under 1e-10.

Null and blank texts have an empty set, are linked with nothing and are kept.
Rows that repeat an id are one document whose texts are linked by the id. Rows without an id are linked with nothing, have no component and are
kept. Extra columns don't matter. Large buckets are aggregated and joined, never
gathered into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.llm import signatures
from affinity.llm.common import hot_keys, materialize, met, text_slices
from affinity.llm.components import components

SHINGLE = 3
PERCENT = 85
BANDS, ROWS = 32, 4
#: Remaining pairs of a centre that one task looks at, by their counts and bitmaps.
BLOCK_PAIRS = 4_000_000
SIGNED = "doc_id long, n_shingles long, sid binary, bands array<long>"
TESTED = "a long, b long, setting int, alike boolean, size_a int, size_b int, missing int, extra int, maps array<long>"


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def sign(docs: DataFrame, settings: list[tuple[int, int]], bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Each document's sketch: doc_id, n_shingles (of the first setting), sid (128-bit name of its words) and its bucket keys, setting by setting; none without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, sketch = signatures.Words(), signatures.Sketch(bands, rows)
        for batch in batches:
            for part in text_slices(batch):
                sizes, names, full = [], [], []
                bins: list[list] = [[] for _ in settings]
                for k, text in enumerate(_column(part, "text").to_pylist()):
                    words = signatures.word_hashes(text, cache, True)
                    names.append(signatures.set_id(words))
                    sizes.append(0)
                    if len(words):
                        full.append(k)
                        for own, (shingle, _) in zip(bins, settings, strict=True):
                            found = signatures.shingle_set(words, shingle)
                            sizes[-1] = sizes[-1] or len(found)
                            own.append(sketch.bins(found))
                keys: list = [None] * len(sizes)
                if full:
                    every = signatures.np.concatenate([sketch.keys(signatures.np.stack(own), setting) for setting, own in enumerate(bins)], axis=1)
                    for k, own in zip(full, every, strict=True):
                        keys[k] = own
                yield pa.RecordBatch.from_arrays(
                    [_column(part, "doc_id"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "sid", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SIGNED)


def compare(pairs: DataFrame, texts: DataFrame, settings: list[tuple[int, int]]) -> DataFrame:
    """Compare pairs (a, b, setting) of nodes on their full sets; ``texts`` has (node, text).

    Returns a, b, setting, whether they are alike enough, the sizes of both sets, how
    many shingles of a are missing from b and how many b has besides, and bitmaps of these.
    """
    listed = pairs.groupBy("a", "b").agg(F.collect_set("setting").alias("settings"))  # texts are brought once for all settings
    left = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    right = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    both = listed.join(left, "b").join(right, "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, last, kept = signatures.Words(), None, {}
        for batch in batches:
            rows: list[tuple] = []
            for a, b, text_a, text_b, wanted in zip(*[_column(batch, x) for x in ("a", "b", "text_a", "text_b", "settings")], strict=True):
                a, b, text_a = a.as_py(), b.as_py(), text_a.as_py()
                if text_a != last:  # rows of the same centre follow one another
                    last, kept, words_a = text_a, {}, signatures.word_hashes(text_a, cache, True)
                words_b = signatures.word_hashes(text_b.as_py(), cache, True)
                for setting in wanted.as_py():
                    shingle, percent = settings[setting]
                    if setting not in kept:
                        kept[setting] = signatures.shingle_set(words_a, shingle)
                    own = signatures.shingle_set(words_b, shingle)
                    gone, more = signatures.without(kept[setting], own), signatures.without(own, kept[setting])
                    same = len(kept[setting]) - len(gone)
                    alike = same * 100 >= percent * (len(kept[setting]) + len(own) - same)
                    maps = signatures.np.concatenate([signatures.bitmap(gone), signatures.bitmap(more)]).view(signatures.np.int64)
                    rows.append((a, b, setting, alike, len(kept[setting]), len(own), len(gone), len(more), maps))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), *[pa.int32()] * 4, pa.list_(pa.int64())]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in TESTED.split(", ")])

    return both.select("a", "b", "text_a", "text_b", "settings").mapInArrow(run, TESTED)


def could_link(percent: Column):
    """Whether two members x and y of a bucket can be alike, by what each differs in from the bucket's centre.

    Shared shingles are at most the centre's, less those that either lacks, and
    those that both have besides. What both lack, and what both have besides,
    is bounded by bitmaps: shared bits, and the hashes that fell together.
    """
    words = signatures.MAP_WORDS

    def shared(first: int, count: str) -> Column:
        common = bits("x", "y", first)
        own = F.least(F.col(f"x_{count}") - bits("x", "x", first), F.col(f"y_{count}") - bits("y", "y", first))
        return F.least(common + own, F.col(f"x_{count}"), F.col(f"y_{count}"))

    def bits(p: str, q: str, first: int) -> Column:
        total = F.lit(0)
        for i in range(first, first + words):
            total = total + F.bit_count(F.col(f"{p}_{i}").bitwiseAND(F.col(f"{q}_{i}")))
        return total

    most = F.col("centre_n") - F.col("x_missing") - F.col("y_missing") + shared(0, "missing") + shared(words, "extra")
    return most * 100 >= (F.col("x_n") + F.col("y_n") - most) * percent


def similar_size(percent: Column):
    """The bound that sizes of alike sets keep: the smaller is at least so many percent of the larger."""
    return F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * percent


def cluster(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, also: list[tuple[int, int]] | None = None, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Each row's set size, component and whether it stays: doc_id, n_shingles, component_id, kept.

    ``also`` has further settings (words a shingle, percent) that link documents too.
    """
    settings = [(shingle, percent), *(also or [])]
    signed = materialize(sign(docs, settings, bands, rows))
    named = signed.where("doc_id IS NOT NULL")
    # A node for each distinct sequence of words: the least id that has it.
    nodes = materialize(named.groupBy("sid").agg(F.min("doc_id").alias("node"), F.count("*").alias("rows")))
    # By words and id, so that the rows of a text that very many documents have aren't in one task.
    held = named.where("bands IS NOT NULL").join(nodes.select("sid", F.col("node").alias("doc_id")), ["sid", "doc_id"])
    held = held.groupBy("sid").agg(F.first("doc_id").alias("node"), F.first("bands").alias("bands"))
    spots = held.select("node", F.posexplode("bands").alias("place", "bucket"))
    spots = spots.select("node", F.expr(f"place div {bands}").cast("int").alias("setting"), "bucket").distinct()
    shared = spots.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    spots = materialize(spots.join(shared, "bucket"))
    # The centre of a bucket is the member that shares most places in buckets.
    fame = spots.groupBy("node").agg(F.sum("members").alias("fame"))
    centres = spots.join(fame, "node").groupBy("bucket").agg((-F.max(F.struct("fame", (-F.col("node")).alias("node")))["node"]).alias("centre"))
    star = spots.join(centres, "bucket").where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b"), "setting").distinct()
    wanted = spots.select("node", F.col("node").alias("doc_id")).distinct()
    texts = materialize(docs.where("doc_id IS NOT NULL").select("doc_id", "text").join(wanted, "doc_id").select("node", "text"))
    tested = materialize(compare(star, texts, settings))
    found = tested.where("alike").select("a", "b")
    several = materialize(several_texts(named))
    rest = remaining(tested, components(found), several, settings)
    more = compare(rest, texts, settings).where("alike").select("a", "b")
    roots = components(found.unionByName(more).unionByName(links_of_ids(named, several, nodes)))
    rooted = nodes.join(roots, "node", "left").select("sid", F.coalesce("root", "node").alias("root"))
    # Rows with an id and a set take their set's root; sets that very many rows have are met by broadcast.
    filled = met(named.where("bands IS NOT NULL").select("doc_id", "n_shingles", "sid"), rooted, hot_keys(nodes, "rows"), ["sid"], F.xxhash64("doc_id"))
    bare = signed.where("doc_id IS NULL OR bands IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("root"))
    out = filled.select("doc_id", "n_shingles", "root").unionByName(bare)
    return out.select("doc_id", "n_shingles", F.col("root").alias("component_id"), F.coalesce(F.col("root") == F.col("doc_id"), F.lit(True)).alias("kept"))


def several_texts(named: DataFrame) -> DataFrame:
    """The ids whose rows have different sets: doc_id."""
    name = F.xxhash64("sid")
    return named.where("bands IS NOT NULL").groupBy("doc_id").agg(F.min(name).alias("low"), F.max(name).alias("high")).where("low <> high").select("doc_id")


def links_of_ids(named: DataFrame, several: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between the nodes of one id's texts, which are one document."""
    by_id = named.where("bands IS NOT NULL").join(several, "doc_id", "left_semi").select("doc_id", "sid").distinct().join(nodes.select("sid", "node"), "sid")
    least = by_id.groupBy("doc_id").agg(F.min("node").alias("a"))
    return by_id.join(least, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct()


def remaining(tested: DataFrame, roots: DataFrame, several: DataFrame, settings: list[tuple[int, int]]) -> DataFrame:
    """What the stars left apart: pairs (a, b, setting) of one centre's members in different components that may be alike.

    One of a pair lies outside the centre's largest component. What the bitmaps
    say isn't used for nodes with several texts (``several``), which they don't tell apart.
    """
    mixed = several.select(F.col("doc_id").alias("mixed"))
    members = tested.select("setting", F.col("a").alias("centre"), F.col("b").alias("node"), F.col("size_a").alias("centre_n"), F.col("size_b").alias("n"), "missing", "extra", "maps")
    members = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    shares = members.groupBy("setting", "centre", "root").agg(F.count("*").alias("k"))
    groups = shares.groupBy("setting", "centre").agg(F.max(F.struct("k", "root")).alias("most"), F.count("*").alias("roots"), F.sum("k").alias("all")).where("roots > 1")
    blocks = F.ceil((F.col("all") - F.col("most.k")) * F.col("all") / BLOCK_PAIRS)
    groups = groups.select("setting", "centre", F.col("most.root").alias("main"), blocks.cast("int").alias("blocks"))
    unsure = F.col("mixed").isNotNull()
    groups = groups.join(mixed, F.col("centre") == F.col("mixed"), "left").withColumn("centre_unsure", unsure).drop("mixed")
    own = members.join(groups, ["setting", "centre"]).join(mixed, F.col("node") == F.col("mixed"), "left").withColumn("unsure", unsure | F.col("centre_unsure"))
    maps = [F.col("maps")[i].alias(str(i)) for i in range(2 * signatures.MAP_WORDS)]
    own = materialize(own.select("setting", "centre", "centre_n", "main", "blocks", "node", "n", "root", "missing", "extra", "unsure", *maps))
    columns = ["node", "n", "root", "missing", "extra", "unsure", *map(str, range(2 * signatures.MAP_WORDS))]
    one = own.where("root <> main").select("setting", "centre", "centre_n", "main", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), *[F.col(c).alias(f"x_{c}") for c in columns])
    two = own.select("setting", "centre", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *[F.col(c).alias(f"y_{c}") for c in columns])
    # Two outside the largest component would meet twice.
    once = (F.col("y_root") == F.col("main")) | (F.col("x_node") < F.col("y_node"))
    rest = one.join(two, ["setting", "centre", "block"]).where(F.col("x_root") != F.col("y_root")).where(once)
    percent = F.element_at(F.array(*[F.lit(p) for _, p in settings]), F.col("setting") + 1)
    rest = rest.where(F.col("x_unsure") | F.col("y_unsure") | (similar_size(percent) & could_link(percent)))
    return rest.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"), "setting").distinct()


def keep(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, also: list[tuple[int, int]] | None = None) -> DataFrame:
    """The documents that stay, one of each component, with all their columns; rows that repeat its id stay too, and rows without an id."""
    gone = cluster(docs, shingle, percent, also).where("NOT kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def cluster_sql() -> str:
    """DuckDB SQL of ``cluster(documents)`` where ids are unique."""
    return r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 2], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(v, u) AS (SELECT a, b FROM e UNION SELECT r.v, e.b FROM reach r JOIN e ON e.a = r.u),
c AS (SELECT v, min(u) AS root FROM reach GROUP BY v)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(root, doc_id)) AS component_id, coalesce(root, doc_id) >= doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.v = doc_id"""
