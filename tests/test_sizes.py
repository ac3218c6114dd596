"""What failed on larger tables, on small ones with small limits."""

import itertools
import random
from collections import Counter

import pytest

from affinity.operators import frontier, layers, neighbour_index, traversal
from affinity.plans import taste_queries


def test_walks_to_root_are_not_limited(spark):
    """More rows than a recursive query may make."""
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "50")
    try:
        parents = spark.range(2, 101).selectExpr("id AS child", "0 AS pos", "id div 2 AS parent")
        got = {r.label: (r.path, r.root) for r in traversal.walk_to_root(parents, spark.range(1, 101).selectExpr("id AS label"), [3], 4).collect()}
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", limit)
    for label in range(1, 101):
        path = [label]
        while path[-1] > 1 and path[-1] // 2 != 3 and len(path) <= 4:
            path.append(path[-1] // 2)
        assert got[label] == (path, path[-1])


@pytest.mark.parametrize("kind,members,groups,size,blocks", [("long", 60, 200, 4, False), ("string", 40, 6, 30, True), ("long", 60, 12, 25, False)])
def test_pairs_of_few_and_many_groups(spark, monkeypatch, kind, members, groups, size, blocks):
    """Pairs by group, by pieces of large groups and by blocks of members, against all pairs."""
    for name, value in (("TASK_MEMBERS", 50), ("TASK_PAIRS", 200), ("PIECE", 10), ("BLOCK", 16), ("GROUPS_AT_ONCE", 4)):
        monkeypatch.setattr(layers, name, value)
    taken = []
    whole = layers._block_pairs
    monkeypatch.setattr(layers, "_block_pairs", lambda *a: taken.append(1) or whole(*a))
    rng = random.Random(5)
    name = (lambda k: k) if kind == "long" else (lambda k: f"é{k}")
    own = {g: rng.sample(range(members), size) for g in range(groups)}
    if groups == 12:
        own = {g: m if g < 4 else m[:2] for g, m in own.items()}
    rows = [(f"g{g}", name(m)) for g, found in own.items() for m in found]
    frame = spark.createDataFrame([*rows, *rows[:20], (None, name(1)), ("g1", None)], f"g string, m {kind}")
    want = Counter(pair for found in own.values() for pair in itertools.combinations(sorted(map(name, found)), 2))
    got = layers.pairs(frame, "g", "m").collect()
    assert {(r.src, r.dst): r.weight for r in got} == want and len(got) == len(want)
    assert bool(taken) == blocks
    assert layers.pairs(frame, "g", "m", 3).count() == len({p for m in own.values() if len(m) <= 3 for p in itertools.combinations(sorted(map(name, m)), 2)})


def test_few_members_in_many_groups(spark, monkeypatch):
    """Few members that meet in many small groups aren't listed with all their groups."""
    monkeypatch.setattr(layers, "TASK_PAIRS", 200)
    monkeypatch.setattr(layers, "_block_pairs", lambda *a: pytest.fail("lists of groups"))
    rng = random.Random(9)
    own = {g: rng.sample("abcdef", rng.randint(1, 5)) for g in range(900)}
    frame = spark.createDataFrame([(g, m) for g, found in own.items() for m in found], "g long, m string")
    want = Counter(pair for found in own.values() for pair in itertools.combinations(sorted(found), 2))
    assert {(r.src, r.dst): r.weight for r in layers.pairs(frame, "g", "m").collect()} == want


def test_crowds_are_compared_in_slices_of_groups(spark, monkeypatch):
    """No block lists more than its share of the groups, and slices add up."""
    for name, value in (("TASK_PAIRS", 200), ("GROUPS_AT_ONCE", 4), ("CROWD", 2), ("LISTED", 50)):
        monkeypatch.setattr(layers, name, value)
    rng = random.Random(10)
    own = {g: rng.sample(range(24), 12) for g in range(300)}
    frame = spark.createDataFrame([(f"g{g}", m) for g, found in own.items() for m in found], "g string, m long")
    want = Counter(pair for found in own.values() for pair in itertools.combinations(sorted(found), 2))
    found = layers.pairs(frame, "g", "m").collect()
    assert {(r.src, r.dst): r.weight for r in found} == want and len(found) == len(want)


def test_tasks_of_pairs_follow_their_number(spark, monkeypatch):
    """Ten times as many pairs are counted in ten times as many tasks, whatever the number of shuffle partitions."""
    monkeypatch.setattr(layers, "TASK_PAIRS", 100)
    for groups in (80, 800):
        found = layers.pairs(spark.range(groups * 5).selectExpr("id div 5 AS g", "id AS m"), "g", "m")
        assert found.rdd.getNumPartitions() == groups * 10 // 100 and found.count() == groups * 10


def test_cells_of_neighbours():
    """Few queries meet many points in one row of cells; shuffles don't grow with the square of the points."""
    assert frontier.grid(9_000, 900_000, 24)[0] == 1
    for n in (12_000, 120_000, 720_000):
        rows, columns = frontier.grid(n, n, 24)
        assert rows * columns >= 24 and (rows + columns) * n <= 24 * n
        assert n / min(rows, columns) <= frontier.SIDE * 1.01
    assert frontier.grid(10, 10, 24) == (1, 1)


def test_neighbours_over_cells(spark, monkeypatch):
    """Few queries and equals over several cells and blocks, against all pairs."""
    monkeypatch.setattr(frontier, "SIDE", 50)
    monkeypatch.setattr(frontier, "BLOCK", 8)
    rng = random.Random(4)
    v = {k: [float(rng.randint(1, 3)) for _ in range(3)] for k in rng.sample(range(1000), 160)}
    points = spark.createDataFrame(list(v.items()), "id long, v array<double>").repartition(5)
    asked = sorted(v)[::9]
    length = lambda x: sum(e * e for e in x) ** 0.5 + 1e-9
    cosine = lambda x, y: round(sum(a * b for a, b in zip(v[x], v[y], strict=True)) / length(v[x]) / length(v[y]), 10)
    found = frontier.nearest(points, "id", "v", 5, spark.createDataFrame([(k,) for k in asked], "id long")).collect()
    assert len(found) == 5 * len(asked)
    for k in asked:
        best = sorted((-cosine(k, j), j) for j in v if j != k)[:5]
        assert [r.other for r in sorted(found, key=lambda r: r["rank"]) if r.id == k] == [j for _, j in best]


def test_like_tracks_look_into_few_cells(spark, monkeypatch):
    """Few of all pairs are compared; every answer is that of all pairs, copies and tracks without features included."""
    rng = random.Random(11)
    tracks = [(k, [rng.choice("abc")], [rng.choice("xy")], rng.choice([50, rng.randint(1, 10**6)]), rng.randint(2000, 2003)) for k in range(0, 6000, 2)]
    tracks += [(k, [], [], 0, 2000) for k in (1, 3001, 5999)]
    frame = spark.createDataFrame(tracks, "id long, descriptors array<string>, macros array<string>, played_seconds long, release_year int")
    asked, rows = [*range(0, 6000, 100), 3001], []
    looked_up = neighbour_index.CellIndex.looked_up

    def seen(self, *a):
        rows.append((looked_up(self, *a), self.rows))
        return rows[-1][0]

    monkeypatch.setattr(neighbour_index.CellIndex, "looked_up", seen)
    got = frontier.more_like(frame, "id", list("abc"), list("xy"), 5, spark.createDataFrame([(k,) for k in asked], "id long")).collect()
    sizes = [points.groupBy("cell", "part").count() for _, points in rows]
    pairs = sum(asks.join(n, ["cell", "part"]).agg({"count": "sum"}).first()[0] or 0 for (asks, _), n in zip(rows, sizes, strict=True))
    assert pairs < len(asked) * len(tracks) / 4
    v = {r.id: r.vector for r in frontier.track_features(frame, "id", list("abc"), list("xy")).collect()}
    length = {k: sum(e * e for e in x) ** 0.5 + 1e-9 for k, x in v.items()}
    for k in asked:
        cosine = {j: round(sum(a * b for a, b in zip(v[k], x, strict=True)) / length[k] / length[j], 11) for j, x in v.items() if j != k}
        own = sorted((r for r in got if r.id == k), key=lambda r: r["rank"])
        assert [round(cosine[r.other], 10) for r in own] == [round(c, 10) for c in sorted(cosine.values(), reverse=True)[:5]]
        assert len({r.other for r in own}) == 5 and [(-r.cosine, r.other) for r in own] == sorted((-r.cosine, r.other) for r in own)
        if k == 3001:
            assert [r.other for r in own] == [0, 1, 2, 4, 6]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_cells_follow_cores(spark, monkeypatch, kind):
    """More shuffle partitions deal vectors to no more cells, floats are dealt as floats, and six times as many vectors are dealt no more often."""
    assert frontier.grid(615_000, 615_000, 36) == frontier.grid(102_000, 102_000, 36) == (6, 6)
    monkeypatch.setattr(frontier, "BLOCK", 4)
    asked, dealt = [], []
    grid, kept = frontier.grid, frontier._cell_nearest
    monkeypatch.setattr(frontier, "grid", lambda q, n, tasks: asked.append(tasks) or grid(q, n, tasks))

    def seen(k):
        inner = kept(k)

        def run(table):
            assert str(table.schema.field("v").type.value_type) == kind
            return inner(table)

        return dealt.append(k) or run

    monkeypatch.setattr(frontier, "_cell_nearest", seen)
    rng = random.Random(6)
    v = {k: [rng.random() for _ in range(5)] for k in range(90)}
    points = spark.createDataFrame(list(v.items()), f"id long, v array<{kind}>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        plan = frontier.nearest(points, "id", "v", 3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    found = plan.collect()
    assert asked[0] <= max(24, 3 * spark.sparkContext.defaultParallelism) and dealt == [3]
    cosine = lambda x, y: sum(a * b for a, b in zip(v[x], v[y], strict=True)) / (sum(a * a for a in v[x]) * sum(b * b for b in v[y])) ** 0.5
    for k in v:
        best = sorted((-cosine(k, j), j) for j in v if j != k)[:3]
        assert [r.other for r in sorted(found, key=lambda r: r["rank"]) if r.id == k] == [j for _, j in best]


def test_hover_lines_deal_vectors_by_cores(spark, monkeypatch, tmp_path):
    """With many shuffle partitions the map's vectors are dealt to no more cells than cores take, and every line is right."""
    dealt, grid = [], frontier.grid
    monkeypatch.setattr(frontier, "BLOCK", 4)
    monkeypatch.setattr(frontier, "grid", lambda *a: dealt.append(grid(*a)) or dealt[-1])
    rng = random.Random(7)
    v = {k: [float(rng.randint(1, 9)) for _ in range(64)] for k in rng.sample(range(500), 90)}
    spark.createDataFrame([(k, x, k % 3) for k, x in v.items()], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        plan = taste_queries.atlas_hover(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    rows, columns = dealt[0]
    assert rows * columns <= 2 * max(24, 3 * spark.sparkContext.defaultParallelism)
    length = {k: sum(e * e for e in x) ** 0.5 for k, x in v.items()}
    cosine = lambda x, y: round(sum(a * b for a, b in zip(v[x], v[y], strict=True)) / (length[x] * length[y]), 10)
    near = {k: ", ".join(f"v{j}" for _, j in sorted((-cosine(k, j), j) for j in v if j != k)[:5]) for k in v}
    tag = {0: "?", 1: "&lt;1&gt;", 2: "&lt;2&gt;"}
    assert sorted((r.node, r.line) for r in plan.collect()) == sorted((k, f"<b>v{k}</b><br>tag: {tag[k % 3]}<br>nearest: {near[k]}") for k in v)


def test_repeated_ids_are_not_their_own_neighbours(spark, monkeypatch):
    """Rows of one id never name that id, whether they meet in one block or in several."""
    monkeypatch.setattr(frontier, "BLOCK", 8)
    rng = random.Random(8)
    rows = [(k % 12, [rng.random() for _ in range(4)]) for k in range(60)]
    found = frontier.nearest(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 5).collect()
    assert len(found) == 12 * 5 and all(r.id != r.other for r in found)
