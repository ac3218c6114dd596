"""Sources, sinks, reports and streams."""

import json

import pytest
from pyspark.sql import functions as F

from affinity.operators import report
from affinity.sources import files, similarity
from affinity.streaming import sessions as streams


def test_json_sources(spark, tmp_path):
    export = {"top_tracks": {"items": [{"uri": "u", "name": "n", "played_seconds": 3}]}, "meta": {"exported_at": "x"}}
    (tmp_path / "e.json").write_text(json.dumps(export, indent=1))
    top, recent = files.read_export(spark, str(tmp_path / "e.json"))
    assert [(r.uri, r.played_seconds, r.last_played_at, r.pos) for r in top.collect()] == [("u", 3, None, 0)]
    assert recent.count() == 0
    cache = {"k1": {"name": "A", "similar": [{"name": "B", "match": 0.5}]}, "k2": {"name": "B"}, "k3": {"name": "B", "genres": ["g"]}}
    (tmp_path / "a.json").write_text(json.dumps(cache))
    artists = files.read_artists(spark, str(tmp_path / "a.json"))
    assert {r.name: r.genres for r in artists.collect()} == {"A": None, "B": ["g"]}
    assert [tuple(r) for r in files.similar_edges(artists).collect()] == [("A", "B", 0.5)]
    assert files.read_universe(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "p.json").write_text(json.dumps({"x": ["y", "z"], "w": []}))
    assert sorted(map(tuple, files.read_parents(spark, str(tmp_path / "p.json")).collect())) == [("x", 0, "y"), ("x", 1, "z")]
    graph = {"nodes": {"artists": [{"id": "a", "name": "A"}], "genres": [], "concepts": []}, "edges": [{"from": "a", "to": "b", "type": "influenced"}], "playlists": [], "next_directions": []}
    (tmp_path / "g.json").write_text(json.dumps(graph))
    read = files.read_graph(spark, str(tmp_path / "g.json"))
    assert [(r.src, r.dst, r.note) for r in read["edges"].collect()] == [("a", "b", None)]
    assert read["artists"].first().name == "A"


def test_similarity_source(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"name": "A", "similar": [{"name": "B", "match": "0.5"}, {"name": "C", "match": "0.1"}]}))
    spark.dataSource.register(similarity.SimilaritySource)
    got = spark.read.format("similarity").option("path", str(tmp_path)).option("floor", "0.2").load()
    assert [tuple(r) for r in got.collect()] == [("A", "B", 0.5)]


def test_similarity_stream(spark, tmp_path):
    """Each file is read once over restarts; failures of all tasks count against one budget."""
    spark.dataSource.register(similarity.SimilaritySource)
    folder = tmp_path / "in"
    folder.mkdir()

    def put(name, text=None):
        (folder / f"{name}.json").write_text(text or json.dumps({"name": name, "similar": [{"name": "Z", "match": "0.5"}, {"name": "Y", "match": "0.1"}]}))

    def run():
        stream = spark.readStream.format("similarity").option("path", str(folder)).option("floor", "0.2").option("errors", str(tmp_path / "errors")).option("budget", "2").load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(r.src for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put("A")
    put("B")
    assert run() == ["A", "B"]
    put("C")
    put("D", "no json")
    assert run() == ["A", "B", "C"]
    assert run() == ["A", "B", "C"]
    put("E", "[]")
    put("F", "{")
    put("G")
    assert run() == ["A", "B", "C", "G"]
    put("H")
    with pytest.raises(Exception, match="3 files failed, 2 may"):
        run()


def test_retry():
    waits, calls = [], []

    def busy():
        calls.append(1)
        if len(calls) < 3:
            raise similarity.Busy
        return "done"

    assert similarity.with_retry(busy, sleep=waits.append) == "done"
    assert waits == [1.0, 2.0]
    with pytest.raises(similarity.Busy):
        similarity.with_retry(lambda: (_ for _ in ()).throw(similarity.Busy()), sleep=waits.append)


def test_refresh_and_names(spark):
    kind = "uri string, name string, last_played_at string"
    fetched = spark.createDataFrame([("u1", "new1", "t2"), ("u2", "new2", None), ("u3", "new3", "t3")], kind)
    old = spark.createDataFrame([("u1", "old1", 5, "t1"), ("u2", "old2", 6, "t1"), ("gone", "x", 7, "t1")], "uri string, name string, played_seconds long, last_played_at string")
    got = {r.uri: tuple(r)[1:] for r in files.refreshed(fetched, old).collect()}
    assert got == {"u1": ("old1", 5, "t2"), "u2": ("old2", 6, "t1"), "u3": ("new3", 0, "t3")}
    row = spark.range(1).select(files.packed_name(F.lit("u"), F.lit("T"), F.array(F.struct(F.lit("A").alias("name"), F.lit("I").alias("id"))), F.lit("2020-01-01")).alias("n"))
    assert row.first().n == 'u\t# Track: "T" by "A"(spotify:artist:I). Released on 2020-01-01. Descriptors: unknown.'


def test_text_edits(spark):
    def edit(content, values):
        return spark.createDataFrame([(content,)], "c string").select(report.front_matter_upserted(F.col("c"), values).alias("r")).first().r

    some = {"meta_genres": F.array(F.lit("a"), F.lit("b")), "lastfm_tags": F.array().cast("array<string>")}
    assert edit("---\nx: 1\nmeta_genres: [z]\n---\nbody --- y", some) == "---\nx: 1\nmeta_genres: [a, b]\n---\nbody --- y"
    assert edit("no front", some) == "no front"
    once = edit("---\nx: 1\n---\n", some)
    assert edit(once, some) == once


def test_graph_xml(spark):
    nodes = spark.createDataFrame([("a<", ["x", "y"], None)], "node string, tags array<string>, note string")
    edges = spark.createDataFrame([("a<", "b", 1.5)], "src string, dst string, weight double")
    lines = [r.line for r in files.graph_xml(nodes, edges).orderBy("part").collect()]
    assert lines[1] == '<node id="a&lt;"><data key="tags">x, y</data><data key="note"></data></node>'
    assert lines[2].startswith('<edge source="a&lt;" target="b">')


def test_snapshot(spark, tmp_path):
    one = spark.createDataFrame([("x", 1)], "name string, n int")
    for day in ("2024-01-01", "2024-01-02", "2024-01-02"):
        report.snapshot(one, str(tmp_path / "s"), day)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2


def test_streamed_sessions(spark, tmp_path):
    rows = [("u", "2024-01-01 10:00:00"), ("u", "2024-01-01 10:30:00"), ("u", "2024-01-01 11:00:01"), ("v", "2024-01-01 10:00:00"), ("w", "2024-01-02 00:00:00")]
    plays = spark.createDataFrame(rows, "who string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    plays.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(plays.schema).parquet(str(tmp_path / "in"))
    query = streams.sessions(stream, "who").writeStream.outputMode("append").format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.who, r.plays) for r in spark.table("found").collect())
    assert got == [("u", 1), ("u", 2), ("v", 1)]  # the last session is still open


def test_many_documents(spark, tmp_path):
    """A table as several JSON objects: each row in one of them, each file read for itself, read back whole."""
    rows = spark.range(95).selectExpr("concat('k', id) AS key", "id AS n", "array(id, id + 1) AS list")
    files.write_json_maps(rows, "key", str(tmp_path / "maps"), 10)
    assert len(list((tmp_path / "maps").glob("piece=*/part-*"))) > 5
    back = files.read_map(spark, str(tmp_path / "maps"), "struct<n:long,list:array<long>>")
    assert sorted(tuple(r) for r in back.select("key", "value.*").collect()) == sorted(tuple(r) for r in rows.collect())
    files.write_json_maps(rows.limit(0), "key", str(tmp_path / "none"), 10)
