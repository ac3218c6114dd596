"""The pipeline on a small folder of its own: each stage takes effect and keeps the columns."""

import random

import corpus_pipeline


def write(spark, folder):
    rng = random.Random(2)
    vocabulary = [f"{a}{b}" for a in ("sto", "riv", "clo", "gre", "wal", "und") for b in ("ne", "er", "ud", "en", "ks", "ry", "la", "mo")]
    clean = lambda n=90: " ".join(rng.choices(vocabulary, k=n))
    item = clean(30)
    texts = {i: clean() for i in range(60)}
    texts[60] = texts[7] + " end"
    texts[61] = texts[7]
    texts[62] = item + " " + clean(60)
    texts[63] = clean(40) + " write to jo.doe@mail.example.com or +49 30 1234567 " + clean(40)
    texts[64] = " ".join(rng.choices(["win###", "cash$$$", "free***"], k=120))
    texts[65] = None
    texts[66] = clean(900) + " " + " ".join(item.split()[5:18]) + " " + clean(900)
    texts[67] = clean(60) + " " + " ".join(item.split()[5:17]) + " " + clean(300)
    rows = [(i, t, "en", "s", len(t) if t else None) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in [*range(60), 63]] + [(64, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    texts = write(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, folder)
        assert out.schema.names == docs.schema.names
        out.write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        seen.append({r.doc_id: r.text for r in docs.collect()})
    assert set(texts) - set(seen[0]) == {64, 65}
    assert set(seen[0]) - set(seen[1]) == {60, 61}
    # A long document goes for one window of the benchmark, but not for twelve words of it.
    assert set(seen[1]) - set(seen[2]) == {62, 66}
    assert set(seen[3]) == set(seen[2])
    assert "[EMAIL]" in seen[3][63] and "[PHONE]" in seen[3][63] and "@" not in seen[3][63]
    assert all(seen[3][i] == texts[i] for i in seen[3] if i != 63)
    last = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(last) == set(seen[3])


def test_stages_on_nothing(spark, tmp_path):
    write(spark, str(tmp_path))
    none = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls after the first stage, repeated ids and further columns with clashing names pass through; no row without need goes."""
    texts = write(spark, str(tmp_path))
    some = [(1, texts[1]), (1, texts[1]), (2, texts[2]), (None, texts[3]), (70, None), (71, "")]
    kind = "doc_id long, text string, lang string, source string, n_chars long, n_words long, node long, gone long, item_ids string, kept boolean"
    docs = spark.createDataFrame([(i, t, None, None, None, 1, 2, 3, "x", False) for i, t in some], kind)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.names == docs.schema.names
        assert sorted(((r.doc_id, r.text, r.item_ids) for r in out.collect()), key=str) == sorted(((i, t, "x") for i, t in some), key=str)


def test_stages_on_any_column_names(spark, tmp_path):
    """Names with dots, backticks and spaces pass through all stages that keep columns; the last one ignores them."""
    write(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where("doc_id < 20").selectExpr("*", "1 AS `a.b`", "2 AS `doc.text`", "3 AS `c d`", "4 AS `e``f`", "5 AS row")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 20
        if k < 4:
            assert out.schema.names == docs.schema.names
            assert [tuple(r)[5:] for r in out.collect()] == [(1, 2, 3, 4, 5)] * 20
