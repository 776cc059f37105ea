"""The pipeline against a brute-force version of its stages, and its registration."""

import random

import duckdb
import pyarrow as pa
import test_operators as ops

import corpus_pipeline
from platgrid.llm import mixing, quality


def test_pipeline_brute_force(spark, tmp_path):
    rng = random.Random(20)
    rows, labels = ops.graded(rng, 150)
    rows = [(i, t, "abc"[i % 3]) for i, t, _ in rows]
    lines = [ops.prose(rng, 6) for _ in range(5)]
    rows += [(1000 + i, t + "\n" + rng.choice(lines), "a") for i, t, _ in ops.copies(rng, 60)]
    bench = [(k, ops.prose(rng, 25)) for k in range(4)]
    rows += [(2000 + i, ops.prose(rng, 40) + "\n" + rng.choice(bench)[1], "b") for i in range(12)]
    df = ops.table(spark, rows)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    lab.write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    w, threshold = quality.fit(df, lab)
    score = quality.score_column(pa.array([t for _, t, _ in rows]), w, quality.QualityConfig().bits)
    docs = [r for r, s in zip(rows, score) if round(float(s), 6) >= threshold]
    docs = ops.line_dedup_brute(docs)
    group = ops.simhash_brute(docs)
    docs = [r for r in docs if group[r[0]] == r[0]]
    leaks = {i for i, _ in ops.leak_brute(docs, bench)}
    assert 0 < len(leaks)
    docs = [r for r in docs if r[0] not in leaks]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", docs)
    want = con.execute(mixing.OP7_SQL).fetchall()
    key = lambda r: r[0]
    assert sorted(((r.slot, r.source, r.block, r.epoch, r.n_tokens, ",".join(map(str, r.doc_ids)), r.text) for r in got), key=key) == sorted(want, key=key)


def test_stages_on_empty_and_awkward_tables(spark, tmp_path):
    ops.table(spark, [(1, "word " * 30, "a")]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = ops.awkward(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() > 0, name
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns


def test_stored_tables_can_be_removed(spark):
    import os

    from platgrid.llm import common

    df = common.stored(spark.range(3), "test")
    paths = list(common._stored)
    assert df.count() == 3 and all(os.path.isdir(x) for x in paths)
    common.forget(spark)
    assert not any(os.path.exists(x) for x in paths) and common._stored == []


def test_registered():
    import __spark_entry__ as e

    q = e.queries()
    assert "pipeline" in q and all(any(n.startswith(f"op{k}_") for n in q) for k in range(1, 11))
    assert set(e.oracle_sql()) <= set(q)
