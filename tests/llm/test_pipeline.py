"""The pipeline's stages each work on what the one before kept, and their decisions take effect."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from skyfold.llm.common import keep


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, sf), f"test-{name}")
        out.append(docs)
    return out


def test_columns_and_order(spark, sf, steps):
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dup", "mixing", "packing"]
    assert all(s.columns == columns for s in steps[:-1]) and all(s.count() for s in steps)


def test_clean_documents_stay(spark, sf, steps):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = spark.read.parquet(f"{sf}/documents.parquet").join(labels.filter("quality = 1"), "doc_id").select("doc_id")
    assert good.join(steps[0], "doc_id", "left_anti").count() <= 0.03 * good.count()


def test_mixed_words_come_near_targets(steps):
    from skyfold.llm import mixing

    planned = mixing.plan(steps[2]).groupBy("source").agg({"target": "max"}).collect()
    got = {r.source: r.n for r in steps[3].selectExpr("source", "regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+') n").groupBy("source").sum("n").toDF("source", "n").collect()}
    assert sum(abs(got[r.source] - r["max(target)"]) for r in planned) < 0.1 * sum(got.values())


def test_everything_mixed_is_packed(steps):
    assert {r.doc_id for r in steps[4].select("doc_id").collect()} == {r.doc_id for r in steps[3].select("doc_id").collect()}


def test_stages_take_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0, name


def test_stages_keep_columns_of_any_name(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    for c in ("_was_empty", "_mix_words", "_mix_position", "words", "position", "_gone", "_again", "_rid", "key", "cid", "c0"):
        docs = docs.withColumn(c, docs["doc_id"] * 2)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and all(r._gone == r.doc_id * 2 == r.words for r in out.collect()), name


@pytest.mark.parametrize("name", ["op2_warc", "op3_line_dedup", "op4_licenses", "op6_near_dup", "op7_mixing"])
def test_query_equals_its_sql(spark, sf, name):
    got = entry.queries()[name](spark, sf)
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = db.sql(f"select {', '.join(got.columns)} from ({entry.oracle_sql()[name]}) q").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_held_out_accuracy(spark, sf):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = entry.queries()["op8_quality"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("held_out").selectExpr("avg(cast(predicted = quality as int))").first()
    assert rows[0] >= 0.9


def test_neighbours_query_recall(spark, sf):
    import numpy as np

    pages = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.array(pages.embedding.tolist(), float), pages.vec_id.to_numpy()
    found = entry.queries()["op1_neighbours"](spark, sf).toPandas()
    hit = total = 0
    for q, own in found.groupby("query_id"):
        s = x @ x[np.flatnonzero(ids == q)[0]]
        best = [i for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        hit, total = hit + len(set(best) & set(own.vec_id)), total + 20
    assert hit >= 0.9 * total


def test_quality_stage_keeps_what_the_classifier_accepts(spark, sf):
    """The stage keeps exactly the scores of 0.7 or more; accept() cuts at any score there is, the score itself included."""
    from skyfold.llm import quality
    from skyfold.llm.common import table

    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    net = quality.train(docs, quality.learnable(labels))
    scores = {r.doc_id: r.score for r in quality.score(docs, net).collect()}
    kept = corpus_pipeline.quality_stage(spark, docs, sf)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s >= 0.7}
    for cut in sorted(scores.values())[:: max(1, len(scores) // 3)]:
        assert {r.doc_id for r in quality.accept(docs, net, cut).collect()} == {i for i, s in scores.items() if s >= cut}
