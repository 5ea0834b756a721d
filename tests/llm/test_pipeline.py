from __future__ import annotations

import importlib

import pytest
from test_neardup import brute


@pytest.fixture(scope="module")
def pipeline():
    return importlib.import_module("corpus_pipeline")


def test_stages(spark, sf, pipeline):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    sizes = [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        from babelyard.llm.tables import materialise

        docs = materialise(out, f"test-{name}")
        sizes.append(docs.count())
        assert all(texts[r.doc_id] == r.text for r in docs.collect())
    assert sizes[0] >= sizes[1] >= sizes[2] > sizes[3] and sizes[4] > 0
    assert pipeline.STAGES[-1][1](spark, docs, sf).count() >= sizes[4]


def test_near_duplicate_stage_against_all_pairs(spark, sf, pipeline):
    """The stage keeps the first document of each class that comparing every pair finds."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    classes = brute([(r.doc_id, r.text) for r in docs.collect()])
    kept = pipeline.drop_near_duplicates(spark, docs, sf)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c, _, _ in classes.values()})
    assert kept.join(docs, docs.columns, "left_anti").count() == 0


def test_registered(pipeline):
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)


def test_toxic_rows_go(spark, pipeline, tmp_path):
    """Toxic documents whose labels the stage hasn't seen, nor any labelled copy of their texts; clean ones stay."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    learnt = labels.where("crc32(cast(doc_id as string)) % 5 <> 0")
    learnt.write.parquet(f"{tmp_path}/labels.parquet")
    known = docs.join(learnt, "doc_id", "left_semi").select("text").distinct()
    unseen = labels.join(learnt, "doc_id", "left_anti").join(docs, "doc_id").join(known, "text", "left_anti")
    toxic = {r.doc_id: r.toxic for r in unseen.where("toxic is not null").collect()}
    kept = {r.doc_id for r in pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()}
    bad, clean = ({d for d, t in toxic.items() if t == k} for k in (1, 0))
    assert len(bad) > 5 and len(bad & kept) < 0.2 * len(bad)
    assert len(clean) > 100 and len(clean & kept) > 0.97 * len(clean)


def test_odd_rows(spark, sf, pipeline, odd):
    """Null, empty and very long texts, repeated rows, null ids, and columns whose names the operators use inside."""
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns, name
        assert {r.text for r in out.collect()} <= {r.text for r in odd.collect()}, name
    assert pipeline.pack(spark, odd, sf).select("doc_id").count() >= odd.count()


def test_empty_table(spark, sf, pipeline, empty):
    for name, stage in pipeline.STAGES:
        out = stage(spark, empty, sf)
        assert out.count() == 0, name
        assert name == pipeline.STAGES[-1][0] or out.columns == empty.columns
