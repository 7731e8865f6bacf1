"""The stages on a small corpus, each against what it should do to its own input."""

import os

import pytest

import corpus_pipeline
from contactloom.llm import registry
from contactloom.llm.common import Workspace

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    space = Workspace(spark, "test-pipeline")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.toPandas() if k < 4 else docs.select("doc_id").toPandas()
        docs = space.write(stage(spark, docs, SF), name)
        if k == 4:
            break
        after = docs.toPandas()
        assert docs.columns == columns and len(after)
        merged = after.merge(before.drop_duplicates(), on="doc_id", suffixes=("", "_b"))
        assert (merged.text == merged.text_b).all()
        if name == "exact_dedup":
            normal = lambda t: " ".join(t.split())
            assert after.text.map(normal).nunique() == len(after) == before.text.map(normal).nunique()
        if name in ("toxicity", "simhash_dedup"):
            assert len(after) > 0.8 * len(before)
        if name == "mixing":
            assert after.groupby("doc_id").size().max() <= 2
    packed = docs.toPandas()
    assert set(packed.doc_id) == set(before.doc_id)
    assert packed.groupby("sequence_id").length.sum().max() <= 2048


def test_run_and_edges(spark, edge, nothing):
    """The whole run packs just what its stages leave; every stage takes nulls, copies and no rows."""
    sizes = {}
    for docs, name in ((edge, "edge"), (nothing, "nothing")):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            own = stage(spark, docs, SF)
            assert k == 4 or own.columns == docs.columns
            sizes[name, k] = own.count()
    assert [sizes["nothing", k] for k in range(5)] == [0] * 5
    assert sizes["edge", 1] == 9 and sizes["edge", 2] == 8
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert (out.groupby("sequence_id").length.sum() <= 2048).all() and len(out) > 100


def test_stages_begin_lean(spark, nothing):
    """Every stage, called by itself, keeps Arrow batches short and collects the heaps first."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for name, stage in corpus_pipeline.STAGES:
        spark.conf.unset(rows)
        before = full()
        stage(spark, nothing, SF)
        assert int(spark.conf.get(rows)) <= corpus_pipeline.BATCH_ROWS and full() > before, name


def test_registry():
    names = list(registry.queries())
    assert [n for k in range(1, 11) for n in names if n.startswith(f"op{k}_")] and len(names) == 10
    assert set(registry.oracle_sql()) <= set(names)
