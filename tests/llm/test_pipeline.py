"""The pipeline's stages: each does its part on its own input."""

import re

import corpus_pipeline
import numpy as np
import pyarrow as pa
from conftest import SMALL
from pyspark.sql import functions as F

from tallyloom.llm import toxicity


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        seen[name] = (docs, out)
        assert i == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
        docs = out
    before, after = seen["exact_dedup"]
    bare = lambda df: [re.sub("[\\x20\\x09-\\x0D]", "", r[0] or "") for r in df.select("text").collect()]
    assert len(set(bare(after))) == after.count() and set(bare(after)) == set(bare(before))
    before, after = seen["simhash_near_dedup"]
    assert after.join(before, "doc_id", "left_anti").count() == 0 and after.count() == after.select("doc_id").distinct().count()
    before, after = seen["source_mixing"]
    assert after.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert seen["length_packing"][1].count() == after.count()
    clean = seen["toxicity"]
    assert 0 < clean[0].count() - clean[1].count() < 0.3 * clean[0].count()


def test_stages_take_odd_tables(spark):
    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (2, None, None, None, None), (None, "a b c d", "en", None, 7), (3, "", "en", "t", 0)]
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL)
        assert docs.count() >= 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def test_toxicity_learns_outside_the_driver(spark, monkeypatch):
    """No labelled text comes to the driver; the weights are those of training on the texts in order of doc_id."""
    from tallyloom.llm import _linear

    docs, labels = (spark.read.parquet(f"{SMALL}/{name}.parquet") for name in ("documents", "labels"))
    got = _linear.labelled(docs, labels, "toxic", 10, toxicity.FOLDS, toxicity.HELD_OUT, 60).collect()
    want = toxicity.train(pa.array([r.text for r in got], pa.string()), np.array([r.label for r in got]))
    monkeypatch.setattr(type(docs), "toPandas", None)
    assert len(got) > 10
    assert (toxicity.fit(docs, labels, 60) == want).all()
    assert (toxicity.fit(docs, labels.where("false"))[:-1] == 0).all()
