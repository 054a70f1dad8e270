import importlib

import corpus_pipeline
from hireloom.llm import queries
from tests.conftest import DATA


def test_names():
    numbers = [int(name[2:].split("_")[0]) for name in queries.queries()]
    assert sorted(numbers) == list(range(1, 11))
    assert "pipeline" in importlib.import_module("__spark_entry__").queries()


def test_stages(spark, docs, empty):
    for rows in (docs, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, DATA)
            assert out.columns == rows.columns and out.schema == rows.schema, name
            assert out.count() <= 3 * rows.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() >= docs.count()


def test_run(spark):
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.count() > 0
    full = rows.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0]
    assert full <= 2048
