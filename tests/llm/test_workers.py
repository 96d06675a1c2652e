"""What Python workers hold: tables of the operator at work alone, and batches of bounded bytes."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioflow.llm import alike, langid, shared, substrings

ROWS = "pid long, held long"


def _held():
    return pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([len(shared._kept)])], ["pid", "held"])


def _making(batches):
    for _ in batches:
        shared.kept("a", lambda: bytes(10))
        yield _held()


def _looking(batches):
    for _ in batches:
        yield _held()


def test_workers_let_go(spark):
    rows = spark.range(0, 400, 1, 16)
    made = shared.in_workers(rows, _making, ROWS, "a").collect()
    assert {r["held"] for r in made} == {1}
    pids = {r["pid"] for r in made}
    same = [r for r in shared.in_workers(rows, _looking, ROWS, "a").collect() if r["pid"] in pids]
    assert same and {r["held"] for r in same} == {1}
    other = [r for r in shared.in_workers(rows, _looking, ROWS).collect() if r["pid"] in pids]
    assert other and {r["held"] for r in other} == {0}


@pytest.mark.parametrize("operator", ["language", "sets", "pieces"])
def test_operators_let_go(spark, monkeypatch, operator):
    """Each operator's own function drops another's tables."""
    docs, found = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string"), []
    model, kind, map_in_arrow = langid.fit(docs), type(docs), type(docs).mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, of, *a, **b: found.append(of) or map_in_arrow(self, of, *a, **b))
    {
        "language": lambda: langid.identify(docs, model),
        "sets": lambda: alike.sets_of(docs, 5),
        "pieces": lambda: substrings._occurrences(docs.select("doc_id", F.lit(1).cast("long").alias("row"), "text"), 20),
    }[operator]()
    monkeypatch.setitem(shared._kept, "vocabulary", object())
    assert list(found[0](iter([]))) == []
    assert not shared._kept


def _sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_bound_batches(spark, tmp_path, name, stage):
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(1, "a text", "en", "s", 6)], "doc_id long, text string, lang string, source string, n_chars long")
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(bound)
    try:
        stage(spark, docs, str(tmp_path))
        long_rows = spark.range(0, 9_000, 1, 1).select(F.repeat(F.lit("0123456789"), 300).alias("text"))
        sizes = [r["n"] for r in long_rows.mapInArrow(_sizes, "n long").collect()]
    finally:
        spark.conf.unset(bound)
    assert sum(sizes) >= 27_000_000
    assert max(sizes) < 5_000_000
