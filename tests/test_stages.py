"""What staged tables leave on disk: nothing that was dropped, no shuffle files, and of texts through a model only the results."""

import os
import time
from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from folioflow.config import Options
from folioflow.operators import backends, layout, recovery
from folioflow.operators.translate import translate
from folioflow.plans import documents, stages
from folioflow.queries.routing import Forgetful

TEXTS = "key string, lang string, text string"


def folders(spark):
    top = Path(stages.shared_folder(spark).removeprefix("file:"))
    return {p for p in top.glob("round-*") if any(x.name.startswith("part-") for _, _, names in os.walk(p) for x in map(Path, names))}


def shuffled(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return sum(b.isShuffle() for b in (lambda s: [s.apply(k) for k in range(s.size())])(disk.getAllBlocks()))


def test_staged_leaves_no_shuffle_files_and_is_dropped(spark):
    spark.sparkContext._jvm.System.gc()
    before, set_before, there = shuffled(spark), spark.conf.get(stages.CLEANUP), folders(spark)
    out = stages.staged(spark.range(1_000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):  # deleted in the background
        if (left := shuffled(spark)) > before:
            time.sleep(0.1)
    assert left <= before
    assert out.count() == 7 and spark.conf.get(stages.CLEANUP) == set_before
    assert len(folders(spark) - there) == 1
    stages.dropped(out, spark.range(1))
    assert folders(spark) == there


def test_staged_apart(spark):
    rows = spark.range(10).select("id", (F.col("id") < 4).alias("low"))
    others, low = stages.staged_apart(rows, "low")
    assert sorted(r["id"] for r in low.collect()) == [0, 1, 2, 3] and others.columns == ["id"] and others.count() == 6
    stages.dropped(low)
    assert others.count() == 6
    none = stages.staged_apart(rows.filter("id > 5"), "low")[1]
    assert none.isEmpty() and none.columns == ["id"]


def test_recovery_leaves_its_result_only(spark):
    rows = [(str(k), "fr", " ".join(["mot"] * (k % 60 + 1)) + "x" * (k % 7)) for k in range(200)] + [("none", "fr", ""), ("no language", None, "un mot x")]
    before = folders(spark)
    kept = recovery.translated(spark.createDataFrame(rows, TEXTS), backends.runner("left", Forgetful, "pt", max_tokens=24))
    assert len(folders(spark) - before) == 1
    texts = stages.staged(spark.createDataFrame(rows, TEXTS))
    found = recovery.translated(texts, backends.runner("left", Forgetful, "pt", max_tokens=24), spent=True)
    assert len(folders(spark) - before) == 2
    assert found.count() == len(rows) and sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, kept.collect()), key=repr)
    assert found.filter("error is null and n_tries > 0").count() > 10


def test_parts_with_odd_units(spark):
    parts = [["a", "b c"], ["x\0y", "z"], ["\1a"], [""], ["", ""], [], ["é\"\\", "\U0001d400\n"], ["\0"]]
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(parts)], "k int, units array<string>").select("k", recovery.together("units").alias("t"))
    assert {r["k"]: backends.apart(r["t"]) for r in rows.collect()} == dict(enumerate(parts))


class Dropping(backends.LexicalModel):
    """Loses markers of texts with a word, so that their elements have to be put between."""

    def translate(self, texts, source, target, beam):
        return [t.replace("ZXQKEEP", "") if "drop" in t else f"<{t}>" for t in texts]


def test_translation_leaves_its_results_only(spark):
    texts = ["bonjour", "bonjour", "voir ABC ici", "voir DEF ici", "drop ABC ici", "drop DEF ici", "mot " * 2_000, "", None]
    units = spark.createDataFrame([(t, "fr") for t in texts], "text string, lang string")
    before = folders(spark)
    results, added = translate(units, spark.createDataFrame([], "key string, value string"), backends.runner("dropping", Dropping, "pt"), "pt", "ns")
    found = {r["text"]: r for r in results.collect()}
    assert {t: (found[t]["translation"], found[t]["n_protected"], found[t]["n_recovered"]) for t in texts[1:6]} == {
        "bonjour": ("<bonjour>", 0, 0), "voir ABC ici": ("<voir ABC ici>", 1, 0), "voir DEF ici": ("<voir DEF ici>", 1, 0),
        "drop ABC ici": ("drop ABC <ici>", 1, 1), "drop DEF ici": ("drop DEF <ici>", 1, 1),
    }
    assert found["mot " * 2_000]["n_parts"] == 3 and found[""]["translation"] == "" and found[""]["n_parts"] == 0
    assert {"<bonjour>", "<ici>"} <= {r["value"] for r in added.collect()}
    assert len(folders(spark) - before) <= 5  # the results, and what was found in either round in the cache and by the model


def test_run_leaves_its_units_and_entries_only(spark):
    line = lambda p, k, text: ("d", p, k, k, text, 60.0, 100.0 + 30 * k, 540.0, 112.0 + 30 * k, 10.0)
    lines = [line(p, k, f"The cat of house {p} is in garden {k} and it is small.") for p in range(1, 5) for k in range(6)]
    df = spark.createDataFrame(lines, "doc_key string, page_no int, block_no int, line_no int, text string, x0 double, y0 double, x1 double, y1 double, font_size double")
    pages = df.select("doc_key", "page_no", F.lit(600.0).alias("width"), F.lit(800.0).alias("height")).distinct()
    empty = spark.createDataFrame([], "key string, value string")
    options = Options(source="en,fr")
    before = folders(spark)
    rows, added = documents.run(df, pages, empty, backends.runner("stand-in", backends.LexicalModel, "pt"), "ns", options)
    size = lambda p: sum(x.stat().st_size for x in p.rglob("part-*"))
    texts = [p for p in folders(spark) - before if {"text", "value", "input", "line_text"} & {c for x in list(p.rglob("part-*"))[:1] for c in pq.read_schema(x).names}]
    assert len(texts) <= 3 and rows.count() == 24 and added.count() == 24  # the units, entries found in the model, texts of groups over pages
    assert all(size(p) < 100_000 for p in folders(spark) - before)
    staged = stages.staged(df)
    found = documents.outcome(staged, pages, empty, backends.runner("stand-in", backends.LexicalModel, "pt"), "ns", options, spent=[staged], entries=False)
    names = ["page_no", "unit_no", "state", "translation"]
    assert sorted(map(tuple, found.units.select(*names).collect())) == sorted(map(tuple, rows.select(*names).collect()))
    stages.dropped(*found.of_units)
    assert not any("value" in pq.read_schema(x).names for p in folders(spark) - before for x in list(p.rglob("part-*"))[:1] if p not in texts)


def test_blocks_of_one_line_hold_their_text_once(spark):
    rows = spark.createDataFrame([(0, [("a b",)], "a b"), (1, [("a-",), ("b",)], "ab"), (2, [], "x")], "k int, lines array<struct<line_text:string>>, text string")
    slim = layout.slim(rows)
    assert {r["k"]: r["text"] for r in slim.collect()} == {0: None, 1: "ab", 2: "x"}
    assert {r["k"]: r["text"] for r in layout.full(slim).collect()} == {0: "a b", 1: "ab", 2: "x"}
