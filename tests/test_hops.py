"""Ways over several packages, their windows and recovery, with stand-ins; model folders, snapshots, the cache of read pages, states of files."""

import json

import pytest

from folioflow.operators import axtree, hops
from folioflow.operators.backends import ChunkError, namespace
from folioflow.sources import files, models, sinks


def test_windows_lose_nothing():
    tokens = [("▁" if k % 7 == 0 else "") + str(k) for k in range(950)]
    found = hops.windows(tokens)
    assert [t for w in found for t in w] == tokens
    assert all(w[0].startswith("▁") and 101 <= len(w) <= 200 for w in found[:-1])
    assert [len(w) for w in hops.windows(["x"] * 401)] == [200, 200, 1]
    assert hops.windows([]) == []


def test_package_hop():
    class Result:
        def __init__(self, tokens):
            self.hypotheses = [tokens]

    class Model:
        def translate_batch(self, rows, **options):
            assert options["target_prefix"] == [["<pt>"]] * len(rows)
            return [Result(["<pt>", *r]) for r in rows]

    class Pieces:
        def encode(self, text, out_type):
            return ["▁" + w for w in text.split()]

        def decode(self, tokens):
            return "".join(tokens)

    hop = hops.PackageHop("p", "pt", "<pt>", most_output=9, load=lambda path: (Model(), Pieces()))
    parts = hops.TokenParts(hop)
    assert parts.ask(parts.split("a b"), "fr", "pt", 4) == ["a b"]
    for bad in ([], ["x"] * 9, ["<pt>"]):
        with pytest.raises(ChunkError):
            hop.decode(bad)


def test_namespace_follows_what_it_names():
    one = namespace("nllb", {"v": 1, "w": 2}, "float16", 4)
    assert one == namespace("nllb", {"w": 2, "v": 1}, "float16", 4)
    assert len({one, namespace("nllb", {"v": 1, "w": 2}, "int8", 4), namespace("nllb", {"v": 1, "w": 2}, "float16", 1), namespace("nllb", {"v": 2, "w": 2}, "float16", 4)}) == 4


def test_converted_models(tmp_path):
    root = models.converted_folder("nllb_600m", "Float-16", str(tmp_path))
    assert root.name == "hf_nllb_600m_float_16"
    assert not models.is_converted(root)
    (root / "model").mkdir(parents=True)
    (root / "tokenizer").mkdir()
    (root / "tokenizer" / "tokenizer.json").write_text("{}")
    (root / "model" / "model.bin").write_text("x")
    (root / "metadata.json").write_text(json.dumps({"modelo": "nllb_600m"}))
    assert models.is_converted(root) and models.is_converted(root, "nllb_600m") and not models.is_converted(root, "other")


def test_best_snapshots_and_cache(spark, tmp_path):
    units = spark.createDataFrame([("d", 1, 1, "ab"), ("d", 2, 1, "abcd"), ("d", 3, 1, "wxyz"), ("d", 3, 9, "not asked for"), ("e", 1, 1, None)], "doc_key string, snapshot int, page_no int, text string")
    asked = spark.createDataFrame([("d", 1), ("e", 1)], "doc_key string, page_no int")
    assert [(r["doc_key"], r["snapshot"]) for r in axtree.best_snapshots(units, asked).collect()] == [("d", 2)]
    path = str(tmp_path / "cache")
    rows = spark.createDataFrame([("s1", 1, 1, "x"), ("s2", 1, 1, "y")], "sha256 string, page_no int, nth int, text string")
    sinks.add_to_ocr_cache(rows.filter("sha256 = 's1'"), None, path)
    sinks.add_to_ocr_cache(rows, spark.read.parquet(path), path)
    assert sorted((r["sha256"], r["text"]) for r in spark.read.parquet(path).collect()) == [("s1", "x"), ("s2", "y")]


def test_file_states(spark):
    rows = spark.createDataFrame([("a", "oa"), ("b", "ob"), ("c", "oc")], "doc_key string, output_path string")
    there, done = spark.createDataFrame([("oa",), ("oa",)], "output_path string"), spark.createDataFrame([("a",), ("b",)], "doc_key string")
    of = lambda **k: {r["doc_key"]: r["state"] for r in files.file_states(rows, there, done, **k).collect()}
    assert of() == {"a": "ignorado_existente", "b": "ignorado_ja_traduzido", "c": "pendente"}
    assert of(overwrite=True, skip_translated=False) == dict.fromkeys("abc", "pendente")
