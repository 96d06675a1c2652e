"""Operators on small tables: folds, columns, states, caches, trees, files."""

import json
import random
import zipfile

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.config import Options
from folioflow.operators import axtree, backends, language, layout, report, running
from folioflow.operators.translate import full_key, translate, valid_cache
from folioflow.operators.unit_fold import cuts, fold_page
from folioflow.plans import documents
from folioflow.sources import files, models, pdf
from folioflow.sources.sinks import write_run

EMPTY_CACHE = "key string, value string"


# running values ------------------------------------------------------------------------------------


def test_running_values(spark):
    rng = random.Random(2)
    rows = [(f"k{rng.randrange(3)}", n, rng.choice([0, 1, None]), rng.randrange(9)) for n in range(300)]
    df = spark.createDataFrame(rows, "doc_key string, page_no int, e int, v int").repartition(7)
    sums = {r["page_no"]: r["before"] for r in running.sum_before(df, "doc_key", "page_no", "v", "before", stretch=10).collect()}
    last = {r["page_no"]: r["state"] for r in running.last_so_far(df, "doc_key", "page_no", [], F.col("e"), "state", stretch=10).collect()}
    for k, n, _, _ in rows:
        mine = [r for r in rows if r[0] == k]
        assert sums[n] == sum(r[3] for r in mine if r[1] < n)
        assert last[n] == next((r[2] for r in reversed(mine) if r[1] <= n and r[2] is not None), None)


# layout --------------------------------------------------------------------------------------------


def test_reading_order_with_orphan(spark):
    cols = "doc_key string, page_no int, orig_no int, x0 double, y0 double, x1 double, y1 double, width double, two_columns boolean"
    rows = [("d", 1, 1, 50.0, 50.0, 280.0, 80.0, 600.0), ("d", 1, 2, 10.0, 0.0, 590.0, 100.0, 600.0), ("d", 1, 3, 320.0, 150.0, 550.0, 180.0, 600.0)]
    df = spark.createDataFrame([(*r, True) for r in rows], cols)
    found = layout.reading_order(df.drop("two_columns"), df.select("doc_key", "page_no", "two_columns").distinct()).orderBy("place").collect()
    assert [r["column"] for r in found] == ["wide", "right", "left"]


def test_margin_thresholds(spark):
    for n_pages, least in ((4, 3), (12, 3), (13, 4), (20, 5)):
        pages = spark.createDataFrame([("d", p, 600.0, 800.0) for p in range(1, n_pages + 1)], "doc_key string, page_no int, width double, height double")
        line = lambda text, upto: [("d", p, 0, 0, text, 50.0, 10.0, 500.0, 20.0, 9.0) for p in range(1, upto + 1)]
        lines = spark.createDataFrame(line("Enough pages", least) + line("Not so many", least - 1), "doc_key string, page_no int, block_no int, line_no int, text string, x0 double, y0 double, x1 double, y1 double, font_size double")
        assert [r["margin_key"] for r in layout.margin_keys(lines, pages).collect()] == ["enough pages"]


def test_page_box(spark):
    df = spark.sql("SELECT named_struct('x', 10D, 'y', 20D, 'w', 100D, 'h', 10D) AS b, named_struct('x', 0D, 'y', 0D, 'w', 200D, 'h', 400D) AS p")
    assert tuple(df.select(layout.to_page_box("b", "p", F.lit(600.0), F.lit(800.0)).alias("r")).first()["r"]) == (30.0, 40.0, 330.0, 60.0)


def block(text, y0, **more):
    line = {"text": text, "x0": 50.0, "y0": y0, "x1": 500.0, "y1": y0 + 10, "font_size": 10.0}
    return {"doc_key": "d", "page_no": 1, "column": "single", "paragraph_break_before": False, "body_font": 10.0, "head": False, "small": True, "width": 600.0, "height": 800.0, "lines": [line], **line, **more}


def test_fold():
    rows = pd.DataFrame([block("this goes", 10), block("on and ends.", 22), block("Far away", 200), block("other font", 212, font_size=20.0)])
    assert fold_page(rows, 1200, 3500, True)["text"].tolist() == ["this goes on and ends.", "Far away", "other font"]
    assert len(fold_page(rows, 1200, 3500, False)) == 4


def plain_cuts(sizes, stops, limit, most):
    out, rest = [], list(range(len(sizes)))
    while rest:
        ends = [(sum(sizes[i] for i in rest[:k]) + k - 1, k) for k in range(1, len(rest) + 1)]
        good = [(abs(n - limit), k) for n, k in ends if 0.55 * limit <= n <= 1.35 * limit and stops[rest[k - 1]]]
        if ends[-1][0] <= limit:
            k = len(rest)
        elif good:
            k = min(good)[1]
        elif ends[-1][0] <= most:
            k = len(rest)
        else:
            k = max([k for n, k in ends if n <= most], default=1)
        rest = rest[k:]
        out.append(len(sizes) - len(rest))
    return out


def test_cuts_equal_plain_ones():
    rng = random.Random(3)
    for _ in range(3_000):
        n = rng.randrange(0, 40)
        sizes, stops = [rng.choice([0, 3, 20, 80, 200, 900]) for _ in range(n)], [rng.random() < 0.3 for _ in range(n)]
        limit = rng.choice([200, 300, 1200])
        most = max(rng.choice([400, 3500]), int(1.6 * limit))
        assert cuts(sizes, stops, limit, most) == plain_cuts(sizes, stops, limit, most)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.booleans()), min_size=1, max_size=40), st.integers(200, 800))
def test_cuts_keep_all_lines(lines, limit):
    sizes, stops = [x for x, _ in lines], [x for _, x in lines]
    most = max(3500, int(1.6 * limit))
    found = cuts(sizes, stops, limit, most)
    assert found == sorted(set(found))
    assert found[-1] == len(sizes)
    for a, b in zip([0, *found], found, strict=False):
        assert b == a + 1 or sum(sizes[a:b]) + b - a - 1 <= max(most, 1.35 * limit)


# languages -----------------------------------------------------------------------------------------


def test_routes(spark):
    rows = spark.createDataFrame([(0, "fr", "en", "1"), (1, "en", "pb", "1"), (2, "fr", "en", "1.2"), (3, "fr", "en", "1.10")], "nth int, from_code string, to_code string, version string")
    of = lambda a, b: [(r["hop"], r["from_code"], r["to_code"], r["version"]) for r in language.routes(rows, a, b).orderBy("hop").collect()]
    assert of("fr", "pt-br") == [(1, "fr", "en", "1.10"), (2, "en", "pb", "1")]
    assert of("en", "fr") == []
    assert of("fr", "fr") == []


def test_sample_stops_when_full(spark):
    pages = spark.createDataFrame([("d", p, "x" * 3000) for p in range(1, 60)] + [("e", 1, None)], "doc_key string, page_no int, text string")
    assert language.sample_pages(pages).count() == 40
    found = {r["doc_key"]: r["dominant"] for r in language.dominant_language(pages, ["fr", "en"], "fr").collect()}
    assert found["e"] == "en"


# translation ---------------------------------------------------------------------------------------


class Faulty(backends.LexicalModel):
    """Loses markers, fails on some words, and is empty for others."""

    def translate(self, texts, source, target, beam):
        if any("boom" in t for t in texts):
            raise RuntimeError("no memory")
        out = [t.replace("ZXQKEEP", "") if "drop" in t else "" if "void" in t else f"<{t}>" for t in texts]
        return out


def run_with(spark, texts, cache=(), model=Faulty, name="faulty", **more):
    units = spark.createDataFrame([(t, "fr") for t in texts], "text string, lang string")
    known = spark.createDataFrame(list(cache), EMPTY_CACHE)
    results, added = translate(units, known, backends.runner(name, model, "pt"), "pt", "ns", **more)
    return {r["text"]: r for r in results.collect()}, added


def test_translate(spark):
    texts = ["bonjour", "bonjour", "see ABC now", "please drop ABC here", "boom", "boom and ABC", "void", None]
    found, added = run_with(spark, texts)
    assert found["bonjour"]["translation"] == "<bonjour>"
    assert found["see ABC now"]["translation"] == "<see ABC now>"
    assert (found["please drop ABC here"]["translation"], found["please drop ABC here"]["n_recovered"]) == ("please drop ABC <here>", 1)
    assert found["boom"]["translation"] is None
    assert "no memory" in found["boom"]["error"]
    assert found["boom and ABC"]["error"] is not None
    assert found["void"]["error"] is not None
    assert (found[""]["translation"], found[""]["error"]) == ("", None)
    key = spark.range(1).select(full_key("ns", F.lit("bonjour"), F.lit("fr"), "pt")).first()[0]
    assert {r["key"]: r["value"] for r in added.collect()}[key] == "<bonjour>"


def test_cache_is_used(spark):
    key = spark.range(1).select(full_key("ns", F.lit("bonjour"), F.lit("fr"), "pt")).first()[0]
    found, added = run_with(spark, ["bonjour"], [(key, "olá")])
    assert (found["bonjour"]["translation"], found["bonjour"]["n_cached"]) == ("olá", 1)
    assert added.count() == 0
    found, _ = run_with(spark, ["bonjour"], [(key, "<html><body>503"), (None, "x")])
    assert found["bonjour"]["translation"] == "<bonjour>"


def test_valid_cache(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", " "), ("c", None), ("d", "HTTP 500 error"), ("e", "Too many requests.")], EMPTY_CACHE)
    assert [tuple(r) for r in valid_cache(df).collect()] == [("a", "x")]


# states --------------------------------------------------------------------------------------------


def test_skipped_page(spark):
    rows = spark.createDataFrame([("d", 1, 1, None, "fr", "a", None), ("d", 1, 2, None, "fr", None, "e"), ("d", 1, 3, "referencia", "fr", None, None), ("d", 1, 4, None, "fr", "b", None), ("d", 2, 1, None, "pt", "c", None)], "doc_key string, page_no int, unit_no int, kind string, lang string, translation string, error string")
    of = lambda policy, mixed: [r["state"] for r in report.states(rows, "pt", mixed, policy).orderBy("page_no", "unit_no").collect()]
    assert of("pular_pagina", True) == ["traduzido", "falhou", "pulado", "pulado", "preservado"]
    assert of("continuar", False) == ["traduzido", "falhou", "preservado", "traduzido", "traduzido"]
    with pytest.raises(Exception, match="translation failed"):
        of("parar", False)


def test_batch_state(spark):
    of = lambda states: report.batch_totals(spark.createDataFrame([(s, 2) for s in states], "state string, n_reviews long")).first()["estado"]
    assert of(["erro", "concluido"]) == "concluido_com_erros"
    assert of(["concluido_com_pendencias"]) == "concluido_com_pendencias"
    assert of(["ignorado_existente"]) == "concluido"
    assert of([]) == "sem_arquivos"


def test_note_places(spark):
    rows = spark.createDataFrame([(38,), (39,)], "n int")
    x, y = report.note_place("n", F.lit(600.0), F.lit(800.0))
    assert [tuple(r) for r in rows.select(x, y).collect()] == [(586.0, 758.0), (570.0, 18.0)]


def test_whole_run(spark, tmp_path):
    line = lambda p, k, text: ("d", p, k, k, text, 60.0, 100.0 + 30 * k, 540.0, 112.0 + 30 * k, 10.0)
    lines = [line(1, 0, "The cat of the house is in the garden and it is small."), line(1, 1, "x = 2 + sin x, with text to keep ABC."), line(2, 0, "References"), line(2, 1, "Author, A. (2001). The book of all."), line(3, 0, "12")]
    df = spark.createDataFrame(lines, "doc_key string, page_no int, block_no int, line_no int, text string, x0 double, y0 double, x1 double, y1 double, font_size double")
    pages = spark.createDataFrame([("d", p, 600.0, 800.0) for p in (1, 2, 3)], "doc_key string, page_no int, width double, height double")
    empty = spark.createDataFrame([], EMPTY_CACHE)
    rows, added = documents.run(df, pages, empty, backends.runner("stand-in", backends.LexicalModel, "pt"), "ns", Options(source="en,fr"))
    found = rows.orderBy("page_no", "unit_no").collect()
    assert [r["state"] for r in found if r["page_no"] == 2] == ["preservado"] * len([r for r in found if r["page_no"] == 2])
    assert all(r["state"] == "traduzido" for r in found if r["page_no"] == 1)
    assert added.count() > 0
    write_run(rows, pages, "pt", str(tmp_path / "out"))
    out = json.loads(json.loads(spark.read.text(str(tmp_path / "out/reports")).first()[0])["report"])
    assert out["estado"] == "concluido_com_pendencias"  # page 3 has no text
    assert out["paginas_sem_texto"] == [3]


# accessibility trees -------------------------------------------------------------------------------


def test_dump(spark):
    dump = """region name='Page 2' location=(0, 0) size=(600, 800)
  staticText name='Alone at the start' location=(1, 2) size=(3, 4)
  inlineTextBox location=(1, 2) size=(3, 4)
  paragraph location=(5, 5) size=(9, 9)
    staticText name='It\\'s a para-'
    inlineTextBox bounds=(7, 8, 9, 10)
    staticText name='graph'
  heading
    staticText 'Start of extracted text'
  paragraph
    staticText name='Powered by Google AI'"""
    df = spark.createDataFrame([("d", k, x) for k, x in enumerate(dump.split("\n"))], "doc_key string, line_no int, line string")
    found = axtree.dump_units(df).orderBy("nth").collect()
    assert [(r["page_no"], r["nth"], r["text"]) for r in found] == [(2, 1, "Alone at the start"), (2, 2, "It's a paragraph")]
    assert tuple(found[1]["bounds"]) == (5.0, 5.0, 9.0, 9.0)
    assert [tuple(x) for x in found[1]["line_bounds"]] == [(7.0, 8.0, 9.0, 10.0)]


def test_nodes(spark):
    nodes = [
        ("d", 0, "r", "region", "Page 4", ["p", "s3", "s4"]), ("d", 1, "p", "Paragraph", "", ["s1", "s2", "r"]), ("d", 2, "s1", "StaticText", "First part", ["b1"]), ("d", 3, "b1", "InlineTextBox", "First part", []),
        ("d", 4, "s2", "StaticText", "second part", None), ("d", 5, "s3", "StaticText", "Left over one.", []), ("d", 6, "s4", "StaticText", "Left over two", []), ("e", 0, "x", "StaticText", "No page at all", []),
    ]
    df = spark.createDataFrame(nodes, "doc_key string, pos long, node_id string, role string, name string, child_ids array<string>")
    found = sorted((r["doc_key"], r["page_no"], r["nth"], r["text"]) for r in axtree.node_units(df).collect())
    assert found == [("d", 4, 1, "First part second part"), ("d", 4, 2, "Left over one."), ("d", 4, 3, "Left over two"), ("e", 1, 1, "No page at all")]


def test_merging_and_targets(spark):
    unit = "doc_key string, page_no int, nth int, text string"
    a, b = spark.createDataFrame([("d", 1, 1, "a"), ("d", 1, 2, "b")], unit), spark.createDataFrame([("d", 1, 1, "b "), ("d", 1, 2, "c")], unit)
    assert [r["text"] for r in axtree.merged(a, b).orderBy("nth").collect()] == ["a", "b", "c"]
    targets = spark.createDataFrame([(0, "page", "x.pdf", "u"), (1, "page", "other", "none"), (2, "worker", "x.pdf", ""), (3, "page", "doc", "http://h/x.pdf")], "pos int, type string, title string, url string")
    assert [r["pos"] for r in axtree.ranked_targets(targets, "x.pdf", "http://h/x.pdf").collect()] == [3, 0]


def test_cached_pages(spark):
    cache = spark.createDataFrame([("h", 1, "a" * 40), ("h", 2, "b" * 10), ("g", 1, "c" * 35)], "sha256 string, page_no int, text string")
    asked = spark.createDataFrame([("d", "h", 1), ("d", "h", 2), ("e", "g", 1), ("f", "h", 1)], "doc_key string, sha256 string, page_no int")
    assert sorted((r["doc_key"], r["page_no"]) for r in axtree.cached_pages(cache, asked).collect()) == [("e", 1), ("f", 1)]


# files ---------------------------------------------------------------------------------------------


def test_files(spark):
    names = ["/in/B.pdf", "/in/a.PDF", "/in/x.txt", "/in/a_traduzido_pt.pdf", "/in/sub/c.pdf", "/in/out/d.pdf"]
    df = spark.createDataFrame([(f"file:{n}",) for n in names], "path string")
    flat = files.listed(df, "/in", "/in/out", "pt").collect()
    assert [(r["rel_path"], r["output_path"]) for r in flat] == [("a.PDF", "/in/out/a_traduzido_pt.PDF"), ("B.pdf", "/in/out/B_traduzido_pt.pdf")]
    assert [r["rel_path"] for r in files.listed(df, "/in", "/in/out", "pt", recursive=True).collect()] == ["a.PDF", "B.pdf", "sub/c.pdf"]
    notes = spark.createDataFrame([("d", "x", "Tradução FR → PT"), ("e", None, "other"), ("f", "A Tradução Automática", None)], "doc_key string, title string, subject string")
    assert sorted(r[0] for r in files.has_translation(notes).collect()) == ["d", "f"]


def test_scan_and_json_cache(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"%PDF")
    (tmp_path / "b.txt").write_bytes(b"")
    assert [r["rel_path"] for r in files.scan(spark, str(tmp_path), str(tmp_path / "out"), "pt").collect()] == ["a.PDF"]
    (tmp_path / "j").mkdir()
    (tmp_path / "j/good.json").write_text('{\n "k": "v"}')
    (tmp_path / "j/bad.json").write_text("[1")
    assert [tuple(r) for r in files.cache_from_json(spark, str(tmp_path / "j")).collect()] == [("k", "v")]


def test_pdf_rows():
    found = {"blocks": [{"type": 1}, {"type": 0, "lines": [{"bbox": (1, 2, 3, 4), "spans": [{"text": "a", "size": 8}, {"text": "b", "size": 12}, {"text": " ", "size": 99}]}]}]}
    assert list(pdf.rows_of("p", [(1, 600.0, 800.0, found)])) == [("p", 1, 600.0, 800.0, 0, 0, "ab ", 1.0, 2.0, 3.0, 4.0, 10.0, None)]


def test_model_packages(tmp_path):
    def archive(name, members):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for k, v in members.items():
                z.writestr(k, v)
        return str(tmp_path / name)

    meta = json.dumps({"from_code": "fr", "to_code": "en", "package_version": "1.2"})
    good = archive("g", {"m/metadata.json": meta, "m/model/model.bin": "x", "m/sentencepiece.model": "y", "m/stanza/z": "no", "m/README.md": "r"})
    at = models.install(good, str(tmp_path / "models"))
    assert at.name == "fr_en_1_2"
    assert (at / "README.md").exists()
    assert not (at / "stanza").exists()
    assert models.install(good, str(tmp_path / "models")) == at
    assert [x[1:4] for x in models.installed(str(tmp_path / "models"))] == [("fr", "en", "1.2")]
    for k, members in enumerate([{"../metadata.json": meta}, {"metadata.json": meta.replace("1.2", "3")}, {"a/metadata.json": meta, "b/metadata.json": meta}, {"metadata.json": '{"from_code": "F"}'}]):
        with pytest.raises(ValueError):
            models.install(archive(f"bad{k}", members), str(tmp_path / "models"))


# streaming -----------------------------------------------------------------------------------------


def test_inbox(spark, tmp_path):
    from folioflow.sources.cache_store import CacheStore
    from folioflow.streaming import inbox

    paths = {k: str(tmp_path / k) for k in ("in", "cache", "results", "state")}
    units = lambda *texts: spark.createDataFrame([(t, "fr") for t in texts], "text string, lang string").coalesce(1).write.mode("append").parquet(paths["in"])
    go = lambda: inbox.start(spark, paths["in"], "text string, lang string", paths["cache"], paths["results"], paths["state"], backends.runner("stand-in", backends.LexicalModel, "pt"), "pt", "ns").awaitTermination()
    units("le chat", "la maison")
    go()
    units("le chat", "new ones")
    go()
    found = {(r["batch"], r["text"]): r["n_cached"] for r in spark.read.parquet(paths["results"]).collect()}
    assert found[1, "le chat"] == 1
    assert found[1, "new ones"] == 0
    assert CacheStore(spark, paths["cache"]).entries().count() == 3


# catalog, one text, sums ---------------------------------------------------------------------------


def test_catalog(spark):
    from folioflow.operators import catalog

    assert catalog.models(spark).count() == 3
    assert catalog.model_name(None) == "nllb_1_3b"
    assert catalog.model_name("NLLB-600") == "nllb_600m"
    assert catalog.nllb_code("pt") == "por_Latn"
    for bad in (lambda: catalog.model_name("x"), lambda: catalog.nllb_code("pb")):
        with pytest.raises(ValueError):
            bad()


def test_one_text_and_sums(spark):
    from folioflow.plans.one_text import translate_text

    go = lambda text, **more: translate_text(spark, text, backends.runner("stand-in", backends.LexicalModel, "pt"), Options(**more))
    assert go("le facto", source="fr", variant="br") == "o fato"
    assert go("o livro e a casa que não é uma das mais", source="fr,pt") == "o livro e a casa que não é uma das mais"
    with pytest.raises(ValueError):
        translate_text(spark, "boom", backends.runner("faulty", Faulty, "pt"), Options(source="fr"))
    units = spark.createDataFrame([("le (Silva, 2001) chat", "fr"), ("le chien", "fr")], "text string, lang string")
    results, _ = translate(units, spark.createDataFrame([], EMPTY_CACHE), backends.runner("stand-in", backends.LexicalModel, "pt"), "pt", "ns")
    found = report.model_stats(results).first()
    assert (found["fragmentos_locais"], found["fragmentos_cache"], found["elementos_protegidos"], found["motores"]) == (2, 0, 1, ["local"])
