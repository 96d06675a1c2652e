"""What keeps the work of the layout and language steps in proportion to their input: plans, and cheaper forms against plain ones."""

import re
import time
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as tx
from folioflow.functions.glossary import glossary, profile_of
from folioflow.functions.terms import terms_of
from folioflow.operators import layout, ngrams, recovery, trees
from folioflow.operators.backends import LexicalModel, runner
from folioflow.plans.stages import staged
from folioflow.queries import layout as queries
from folioflow.queries import routing
from folioflow.sources.layout_view import layout_lines
from tests.compare import SF

WHITE = r"[\t-\r \x85\xa0  -     　]"
ODD = [
    "", " ", "\n", "\t", "a", " a ", "a  b", "a\tb", "a \t b", "a\nb", "a \n b", "a\n\n b", " a ", "a  \n\t b\n", "­x­ y", "\x1ca\x1c", "　\n ", "a\r\nb", "ab1", "a1b2c", "é à ü",
    "12 / 14", "Page 3 of 9", "www.example.org", "https://x.y/z w", "doi: 10.1234/abc", "10.12345/xab y", "a.b@c.de", "a@b", "see orcid.org/0000 x", "see orcid.org/0000 x y z", "x\ny@z.de",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_staged_tables_are_read_by_columns(spark):
    rows = staged(spark.range(5).select("id", F.lit("x" * 50).alias("text")))
    assert rows.inputFiles() and rows.count() == 5
    assert "ReadSchema: struct<id:bigint>" in plan(rows.select("id"))


def test_normalised_texts_equal_plain_ones(spark):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(ODD)], "k int, x string")
    found = {r["k"]: r for r in rows.select("k", tx.normalize_spaces("x").alias("t"), tx.strip("x").alias("s"), tx.latin_letters("x").alias("n")).collect()}
    for k, x in enumerate(ODD):
        whole = re.sub(rf"{WHITE}*\n{WHITE}*", "\n", re.sub("[ \t]+", " ", x.replace("\xad", "")))
        ends = lambda v: re.sub(rf"\A{WHITE}+|{WHITE}+\Z", "", v)
        assert (found[k]["t"], found[k]["s"], found[k]["n"]) == (ends(whole), ends(x), len(re.findall(f"[{tx.LATIN}]", x))), repr(x)


def test_noise_of_odd_lines(spark):
    rows = spark.createDataFrame([(x,) for x in [*ODD, None]], "x string")
    noisy = {r["x"] for r in rows.filter(tx.is_noise("x")).collect()}
    clear = {"a1b2c", "é à ü", "https://x.y/z w", "10.12345/xab y", "see orcid.org/0000 x y z", "x\ny@z.de"}
    # three Latin letters at least, and nothing that stands alone
    assert clear & noisy == set()
    assert {None, "ab1", "12 / 14", "Page 3 of 9", "www.example.org", "doi: 10.1234/abc", "a.b@c.de", "see orcid.org/0000 x", "a@b"} <= noisy


def test_units_of_a_page_pass_in_batches(spark):
    block = "doc_key string, page_no int, place int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, column string, paragraph_break_before boolean, width double, height double, lines array<struct<line_no:int,line_text:string,x0:double,y0:double,x1:double,y1:double,font_size:double>>"
    of = lambda doc, page, place, text, y: (doc, page, place, text, 10.0, y, 300.0, y + 10, 10.0, "single", False, 600.0, 800.0, [(place, text, 10.0, y, 300.0, y + 10, 10.0)])
    rows = [of(d, p, k, f"{d} page {p} line {k} goes on" + ("." if k == 2 else ""), 10.0 + 12 * k + (30 if k == 3 else 0)) for d in "ab" for p in range(200) for k in (3, 1, 2)]
    found = layout.units(spark.createDataFrame(rows, block))
    assert "MapInArrow" in plan(found) and "InPandas" not in plan(found)
    got = sorted((r["doc_key"], r["page_no"], r["unit_no"], r["text"], r["n_lines"]) for r in found.collect())
    assert got == sorted(x for d in "ab" for p in range(200) for x in ((d, p, 1, f"{d} page {p} line 1 goes on {d} page {p} line 2 goes on.", 2), (d, p, 2, f"{d} page {p} line 3 goes on", 1)))


def test_laid_out_texts_are_read_once_for_their_lines(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    assert plan(layout_lines(documents)).split("Initial Plan")[-1].count(documents.inputFiles()[0].split("/", 3)[-1].lstrip("/")) <= 2


@pytest.fixture(scope="module")
def model(spark):
    return ngrams.learn(spark.createDataFrame([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("x", "de"), (None, "en")], "text string, lang string"), ["en", "fr"])


def test_scores_move_no_text(spark, model):
    rows = spark.createDataFrame([(1, "the cat"), (2, None), (3, "1 2"), (4, "le  chien, et")], "id int, text string")
    found = ngrams.scored(rows, "text", model)
    assert "Exchange" not in plan(found)
    scores = {r["id"]: [s["score"] for s in r["lang_scores"]] for r in found.collect()}
    assert scores[1][0] > 0.9 and scores[4][1] > 0.9 and scores[2] == scores[3] == [0.5, 0.5]


def test_classes_of_joined_words_equal_those_of_each(spark):
    texts = ["the cat", "a", "Éa b  ccc!d", "\U0001d400b x", "ab"]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string")
    each = rows.select("k", F.explode(ngrams.words("x")).alias("w")).select("k", F.explode(ngrams.ngram_buckets("w")).alias("b"))
    wanted = {r["k"]: sorted(r["b"]) for r in each.groupBy("k").agg(F.collect_list("b").alias("b")).collect()}
    joined = {r["k"]: r["j"] for r in rows.select("k", ngrams.words_joined("x").alias("j")).collect()}
    assert {k: sorted(int(b) for part in ngrams.joined_buckets(joined[k]) for b in part) for k in joined} == wanted


def test_last_words_of_long_runs(spark):
    texts = ["", "1", "one two", "one two!", "é1 b2 ", "x\ny\n", "a" * 60_000 + "1 b ", "A-B"]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string")
    start = time.perf_counter()
    found = {r["k"]: r["w"] for r in rows.select("k", tx.last_word("x").alias("w")).collect()}
    assert found == {k: (re.findall(f"[{tx.LATIN}]+", x.lower()) or [""])[-1] for k, x in enumerate(texts)}
    assert time.perf_counter() - start < 8  # a run that is tried from each of its letters takes far longer


def test_parts_are_moved_once_for_their_answers(spark, tmp_path):
    told = str(tmp_path)

    class Told(LexicalModel):
        def translate(self, texts, source, target, beam):
            (Path(told) / uuid.uuid4().hex).write_text("\n".join(texts), encoding="utf-8")
            return super().translate(texts, source, target, beam)

    parts = spark.createDataFrame([(f"k{k}", k % 3, "", "fr", ["le", f"chat{k % 7}"]) for k in range(300)], "key string, nth int, path string, lang string, units array<string>")
    found = recovery.asked(parts, runner(f"told-{told}", Told, "pt").stages[0], "pt", 1).collect()
    assert sorted((r["key"], r["nth"], r["value"]) for r in found) == sorted((f"k{k}", k % 3, f"o chat{k % 7}") for k in range(300))
    assert sorted(x for p in tmp_path.iterdir() for x in p.read_text(encoding="utf-8").split("\n")) == [f"le chat{k}" for k in range(7)]


@pytest.mark.parametrize("whole", [20_000, 3])
def test_trees_of_bounded_size_take_no_rounds(spark, monkeypatch, whole):
    calls = []
    real = trees.rewritten
    monkeypatch.setattr(trees, "rewritten", lambda *a: calls.append(1) or real(*a))
    monkeypatch.setattr(trees, "WHOLE_NODES", whole)
    docs = {"chain": {str(k): [str(k + 1)] for k in range(40)} | {"40": None}, "bush": {"0": ["2", "1", "no"], "1": [], "2": ["3"], "3": None}, "two": {"0": ["1"], "1": []}}
    nodes = spark.createDataFrame([(d, n, kids) for d, all_ in docs.items() for n, kids in all_.items()], "doc_key string, node_id string, child_ids array<string>")
    roots = spark.createDataFrame([("chain", "0"), ("chain", "38"), ("bush", "0"), ("two", "0"), ("two", "9")], "doc_key string, root string")
    got = {}
    for r in trees.descendants(nodes, roots).orderBy("pre").collect():
        got.setdefault((r["doc_key"], r["root"]), []).append(r["node_id"])
    assert got == {("chain", "0"): [str(k) for k in range(1, 41)], ("chain", "38"): ["39", "40"], ("bush", "0"): ["2", "3", "1"], ("two", "0"): ["1"]}
    assert bool(calls) == (whole == 3)


def test_patterns_wait_for_what_they_start_from(spark):
    told = plan(spark.createDataFrame([("a",)], "x string").select(tx.normalize_spaces("x").alias("t"), tx.is_standalone_math("x").alias("m")))
    assert "Contains" in told and f"RLIKE(x, {tx.MATH_SIGN})" not in re.sub(r"#\d+", "", told)
    assert all("CASE WHEN" in told[: at.start()] for at in re.finditer("regexp_replace", told))
    rows = spark.createDataFrame([(x,) for x in ("a = b", "sin x ≤ 1", "a = word", "a b", "", "x­ = y", "[a]", "dx√y", None)], "x string")
    found = {r["x"]: r["m"] for r in rows.select("x", tx.is_standalone_math("x").alias("m")).collect()}
    assert found == {"a = b": True, "sin x ≤ 1": True, "a = word": False, "a b": False, "": False, "x­ = y": True, "[a]": False, "dx√y": True, None: None}


def windows(node):
    """Window nodes of an optimized plan."""
    below = [node.children().apply(k) for k in range(node.children().size())]
    return [*([node] if node.nodeName() == "Window" else []), *[w for b in below for w in windows(b)]]


def test_states_of_pages_move_no_text(spark):
    found = windows(routing.q_status_totals(spark, str(SF))._jdf.queryExecution().optimizedPlan())
    by_page = [w.children().apply(0).output().mkString(",") for w in found if "min(" in w.toString().split("\n")[0]]
    assert by_page and not [x for x in by_page if "text#" in x]


@pytest.mark.parametrize("name", ["q_two_columns", "q_reading_order", "q_body_font"])
def test_lines_of_blocks_are_written_for_units_alone(spark, monkeypatch, name):
    written = []
    monkeypatch.setattr(queries, "staged", lambda df: written.append(df.columns) or staged(df))
    assert queries.QUERIES[name](spark, str(SF)).count() > 0
    assert written and not [x for x in written if "lines" in x]


def test_glossary_takes_texts_in_slices(spark):
    texts = [None if k % 7 == 3 else "" if k % 7 == 5 else f"O Feedback {k} e data do ambiente." for k in range(700)]
    rows = spark.createDataFrame([(k, "le milieu et la rétroaction", x, ["fr", "pt", None][k % 3]) for k, x in enumerate(texts)], "k int, s string, x string, lang string").coalesce(1)
    found = rows.select("k", glossary("s", "x", "lang", "didatica_matematica", {"data": "dados"}).alias("g"))
    assert "], 250" in plan(found)  # Arrow arrays, of which TEXTS rows at once are Python objects, not pandas series of a whole batch
    profile, terms = profile_of("didatica_matematica"), terms_of((("data", "dados"),))
    for r in found.collect():
        text, n = texts[r["k"]], 0
        if text is not None:
            if r["k"] % 3 == 0:
                text, n = profile["fr"].put("le milieu et la rétroaction", text)
            text, more = terms.put(text)
            n += more
        assert tuple(r["g"]) == (text, n)
