"""Recovery as rounds against a plain recursive version: whole tables, budgets of parts and of texts, tokens and words."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators import backends, hops, recovery
from folioflow.queries import QUERIES
from folioflow.queries.routing import Forgetful
from folioflow.sources import models
from tests.compare import SF

TEXTS = "key string, lang string, text string"


class Gone(Exception):
    pass


def plain(text, stage, target):
    """(value, tries) depth first, with the tries of each part, or of all parts of a text."""
    made = stage.made()
    left = [stage.tries]
    total = [0]

    def cut(units):
        n = len(units)
        if stage.on_words:
            return n // 2 if n >= 4 else None
        starts = [k for k in range(1, n) if n <= 4 * k <= 3 * n and units[k].startswith("▁")]
        return min(starts, key=lambda k: (abs(2 * k - n), k)) if starts else None

    def one(units, beam):
        found, _, again = stage.answers([units], "fr", target, beam)[0]
        if found is None and not again:
            raise Gone
        return found

    def attempt(units, level):
        if not left[0]:
            raise Gone
        left[0] -= 1
        total[0] += 1
        found = one(units, 1)
        if found is not None:
            return found
        at = cut(units)
        if level == stage.depth or at is None:
            raise Gone
        return f"{attempt(units[:at], level + 1)} {attempt(units[at:], level + 1)}"

    out = []
    try:
        parts = made.split(text)
        if not parts:
            raise Gone
        for units in parts:
            found = one(units, stage.beam)
            if not stage.shared:
                left[0] = stage.tries
            out.append(attempt(units, 0) if found is None else found)
    except Gone:
        return None, None
    return " ".join(out), total[0]


def equal(spark, texts, stage):
    rows = spark.createDataFrame([(str(k), "fr", t) for k, t in enumerate(texts)], TEXTS)
    found = {r["key"]: (r["value"], r["n_tries"] if r["error"] is None else None) for r in recovery.translated(rows, backends.Runner((stage,), "pt", "n")).collect()}
    assert found == {str(k): plain(t, stage, "pt") for k, t in enumerate(texts)}
    return found


class Rule(backends.LexicalModel):
    """Fails on runs whose words' lengths make a multiple of 3, and on all of a kind."""

    def translate(self, texts, source, target, beam):
        if any("boom" in t for t in texts):
            raise RuntimeError("no memory")
        return ["" if sum(map(len, t.split())) % 3 == 0 or "void" in t else f"<{t}>" for t in texts]


def made_texts(seed, n=150):
    rng = random.Random(seed)
    words = ["a", "bb", "ccc", "dddd", "eeeee", "void", "Fff.", "Gg."]
    weights = [5, 5, 5, 5, 5, 0.1, 1, 1]
    return [" ".join(rng.choices(words, weights, k=rng.choice([1, 2, 4, 9, 20, 45]))) for _ in range(n)] + ["boom", "a boom b c d e f", "", "  "]


@pytest.mark.parametrize(("tries", "depth", "shared"), [(10, 3, False), (4, 2, False), (9, 3, True), (100, 5, True), (1, 0, False)])
def test_words(spark, tries, depth, shared):
    stage = backends.Stage(f"rule-{tries}-{depth}", lambda: backends.WordParts(Rule(), 12), tries=tries, depth=depth, shared=shared, batch=3)
    found = equal(spark, made_texts(tries), stage)
    states = [v is None for v, _ in found.values()]
    assert any(states) and not all(states)
    assert depth == 0 or any(n for _, n in found.values())


class Tokens:
    """Words as tokens, each in pieces of two letters. Rows of a length that 5 divides fail, longer ones than 90 are lost."""

    def encode(self, text):
        return [("▁" if k == 0 else "") + w[k : k + 2] for w in text.split() for k in range(0, len(w), 2)]

    def run(self, rows, beam):
        return [[] if len(r) % 5 == 0 or len(r) > 90 else r for r in rows]

    def decode(self, tokens):
        if not tokens:
            raise backends.ChunkError("nothing")
        return "".join(tokens).replace("▁", " ").strip()


def test_tokens(spark):
    rng = random.Random(4)
    texts = [" ".join("x" * rng.randrange(1, 9) for _ in range(rng.choice([1, 3, 8, 30, 90, 200]))) + rng.choice(["", ". Next one", "."]) for _ in range(120)] + ["", "y" * 600]
    found = equal(spark, texts, hops.stage("tokens", Tokens))
    assert {v is None for v, _ in found.values()} == {True, False}


def test_whole_table(spark):
    """q_recovery equals the plain version line by line."""
    stage = backends.Stage("plain-forgetful", lambda: backends.WordParts(Forgetful(), 24))
    docs = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    from folioflow.functions import text as tx

    rows = spark.createDataFrame([(x,) for t in docs for x in t.split("\n")], "x string").select(tx.normalize_spaces("x").alias("x")).filter("x != ''").distinct()
    rows = rows.select("x", F.md5("x").alias("key")).collect()
    import hashlib

    expected = {}
    for r in rows:
        value, tries = plain(r["x"], stage, "pt")
        expected[r["key"]] = ("failed" if value is None else "translated", None if value is None else hashlib.md5(value.encode()).hexdigest(), tries)
    found = {r["key"]: (r["state"], r["value_md5"], r["n_tries"]) for r in QUERIES["q_recovery"](spark, SF).collect()}
    assert found == expected
    assert sum(bool(t) for *_, t in expected.values()) > 20


class Letter(Tokens):
    """A package that puts a letter behind each word."""

    def __init__(self, letter):
        self.letter = letter

    def run(self, rows, beam):
        return [[t + (self.letter if k + 1 == len(r) or r[k + 1].startswith("▁") else "") for k, t in enumerate(r)] for r in rows]


def test_way_of_packages(spark, tmp_path):
    from folioflow.operators import language

    packages = spark.createDataFrame([(0, "fr", "en", "1.2", "/p/a"), (1, "en", "pb", "1.0", "/p/b"), (2, "fr", "en", "1.10", "/p/c")], "nth int, from_code string, to_code string, version string, path string")
    way = language.routes(packages.drop("path"), "fr", "pt-br")
    runner = hops.route_runner(way, packages, "pt", lambda path, to: Letter(path[-1]))
    rows = spark.createDataFrame([("k", "fr", "un deux. Trois"), ("l", "fr", "")], TEXTS)
    found = {r["key"]: (r["value"], r["error"], r["n_tries"]) for r in recovery.translated(rows, runner).collect()}
    assert found["k"] == ("uncb deux.cb Troiscb", None, 0)
    assert found["l"][0] is None and "no parts" in found["l"][1]
    assert hops.route_runner(way, packages, "pt", lambda *_: None).namespace == runner.namespace != hops.route_runner(language.routes(packages.drop("path"), "en", "pt-br"), packages, "pt").namespace
    with pytest.raises(ValueError, match="no way"):
        hops.route_runner(language.routes(packages.drop("path"), "pt-br", "fr"), packages, "pt")
    with pytest.raises(ValueError, match="not installed: fr-en 1.10"):
        hops.route_runner(way, packages.filter("nth < 2"), "pt")


def test_second_package_fails(spark):
    class Bad(Letter):
        def run(self, rows, beam):
            return [[] for _ in rows]

    runner = backends.Runner((hops.stage("good-x", lambda: Letter("x")), hops.stage("bad-x", lambda: Bad("y"))), "pt", "n")
    rows = spark.createDataFrame([("k", "fr", "un deux"), ("m", "fr", "un deux")], TEXTS)
    found = recovery.translated(rows, runner).collect()
    assert [(r["value"], r["error"] is not None) for r in found] == [(None, True)] * 2


def test_nothing(spark):
    assert recovery.translated(spark.createDataFrame([], TEXTS), backends.runner("stand-in", backends.LexicalModel, "pt")).count() == 0


def test_packed():
    class Counted(backends.LexicalModel):
        calls = 0

        def count_tokens(self, text):
            Counted.calls += 1
            return len(text.split())

    model = Counted()
    assert backends.packed("One two. Three four five six.", model, 3) == [["One", "two."], ["Three", "four", "five"], ["six."]]
    assert backends.packed(" ", model, 3) == [] and backends.packed("a", model, 0) == [["a"]]
    Counted.calls = 0
    assert [len(p) for p in backends.packed(" ".join(["w"] * 5_000), model, 2_000)] == [2_000, 2_000, 1_000]
    assert Counted.calls < 50


def test_model_folders(tmp_path):
    (tmp_path / "model").mkdir()
    (tmp_path / "model" / "model.bin").write_text("x")
    assert models.lacking(tmp_path, models.PACKAGE) == ["metadata.json", "sentencepiece.model"]
    (tmp_path / "metadata.json").write_text("[1]")
    assert models.metadata(tmp_path) == {} and models.metadata(tmp_path / "none") == {}
