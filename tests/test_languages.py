"""Languages by learned n-grams: accuracy on texts that weren't learned from, odd texts, and the layout of rows that share an id."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioflow.functions import language as lg
from folioflow.operators import language, ngrams
from folioflow.sources.layout_view import layout_lines
from tests.compare import SF

CODES = ["en", "fr", "es", "de"]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF.rsplit('/', 1)[0]}/sf0.01/documents.parquet").select("doc_id", "text", "lang")


@pytest.fixture(scope="module")
def model(documents):
    return ngrams.learn(documents.filter("doc_id % 4 != 2"), CODES)


def test_held_out_accuracy(documents, model):
    rows = ngrams.scored(documents.filter("doc_id % 4 = 2"), "text", model)
    told = rows.withColumn("best", lg.best(F.col("lang_scores"))["code"]).filter(F.length("text") >= 40)
    n, right = told.agg(F.count("*"), F.count_if(F.col("best") == F.col("lang"))).first()
    assert n > 200 and right / n > 0.97, (n, right)


def plain_buckets(word):
    codes = [ord(c) for c in f" {word} "]
    return Counter((sum(f * c for f, c in zip((1, 263, 69_169), codes[k : k + n])) + 7_919 * n) % 65_536 for n in (1, 2, 3) for k in range(len(codes) - n + 1))


def test_buckets(spark):
    words = ["a", "été", "straße", "日本語", "𝒳y", "x" * 5_000]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", ngrams.ngram_buckets("w").alias("b")).collect()
    assert {r["w"]: Counter(r["b"]) for r in rows} == {w: plain_buckets(w) for w in words}


def test_scores_equal_plain_ones(spark):
    texts = [("the cat the", "en"), ("le chat", "fr"), ("der Hund", "de"), (None, "en"), ("of", None), ("unknown", "xx")]
    learned = ngrams.learn(spark.createDataFrame(texts, "text string, lang string"), CODES)
    counts = {k: Counter() for k in CODES}
    for text, lang in texts:
        if text and lang in counts:
            for w in text.lower().split():
                counts[lang] += plain_buckets(w)
    asked = ["the dog", "the dog", "LE", "", None, "123 !", "z" * 20_000]
    rows = spark.createDataFrame([(k, t, "clash", 1) for k, t in enumerate(asked)], "id int, text string, word string, n int")
    found = {r["id"]: {s["code"]: s["score"] for s in r["lang_scores"]} for r in ngrams.scored(rows, "text", learned).collect()}
    assert len(found) == len(asked)
    for k, text in enumerate(asked):
        if not text or text == "123 !":
            assert found[k] == dict.fromkeys(CODES, 0.25)
            continue
        sums = {c: sum(n * round(1000 * math.log((counts[c][b] + 1) / (sum(counts[c].values()) + 65_536))) for w in text[:15_000].lower().split() for b, n in plain_buckets(w).items()) for c in CODES}
        powers = {c: math.exp((s - max(sums.values())) / 1000) for c, s in sums.items()}
        assert all(abs(found[k][c] - powers[c] / sum(powers.values())) < 1e-9 for c in CODES), text


def test_units_by_model(spark, model):
    rows = [("d", "Résumé"), ("d", "x"), ("d", "the name of the rose is what it is and nothing else of that"), (None, None), ("e", "the name of the rose is what it is and nothing else of that")]
    units = spark.createDataFrame(rows, "doc_key string, text string")
    main = spark.createDataFrame([("d", "de"), ("e", "es")], "doc_key string, dominant string")
    found = {(r["doc_key"], r["text"]): (r["lang"], r["lang_reason"]) for r in language.with_language(units, main, CODES, model=model).collect()}
    assert found["d", "Résumé"] == ("fr", "cabecalho")
    assert found["d", "x"] == ("de", "predominante_texto_curto")
    assert found["e", rows[2][1]] == ("en", "estatistica_trecho")
    assert found[None, None] == (None, "predominante_texto_curto")
    assert language.with_language(units, main, CODES, model=model).columns == ["doc_key", "text", "lang", "lang_score", "lang_reason"]


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "text string, lang string")
    model = ngrams.learn(none, CODES)
    assert ngrams.scored(none, "text", model).count() == 0
    one = ngrams.scored(spark.createDataFrame([("a word", None)], "text string, lang string"), "text", model).first()
    assert [s["score"] for s in one["lang_scores"]] == [0.25] * 4


@pytest.mark.parametrize("ids", [[None] * 4, [7] * 4, [None, 7, 7, 3], [1, 2, 3, 4]])
@pytest.mark.parametrize("same", [True, False])
def test_layout_counts_rows_once(spark, ids, same):
    texts = ["one line of text"] * 4 if same else [f"line {k} of text\n\nsecond {k}" for k in range(4)]
    df = spark.createDataFrame([(i, t, "s", "clash") for i, t in zip(ids, texts)], "doc_id long, text string, source string, row string")
    rows = layout_lines(df).filter("line_no between 0 and 900").collect()
    assert sorted(r["text"] for r in rows) == sorted(line for t in texts for line in t.split("\n") if line)
    assert sorted({r["page_no"] for r in rows}) == [1, 2, 3, 4]
    by_page = {p: {r["text"] for r in rows if r["page_no"] == p} for p in (1, 2, 3, 4)}
    assert all(by_page[p] == {x for x in t.split("\n") if x} for p, t in zip((1, 2, 3, 4), texts)) or ids != [1, 2, 3, 4]
