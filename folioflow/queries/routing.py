"""Queries of languages, routes, caches, states, reports, files and accessibility trees."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.config import Options
from folioflow.functions import language as lg
from folioflow.functions import text as tx
from folioflow.operators import axtree, language, ngrams, report
from folioflow.operators.backends import LexicalModel, runner
from folioflow.operators.recovery import translated
from folioflow.operators.translate import valid_cache
from folioflow.plans import documents
from folioflow.plans.stages import dropped, shared_folder, staged
from folioflow.queries import duck, layout
from folioflow.queries.text import lines, table
from folioflow.sources import files
from folioflow.sources.cache_store import CacheStore
from folioflow.sources.layout_view import HEIGHT, WIDTH
from folioflow.streaming import finished

CODES = ["en", "fr", "es", "de"]


def _model(spark: SparkSession, sf_dir: str) -> ngrams.LanguageModel:
    """Learned from all documents but every fourth, which are left for a test of accuracy."""
    return ngrams.learn(table(spark, sf_dir, "documents").filter("doc_id % 4 != 2").select("text", "lang"), CODES)


def q_dominant_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source as a document, its texts as pages."""
    rows = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("doc_key"), F.col("doc_id").alias("page_no"), F.coalesce("text", F.lit("")).alias("text"))
    return language.dominant_language(rows, CODES, "pt", model=_model(spark, sf_dir)).select("doc_key", "dominant", F.round("score", 6).alias("dominant_score"))


def q_lang_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text by itself: its language, and whether a model has to be asked for a translation into English."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("doc_key"), "text")
    main = rows.select("doc_key", F.lit("fr").alias("dominant")).distinct()
    rows = language.with_language(rows, main, CODES, model=_model(spark, sf_dir))
    return rows.select("doc_id", F.col("lang").alias("unit_lang"), F.col("lang_reason").alias("reason"), F.round("lang_score", 6).alias("unit_score"), F.when(F.col("lang") == "en", "preserve").otherwise(F.col("lang")).alias("route"))


PACKAGES = [(0, "fr", "en", "1.2"), (1, "en", "pb", "1.0"), (2, "fr", "en", "1.10"), (3, "fr", "es", "2"), (4, "es", "it", "1"), (5, "it", "pb", "1"), (6, "de", "en", "1.9"), (7, "en", "fr", "1")]


def q_model_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(PACKAGES, "nth int, from_code string, to_code string, version string")
    parts = [language.routes(rows, a, b).withColumn("asked", F.lit(f"{a}-{b}")) for a, b in (("fr", "pt-br"), ("de", "pt-br"), ("fr", "it"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def q_dedupe_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a document, equal ones once, in the order of their first place."""
    rows = lines(spark, sf_dir).select("doc_id", "pos", tx.normalize_spaces("line").alias("t")).filter("t != ''")
    once = rows.groupBy("doc_id", "t").agg(F.min("pos").alias("pos"))
    return once.groupBy("doc_id").agg(F.count("*").alias("n_units"), F.sum("pos").alias("sum_first"), F.sum(F.length("t")).alias("n_chars_once"))


def q_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines against a cache of all lines that occur twice, in which those with a digit hold an error page."""
    rows = lines(spark, sf_dir).filter("trim(line) != ''").withColumn("key", tx.cache_key("line", F.coalesce("lang", F.lit("")), F.lit("pt")))
    value = F.when(F.col("line").rlike("[0-9]"), "<html><body>503</body></html>").otherwise(F.concat(F.lit("t "), F.col("line")))
    cache = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("line").alias("line")).filter("n > 1").select("key", value.alias("value"))
    found = rows.join(valid_cache(cache), "key", "left")
    return found.groupBy("lang").agg(F.count("*").alias("n_units"), F.count("value").alias("n_hits"), F.count_distinct(F.when(F.col("value").isNull(), F.col("key"))).alias("n_asked"))


def q_cache_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in two rounds against a store: those of every other document, then, with the store compacted, those of all; each round adds what was missing, and what a third finds is counted."""
    rows = lines(spark, sf_dir).filter("trim(line) != ''").select("lang", "doc_id", "line", tx.cache_key("line", F.coalesce("lang", F.lit("")), F.lit("pt")).alias("key"))
    store = CacheStore(spark, f"{shared_folder(spark)}/cache-{uuid.uuid4().hex}")

    def a_round(asked: DataFrame, number: int) -> None:
        missing = asked.join(staged(store.lookup(asked).select("key")), "key", "left_anti").groupBy("key").agg(F.min("line").alias("line"))
        value = F.when(F.col("line").rlike("[0-9]"), "<html><body>503</body></html>").otherwise(F.concat(F.lit(f"{number} "), F.col("line")))
        store.add(missing.select("key", value.alias("value")), number)

    a_round(rows.filter("doc_id % 2 = 0"), 1)
    store.compact()
    a_round(rows, 2)
    store.compact()
    found = rows.select("lang", "key").join(staged(store.lookup(rows).select("key", F.substring("value", 1, 1).alias("round"))), "key", "left")
    out = staged(found.groupBy("lang").agg(F.count("*").alias("n_units"), F.count_if(F.col("round") == "1").alias("n_first"), F.count_if(F.col("round") == "2").alias("n_second"), F.count_distinct(F.when(F.col("round").isNull(), F.col("key"))).alias("n_missing")))
    store.vacuum()
    store.close()
    return out


def _worked(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Body lines as units with a made-up outcome: errors, translations, and a language from their length."""
    # the length as a column, so that states by page move no text where none is asked for
    rows = layout.marked(spark, sf_dir, rows).withColumn("n", F.length("text"))
    n = F.col("n")
    rows = rows.withColumns({"kind": report.preserved_kind(tx.normalize_spaces("text"), "preserve"), "lang": F.when(n % 7 == 0, "pt").otherwise("fr"), "error": F.when(n % 11 == 0, "ValueError: x"), "translation": F.when(n % 11 != 0, F.concat(F.lit("t "), "text"))})
    rows = report.states(rows, "pt", mixed=True, policy="pular_pagina")
    return rows.withColumns({"flags": F.when((F.col("state") == "traduzido") & (n % 5 == 0), F.array(F.struct(F.lit("x").alias("code"), F.lit("y").alias("message")))).otherwise(F.array().cast("array<struct<code:string,message:string>>")), "providers": F.array(F.lit("local")), "ocr": n % 2 == 0}).drop("n")


#: What sums and states of units are made of.
OUTCOME = ["doc_key", "page_no", "unit_no", "state", "kind", "flags"]


def q_status_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.totals(_worked(spark, sf_dir))


def q_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    laid = layout.lines(spark, sf_dir)
    rows = staged(_worked(spark, sf_dir, laid).select(*OUTCOME))
    states = report.document_states(layout.pages(laid), rows)
    return report.batch_totals(states.join(report.totals(rows).select("doc_key", F.col("revisao_recomendada").alias("n_reviews")), "doc_key", "left"))


def q_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of all documents as a stream would bring them: those that are whole, with their sums and states."""
    laid = layout.lines(spark, sf_dir)
    rows = staged(_worked(spark, sf_dir, laid).select(*OUTCOME))
    pages = finished.page_totals(layout.pages(laid), rows)
    found = finished.documents_of(pages)
    return found.withColumn("n_empty", F.size("empty_pages")).drop("empty_pages")


def q_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents that were read several times: each turn is a snapshot of two pages, of which one is settled on."""
    rows = table(spark, sf_dir, "conversations").filter("conv_id is not null").groupBy("conv_id", "turn").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    page = lambda n, text: F.struct(F.lit(n).alias("page_no"), text.alias("text"))
    both = F.explode(F.array(page(1, F.left("text", half)), page(2, F.expr("substring(text, int(floor(length(text) / 2)) + 1)")))).alias("p")
    units = staged(rows.select(F.col("conv_id").cast("string").alias("doc_key"), F.col("turn").alias("snapshot"), both).select("doc_key", "snapshot", "p.*"))
    asked = units.select("doc_key", "page_no").distinct()
    chosen = staged(axtree.chosen_snapshots(axtree.snapshot_runs(units, asked)))
    taken = axtree.read_pages(units, asked, chosen).groupBy("doc_key").agg(F.count("*").alias("n_cached"))
    return chosen.join(taken, "doc_key", "left").select("doc_key", "snapshot", "letters", "settled", F.coalesce("n_cached", F.lit(0).cast("long")).alias("n_cached"))


def q_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.when(F.col("ocr"), F.array().cast("array<struct<x0:double>>")).otherwise(F.array(F.struct("x0")))
    rows = _worked(spark, sf_dir).withColumns({"quads": box, "group_pages": F.when(F.col("unit_no") == 1, F.array(F.col("page_no"), F.col("page_no") + 1))})
    found = report.annotations(rows, "pt")
    return found.select("doc_key", "page_no", "unit_no", "kind", "form", "subject", F.md5("content").alias("content_md5"), "x", "y")


def q_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' urls as paths of files in a folder."""
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[a-z]+://|[?#].*$", "")
    rows = table(spark, sf_dir, "pages").select(F.concat(F.lit("/data/in/"), url, F.lit(".PDF")).alias("path"))
    return files.listed(rows, "/data/in", "/data/in/example.org", "pt", recursive=True).select("rel_path", "output_path")


def q_ax_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as trees: a page for each, a paragraph for each turn."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    none, key = F.array().cast("array<string>"), F.col("conv_id").cast("string")
    of = lambda kind: F.concat(F.lit(kind), F.col("turn").cast("string"))
    page = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("turn")), lambda x: F.concat(F.lit("p"), x.cast("string"))).alias("child_ids"))
    nodes = page.select(key.alias("doc_key"), F.lit(-1).cast("long").alias("pos"), F.lit("root").alias("node_id"), F.lit("region").alias("role"), F.lit("Page 3").alias("name"), "child_ids")
    nodes = nodes.unionByName(turns.select(key.alias("doc_key"), (F.col("turn") * 2).alias("pos"), of("p").alias("node_id"), F.lit("paragraph").alias("role"), F.lit("").alias("name"), F.array(of("t")).alias("child_ids")))
    nodes = nodes.unionByName(turns.select(key.alias("doc_key"), (F.col("turn") * 2 + 1).alias("pos"), of("t").alias("node_id"), F.lit("StaticText").alias("role"), F.col("text").alias("name"), none.alias("child_ids")))
    return axtree.node_units(nodes).select("doc_key", "page_no", "nth", F.md5("text").alias("text_md5"))


def q_ax_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as trees as deep as they have lines: each line below the one before, every seventh below the first, every third below the one three before; every fifth is a paragraph, the others are texts."""
    rows = lines(spark, sf_dir).filter("doc_id is not null").select("doc_id", "pos", "line")
    parent = F.when(F.col("pos") % 7 == 6, 0).when((F.col("pos") % 3 == 0) & (F.col("pos") >= 3), F.col("pos") - 3).otherwise(F.col("pos") - 1)
    below = rows.filter("pos > 0").groupBy("doc_id", parent.alias("pos")).agg(F.transform(F.array_sort(F.collect_list("pos")), lambda x: x.cast("string")).alias("child_ids"))
    role = F.when(F.col("pos") == 0, "region").when(F.col("pos") % 5 == 0, "heading").otherwise("StaticText")
    name = F.when(F.col("pos") == 0, "Page 1").otherwise(F.col("line"))
    nodes = rows.join(below, ["doc_id", "pos"], "left").select(F.col("doc_id").cast("string").alias("doc_key"), "pos", F.col("pos").cast("string").alias("node_id"), role.alias("role"), name.alias("name"), "child_ids")
    return axtree.node_units(nodes).select("doc_key", "page_no", "nth", F.md5("text").alias("text_md5"))


def q_ax_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as dumped trees: a paragraph for every third line."""
    rows = lines(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_key"), "pos", F.regexp_replace("line", r"['\\]", " ").alias("line"))
    text = F.concat(F.lit("staticText name='"), F.col("line"), F.lit("' location=(10, "), (F.col("pos") * 10).cast("string"), F.lit(") size=(100, 9.5)"))
    head = F.when(F.col("pos") == 0, F.array(F.lit("region name='Page 1' location=(0, 0) size=(600, 800)"))).otherwise(F.array().cast("array<string>"))
    opens = F.when(F.col("pos") % 3 == 0, F.array(F.lit("paragraph"))).otherwise(F.array().cast("array<string>"))
    dump = rows.select("doc_key", "pos", F.posexplode(F.concat(head, opens, F.array(text))).alias("k", "line")).select("doc_key", (F.col("pos") * 4 + F.col("k")).alias("line_no"), "line")
    return axtree.dump_units(dump).select("doc_key", "page_no", "nth", F.md5("text").alias("text_md5"), F.col("bounds.y").alias("y"))


class Forgetful(LexicalModel):
    """The stand-in, which fails on long runs of words, and on every run whose letters make a multiple of 7."""

    def translate(self, texts: list[str], source: str, target: str, beam: int) -> list[str]:
        found = super().translate(texts, source, target, beam)
        return ["" if len(x.split()) > 40 // beam or sum(c.isalpha() for c in x) % 7 == 0 else y for x, y in zip(texts, found, strict=True)]


def q_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different lines of all documents through a model that fails by a rule: what came of each, after how many more tries."""
    rows = lines(spark, sf_dir).select(tx.normalize_spaces("line").alias("text")).filter("text != ''").distinct()
    rows = staged(rows.select(F.md5("text").alias("key"), F.lit("fr").alias("lang"), "text"))
    found = translated(rows, runner("forgetful", Forgetful, "pt", max_tokens=24), spent=True)
    return found.select("key", F.when(F.col("error").isNull(), "translated").otherwise("failed").alias("state"), F.md5("value").alias("value_md5"), F.when(F.col("error").isNull(), F.col("n_tries")).alias("n_tries"))


def model_runner(target: str = "pt"):
    return runner("stand-in", LexicalModel, target)


def _run(spark: SparkSession, sf_dir: str) -> documents.Outcome:
    rows = layout.lines(spark, sf_dir)
    empty = spark.createDataFrame([], "key string, value string")
    options = Options(target="pt", source=("en", "fr", "es", "de"), variant="pt-BR", profile="didatica_matematica")
    return documents.outcome(rows.withColumn("block_no", F.col("line_no")), layout.pages(rows), empty, model_runner(), "stand-in", options, spent=[rows], entries=False)


def q_translate_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan over documents as laid out, with the stand-in for a model."""
    found = _run(spark, sf_dir)
    out = staged(found.units.select("doc_key", "page_no", "unit_no", "state", "kind", "lang", F.md5("translation").alias("translation_md5"), F.array_join(F.transform("flags", lambda x: x["code"]), ",").alias("codes")))
    dropped(*found.of_units)
    return out


# Written out: the first 15,000 characters, words of letters with a blank on both sides, runs of 1 to 3 letters in 65,536 classes.
_duck_words = lambda x: f"regexp_extract_all(lower(substr({x}, 1, 15000)), '\\p{{L}}+')"
_LEARNED = f"""lw AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest({_duck_words('text')}) AS word FROM documents WHERE doc_id % 4 != 2 AND lang IN ('en', 'fr', 'es', 'de') AND text IS NOT NULL) GROUP BY ALL)"""


def _duck_grams(table: str, keep: str) -> str:
    of = lambda n: ", ".join(f"ascii(p[k + {j}:k + {j}]) * {f}" for j, f in enumerate((1, 263, 69169)[:n])).replace(", ", " + ")
    each = " UNION ALL ".join(f"SELECT {keep}, ({of(n)} + {7919 * n}) % 65536 AS bucket FROM (SELECT {keep}, p, unnest(range(1, length(p) - {n} + 2)) AS k FROM (SELECT {keep}, concat(' ', word, ' ') AS p FROM {table}))" for n in (1, 2, 3))
    return f"({each})"


def _duck_scores(texts: str) -> str:
    """CTEs of sc (text_key, sc): the posteriors of texts, a table with x, by the learned weights."""
    log = lambda n, k: f"round(ln(({n} + 1.0) / (sum_{k} + 65536.0)) * 1000)"
    return f"""{_LEARNED},
lc AS (SELECT bucket, {', '.join(f"sum(CASE WHEN lang = '{k}' THEN n ELSE 0 END) AS n_{k}" for k in CODES)} FROM {_duck_grams('lw', 'lang, n')} GROUP BY bucket),
ls AS (SELECT {', '.join(f'sum(n_{k}) AS sum_{k}' for k in CODES)} FROM lc),
lm AS (SELECT bucket, {', '.join(f"{log(f'n_{k}', k)} AS w_{k}" for k in CODES)} FROM lc, ls),
lu AS (SELECT {', '.join(f"{log('0', k)} AS u_{k}" for k in CODES)} FROM ls),
tk AS (SELECT x, unnest({_duck_words('x')}) AS word FROM (SELECT DISTINCT x FROM {texts})),
tw AS (SELECT DISTINCT word FROM tk),
ws AS (SELECT word, {', '.join(f'sum(coalesce(w_{k}, u_{k})) AS s_{k}' for k in CODES)} FROM {_duck_grams('tw', 'word')} LEFT JOIN lm USING (bucket), lu GROUP BY word),
xs AS (SELECT x, [{', '.join(f'sum(s_{k})' for k in CODES)}] AS s FROM tk JOIN ws USING (word) GROUP BY x),
xp AS (SELECT x, [exp((v - list_max(s)) / 1000.0) FOR v IN s] AS p FROM xs),
sc AS (SELECT x, [v / list_sum(p) FOR v IN p] AS sc FROM xp)"""


_UNSURE = "[" + ", ".join([repr(1 / 4)] * 4) + "]"
_codes = "[" + ", ".join(f"'{k}'" for k in CODES) + "]"


def _duck_hint(x: str) -> str:
    low = f"regexp_replace(lower({x}), '^[0-9.:\\-–—()\\[\\] ]+', '')"
    return "CASE " + " ".join(f"WHEN regexp_matches({low}, '^(?:{'|'.join(lg.HEADING_HINTS[k])})') THEN '{k}'" for k in CODES) + " END"


_t = duck.norm("text")
_MARKED = layout._MARKED
_f, _v = tx.MATH_FUNCTION, tx.MATH_VARIABLE
_atom = f"^(?:{_f}|{_v}|d{_v}|{_f}?{_v}d{_v}|{_f}{_v})$"
_math = f"(regexp_matches(t, '{tx.MATH_SIGN}') AND len(list_filter(regexp_extract_all(t, '\\p{{L}}+'), lambda w: NOT regexp_matches(w, '{_atom}'))) = 0)"
_WORKED = f"""{_MARKED},
w1 AS (SELECT *, length(text) AS n, CASE WHEN preserve THEN 'referencia' WHEN {_math} THEN 'notacao' END AS kind1 FROM marked),
w2 AS (SELECT *, coalesce(kind1, CASE WHEN n % 11 <> 0 AND n % 7 = 0 THEN 'idioma_destino' END) AS kind2 FROM w1),
w3 AS (SELECT *, CASE WHEN kind1 IS NOT NULL THEN 'preservado' WHEN n % 11 = 0 THEN 'falhou' WHEN kind2 IS NOT NULL THEN 'preservado' ELSE 'traduzido' END AS state1 FROM w2),
w4 AS (SELECT *, coalesce(unit_no > min(CASE WHEN state1 = 'falhou' THEN unit_no END) OVER (PARTITION BY doc_key, page_no), false) AS late FROM w3),
worked AS (SELECT * EXCLUDE (state1), CASE WHEN late THEN 'pulado' ELSE state1 END AS state, CASE WHEN NOT late THEN kind2 END AS kind FROM w4)"""
_n = lambda when, name: f"count(*) FILTER ({when}) AS {name}"
_TOTALS = f"""SELECT doc_key, {_n("state = 'traduzido'", 'traduzidos')}, {_n("state = 'preservado' AND kind = 'notacao'", 'notacoes_preservadas')}, {_n("state = 'preservado' AND kind = 'idioma_destino'", 'idioma_destino_preservados')},
  {_n("state = 'preservado' AND kind = 'referencia'", 'referencias_preservadas')}, {_n("state = 'traduzido' AND n % 5 = 0", 'revisao_recomendada')}, {_n("state NOT IN ('traduzido', 'preservado')", 'pendentes')} FROM worked GROUP BY doc_key"""
_path = "regexp_replace(coalesce(url, ''), '^[a-z]+://|[?#].*$', '', 'g')"
_ax = duck.norm("coalesce(text, '')")
_key = "sha256(concat(coalesce(lang, ''), chr(0), 'pt', chr(0), line))"

QUERIES = {
    "q_dominant_lang": q_dominant_lang,
    "q_lang_route": q_lang_route,
    "q_model_route": q_model_route,
    "q_dedupe_units": q_dedupe_units,
    "q_cache_hits": q_cache_hits,
    "q_cache_store": q_cache_store,
    "q_status_totals": q_status_totals,
    "q_batch_summary": q_batch_summary,
    "q_annotations": q_annotations,
    "q_finished": q_finished,
    "q_snapshots": q_snapshots,
    "q_file_scan": q_file_scan,
    "q_ax_nodes": q_ax_nodes,
    "q_ax_deep": q_ax_deep,
    "q_ax_dump": q_ax_dump,
    "q_recovery": q_recovery,
    "q_translate_units": q_translate_units,
}
_LINES = "(SELECT doc_id, lang, unnest(range(len(a))) AS pos, unnest(a) AS line FROM (SELECT doc_id, lang, string_split(coalesce(text, ''), chr(10)) AS a FROM documents))"
ORACLE = {
    "q_dominant_lang": f"""WITH p AS (SELECT coalesce(source, '') AS doc_key, doc_id, substr(coalesce(text, ''), 1, 2500) AS x FROM documents),
q AS (SELECT *, coalesce(sum(length(x)) OVER (PARTITION BY doc_key ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM p WHERE length(x) > 0),
z AS (SELECT doc_key, x, length(x) AS size, len(regexp_extract_all(x, '\\p{{L}}')) AS letters FROM q WHERE bef < 100000),
{_duck_scores('z')},
u AS (SELECT doc_key, size, letters, unnest(coalesce(sc, {_UNSURE})) AS score, unnest({_codes}) AS code, unnest(range({len(CODES)})) AS nth FROM z LEFT JOIN sc USING (x)),
g AS (SELECT doc_key, code, nth, round(sum(score * size) / sum(size), 9) AS score, sum(letters) AS letters FROM u GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY score DESC, nth) AS k FROM g)
SELECT d.doc_key, CASE WHEN coalesce(r.letters, 0) < 30 THEN 'en' ELSE r.code END AS dominant, CASE WHEN r.letters >= 30 THEN round(r.score, 6) END AS dominant_score FROM (SELECT DISTINCT doc_key FROM p) d LEFT JOIN r ON r.doc_key = d.doc_key AND r.k = 1""",
    "q_lang_route": f"""WITH z AS (SELECT doc_id, {duck.norm("coalesce(text, '')")} AS x FROM documents),
{_duck_scores('z')},
s AS (SELECT doc_id, len(regexp_extract_all(x, '\\p{{L}}')) AS n, {_duck_hint('x')} AS hint, coalesce(sc, {_UNSURE}) AS sc FROM z LEFT JOIN sc USING (x)),
b AS (SELECT *, list_max(sc) AS top, {_codes}[list_position(sc, list_max(sc))] AS code FROM s),
f AS (SELECT doc_id, CASE WHEN hint IS NOT NULL THEN 1.0 WHEN n < 8 THEN NULL ELSE top END AS sc2,
  CASE WHEN hint IS NOT NULL THEN hint WHEN n < 8 THEN 'fr' WHEN (n >= 40 AND top >= 0.80) OR (n >= 15 AND top >= 0.96) THEN code ELSE 'fr' END AS unit_lang,
  CASE WHEN hint IS NOT NULL THEN 'cabecalho' WHEN n < 8 THEN 'predominante_texto_curto' WHEN (n >= 40 AND top >= 0.80) OR (n >= 15 AND top >= 0.96) THEN 'estatistica_trecho' ELSE 'predominante_baixa_confianca' END AS reason FROM b)
SELECT doc_id, unit_lang, reason, CAST(round(sc2, 6) AS DOUBLE) AS unit_score, CASE WHEN unit_lang = 'en' THEN 'preserve' ELSE unit_lang END AS route FROM f""",
    "q_model_route": f"""WITH RECURSIVE pk(nth, from_code, to_code, version) AS (VALUES {', '.join(f"({n}, '{a}', '{b}', '{v}')" for n, a, b, v in PACKAGES)}),
nw AS (SELECT min(nth) OVER (PARTITION BY from_code, to_code) AS nth, from_code, to_code, version, row_number() OVER (PARTITION BY from_code, to_code ORDER BY list_transform(string_split(version, '.'), lambda x: CAST(x AS INT)) DESC, nth) AS k FROM pk),
e AS (SELECT * FROM nw WHERE k = 1),
asked(asked, a, b) AS (VALUES ('fr-pt-br', 'fr', 'pb'), ('de-pt-br', 'de', 'pb'), ('fr-it', 'fr', 'it')),
w AS (SELECT asked, a AS node, b AS goal, CAST([] AS STRUCT(from_code VARCHAR, to_code VARCHAR, version VARCHAR)[]) AS way, [a] AS seen, CAST([] AS INT[]) AS ord FROM asked
  UNION ALL SELECT w.asked, e.to_code, goal, list_append(way, struct_pack(from_code := e.from_code, to_code := e.to_code, version := e.version)), list_append(seen, e.to_code), list_append(ord, e.nth) FROM w JOIN e ON e.from_code = w.node WHERE NOT list_contains(seen, e.to_code) AND node <> goal),
best AS (SELECT asked, way, row_number() OVER (PARTITION BY asked ORDER BY len(way), ord) AS k FROM w WHERE node = goal)
SELECT asked, CAST(unnest(range(1, len(way) + 1)) AS INT) AS hop, unnest(way).from_code AS from_code, unnest(way).to_code AS to_code, unnest(way).version AS version FROM best WHERE k = 1""",
    "q_dedupe_units": f"SELECT doc_id, count(*) AS n_units, CAST(sum(pos) AS BIGINT) AS sum_first, CAST(sum(length(t)) AS BIGINT) AS n_chars_once FROM (SELECT doc_id, t, pos FROM (SELECT doc_id, pos, t, row_number() OVER (PARTITION BY doc_id, t ORDER BY pos) AS k FROM (SELECT doc_id, pos, {duck.norm('line')} AS t FROM {_LINES}) WHERE t <> '') WHERE k = 1) GROUP BY doc_id",
    "q_cache_hits": f"""WITH l AS (SELECT lang, line, {_key} AS key FROM {_LINES} WHERE trim(line) <> ''),
c AS (SELECT key FROM l GROUP BY key HAVING count(*) > 1 AND NOT regexp_matches(min(line), '[0-9]'))
SELECT lang, count(*) AS n_units, count(c.key) AS n_hits, count(DISTINCT CASE WHEN c.key IS NULL THEN l.key END) AS n_asked FROM l LEFT JOIN c ON c.key = l.key GROUP BY lang""",
    "q_cache_store": f"""WITH l AS (SELECT doc_id, lang, line, {_key} AS key FROM {_LINES} WHERE trim(line) <> ''),
k AS (SELECT key, bool_or(doc_id % 2 = 0) AS early, regexp_matches(min(line), '[0-9]') AS bad FROM l GROUP BY key)
SELECT lang, count(*) AS n_units, count(*) FILTER (early AND NOT bad) AS n_first, count(*) FILTER (NOT early AND NOT bad) AS n_second, count(DISTINCT CASE WHEN bad THEN l.key END) AS n_missing FROM l JOIN k USING (key) GROUP BY lang""",
    "q_status_totals": f"{_WORKED} {_TOTALS}",
    "q_batch_summary": f"""{_WORKED}, tt AS ({_TOTALS}),
pgs AS (SELECT DISTINCT doc_key, page_no FROM layout_lines),
op AS (SELECT doc_key, bool_or(coalesce(o, true)) AS o FROM pgs LEFT JOIN (SELECT doc_key, page_no, bool_or(state NOT IN ('traduzido', 'preservado')) AS o FROM worked GROUP BY ALL) USING (doc_key, page_no) GROUP BY doc_key),
x AS (SELECT count(*) AS arquivos, count(*) FILTER (NOT o) AS concluidos, count(*) FILTER (o) AS com_pendencias, CAST(coalesce(sum(revisao_recomendada), 0) AS BIGINT) AS trechos_para_revisao FROM op LEFT JOIN tt USING (doc_key))
SELECT arquivos, concluidos, com_pendencias, CAST(0 AS BIGINT) AS ignorados_existentes, CAST(0 AS BIGINT) AS ignorados_ja_traduzidos, CAST(0 AS BIGINT) AS erros, trechos_para_revisao,
  CASE WHEN arquivos = 0 THEN 'sem_arquivos' WHEN com_pendencias > 0 THEN 'concluido_com_pendencias' ELSE 'concluido' END AS estado FROM x""",
    "q_finished": f"""{_WORKED},
pgs AS (SELECT DISTINCT doc_key, page_no FROM layout_lines),
pt AS (SELECT doc_key, page_no, count(state) AS n_units, {_n("state = 'traduzido'", 'n_translated')}, {_n("state = 'preservado'", 'n_kept')}, {_n("state NOT IN ('traduzido', 'preservado')", 'n_open')}, {_n("state = 'traduzido' AND n % 5 = 0", 'n_reviews')} FROM pgs LEFT JOIN worked USING (doc_key, page_no) GROUP BY ALL)
SELECT doc_key, CAST(count(*) AS INT) AS n_pages, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('n_units', 'n_translated', 'n_kept', 'n_open', 'n_reviews'))}, CAST(count(*) FILTER (n_units = 0) AS INT) AS n_empty,
  CASE WHEN sum(n_open) > 0 OR count(*) FILTER (n_units = 0) > 0 THEN 'concluido_com_pendencias' ELSE 'concluido' END AS state FROM pt GROUP BY doc_key""",
    "q_snapshots": f"""WITH r AS (SELECT CAST(conv_id AS VARCHAR) AS doc_key, turn AS snapshot, min(coalesce(text, '')) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY ALL),
h AS (SELECT doc_key, snapshot, {duck.letters('substr(t, 1, length(t) // 2)')} AS a, {duck.letters('substr(t, length(t) // 2 + 1)')} AS b FROM r),
g AS (SELECT *, a + b AS letters, a >= 35 AND b >= 35 AS ready, coalesce(a + b <= max(a + b) OVER (PARTITION BY doc_key ORDER BY snapshot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS still FROM h),
c AS (SELECT doc_key, min(snapshot) FILTER (ready AND still) AS settled_at, arg_min(snapshot, [-letters, snapshot]) AS most_at FROM g GROUP BY doc_key)
SELECT c.doc_key, g.snapshot, CAST(g.letters AS BIGINT) AS letters, settled_at IS NOT NULL AS settled, CASE WHEN settled_at IS NOT NULL THEN 2 ELSE 0 END AS n_cached FROM c JOIN g ON g.doc_key = c.doc_key AND g.snapshot = coalesce(settled_at, most_at)""",
    "q_annotations": f"""{_WORKED}
SELECT doc_key, page_no, unit_no, CASE WHEN state = 'traduzido' THEN 'translated' ELSE 'failed' END AS kind, CASE WHEN n % 2 = 0 THEN 'note' ELSE 'highlight' END AS form,
  CASE WHEN state = 'traduzido' THEN CASE WHEN n % 2 = 0 THEN 'Chrome OCR | tradução FR → PT' ELSE 'Tradução FR → PT | local' END ELSE CASE WHEN n % 2 = 0 THEN 'Chrome OCR | tradução pendente' ELSE 'Tradução pendente' END END AS subject,
  md5(CASE WHEN state = 'traduzido' THEN concat(CASE WHEN unit_no = 1 THEN concat('[Parágrafo contínuo entre páginas ', page_no, '–', page_no + 1, ']', chr(10)) ELSE '' END, 't ', text) ELSE '{report.FAILED_TEXT}' END) AS content_md5,
  CASE WHEN n % 2 = 0 THEN greatest(8.0, {WIDTH} - 14 - 16 * ((unit_no - 1) // 38)) END AS x, CASE WHEN n % 2 = 0 THEN least({HEIGHT} - 12, 18.0 + ((unit_no - 1) % 38) * 20) END AS y
FROM worked WHERE state <> 'preservado'""",
    "q_file_scan": f"SELECT concat(p, '.PDF') AS rel_path, concat('/data/in/example.org/', regexp_replace(concat(p, '.PDF'), '(\\.[^./]*)?$', ''), '_traduzido_pt.PDF') AS output_path FROM (SELECT {_path} AS p FROM pages) WHERE NOT starts_with(p, 'example.org/')",
    "q_ax_nodes": f"""WITH u AS (SELECT CAST(conv_id AS VARCHAR) AS doc_key, turn, {_ax} AS t FROM conversations),
k AS (SELECT doc_key, t, min(turn) AS turn FROM u WHERE NOT {duck.noise('t')} GROUP BY ALL)
SELECT doc_key, 3 AS page_no, CAST(row_number() OVER (PARTITION BY doc_key ORDER BY turn) AS INT) AS nth, md5(t) AS text_md5 FROM k""",
    "q_ax_deep": f"""WITH RECURSIVE l AS (SELECT doc_id, pos, {duck.norm('line')} AS name, CASE WHEN pos % 7 = 6 THEN 0 WHEN pos % 3 = 0 AND pos >= 3 THEN pos - 3 ELSE pos - 1 END AS parent, pos > 0 AND pos % 5 = 0 AS head FROM {_LINES} WHERE doc_id IS NOT NULL),
w AS (SELECT doc_id, pos, [pos] AS path, CAST([] AS BIGINT[]) AS own, name FROM l WHERE pos = 0
  UNION ALL SELECT l.doc_id, l.pos, list_append(w.path, l.pos), CASE WHEN len(w.own) > 0 THEN w.own WHEN l.head THEN list_append(w.path, l.pos) ELSE w.own END, l.name FROM w JOIN l ON l.doc_id = w.doc_id AND l.parent = w.pos AND l.pos > 0),
t AS (SELECT doc_id, path, own, name FROM w WHERE pos > 0 AND pos % 5 <> 0 AND name <> ''),
ins AS (SELECT doc_id, 0 AS kind, own AS place, 0 AS part, {duck.norm("string_agg(name, ' ' ORDER BY path)")} AS text FROM t WHERE len(own) > 0 GROUP BY doc_id, own),
lst AS (SELECT doc_id, list(struct_pack(n := length(name) + 1, tail := name, out := [name]) ORDER BY path) AS s FROM t WHERE len(own) = 0 AND NOT {duck.noise('name')} GROUP BY doc_id),
red AS (SELECT doc_id, list_reduce(s, lambda a, x: struct_pack(
  n := CASE WHEN a.n + x.n - 1 > 900 OR regexp_matches(a.tail, '[.!?;:]$') THEN x.n ELSE a.n + x.n END, tail := x.tail,
  out := CASE WHEN a.n + x.n - 1 > 900 OR regexp_matches(a.tail, '[.!?;:]$') THEN list_concat(a.out, x.out) ELSE list_append(a.out[:-2], concat(a.out[-1], ' ', x.tail)) END)).out AS out FROM lst),
rest AS (SELECT doc_id, 1 AS kind, CAST([] AS BIGINT[]) AS place, unnest(range(len(out))) AS part, {duck.norm('unnest(out)')} AS text FROM red),
u AS (SELECT * FROM ins WHERE NOT {duck.noise('text')} UNION ALL SELECT * FROM rest WHERE text <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY kind, place, part) AS again FROM u),
here AS (SELECT CAST(doc_id AS VARCHAR) AS doc_key, 1 AS page_no, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY kind, place, part) AS INT) AS nth, md5(text) AS text_md5 FROM o WHERE again = 1),
flat AS (SELECT doc_id, {duck.norm("string_agg(name, ' ' ORDER BY pos)")} AS text FROM l WHERE pos > 0 AND pos % 5 <> 0 AND NOT {duck.noise('name')} AND doc_id NOT IN (SELECT doc_id FROM o) GROUP BY doc_id)
SELECT * FROM here UNION ALL SELECT CAST(doc_id AS VARCHAR), 1, 1, md5(text) FROM flat WHERE text <> ''""",
}
