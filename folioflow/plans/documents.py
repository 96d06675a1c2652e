"""The whole way from lines to translated, audited and annotated units, as one plan over all documents."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.config import Options
from folioflow.functions import language as lg
from folioflow.functions import text as tx
from folioflow.operators import language, layout, ngrams, report
from folioflow.operators.backends import Runner
from folioflow.operators.translate import digest, translations
from folioflow.plans.stages import bounded, dropped, staged
from folioflow.sources.cache_store import CacheStore

#: Pages told apart by number that are broadcast, some forty a document.
SAMPLED_PAGES = 1_000_000


class Outcome(NamedTuple):
    """Units and the cache's new entries, and the staged tables that either is read from."""

    units: DataFrame
    added: DataFrame
    of_units: list[DataFrame]
    of_added: list[DataFrame]


def prepared(lines: DataFrame, pages: DataFrame, options: Options, spent: Sequence[DataFrame] = ()) -> DataFrame:
    """Units of all documents in reading order, staged, with preserve; continued gives them their groups.

    Running heads are told from all pages, whatever pages are asked for. Blocks of a page's lines are
    given by block_no. spent are staged tables that lines and pages are read from, and nothing else is; they are
    dropped as soon as they were read, as are the tables of all steps: no more than two hold the texts at once.
    """
    keys = layout.margin_keys(lines, pages)
    if options.pages:
        lines = lines.filter(F.col("page_no").between(*options.pages))
    blocks = staged(layout.slim(layout.paragraphs(layout.kept_lines(lines, pages, keys))))
    dropped(*spent)
    columns = staged(layout.column_pages(layout.full(blocks)))
    ordered = layout.full(layout.reading_order(blocks, columns))
    units = layout.units(ordered, options.unit_chars, options.merge_blocks).filter(~tx.is_noise("text"))
    units = staged(units.withColumn("event", layout.reference_event() if options.preserve_references else F.lit(None).cast("int")))
    dropped(blocks, columns)
    # numbers and reference sections are told without the texts
    places = units.select("doc_key", "page_no", F.col("unit_no").alias("of_no"), "event")
    places = places.withColumn("unit_no", F.row_number().over(Window.partitionBy("doc_key", "page_no").orderBy("of_no")))
    places = layout.referenced(places, ["page_no", "unit_no"], F.col("event")) if options.preserve_references else places.withColumn("preserve", F.lit(False))
    places = places.select("doc_key", "page_no", "of_no", F.col("unit_no").alias("new_no"), "preserve")
    numbered = units.drop("event").withColumnRenamed("unit_no", "of_no").join(places, ["doc_key", "page_no", "of_no"])
    numbered = staged(numbered.select("doc_key", "page_no", F.col("new_no").alias("unit_no"), *[c for c in units.columns if c not in ("doc_key", "page_no", "unit_no", "event")], "preserve"))
    dropped(units)
    return numbered


def continued(units: DataFrame, options: Options) -> DataFrame:
    """units with group_id, group_text, owner and group_pages."""
    groups = layout.continuations(units) if options.join_pages else layout.continuations(units.limit(0))
    return layout.with_continuations(units, groups)


def input_of() -> Column:
    return F.coalesce("group_text", tx.normalize_spaces("text"))


def outcome(lines: DataFrame, pages: DataFrame, cache: DataFrame | CacheStore, runner: Runner, namespace: str | None, options: Options, label: str = "local", scores: lg.Scores = lg.word_scores, model: ngrams.LanguageModel | None = None, spent: Sequence[DataFrame] = (), entries: bool = True) -> Outcome:
    """As run, not yet written, so that who asks for a few columns moves and writes these alone; spent as in prepared, entries as in translations."""
    namespace = namespace or runner.namespace  # a model's own, so that entries of another are never met
    plain = prepared(lines, pages, options, spent)
    units = continued(plain, options).withColumn("kind", report.preserved_kind(tx.normalize_spaces("text"), "preserve"))
    if options.mixed or options.source == "auto":
        codes = list(options.source) if options.mixed else list(lg.FUNCTION_WORDS)
        codes += [options.target] if options.target not in codes else []
        sizes = plain.groupBy("doc_key", "page_no").agg((F.sum(F.length("text")) + F.count("*") - 1).alias("chars"))
        wanted = staged(language.sampled(sizes))
        sampled = plain.join(bounded(wanted, SAMPLED_PAGES), ["doc_key", "page_no"], "left_semi")
        texts = sampled.groupBy("doc_key", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
        dominant = staged(language.dominant_language(texts, codes, options.target, scores, model))
        dropped(wanted)
        if options.mixed:
            units = language.with_language(units.withColumn("input", input_of()), dominant, codes, "input", scores, model).drop("input")
        else:
            units = units.join(dominant.select("doc_key", F.col("dominant").alias("lang")), "doc_key").withColumns({"lang_score": F.lit(None).cast("double"), "lang_reason": F.lit(None).cast("string")})
    else:
        units = units.withColumns({"lang": F.lit(options.source), "lang_score": F.lit(None).cast("double"), "lang_reason": F.lit(None).cast("string")})
    units = staged(units)
    dropped(plain)
    same = F.lit(options.mixed) & (F.col("lang") == options.target)
    asked = F.col("kind").isNull() & ~F.coalesce(same, F.lit(False))
    found = translations(units.filter(asked).select(F.coalesce(input_of(), F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang")), cache, runner, options.target, namespace, options.protect, options.profile, options.glossary, options.variant, entries)
    results = found.results.select("id", "translation", "error", F.when(F.col("error").isNull(), F.array(F.lit(label))).alias("providers"))
    # what is made of the text once more needn't be moved with it
    rows = units.withColumn("id", digest(input_of(), "lang", options.target)).join(results, "id", "left").drop("id").withColumn("input", input_of())
    empty = asked & (F.col("input") == "")
    rows = rows.withColumns({"translation": F.when(empty, "").otherwise(F.col("translation")), "providers": F.when(empty, F.array(F.lit(label))).otherwise(F.col("providers"))})
    rows = report.states(rows, options.target, options.mixed, options.policy)
    rows = report.audited(rows) if options.audit else rows.withColumn("flags", F.array().cast("array<struct<code:string,message:string>>"))
    box = F.array(F.struct("x0", "y0", "x1", "y1"))
    return Outcome(rows.withColumns({"quads": box, "ocr": F.lit(False)}), found.added, [units, *found.of_results], found.of_added)


def run(lines: DataFrame, pages: DataFrame, cache: DataFrame | CacheStore, runner: Runner, namespace: str | None, options: Options, label: str = "local", scores: lg.Scores = lg.word_scores, model: ngrams.LanguageModel | None = None) -> tuple[DataFrame, DataFrame]:
    """Units with their states, translations and doubts, and the cache's new entries. Languages are told by model, if one was learned, else by scores.

    Units kept as they are never reach a model; equal inputs reach it once; the two members of a
    paragraph over a page's end share one input.
    """
    found = outcome(lines, pages, cache, runner, namespace, options, label, scores, model)
    rows = staged(found.units)
    dropped(*found.of_units)
    return rows, found.added
