"""The language of documents and units, and the way of models from one language to another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.config import model_language
from folioflow.functions import language as lg
from folioflow.functions import text as tx
from folioflow.operators import ngrams
from folioflow.operators.running import sum_before

#: Of each page of a sample so many characters, and pages until so many are together.
PAGE_CHARS, SAMPLE_CHARS = 2_500, 100_000
#: Fewer letters than this tell no language.
LEAST_LETTERS = 30


def sample_pages(pages: DataFrame) -> DataFrame:
    """(doc_key, page_no, excerpt): the start of each page that has text, up to the page that makes the sample full."""
    rows = pages.select("doc_key", "page_no", F.substring("text", 1, PAGE_CHARS).alias("excerpt")).filter(F.length("excerpt") > 0)
    sized = rows.withColumn("size", F.length("excerpt"))
    return sum_before(sized, "doc_key", "page_no", "size", "before").filter(F.col("before") < SAMPLE_CHARS).select("doc_key", "page_no", "excerpt")


def sampled(sizes: DataFrame) -> DataFrame:
    """Of pages (doc_key, page_no, chars) those that sample_pages may take; each document has one at least."""
    sized = sizes.select("doc_key", "page_no", F.least(F.lit(PAGE_CHARS), "chars").alias("size"))
    return sum_before(sized, "doc_key", "page_no", "size", "before").filter(F.col("before") < SAMPLE_CHARS).select("doc_key", "page_no")


def first_pages(pages: DataFrame, first: int = 1, count: int = 4, chars: int = 5_000) -> DataFrame:
    """(doc_key, sample): the start of the first few pages asked for, one after the other."""
    rows = pages.filter((F.col("page_no") >= first) & (F.col("page_no") < first + count))
    listed = F.array_sort(F.collect_list(F.struct("page_no", F.substring("text", 1, chars).alias("text"))))
    return rows.groupBy("doc_key").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n").alias("sample"))


def dominant_language(pages: DataFrame, codes: list[str], target: str, scores: lg.Scores = lg.word_scores, model: ngrams.LanguageModel | None = None) -> DataFrame:
    """(doc_key, dominant, score): the language that pages (doc_key, page_no, text) have in sum, by a model of its codes or else by scores.

    Scores of a document are the means of its pages' scores, weighted by their length, so a sample is
    never one text. Documents with under 30 letters have the first language that isn't the target.
    """
    rows = sample_pages(pages).withColumns({"size": F.length("excerpt"), "letters": lg.letters("excerpt")})
    if model is not None:
        codes, scores, rows = model.codes, ngrams.given(), ngrams.scored(rows, "excerpt", model)
    each = rows.select("doc_key", "size", "letters", F.posexplode(scores(F.col("excerpt"), codes)).alias("nth", "s"))
    sums = each.groupBy("doc_key", "nth", F.col("s.code").alias("code")).agg(F.sum(F.col("s.score") * F.col("size")).alias("points"), F.sum("size").alias("size"), F.sum("letters").alias("letters"))
    top = F.max(F.struct(F.round(F.col("points") / F.col("size"), 9).alias("score"), (-F.col("nth")).alias("first"), F.col("code"), F.col("letters")))
    other = next((k for k in codes if k != target), target)
    found = sums.groupBy("doc_key").agg(top.alias("top"))
    few = F.coalesce(F.col("top.letters") < LEAST_LETTERS, F.lit(True))
    found = pages.select("doc_key").distinct().join(found, "doc_key", "left")
    return found.select("doc_key", F.when(few, other).otherwise(F.col("top.code")).alias("dominant"), F.when(~few, F.col("top.score")).alias("score"))


def with_language(units: DataFrame, dominant: DataFrame, codes: list[str], text: str = "text", scores: lg.Scores = lg.word_scores, model: ngrams.LanguageModel | None = None) -> DataFrame:
    """units with lang, lang_score and lang_reason, from their text and the language of their document; by a model of its codes, or else by scores."""
    rows = units.join(dominant.select("doc_key", "dominant"), "doc_key", "left")
    if model is not None:
        codes, scores, rows = model.codes, ngrams.given(), ngrams.scored(rows.withColumn("clean", tx.normalize_spaces(F.coalesce(F.col(text), F.lit("")))), "clean", model)
    rows = rows.withColumn("found", lg.unit_language(text if model is None else "clean", codes, F.col("dominant"), scores, clean=model is not None))
    return rows.withColumns({"lang": F.col("found.code"), "lang_score": F.col("found.score"), "lang_reason": F.col("found.reason")}).drop("found", "dominant", "lang_scores", "clean")


def newest_packages(packages: DataFrame) -> DataFrame:
    """Of packages (nth, from_code, to_code, version) the newest of each pair; of equal versions the first. Versions compare number by number."""
    numbers = F.transform(F.regexp_extract_all(F.coalesce(F.col("version").cast("string"), F.lit("")), F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("long"))
    order = Window.partitionBy("from_code", "to_code").orderBy(F.desc("numbers"), "nth")
    rows = packages.withColumn("numbers", numbers).withColumn("place", F.row_number().over(order))
    first = F.min("nth").over(Window.partitionBy("from_code", "to_code"))
    return rows.withColumn("nth", first).filter("place = 1").drop("place", "numbers")


def routes(packages: DataFrame, source: str, target: str) -> DataFrame:
    """(hop, from_code, to_code, version) of the way with the fewest packages; no row if there is none, or if both are one language.

    One join a hop extends all ways by a package; a language keeps the way that reached it first, ways
    of equal length by the order of packages.
    """
    spark, edges = packages.sparkSession, newest_packages(packages)
    source, target = model_language(source), model_language(target)
    empty = edges.limit(0).select(F.lit(0).alias("hop"), "from_code", "to_code", "version")
    if source == target:
        return empty
    step = F.struct("from_code", "to_code", "version")
    ways = spark.createDataFrame([(source,)], "at string").select("at", F.array().cast("array<long>").alias("order"), F.array().cast("array<struct<from_code:string,to_code:string,version:string>>").alias("way"))
    seen = [source]
    while True:  # ends, as every round finds a new language or is the last
        longer = ways.join(edges, F.col("at") == F.col("from_code")).filter(~F.col("to_code").isin(seen))
        longer = longer.select(F.col("to_code").alias("at"), F.array_append("order", F.col("nth").cast("long")).alias("order"), F.array_append("way", step).alias("way"))
        longer = longer.groupBy("at").agg(F.min(F.struct("order", "way")).alias("w")).select("at", "w.order", "w.way")
        found = longer.collect()  # as many rows as there are languages at most
        if not found:
            return empty
        if any(r["at"] == target for r in found):
            return longer.filter(F.col("at") == target).select(F.posexplode("way").alias("hop", "p")).select((F.col("hop") + 1).alias("hop"), "p.*")
        seen += [r["at"] for r in found]
        ways = spark.createDataFrame(found, longer.schema)
