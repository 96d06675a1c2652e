"""Benchmark decontamination over a positional inverted index, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.shared import cut, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of both sides: ASCII letters and digits, and all beyond ASCII. Java looks up listed characters
#: in a table; as ranges, or as a negated class, the same characters take up to four times as long.
WORD = rf"[0123456789{UPPER}{LOWER}\x80-\x{{10FFFF}}]+"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and no other letter; lower() is faster and does the same where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text_or_empty(text)), F.lit(WORD), F.lit(0))


def windows(benchmark: DataFrame, length: int = 13) -> DataFrame:
    """(words, item_id): every run of length words of each item, or all of an item that has fewer; each once an item."""
    items = benchmark.filter(F.col("item_id").isNotNull()).select("item_id", words(F.col("text")).alias("all")).filter(F.size("all") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("all") - length + 1, F.lit(1))))
    return items.select("item_id", "all", starts.alias("k")).select(F.slice("all", F.col("k"), F.lit(length)).alias("words"), "item_id").distinct()


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has at most so many rows; it has to be written already, as it is counted here."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def term_counts(documents: DataFrame, terms: DataFrame, broadcast_rows: int) -> DataFrame:
    """(term, n): how often each term occurs in all documents. Counts are summed before they are shuffled."""
    tokens = documents.select(F.explode(words(F.col("text"))).alias("term"))
    if terms.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return tokens.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    return tokens.groupBy("term").agg(F.count("*").alias("n")).join(terms, "term", "left_semi")


def rarest(phrases: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """(phrase, words, term, offset, rank, needed): of each phrase its rarest terms, at most so many; none of a phrase with a term that no document has. counts are written already."""
    each = phrases.select("phrase", "words", F.posexplode("words").alias("offset", "term"))
    each = each.join(bounded(counts, 1_000_000), "term", "left")
    whole = Window.partitionBy("phrase")
    each = each.withColumn("lacks", F.max(F.col("n").isNull()).over(whole)).withColumn("rank", F.row_number().over(whole.orderBy("n", "offset")))
    return each.filter(~F.col("lacks") & (F.col("rank") <= most)).select("phrase", "words", "term", "offset", "rank", F.least(F.size("words"), F.lit(most)).alias("needed"))


def postings(documents: DataFrame, terms: DataFrame, radius: int, broadcast_rows: int) -> DataFrame:
    """(term, doc_id, row, pos, lead, around): each place of each of terms (term, seed) in all documents.

    Places of seeds, the rarest terms of phrases, have up to radius words on both sides in around, lead
    of them before the term; others have null. row tells apart rows that share a doc_id.
    """
    tokens = documents.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), words(F.col("text")).alias("all"))
    tokens = tokens.select("doc_id", "row", "all", F.posexplode("all").alias("pos", "term"))
    found = tokens.join(bounded(terms, broadcast_rows), "term")
    lead = F.least(F.col("pos"), F.lit(radius))
    return found.select("term", "doc_id", "row", "pos", lead.alias("lead"), F.when(F.col("seed"), F.slice("all", F.col("pos") - lead + 1, lead + radius + 1)).alias("around"))


def phrase_matches(index: DataFrame, selected: DataFrame) -> DataFrame:
    """(phrase, doc_id, row, start): exact occurrences. Lists of a phrase's rarest terms, shifted by their offsets, are intersected; what is in all is compared word by word."""
    shifted = index.join(bounded(selected, 1_000_000), "term").filter(F.col("pos") >= F.col("offset"))
    length = F.size("words")
    same = F.when(F.col("rank") == 1, F.slice("around", F.col("lead") - F.col("offset") + 1, length) == F.col("words"))
    shifted = shifted.select("phrase", "doc_id", "row", (F.col("pos") - F.col("offset")).alias("start"), "offset", "needed", same.alias("same"))
    met = shifted.groupBy("phrase", "doc_id", "row", "start").agg(F.count_distinct("offset").alias("n"), F.max("needed").alias("needed"), F.bool_and("same").alias("same"))
    return met.filter((F.col("n") == F.col("needed")) & F.col("same")).select("phrase", "doc_id", "row", "start")


def proximity_matches(index: DataFrame, selected: DataFrame, within: int) -> DataFrame:
    """(phrase, doc_id, row, pos): places of a phrase's rarest term with all of its words, in any order, among some within words in a row. index needs a radius of within - 1."""
    near = index.join(bounded(selected.filter("rank = 1").select("phrase", "words", "term"), 1_000_000), "term")
    starts = F.sequence(F.greatest(F.col("lead") - within + 2, F.lit(1)), F.col("lead") + 1)
    near = near.filter(F.size(F.array_except("words", "around")) == 0)  # else no part of it has them all
    found = F.exists(starts, lambda s: F.size(F.array_except("words", F.slice("around", s, F.lit(within)))) == 0)
    return near.filter(found).select("phrase", "doc_id", "row", "pos").distinct()


def build(documents: DataFrame, phrases: DataFrame, radius: int, most_terms: int, broadcast_rows: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """The stored index of documents for phrases (phrase, words), and the terms selected of each phrase."""
    terms = cut(phrases.select(F.explode("words").alias("term")).distinct())
    selected = cut(rarest(phrases, cut(term_counts(documents, terms, broadcast_rows)), most_terms))
    index = cut(postings(documents, cut(selected.groupBy("term").agg(F.bool_or(F.col("rank") == 1).alias("seed"))), radius, broadcast_rows))
    return index, selected


def covered(occurrences: DataFrame) -> DataFrame:
    """(doc_id, row, n_hit) of (doc_id, row, start, length): words under any occurrence, each once."""
    one = occurrences.groupBy("doc_id", "row", "start").agg(F.max("length").alias("length"))
    before = Window.partitionBy("doc_id", "row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    new = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0))))
    return one.withColumn("new", new).groupBy("doc_id", "row").agg(F.sum("new").alias("n_hit"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, length: int = 13, most_terms: int = 2) -> DataFrame:
    """Of every row of documents (doc_id, text): its words, those inside benchmark windows, the items of these, and items met in proximity.

    doc_id, row, n_words, n_hit, n_items, items_sha256, contaminated (a twentieth of the words or
    more is hit) and n_near_items: items of which all words of a window stand in any order within
    length words in a row, exact matches included; it has no part in contaminated. row, a hash of doc_id and text, tells rows apart that share a doc_id; equal rows
    have equal results. Null and empty texts have no words. Benchmark rows without text, words or
    item_id are left out. Other columns are ignored. An empty benchmark hits nothing.
    """
    pairs = windows(benchmark, length).select(F.array_join("words", " ").alias("phrase"), "words", "item_id")
    pairs = cut(pairs)
    index, selected = build(documents, pairs.select("phrase", "words").distinct(), length - 1, most_terms)
    found = cut(phrase_matches(index, selected))
    occurrences = found.withColumn("length", F.size(F.split("phrase", " ")))
    items = found.select("phrase", "doc_id", "row").distinct().join(bounded(pairs.select("phrase", "item_id"), 1_000_000), "phrase")
    items = items.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    near = proximity_matches(index, selected, length).select("phrase", "doc_id", "row").distinct().join(bounded(pairs.select("phrase", "item_id"), 1_000_000), "phrase")
    near = near.groupBy("doc_id", "row").agg(F.count_distinct("item_id").alias("n_near_items"))
    hits = _both(covered(occurrences), items, near)
    rows = documents.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.regexp_count(text_or_empty("text"), F.lit(WORD)).cast("long").alias("n_words"))
    hits = hits.withColumnsRenamed({"doc_id": "hit_id", "row": "hit_row"})
    joined = rows.join(hits, rows["doc_id"].eqNullSafe(hits["hit_id"]) & (rows["row"] == hits["hit_row"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    listed = F.coalesce(F.array_join("items", ","), F.lit(""))
    return joined.select(
        "doc_id", "row", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("n_near_items", F.lit(0)).cast("long").alias("n_near_items"),
    )


def _both(hits: DataFrame, items: DataFrame, near: DataFrame) -> DataFrame:
    """Hits with items and near ones, one row a document row that has any: the three are brought under one another and summed up, not joined."""
    none = lambda t: F.lit(None).cast(t)
    rows = hits.select("doc_id", "row", "n_hit", none("array<string>").alias("items"), none("long").alias("n_near_items"))
    rows = rows.unionByName(items.select("doc_id", "row", none("long").alias("n_hit"), "items", none("long").alias("n_near_items")))
    rows = rows.unionByName(near.select("doc_id", "row", none("long").alias("n_hit"), none("array<string>").alias("items"), "n_near_items"))
    return rows.groupBy("doc_id", "row").agg(F.max("n_hit").alias("n_hit"), F.first("items", ignorenulls=True).alias("items"), F.max("n_near_items").alias("n_near_items"))
