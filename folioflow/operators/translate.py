"""Translation of units as one plan: parts, protection, cache, model for what the cache lacks, restoring, terms."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import portuguese, protect
from folioflow.functions import text as tx
from folioflow.functions.glossary import glossary, has_terms
from folioflow.functions.split import split_text
from folioflow.operators.backends import Runner
from folioflow.operators.recovery import translated
from folioflow.plans.stages import dropped, staged
from folioflow.sources.cache_store import CacheStore

CACHE = "key string, value string"
#: What gives (key, value) of a table's keys.
Finder = Callable[[DataFrame], DataFrame]


def full_key(namespace: str, text: str | Column, lang: str | Column, target: str) -> Column:
    return F.concat(F.lit(f"local|{namespace}|"), tx.cache_key(text, lang, F.lit(target)))


def digest(text: str | Column, lang: str | Column, target: str) -> Column:
    return F.unhex(tx.cache_key(text, lang, F.lit(target)))


def key_of(namespace: str, code: str | Column) -> Column:
    """A cache's key of a code, which is the key's digest in base 64: it takes half of the key's room where plans write and move it."""
    return F.concat(F.lit(f"local|{namespace}|"), F.lower(F.hex(F.unbase64(code))))


def code_of(key: str | Column) -> Column:
    return F.base64(F.unhex(F.right(key, F.lit(64))))


def valid_cache(cache: DataFrame) -> DataFrame:
    """Entries that are translations, not blanks or error pages; one a key."""
    return cache.filter(F.col("key").isNotNull() & tx.is_valid_translation("value")).groupBy("key").agg(F.min("value").alias("value"))


def finder(cache: DataFrame | CacheStore) -> Finder:
    """What gives (key, value) of asked keys: a store reads its buckets where they lie, of any other table the valid entries are grouped and joined."""
    if isinstance(cache, CacheStore):
        return cache.lookup
    valid = valid_cache(cache)
    return lambda asked: asked.select("key").join(valid, "key")


class Found(NamedTuple):
    """(code, value, error, cached) of texts, and the staged tables that they are read from."""

    rows: DataFrame
    tables: list[DataFrame]


def looked_up(wanted: DataFrame, find: Finder, run: Runner, namespace: str) -> Found:
    """What each distinct wanted (code, lang, text) comes to: from the cache, else from the model.

    Equal texts reach the model once, wherever they stand, and so do their parts. Misses go through the
    rounds of operators.recovery, so a source with many texts, or a text that fails, is not one task.
    """
    texts = staged(wanted.dropDuplicates(["code"]).select(F.col("code").alias("key"), "lang", "text"))
    hits = staged(find(texts.select(key_of(namespace, "key").alias("key"))).select(code_of("key").alias("code"), "value"))
    if not hits.isEmpty():
        everything, texts = texts, staged(texts.join(hits.select(F.col("code").alias("key")), "key", "left_anti"))
        dropped(everything)
    new = translated(texts, run, spent=True)
    known = hits.select("code", "value", F.lit(None).cast("string").alias("error"), F.lit(True).alias("cached"))
    usable = tx.is_valid_translation("value")
    why = F.coalesce("error", F.when(~usable, F.lit("ValueError: not a translation")))
    rows = known.unionByName(new.select(F.col("key").alias("code"), F.when(usable, F.col("value")).alias("value"), why.alias("error"), F.lit(False).alias("cached")))
    return Found(rows, [hits, new])


class Translated(NamedTuple):
    """results: (id, translation, error, n_parts, n_cached, n_protected, n_recovered, n_terms), ids digests of text and language; a text without parts has no row.

    added: the cache's new entries (key, value). of_results and of_added are the staged tables that these are read from.
    """

    results: DataFrame
    added: DataFrame
    of_results: list[DataFrame]
    of_added: list[DataFrame]


def translations(
    units: DataFrame, cache: DataFrame | CacheStore, run: Runner, target: str, namespace: str, protect_elements: bool = True,
    profile: str | None = None, custom: dict[str, str] | None = None, variant: str | None = None, entries: bool = True,
) -> Translated:
    """What units (text, lang), neither of them null, come to; without entries, what added is read from is dropped early and added may not be read.

    Technical elements are masked; where a marker comes back damaged, or the masked text fails, only the text between
    elements is translated and the elements are put between. If that fails too, the unit has an error and no translation.

    Units are taken apart twice, for what the model is asked and for what its answers are put into, as either would take
    as much room on disk as the units themselves.
    """
    each = units.select(digest("text", "lang", target).alias("id"), "lang", split_text("text").alias("parts"))
    parts = each.select("id", "lang", F.size("parts").alias("n_parts"), F.posexplode("parts").alias("part_no", "part"))
    spans = protect.protected("part") if protect_elements else F.array().cast(protect._SPAN)
    parts = parts.withColumn("spans", spans)
    hit = F.size("spans") > 0
    parts = parts.withColumn("masked", F.when(hit, protect.masked(protect.segments("part", "spans"))).otherwise(F.col("part")))
    parts = parts.withColumn("code", F.base64(digest("masked", "lang", target)))
    find = finder(cache)
    first = looked_up(parts.select("code", "lang", F.col("masked").alias("text")), find, run, namespace)

    # of a part only what is asked for: terms need it in their languages, elements where it has any
    whole = hit | has_terms("lang", profile, custom)
    at = F.struct("id", "part_no", "n_parts", F.when(hit, F.col("spans")).alias("spans"), F.when(hit, F.col("part")).alias("part"))
    places = parts.groupBy("code").agg(F.first("lang").alias("lang"), F.collect_set(at).alias("places"), F.first(F.when(whole & ~hit, F.col("part")), ignorenulls=True).alias("source"))
    rows = places.join(first.rows, "code").select("lang", "source", "value", "error", "cached", F.explode("places").alias("at"))
    rows = rows.select("at.*", "lang", F.coalesce("at.part", "source").alias("source"), "value", "error", "cached")
    rows = rows.withColumn("out", F.when(F.col("error").isNull(), F.when(F.col("spans").isNotNull(), protect.restored("value", "spans")).otherwise(F.col("value"))))
    failed = F.col("out").isNull() & F.col("spans").isNotNull()
    rows = rows.withColumn("terms", glossary("source", "out", "lang", profile, custom))
    rows = staged(rows.select(
        "id", "part_no", "n_parts", "lang", F.col("terms.text").alias("text"), F.col("terms.n").cast("long").alias("n_terms"), "error", "cached", F.size(F.coalesce("spans", F.array().cast(protect._SPAN))).alias("n_spans"),
        F.when(failed, F.col("source")).alias("source"), F.when(failed, protect.segments("source", "spans")).alias("segments"),
    ))
    of_rows, of_added = [rows], list(first.tables)
    added = [first.rows]
    counted = rows.select("id", "part_no", "n_parts", "text", F.when(F.col("text").isNull(), F.col("error")).alias("why"), "cached", "n_spans", F.lit(False).alias("recovered"), "n_terms")
    if not (failed := rows.filter("segments is not null")).isEmpty():
        second, pieces = _between(failed, finder_of_both(find, first.rows, namespace), run, namespace, target)
        pieces = failed.join(pieces, ["id", "part_no"], "left").withColumn("terms", glossary("source", "joined", "lang", profile, custom))
        why = F.when(F.col("joined").isNull(), F.coalesce("piece_error", "error", F.lit("ValueError: an element is lost")))
        again = staged(pieces.select("id", "part_no", "n_parts", F.col("terms.text").alias("text"), why.alias("why"), F.coalesce("pieces_cached", "cached").alias("cached"), "n_spans", F.lit(True).alias("recovered"), F.col("terms.n").cast("long").alias("n_terms")))
        counted = counted.join(again.select("id", "part_no"), ["id", "part_no"], "left_anti").unionByName(again)
        of_rows.append(again)
        of_added += second.tables
        added.append(second.rows)
    if not entries:
        dropped(*of_added)

    count = lambda x, name: x.cast("long").alias(name)
    sums = {"n_cached": F.col("cached"), "n_protected": F.col("n_spans"), "n_recovered": F.col("recovered"), "n_terms": F.col("n_terms")}
    alone = counted.filter("n_parts = 1").select("id", "text", F.col("why").alias("error"), F.lit(1).cast("long").alias("n_parts"), *[count(x, k) for k, x in sums.items()])
    ordered = F.array_sort(F.collect_list(F.struct("part_no", "text")))
    several = counted.filter("n_parts > 1").groupBy("id").agg(
        F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"), F.min("why").alias("error"), F.count("*").alias("n_parts"), *[F.sum(x.cast("long")).alias(k) for k, x in sums.items()],
    )
    text = F.trim(F.coalesce("text", F.lit("")))
    text = F.when(F.col("error").isNull(), portuguese.brazilian(text) if variant == "pt-BR" else text)
    results = alone.unionByName(several).select("id", text.alias("translation"), "error", "n_parts", *sums)
    entry = reduce(DataFrame.unionByName, added).filter("value is not null and not cached").select(key_of(namespace, "code").alias("key"), "value").distinct()
    return Translated(results, entry, of_rows, of_added)


def translate(
    units: DataFrame, cache: DataFrame | CacheStore, run: Runner, target: str, namespace: str, label: str = "local", protect_elements: bool = True,
    profile: str | None = None, custom: dict[str, str] | None = None, variant: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Results for units (text, lang) and the cache's new entries (key, value).

    Results have one row a distinct (text, lang): translation, error, n_parts, n_cached, n_protected,
    n_recovered, n_terms and providers; see translations. Null texts are empty and have an empty translation.
    """
    inputs = units.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))
    found = translations(inputs, cache, run, target, namespace, protect_elements, profile, custom, variant)
    results = inputs.distinct().withColumn("id", digest("text", "lang", target)).join(found.results, "id", "left")
    results = results.withColumn("translation", F.when(F.col("n_parts").isNull(), "").otherwise(F.col("translation")))
    results = results.withColumn("providers", F.when(F.col("error").isNull(), F.array(F.lit(label)))).fillna(0, ["n_parts", "n_cached", "n_protected", "n_recovered", "n_terms"])
    results = staged(results.drop("id"))
    dropped(*found.of_results)
    return results, found.added


def finder_of_both(find: Finder, first: DataFrame, namespace: str) -> Finder:
    """find, and behind it what the model gave in the round before."""
    new = first.filter("value is not null and not cached").select(key_of(namespace, "code").alias("key"), "value")

    def both(asked: DataFrame) -> DataFrame:
        keys = asked.select("key")
        return find(keys).unionByName(keys.join(new, "key"))

    return both


def _between(failed: DataFrame, find: Finder, run: Runner, namespace: str, target: str) -> tuple[Found, DataFrame]:
    """Looked-up segments, and (id, part_no, joined, piece_error, pieces_cached): elements as they are, the text between them translated by itself."""
    each = failed.select("id", "part_no", "lang", F.posexplode("segments").alias("k", "s"))
    plain = ~F.col("s.hit") & (tx.latin_letters("s.text") >= 2)
    each = each.select("id", "part_no", "lang", "k", F.col("s.text").alias("segment"), F.when(plain, tx.strip("s.text")).alias("inner"))
    each = each.withColumn("code", F.when(F.col("inner").isNotNull(), F.base64(digest("inner", "lang", target))))
    found = looked_up(each.filter("code is not null").select("code", "lang", F.col("inner").alias("text")), find, run, namespace)
    each = each.join(found.rows, "code", "left")
    blank = lambda pattern: F.when(tx.rx(F.col("segment"), pattern), " ").otherwise("")
    piece = F.when(F.col("code").isNull(), F.col("segment")).when(F.col("value").isNotNull(), F.concat(blank(r"^\s"), tx.strip("value"), blank(r"\s$")))
    each = each.withColumn("piece", piece)
    ordered = F.array_sort(F.collect_list(F.struct("k", "piece")))
    lost = F.max((F.col("piece").isNull()).cast("int")) == 1
    whole = tx.normalize_spaces(F.array_join(F.transform(ordered, lambda x: x["piece"]), ""))
    return found, each.groupBy("id", "part_no").agg(F.when(~lost, whole).alias("joined"), F.min("error").alias("piece_error"), F.bool_and(F.coalesce("cached", F.lit(True))).alias("pieces_cached"))
