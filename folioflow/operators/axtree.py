"""Units from accessibility trees of a viewer, as dumped lines and as nodes; merging and choosing of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as tx
from folioflow.operators.running import last_so_far, most_before, sum_before
from folioflow.operators.trees import descendants
from folioflow.plans.stages import staged

# Lines that the viewer itself puts around a text; names of a page; roles.
BANNERS = ("start of extracted text", "end of extracted text", "início do texto extraído", "fim do texto extraído")
VENDOR = ("powered by google ai", "texto extraído, desenvolvido pelo google")
PAGE_NAME = r"(?i)(?:page|p[aá]gina|pagina|seite)\s*(\d+)"
PAGE_ROLES = ("region", "group", "genericcontainer", "section")
PARAGRAPH_ROLES = ("paragraph", "heading", "listitem", "blockquote")
VIEWER = "mhjfbmdgcfjbbpaeojofohoefgiehjai"
#: A name in quotes, on a line in which escaped quotes and backslashes stand as control characters: Java
#: matches a choice of characters and escapes by recursion, which long names overflow.
_QUOTED = "'([^']*)'"
_ESCAPES = (("\\\\", "\x02", "\\"), ("\\'", "\x01", "'"))
_NUMBER = r"(-?\d+(?:\.\d+)?)"
_SIZE = r"(\d+(?:\.\d+)?)"
#: Leftover texts are put together up to so many characters.
BUFFER_CHARS = 900
#: A page counts as read with so many letters.
LEAST_LETTERS = 35


def _shielded(line: Column) -> Column:
    for escape, mark, _ in _ESCAPES:
        line = F.replace(line, F.lit(escape), F.lit(mark))
    return line


def unescaped(name: Column) -> Column:
    """A shielded name as it was meant."""
    name = F.replace(name, F.lit('\\"'), F.lit('"'))
    for _, mark, meant in _ESCAPES:
        name = F.replace(name, F.lit(mark), F.lit(meant))
    return name


def _first(*found: Column) -> Column:
    return F.coalesce(*[F.when(x != "", x) for x in found], F.lit(""))


def dump_name(line: str | Column) -> Column:
    """The name on a dumped line, given as name='…' or behind the role; empty where there is none."""
    x = _shielded(tx.col(line))
    return unescaped(_first(F.regexp_extract(x, rf"\bname={_QUOTED}", 1), F.regexp_extract(x, rf"(?i)\b(?:staticText|heading|link)\s+{_QUOTED}", 1)))


def dump_bounds(line: str | Column) -> Column:
    """Struct (x, y, w, h) of a dumped line, null where it has none."""
    x = tx.col(line)
    place = rf"location=\({_NUMBER},\s*{_NUMBER}\)\s+size=\({_SIZE},\s*{_SIZE}\)"
    box = rf"bounds=\({_NUMBER},\s*{_NUMBER},\s*{_SIZE},\s*{_SIZE}\)"
    of = lambda p: F.when(x.rlike(p), F.struct(*[F.regexp_extract(x, p, k + 1).cast("double").alias(n) for k, n in enumerate("xywh")]))
    return F.coalesce(of(place), of(box))


def dump_page(line: str | Column) -> Column:
    """The page number of a dumped region, else null."""
    x = tx.col(line)
    name = _first(dump_name(x), unescaped(F.regexp_extract(_shielded(x), rf"(?i)\bregion\s+{_QUOTED}", 1)))
    number = F.regexp_extract(name, PAGE_NAME, 1)
    return F.when(x.rlike(r"(?i)\bregion\b") & (number != ""), number.try_cast("int"))


def dump_units(lines: DataFrame) -> DataFrame:
    """(doc_key, page_no, nth, text, bounds, line_bounds) of dumped lines (doc_key, line_no, line).

    A region with a page's name starts a page, a paragraph or heading a unit; texts behind a page's
    start without a paragraph are a unit of their own. Units that are noise or the viewer's own banner
    go. A dump is what one viewer shows of one document.
    """
    x = tx.strip("line")
    rows = lines.withColumn("line", x).filter("line != ''")
    page = dump_page("line")
    text = F.col("line").rlike(r"(?i)\bstaticText\b")
    box = F.col("line").rlike(r"(?i)\binlineTextBox\b")
    opens = F.col("line").rlike(r"(?i)\b(?:paragraph|heading)\b") & ~text & ~box
    rows = rows.withColumns({"new_page": page, "opens": opens & page.isNull(), "is_text": text & page.isNull() & ~opens, "is_box": box & page.isNull() & ~opens & ~text})
    order = Window.partitionBy("doc_key").orderBy("line_no")
    up_to = order.rowsBetween(Window.unboundedPreceding, 0)
    starts = F.col("new_page").isNotNull() | F.col("opens")
    rows = rows.withColumns({"page_no": F.last("new_page", ignorenulls=True).over(up_to), "unit": F.sum(starts.cast("int")).over(up_to), "name": dump_name("line"), "box": dump_bounds("line")})
    banner = F.lower(tx.normalize_spaces("name")).isin(*BANNERS)
    rows = rows.filter(F.col("page_no").isNotNull()).withColumn("is_text", F.col("is_text") & (F.col("name") != "") & ~banner)
    begun = F.max((F.col("opens") | F.col("is_text")).cast("int")).over(Window.partitionBy("doc_key", "unit").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)) == 1
    rows = rows.withColumn("begun", begun)
    item = lambda when, *c: F.array_sort(F.collect_list(F.when(when, F.struct("line_no", *c))))
    units = rows.groupBy("doc_key", "page_no", "unit").agg(item(F.col("is_text"), "name", "box").alias("texts"), item(F.col("is_box") & F.col("begun") & F.col("box").isNotNull(), "box").alias("boxes"), F.max(F.when(F.col("opens"), F.col("box"))).alias("own"))
    joined = F.aggregate(F.transform("texts", lambda t: t["name"]), F.lit("").cast("string"), lambda out, t: F.when(out == "", t).otherwise(tx.merge_text(out, t)))
    first_box = F.get(F.filter(F.transform("texts", lambda t: t["box"]), lambda b: b.isNotNull()), F.lit(0))
    units = units.select("doc_key", "page_no", "unit", tx.normalize_spaces(joined).alias("text"), F.coalesce("own", first_box).alias("bounds"), F.transform("boxes", lambda b: b["box"]).alias("line_bounds"))
    low = F.lower("text")
    shown = F.lit(False)
    for mark in BANNERS + VENDOR:
        shown = shown | F.contains(low, F.lit(mark))
    units = units.filter(~tx.is_noise("text") & ~shown)
    return units.select("doc_key", "page_no", F.row_number().over(Window.partitionBy("doc_key", "page_no").orderBy("unit")).alias("nth"), "text", "bounds", "line_bounds")


def node_page(role: str | Column, name: str | Column) -> Column:
    number = F.regexp_extract(tx.normalize_spaces(name), PAGE_NAME, 1)
    return F.when(F.lower(tx.strip(role)).isin(*PAGE_ROLES) & (number != ""), number.try_cast("int"))


def node_units(nodes: DataFrame) -> DataFrame:
    """(doc_key, page_no, nth, text) of nodes (doc_key, pos, node_id, role, name, child_ids).

    Texts below a paragraph are one unit, the first paragraph that has a text keeps it; where a text
    node has boxes with the same words, the text alone counts. Texts below no paragraph are put
    together in order, up to 900 characters or a sentence's end. Equal units of a page count once. Of
    regions with one page number the last with units counts; without any region all is page 1.
    """
    role, name = F.lower(tx.strip(F.coalesce("role", F.lit("")))), tx.normalize_spaces(F.coalesce("name", F.lit("")))
    nodes = staged(nodes.select("doc_key", "pos", "node_id", role.alias("role"), name.alias("name"), "child_ids", node_page(role, name).alias("page_no")))
    pages = nodes.filter("page_no is not null").select("doc_key", F.col("node_id").alias("root"), F.col("pos").alias("root_pos"), "page_no")
    below = descendants(nodes, pages).join(nodes.select("doc_key", "node_id", "role", "name"), ["doc_key", "node_id"])
    below = below.filter(F.col("role").isin("statictext", *PARAGRAPH_ROLES)).withColumn("page", F.struct("doc_key", "root"))
    head = F.col("role").isin(*PARAGRAPH_ROLES)
    # only outermost paragraphs count: those that don't lie in the reach of one before
    below = staged(most_before(below, "page", "pre", F.when(head, F.col("last")), "reach"))
    outer = F.when(head & F.coalesce(F.col("reach") < F.col("pre"), F.lit(True)), F.struct(F.col("pre").alias("at"), F.col("last").alias("reach")))
    rows = last_so_far(below, "page", "pre", ["node_id"], outer, "owner").filter((F.col("role") == "statictext") & (F.col("name") != ""))
    rows = staged(rows.select("doc_key", "root", "pre", "name", F.when(F.col("owner.reach") >= F.col("pre"), F.col("owner.at")).alias("at")))
    whole = lambda x: tx.normalize_spaces(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "name"))), lambda t: t["name"]), x))
    inside = rows.filter("at is not null").groupBy("doc_key", "root", "at").agg(whole(" ").alias("text")).select("doc_key", "root", F.lit(0).alias("kind"), "at", F.lit(0).alias("k"), "text")
    left = rows.filter(F.col("at").isNull() & ~tx.is_noise("name")).groupBy("doc_key", "root").agg(F.transform(F.array_sort(F.collect_list(F.struct("pre", "name"))), lambda t: t["name"]).alias("names"))
    left = left.select("doc_key", "root", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("at"), F.posexplode(buffered("names")).alias("k", "text"))
    units = inside.filter(~tx.is_noise("text")).unionByName(left.filter("text != ''")).join(pages, ["doc_key", "root"])
    last = Window.partitionBy("doc_key", "page_no").orderBy(F.desc("root_pos"))
    units = units.withColumn("newest", F.dense_rank().over(last)).filter("newest = 1")
    place = F.struct("kind", "at", "k")
    once = units.groupBy("doc_key", "page_no", "text").agg(F.min(place).alias("place"))
    once = once.select("doc_key", "page_no", F.row_number().over(Window.partitionBy("doc_key", "page_no").orderBy("place")).alias("nth"), "text")
    flat = nodes.filter((F.col("role") == "statictext") & ~tx.is_noise("name")).join(once.select("doc_key").distinct(), "doc_key", "left_anti")
    flat = flat.groupBy("doc_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda t: t["name"]).alias("names"))
    flat = flat.select("doc_key", F.lit(1).alias("page_no"), F.lit(1).alias("nth"), tx.normalize_spaces(F.array_join("names", " ")).alias("text")).filter("text != ''")
    return once.unionByName(flat)


def buffered(names: str | Column, most: int = BUFFER_CHARS) -> Column:
    """An array of texts put together in order: a new one starts behind a sentence's end, or where it would grow too long."""
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("last"), F.array().cast("array<string>").alias("out"))

    def step(out: Column, x: Column) -> Column:
        new = (out["n"] == 0) | (out["n"] + F.length(x) > most) | out["last"].rlike("[.!?;:]$")
        grown = F.concat(F.element_at(out["out"], -1), F.lit(" "), x)
        return F.when(new, F.struct((F.length(x) + 1).alias("n"), x.alias("last"), F.array_append(out["out"], x).alias("out"))).otherwise(
            F.struct((out["n"] + F.length(x) + 1).alias("n"), x.alias("last"), F.array_append(F.slice(out["out"], F.lit(1), F.size(out["out"]) - 1), grown).alias("out"))
        )

    return F.transform(F.aggregate(tx.col(names), start, step, lambda out: out["out"]), tx.normalize_spaces)


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """Units (doc_key, page_no, nth, text) of both, those of first before, equal texts of a page once."""
    both = first.withColumn("side", F.lit(0)).unionByName(second.withColumn("side", F.lit(1)))
    once = both.withColumn("text", tx.normalize_spaces("text")).filter("text != ''").groupBy("doc_key", "page_no", "text").agg(F.min(F.struct("side", "nth")).alias("place"))
    return once.select("doc_key", "page_no", F.row_number().over(Window.partitionBy("doc_key", "page_no").orderBy("place")).alias("nth"), "text")


def page_letters(units: DataFrame) -> DataFrame:
    """(doc_key, page_no, letters): how much of a page was read, for comparing snapshots."""
    return units.groupBy("doc_key", "page_no").agg(F.sum(tx.latin_letters("text").cast("long")).alias("letters"))


def best_snapshots(units: DataFrame, requested: DataFrame) -> DataFrame:
    """Of units (doc_key, snapshot, page_no, text, …) those of each document's best snapshot: with most letters on requested pages (doc_key, page_no), the first of equals."""
    on = units.join(requested.select("doc_key", "page_no").distinct(), ["doc_key", "page_no"], "left_semi")
    scores = on.groupBy("doc_key", "snapshot").agg(F.sum(F.coalesce(tx.latin_letters("text"), F.lit(0)).cast("long")).alias("letters"))
    best = scores.filter("letters > 0").groupBy("doc_key").agg(F.max(F.struct("letters", (-F.col("snapshot")).alias("first"))).alias("top"))
    return units.join(best.select("doc_key", (-F.col("top.first")).alias("snapshot")), ["doc_key", "snapshot"])


def snapshot_runs(units: DataFrame, requested: DataFrame, least: int = LEAST_LETTERS) -> DataFrame:
    """(doc_key, snapshot, letters, ready, stable): of units (doc_key, snapshot, page_no, text), how much each snapshot read of the pages asked for, requested (doc_key, page_no).

    ready: it has letters enough on each of them. stable counts the snapshots since one read more than all before
    it; that one itself has 0. Snapshots without any unit of the pages asked for read 0 letters; a document without
    such pages is ready at once.
    """
    asked = requested.select("doc_key", "page_no").distinct()
    wanted = asked.groupBy("doc_key").agg(F.count("*").alias("wanted"))
    on = units.join(asked, ["doc_key", "page_no"], "left_semi").groupBy("doc_key", "snapshot", "page_no").agg(F.sum(F.coalesce(tx.latin_letters("text"), F.lit(0)).cast("long")).alias("letters"))
    sums = on.groupBy("doc_key", "snapshot").agg(F.sum("letters").alias("letters"), F.count_if(F.col("letters") >= least).alias("full"))
    rows = units.select("doc_key", "snapshot").distinct().join(sums, ["doc_key", "snapshot"], "left").join(wanted, "doc_key", "left")
    zero = F.lit(0).cast("long")
    rows = rows.select("doc_key", "snapshot", F.coalesce("letters", zero).alias("letters"), (F.coalesce("full", zero) >= F.coalesce("wanted", zero)).alias("ready"), F.lit(1).alias("one"))
    rows = sum_before(most_before(staged(rows), "doc_key", "snapshot", F.col("letters"), "most"), "doc_key", "snapshot", "one", "nth")
    grew = F.coalesce(F.col("letters") > F.col("most"), F.lit(True))
    rows = last_so_far(rows, "doc_key", "snapshot", [], F.when(grew, F.col("nth")), "since")
    return rows.select("doc_key", "snapshot", "letters", "ready", (F.col("nth") - F.col("since")).alias("stable"))


def chosen_snapshots(runs: DataFrame, least_stable: int = 1) -> DataFrame:
    """(doc_key, snapshot, letters, settled) of snapshot_runs: the first that is ready and stable; where none is, the first of those that read most, not settled."""
    first = F.min(F.when(F.col("ready") & (F.col("stable") >= least_stable), F.struct("snapshot", "letters")))
    most = F.max(F.struct("letters", (-F.col("snapshot")).alias("first")))
    found = runs.groupBy("doc_key").agg(first.alias("settled"), most.alias("most"))
    of = lambda x, y: F.when(F.col("settled").isNotNull(), x).otherwise(y)
    return found.select("doc_key", of(F.col("settled.snapshot"), -F.col("most.first")).alias("snapshot"), of(F.col("settled.letters"), F.col("most.letters")).alias("letters"), F.col("settled").isNotNull().alias("settled"))


def read_pages(units: DataFrame, requested: DataFrame, chosen: DataFrame) -> DataFrame:
    """What the cache of read pages takes: of units those of requested pages in the chosen snapshots that are settled."""
    kept = units.join(chosen.filter("settled").select("doc_key", "snapshot"), ["doc_key", "snapshot"], "left_semi")
    return kept.join(requested.select("doc_key", "page_no").distinct(), ["doc_key", "page_no"], "left_semi")


def cached_pages(cache: DataFrame, requested: DataFrame, least: int = LEAST_LETTERS) -> DataFrame:
    """Rows of cache (sha256, page_no, text, …) for requested (doc_key, sha256, page_no), of documents of which every page asked for has letters enough."""
    read = cache.groupBy("sha256", "page_no").agg(F.sum(tx.latin_letters("text")).alias("letters"))
    asked = requested.join(read, ["sha256", "page_no"], "left")
    whole = asked.groupBy("doc_key").agg(F.bool_and(F.coalesce(F.col("letters") >= least, F.lit(False))).alias("whole")).filter("whole").select("doc_key")
    return requested.join(whole, "doc_key").join(cache, ["sha256", "page_no"])


def ranked_targets(targets: DataFrame, hint: str, url: str, most: int = 5) -> DataFrame:
    """Viewer targets (pos, type, title, url) with their score, best first, those that match nothing left out."""
    text = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("url", F.lit(""))))
    named, at = hint.lower(), url.lower()
    points = F.lit(0)
    if named:
        points = points + F.when(F.contains(text, F.lit(named)), 10).otherwise(0)
    if at:
        points = points + F.when(F.contains(text, F.lit(at)) | F.contains(F.lit(at), text), 8).otherwise(0)
    points = points + F.when(F.contains(text, F.lit("pdf")), 2).otherwise(0) + F.when(F.contains(text, F.lit(VIEWER)), 5).otherwise(0)
    rows = targets.filter(F.col("type").isin("page", "iframe", "webview")).withColumn("score", points).filter("score > 0")
    return rows.orderBy(F.desc("score"), "pos").limit(most)
