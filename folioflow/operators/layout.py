"""From lines with geometry to paragraphs in reading order, and to units of text.

A page is the largest group that any of these needs together. Line tables have doc_key, page_no,
block_no, line_no, text, x0, y0, x1, y1, font_size; page tables have doc_key, page_no, width, height.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as tx
from folioflow.operators.running import last_so_far
from folioflow.plans.stages import bounded, staged

PAGE = ["doc_key", "page_no"]
#: Share of a page's height that is margin, at the top and at the bottom.
MARGIN = 0.10
UNIT_CHARS, REQUEST_CHARS = 1200, 3500
#: Running heads and feet that are broadcast.
BROADCAST_KEYS = 200_000


def in_margin(y0: str = "y0", y1: str = "y1", height: str | Column = "height") -> Column:
    h = tx.col(height)
    return (F.col(y1) <= h * MARGIN) | (F.col(y0) >= h * (1 - MARGIN))


def margin_keys(lines: DataFrame, pages: DataFrame, least_pages: int = 3, ratio: float = 0.25) -> DataFrame:
    """(doc_key, margin_key, n_pages): running heads and feet, on a quarter of a document's pages and on three at least.

    Pages count whether or not they have lines, and whatever range of pages is wanted later.
    """
    sizes = pages.groupBy("doc_key").agg(F.count("*").alias("of"))
    zone = lines.join(pages, PAGE).filter(in_margin()).select(*PAGE, tx.margin_key("text").alias("margin_key"))
    seen = zone.filter(F.length("margin_key") >= 3).groupBy("doc_key", "margin_key").agg(F.count_distinct("page_no").alias("n_pages"))
    least = F.greatest(F.lit(least_pages), F.floor(F.col("of") * ratio + 0.999))
    return seen.join(sizes, "doc_key").filter(F.col("n_pages") >= least).select("doc_key", "margin_key", "n_pages")


def kept_lines(lines: DataFrame, pages: DataFrame, keys: DataFrame) -> DataFrame:
    """lines (with the page's width and height) without running heads and feet, page numbers in margins, and noise."""
    number = F.coalesce(tx.rx(F.col("text"), r"^\s*\d+(?:\s*/\s*\d+)?\s*$"), F.lit(False))
    rows = lines.filter(~tx.is_noise("text")).join(pages, PAGE).filter(~(in_margin() & number))
    # lines outside margins meet no key; where keys aren't broadcast, they go to their page's place, not all of a document's to one
    rows = rows.withColumn("margin_key", F.when(in_margin(), tx.margin_key("text")))
    rows = rows.withColumns({"outside": F.col("margin_key").isNull(), "at": F.when(F.col("margin_key").isNull(), F.col("page_no")).otherwise(0), "margin_key": F.coalesce("margin_key", F.lit(""))})
    keys = bounded(staged(keys.select("doc_key", "margin_key", F.lit(False).alias("outside"), F.lit(0).alias("at"))), BROADCAST_KEYS)
    return rows.join(keys, ["doc_key", "margin_key", "outside", "at"], "left_anti").drop("margin_key", "outside", "at")


def paragraphs(lines: DataFrame) -> DataFrame:
    """Lines of each block as paragraphs: text, box, median font, lines, and whether it isn't the block's first.

    A paragraph starts where the line before ends a sentence, the line itself starts with a capital or
    a digit, and it is indented or set apart. Only the line before matters, so a lag and a running sum do.
    """
    block = Window.partitionBy(*PAGE, "block_no")
    order = block.orderBy("line_no")
    rows = lines.withColumn("line_text", tx.normalize_spaces("text"))
    typical = F.coalesce(F.median(F.when(F.col("font_size") > 0, F.col("font_size"))).over(block), F.lit(10.0))
    rows = rows.withColumns({"typical": typical, "base_x": F.min("x0").over(block), "before": F.lag("line_text").over(order), "above": F.lag("y1").over(order)})
    begins = F.regexp_replace("line_text", f"^[{tx.OPENERS}]+", "").rlike(r"^[\p{Lu}\p{Nd}]")
    indented = F.col("x0") - F.col("base_x") >= F.greatest(F.lit(5.0), F.col("typical") * 0.75)
    apart = F.col("y0") - F.col("above") >= F.greatest(F.lit(1.5), F.col("typical") * 0.14)
    new = F.coalesce(tx.rx(F.col("before"), tx.SENTENCE_END) & begins & (indented | apart), F.lit(False))
    rows = rows.withColumn("group_no", F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.struct("line_no", "line_text", "x0", "y0", "x1", "y1", "font_size")
    grouped = rows.groupBy(*PAGE, "block_no", "group_no").agg(
        F.array_sort(F.collect_list(item)).alias("lines"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.coalesce(F.median(F.when(F.col("font_size") > 0, F.col("font_size"))), F.lit(0.0)).alias("font_size"), F.first("width").alias("width"), F.first("height").alias("height"),
    )
    alone = F.when(F.size("lines") == 1, F.get("lines", 0)["line_text"])
    joined = grouped.withColumn("text", alone.otherwise(tx.join_lines(F.transform("lines", lambda x: x["line_text"]), clean=True)))
    joined = joined.filter(~tx.is_noise("text")).withColumn("paragraph_break_before", F.col("group_no") > 0)
    return joined.withColumn("orig_no", F.row_number().over(Window.partitionBy(*PAGE).orderBy("block_no", "group_no")))


def slim(blocks: DataFrame) -> DataFrame:
    """blocks without the text of those of one line, which full gives back: most blocks are one line, and hold it twice."""
    return blocks.withColumn("text", F.when(F.size("lines") != 1, F.col("text")))


def full(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("text", F.coalesce("text", F.get("lines", F.lit(0))["line_text"]))


def column_pages(blocks: DataFrame) -> DataFrame:
    """(doc_key, page_no, two_columns): whether blocks lie in two columns that go on beside each other.

    Three blocks and 120 characters a side, an overlap of 45 % of the shorter side's height, and three
    blocks of the smaller side (the left if equal) level with one of the other side.
    """
    w, centre = F.col("width"), (F.col("x0") + F.col("x1")) / 2
    narrow = (F.col("x1") - F.col("x0")) < w * 0.62
    left = narrow & (centre <= w * 0.46) & (F.col("x1") <= w * 0.64)
    right = narrow & ~left & (centre >= w * 0.54) & (F.col("x0") >= w * 0.36)
    sides = blocks.withColumn("side", F.when(left, "l").when(right, "r")).filter("side is not null")
    of = lambda side, value: F.when(F.col("side") == side, value)
    page = sides.groupBy(*PAGE).agg(*[
        x for s in "lr" for x in (
            F.count(of(s, 1)).alias(f"n_{s}"), F.coalesce(F.sum(of(s, F.length("text"))), F.lit(0)).alias(f"chars_{s}"),
            F.min(of(s, F.col("y0"))).alias(f"top_{s}"), F.max(of(s, F.col("y1"))).alias(f"bottom_{s}"),
        )
    ])
    overlap = F.greatest(F.lit(0.0), F.least("bottom_l", "bottom_r") - F.greatest("top_l", "top_r"))
    span = F.least(F.col("bottom_l") - F.col("top_l"), F.col("bottom_r") - F.col("top_r"))
    page = page.filter((F.least("n_l", "n_r") >= 3) & (F.least("chars_l", "chars_r") >= 120) & (span > 0) & (overlap / span >= 0.45))
    page = page.select(*PAGE, F.when(F.col("n_l") <= F.col("n_r"), "l").otherwise("r").alias("smaller"))
    sides = sides.join(page, PAGE)
    level = (F.col("y0") + F.col("y1")) / 2
    small = sides.filter("side = smaller").select(*PAGE, "orig_no", level.alias("level"), F.greatest(F.lit(24.0), F.col("font_size") * 2.5).alias("slack"))
    large = sides.filter("side <> smaller").select(*PAGE, F.col("y0").alias("low"), F.col("y1").alias("high"))
    near = (small["level"] >= large["low"] - small["slack"]) & (small["level"] <= large["high"] + small["slack"])
    same = (small["doc_key"] == large["doc_key"]) & (small["page_no"] == large["page_no"])
    met = small.join(large, same & near, "left_semi").groupBy(*PAGE).agg(F.count("*").alias("met")).filter("met >= 3")
    return blocks.select(*PAGE).distinct().join(met, PAGE, "left").select(*PAGE, F.col("met").isNotNull().alias("two_columns"))


def block_column(two_columns: str | Column = "two_columns") -> Column:
    w = F.col("width")
    wide = (F.col("x1") - F.col("x0") >= w * 0.72) | ((F.col("x0") < w * 0.28) & (F.col("x1") > w * 0.72))
    return F.when(~tx.col(two_columns), "single").when(wide, "wide").when(F.col("x0") + F.col("x1") < w, "left").otherwise("right")


def reading_order(blocks: DataFrame, pages_with_columns: DataFrame) -> DataFrame:
    """blocks with column and place, their order on the page from 1 on.

    One column: from top to bottom, then from left to right. Two: wide blocks part bands, each read left
    column first; a narrow block that starts within a wide block's height is in no band and comes last.
    """
    rows = blocks.join(pages_with_columns, PAGE).withColumn("column", block_column())
    page = Window.partitionBy(*PAGE)
    wide = F.col("column") == "wide"
    above = page.orderBy("y0").rangeBetween(Window.unboundedPreceding, 0)
    rank = F.sum(wide.cast("int")).over(page.orderBy(F.col("y0"), F.col("orig_no")).rowsBetween(Window.unboundedPreceding, 0))
    bands = F.sum(wide.cast("int")).over(above)
    # the lower end of the last wide block, in their order, that starts at or above this block
    last = F.max(F.when(wide, F.struct("y0", "orig_no", "y1"))).over(above)["y1"]
    rows = rows.withColumns({"rank": rank, "bands": bands, "last": last})
    orphan = (F.col("column") != "single") & ~wide & (F.col("bands") > 0) & (F.col("y0") < F.col("last"))
    single, left = F.col("column") == "single", F.col("column") == "left"
    band = F.when(single | orphan, 0).when(wide, F.col("rank") - 1).otherwise(F.col("bands"))
    within = F.when(single | orphan, 0).when(wide, 3).when(left, 1).otherwise(2)
    top = F.when(wide | orphan, 0.0).otherwise(F.col("y0"))
    key = F.struct(orphan.alias("orphan"), band.alias("band"), within.alias("within"), top.alias("top"), F.when(single, F.col("x0")).otherwise(0.0).alias("x"))
    rows = rows.withColumn("key", key)
    return rows.withColumn("place", F.row_number().over(page.orderBy("key", "orig_no"))).drop("key", "rank", "bands", "last")


def _long_font() -> Column:
    return F.when((F.col("font_size") > 0) & (F.length("text") > 80), F.col("font_size"))


def body_fonts(blocks: DataFrame) -> DataFrame:
    """(doc_key, page_no, body_font): the median font of blocks over 80 characters; 10 where there is none."""
    return blocks.groupBy(*PAGE).agg(F.coalesce(F.median(_long_font()), F.lit(10.0)).alias("body_font"))


UNIT = "doc_key string, page_no int, unit_no int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, n_lines int, column string, width double, height double"


def units(ordered: DataFrame, max_chars: int = UNIT_CHARS, merge: bool = True) -> DataFrame:
    """Blocks in reading order as units: neighbours that go on in each other joined, long ones parted at line ends.

    What a block joins is the unit so far, not the block before, so each page is folded in order. A
    page is a row of its blocks; pages are small and many, and pass in batches. What the fold asks of
    single blocks is worked out in columns before.
    """
    limit = max(200, int(max_chars))
    # a window, as a join with body_fonts would work out what ordered is made of once more
    rows = ordered.withColumn("body_font", F.coalesce(F.median(_long_font()).over(Window.partitionBy(*PAGE)), F.lit(10.0)))
    rows = rows.withColumn("head", tx.is_heading("text", "font_size", "body_font"))
    items = F.transform("lines", lambda x: F.struct(x["line_text"].alias("text"), x["x0"].alias("x0"), x["y0"].alias("y0"), x["x1"].alias("x1"), x["y1"].alias("y1"), x["font_size"].alias("font_size")))
    block = F.struct("place", "text", "x0", "y0", "x1", "y1", "font_size", "column", "paragraph_break_before", "body_font", "head", "width", "height", items.alias("lines"))
    by_page = rows.groupBy(*PAGE).agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    from folioflow.operators.unit_fold import fold_pages

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fold_pages(batches, limit, max(REQUEST_CHARS, int(limit * 1.6)), merge)

    return by_page.mapInArrow(of, UNIT)


def mark_references(rows: DataFrame, order: list[str], first_line: str | Column = "text") -> DataFrame:
    """rows (doc_key, text) with preserve: inside a reference section, from its heading to the heading of an annex or the document's end.

    order are the columns that give the reading order within a document, the first of them whole
    numbers, as pages are. The state is the last heading before or at the row.
    """
    return referenced(rows, order, reference_event(first_line))


def reference_event(first_line: str | Column = "text") -> Column:
    """1 where a reference section starts, 0 where one ends, else null."""
    return F.when(tx.is_reference_heading(first_line, "text"), 1).when(tx.ends_references(first_line), 0)


def referenced(rows: DataFrame, order: list[str], event: Column) -> DataFrame:
    """As mark_references, from events that may be worked out before, where rows then hold no text."""
    rows = last_so_far(rows, "doc_key", order[0], order[1:], event, "state")
    return rows.withColumn("preserve", F.coalesce(F.col("state") == 1, F.lit(False))).drop("state")


def continuations(rows: DataFrame, most_chars: int = REQUEST_CHARS) -> DataFrame:
    """(doc_key, group_id, left_page, left_no, right_page, right_no, text): units that go on on the next page.

    rows: doc_key, page_no, unit_no, text, y0, y1, font_size, height, preserve. On each page the last
    body unit of the lower part and the first of the upper part are candidates; neighbouring pages are
    joined by page number. Units without geometry or font are never candidates.
    """
    rows = rows.join(body_fonts(rows), PAGE)
    body = ~F.col("preserve") & ~tx.is_caption_or_footnote("text", "font_size", "body_font") & ~tx.is_heading("text", "font_size", "body_font")
    low = F.when(F.col("y1") >= F.col("height") * 0.58, F.col("unit_no"))
    high = F.when(F.col("y0") <= F.col("height") * 0.42, F.col("unit_no"))
    ends = rows.filter((low.isNotNull() | high.isNotNull()) & body).groupBy(*PAGE).agg(F.max(F.when(low.isNotNull(), F.struct(low.alias("no"), F.col("text").alias("text")))).alias("last"), F.min(F.when(high.isNotNull(), F.struct(high.alias("no"), F.col("text").alias("text")))).alias("first"))
    ends = staged(ends)
    left = ends.filter(F.col("last").isNotNull() & tx.looks_unfinished("last.text")).select("doc_key", F.col("page_no").alias("left_page"), (F.col("page_no") + 1).alias("page_no"), "last")
    right = ends.filter(F.col("first").isNotNull() & tx.begins_as_continuation("first.text")).select(*PAGE, "first")
    met = left.join(right, PAGE).withColumn("text", tx.merge_text("last.text", "first.text")).filter(F.length("text") <= most_chars)
    met = met.select("doc_key", "left_page", F.col("last.no").alias("left_no"), F.col("page_no").alias("right_page"), F.col("first.no").alias("right_no"), "text")
    name = F.concat(F.lit("p"), "left_page", F.lit("t"), "left_no", F.lit("-p"), "right_page", F.lit("t"), "right_no")
    return met.withColumn("group_id", name)


def with_continuations(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with group_id, group_text, group_pages and owner, whether the row is the group's first member that still shows it.

    A unit that ends one group and starts the next belongs to the later one.
    """
    group = F.struct(F.col("left_page").alias("at"), "group_id", F.col("text").alias("group_text"), F.array("left_page", "right_page").alias("group_pages")).alias("g")
    members = groups.select("doc_key", F.col("left_page").alias("page_no"), F.col("left_no").alias("unit_no"), group)
    members = members.unionByName(groups.select("doc_key", F.col("right_page").alias("page_no"), F.col("right_no").alias("unit_no"), group))
    one = members.groupBy("doc_key", "page_no", "unit_no").agg(F.max("g").alias("g"))
    one = one.select("doc_key", "page_no", "unit_no", "g.group_id", "g.group_text", "g.group_pages")
    # numbered among members alone: units without a group would all be one key
    first = F.row_number().over(Window.partitionBy("doc_key", "group_id").orderBy("page_no", "unit_no")) == 1
    rows = rows.join(one.withColumn("owner", first), ["doc_key", "page_no", "unit_no"], "left")
    return rows.withColumn("owner", F.coalesce("owner", F.lit(True)))


def to_page_box(bounds: str, within: str, width: str | Column, height: str | Column) -> Column:
    """A box of a rendered page (struct x, y, w, h within the page's own) in page coordinates; null if outside or under a point."""
    b, p = F.col(bounds) if isinstance(bounds, str) else bounds, F.col(within)
    sx, sy = tx.col(width) / p["w"], tx.col(height) / p["h"]
    clip = lambda v, top: F.greatest(F.lit(0.0), F.least(tx.col(top), v))
    box = F.struct(
        clip((b["x"] - p["x"]) * sx, width).alias("x0"), clip((b["y"] - p["y"]) * sy, height).alias("y0"),
        clip((b["x"] + b["w"] - p["x"]) * sx, width).alias("x1"), clip((b["y"] + b["h"] - p["y"]) * sy, height).alias("y1"),
    )
    usable = (b["w"] > 0) & (b["h"] > 0) & (p["w"] > 0) & (p["h"] > 0)
    return F.when(usable & (box["x1"] - box["x0"] >= 1) & (box["y1"] - box["y0"] >= 1), box)


def ocr_units(rows: DataFrame) -> DataFrame:
    """rows (…, bounds, line_bounds, page_bounds, width, height) with quads and box: the lines' boxes, else the unit's, else none."""
    each = F.filter(F.transform(F.coalesce("line_bounds", F.array().cast("array<struct<x:double,y:double,w:double,h:double>>")), lambda b: to_page_box(b, "page_bounds", "width", "height")), lambda x: x.isNotNull())
    whole = to_page_box("bounds", "page_bounds", "width", "height")
    quads = F.when(F.size(each) > 0, each).when(whole.isNotNull(), F.array(whole)).otherwise(F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>"))
    rows = rows.withColumn("quads", quads)
    edge = lambda name, f: f(F.transform("quads", lambda q: q[name])).alias(name)
    box = F.struct(edge("x0", F.array_min), edge("y0", F.array_min), edge("x1", F.array_max), edge("y1", F.array_max))
    return rows.withColumn("box", F.when(F.size("quads") > 0, box))
