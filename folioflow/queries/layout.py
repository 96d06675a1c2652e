"""Queries of the layout operators, over the line table that documents are laid out to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import text as tx
from folioflow.operators import layout as op
from folioflow.plans.stages import staged
from folioflow.queries import duck
from folioflow.queries.text import table
from folioflow.sources.layout_view import DUCK_VIEW, HEIGHT, WIDTH, layout_lines


#: What columns of a page are told from. Blocks' lines, which hold each text once more, are staged only for units.
SIDES = ["doc_key", "page_no", "orig_no", "text", "x0", "y0", "x1", "y1", "font_size", "width"]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(layout_lines(table(spark, sf_dir, "documents")))


def pages(rows: DataFrame) -> DataFrame:
    return rows.select("doc_key", "page_no").distinct().select("doc_key", "page_no", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))


def kept(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Lines but for running heads and noise, of rows, if these are laid out already."""
    rows = lines(spark, sf_dir) if rows is None else rows
    return op.kept_lines(rows, pages(rows), op.margin_keys(rows, pages(rows)))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line a block of its own."""
    return op.paragraphs(kept(spark, sf_dir).withColumn("block_no", F.col("line_no")))


def ordered(rows: DataFrame) -> DataFrame:
    return op.reading_order(rows, op.column_pages(rows))


def q_margin_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    return op.margin_keys(rows, pages(rows))


def q_margin_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept(spark, sf_dir)
    return rows.groupBy("doc_key", "page_no").agg(F.count("*").alias("n_kept"), F.sum("line_no").alias("sum_line_no"), F.sum(F.length("text")).alias("n_chars"))


def q_paragraph_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page one block."""
    rows = op.paragraphs(kept(spark, sf_dir).withColumn("block_no", F.lit(0)))
    return rows.select("doc_key", "page_no", "group_no", F.size("lines").alias("n_lines"), F.md5("text").alias("text_md5"), "x0", "y0", "x1", "y1", "font_size", "paragraph_break_before")


def q_two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.column_pages(staged(blocks(spark, sf_dir).select(*SIDES)))


def q_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(blocks(spark, sf_dir).select(*SIDES, "block_no"))
    return ordered(rows).select("doc_key", "page_no", F.col("block_no").alias("line_no"), "column", "place")


def q_body_font(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.body_fonts(blocks(spark, sf_dir))


def marked(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Lines of the body by page and line number, with the reference flag."""
    rows = kept(spark, sf_dir, rows).withColumn("unit_no", F.row_number().over(Window.partitionBy("doc_key", "page_no").orderBy("y0", "x0", "line_no")))
    return op.mark_references(rows, ["page_no", "unit_no"])


def q_reference_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.min(F.when(tx.is_reference_heading("text", "text"), F.struct("page_no", "unit_no")))
    found = marked(spark, sf_dir).groupBy("doc_key").agg(F.sum(F.col("preserve").cast("long")).alias("n_preserved"), start.alias("start"))
    return found.select("doc_key", "n_preserved", F.col("start.page_no").alias("start_page"), F.col("start.unit_no").alias("start_unit"))


def q_continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op.continuations(staged(marked(spark, sf_dir)))
    return found.select("doc_key", "group_id", "left_page", "right_page", F.md5("text").alias("text_md5"))


def q_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.units(staged(ordered(staged(blocks(spark, sf_dir))))).drop("width", "height")


def q_ocr_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as if they came from a rendering of 200 x 400 points shifted by (5, 7)."""
    at = F.struct((F.col("x0") / 3 + 5).alias("x"), (F.col("y0") / 2 + 7).alias("y"), ((F.col("x1") - F.col("x0")) / 3).alias("w"), ((F.col("y1") - F.col("y0")) / 2).alias("h"))
    page = F.struct(*[F.lit(v).alias(k) for k, v in (("x", 5.0), ("y", 7.0), ("w", 200.0), ("h", 400.0))])
    rows = lines(spark, sf_dir).select("doc_key", "page_no", "line_no", at.alias("bounds"), page.alias("page_bounds"))
    box = op.to_page_box("bounds", "page_bounds", F.lit(WIDTH), F.lit(HEIGHT))
    rows = rows.withColumn("box", box)
    whole = lambda name: F.round(F.col(f"box.{name}") * 100).cast("long").alias(name)
    return rows.select("doc_key", "page_no", "line_no", *[whole(k) for k in ("x0", "y0", "x1", "y1")])


_T = duck.norm("text")
_KEPT = f"""{DUCK_VIEW},
lt AS (SELECT *, {_T} AS t, y1 <= 80 OR y0 >= 720 AS margin FROM layout_lines),
lk AS (SELECT *, CASE WHEN margin THEN {duck.margin_key('t')} END AS margin_key FROM lt),
np AS (SELECT source AS doc_key, count(*) AS n FROM pg GROUP BY source),
mk AS (SELECT doc_key, margin_key, count(DISTINCT page_no) AS n_pages FROM lk JOIN np USING (doc_key) WHERE length(margin_key) >= 3 GROUP BY doc_key, margin_key HAVING count(DISTINCT page_no) >= greatest(3, floor(any_value(n) * 0.25 + 0.999))),
kept AS (SELECT lk.* FROM lk LEFT JOIN mk USING (doc_key, margin_key) WHERE mk.n_pages IS NULL AND NOT (margin AND {duck.matches('text', r'^\s*\d+(?:\s*/\s*\d+)?\s*$')}) AND NOT {duck.noise('t')})"""
_PARAGRAPHS = f"""{_KEPT},
pr AS (SELECT *, coalesce(median(CASE WHEN font_size > 0 THEN font_size END) OVER b, 10.0) AS typical, min(x0) OVER b AS base_x, lag(t) OVER o AS bef, lag(y1) OVER o AS above
  FROM kept WINDOW b AS (PARTITION BY doc_key, page_no), o AS (PARTITION BY doc_key, page_no ORDER BY line_no)),
fl AS (SELECT *, CASE WHEN {duck.matches('bef', tx.SENTENCE_END)} AND regexp_matches(regexp_replace(t, {duck.q(f'^[{tx.OPENERS}]+')}, ''), '^[\\p{{Lu}}\\p{{Nd}}]')
  AND (x0 - base_x >= greatest(5.0, typical * 0.75) OR y0 - above >= greatest(1.5, typical * 0.14)) THEN 1 ELSE 0 END AS new FROM pr),
gr AS (SELECT *, sum(new) OVER (PARTITION BY doc_key, page_no ORDER BY line_no) AS group_no FROM fl),
pa AS (SELECT doc_key, page_no, CAST(group_no AS BIGINT) AS group_no, CAST(count(*) AS INT) AS n_lines, {duck.join_lines('list(t ORDER BY line_no)')} AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1,
  coalesce(median(CASE WHEN font_size > 0 THEN font_size END), 0.0) AS font_size FROM gr GROUP BY doc_key, page_no, group_no)"""
_SIDES = f"""{_KEPT},
k AS (SELECT doc_key, page_no, line_no, t, x0, y0, x1, y1, font_size, row_number() OVER (PARTITION BY doc_key, page_no ORDER BY line_no) AS orig_no,
  CASE WHEN x1 - x0 < 600 * 0.62 THEN CASE WHEN (x0 + x1) / 2 <= 600 * 0.46 AND x1 <= 600 * 0.64 THEN 'l' WHEN (x0 + x1) / 2 >= 600 * 0.54 AND x0 >= 600 * 0.36 THEN 'r' END END AS side FROM kept),
sp AS (SELECT doc_key, page_no, count(*) FILTER (side = 'l') AS nl, count(*) FILTER (side = 'r') AS nr, sum(length(t)) FILTER (side = 'l') AS cl, sum(length(t)) FILTER (side = 'r') AS cr,
  min(y0) FILTER (side = 'l') AS tl, max(y1) FILTER (side = 'l') AS bl, min(y0) FILTER (side = 'r') AS tr, max(y1) FILTER (side = 'r') AS br FROM k GROUP BY doc_key, page_no),
good AS (SELECT doc_key, page_no, CASE WHEN nl <= nr THEN 'l' ELSE 'r' END AS smaller FROM sp WHERE least(nl, nr) >= 3 AND least(cl, cr) >= 120 AND least(bl - tl, br - tr) > 0
  AND greatest(0.0, least(bl, br) - greatest(tl, tr)) / least(bl - tl, br - tr) >= 0.45),
lev AS (SELECT g.doc_key, g.page_no FROM good g JOIN k s USING (doc_key, page_no) WHERE s.side = g.smaller AND EXISTS (SELECT 1 FROM k o WHERE o.doc_key = g.doc_key AND o.page_no = g.page_no AND o.side <> g.smaller
  AND (s.y0 + s.y1) / 2 BETWEEN o.y0 - greatest(24.0, s.font_size * 2.5) AND o.y1 + greatest(24.0, s.font_size * 2.5)) GROUP BY ALL HAVING count(*) >= 3),
two AS (SELECT DISTINCT k.doc_key, k.page_no, lev.page_no IS NOT NULL AS two_columns FROM k LEFT JOIN lev USING (doc_key, page_no))"""
_MARKED = f"""{_KEPT},
nu AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_key, page_no ORDER BY y0, x0, line_no) AS INT) AS unit_no FROM kept),
ev AS (SELECT *, CASE WHEN {duck.reference_heading('t', 't')} THEN 1 WHEN {duck.matches('t', f'(?i){tx.AFTER_REFERENCES}')} THEN 0 END AS event FROM nu),
marked AS (SELECT *, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY doc_key ORDER BY page_no, unit_no ROWS UNBOUNDED PRECEDING) = 1, false) AS preserve FROM ev)"""

QUERIES = {
    "q_margin_keys": q_margin_keys,
    "q_margin_filtered": q_margin_filtered,
    "q_paragraph_islands": q_paragraph_islands,
    "q_two_columns": q_two_columns,
    "q_reading_order": q_reading_order,
    "q_body_font": q_body_font,
    "q_reference_section": q_reference_section,
    "q_continuations": q_continuations,
    "q_units": q_units,
    "q_ocr_geometry": q_ocr_geometry,
}
ORACLE = {
    "q_margin_keys": f"{_KEPT} SELECT * FROM mk",
    "q_margin_filtered": f"{_KEPT} SELECT doc_key, page_no, count(*) AS n_kept, CAST(sum(line_no) AS BIGINT) AS sum_line_no, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM kept GROUP BY doc_key, page_no",
    "q_paragraph_islands": f"{_PARAGRAPHS} SELECT doc_key, page_no, group_no, n_lines, md5(text) AS text_md5, x0, y0, x1, y1, font_size, group_no > 0 AS paragraph_break_before FROM pa WHERE NOT {duck.noise('text')}",
    "q_two_columns": f"{_SIDES} SELECT * FROM two",
    "q_reading_order": f"""{_SIDES},
c AS (SELECT k.*, CASE WHEN NOT two_columns THEN 'single' WHEN x1 - x0 >= 600 * 0.72 OR (x0 < 600 * 0.28 AND x1 > 600 * 0.72) THEN 'wide' WHEN x0 + x1 < 600 THEN 'left' ELSE 'right' END AS col FROM k JOIN two USING (doc_key, page_no)),
w AS (SELECT doc_key, page_no, y0, y1, row_number() OVER (PARTITION BY doc_key, page_no ORDER BY y0, orig_no) AS rk, orig_no FROM c WHERE col = 'wide'),
b AS (SELECT c.*, (SELECT count(*) FROM w WHERE w.doc_key = c.doc_key AND w.page_no = c.page_no AND w.y0 <= c.y0) AS bands FROM c),
o AS (SELECT b.*, w.y1 AS last, ww.rk AS rk FROM b LEFT JOIN w ON w.doc_key = b.doc_key AND w.page_no = b.page_no AND w.rk = b.bands LEFT JOIN w ww ON ww.doc_key = b.doc_key AND ww.page_no = b.page_no AND ww.orig_no = b.orig_no)
SELECT doc_key, page_no, line_no, col AS column, CAST(row_number() OVER (PARTITION BY doc_key, page_no ORDER BY
  CASE WHEN col IN ('left', 'right') AND bands > 0 AND y0 < last THEN 1 ELSE 0 END,
  CASE WHEN col = 'single' OR (col <> 'wide' AND bands > 0 AND y0 < last) THEN 0 WHEN col = 'wide' THEN rk - 1 ELSE bands END,
  CASE WHEN col = 'single' OR (col <> 'wide' AND bands > 0 AND y0 < last) THEN 0 WHEN col = 'wide' THEN 3 WHEN col = 'left' THEN 1 ELSE 2 END,
  CASE WHEN col = 'single' OR (col <> 'wide' AND NOT (bands > 0 AND y0 < last)) OR (col <> 'wide' AND bands = 0) THEN y0 ELSE 0 END, CASE WHEN col = 'single' THEN x0 ELSE 0 END, orig_no) AS INT) AS place FROM o""",
    "q_body_font": f"{_KEPT} SELECT doc_key, page_no, coalesce(median(CASE WHEN font_size > 0 AND length(t) > 80 THEN font_size END), 10.0) AS body_font FROM kept GROUP BY doc_key, page_no",
    "q_reference_section": f"""{_MARKED},
st AS (SELECT doc_key, min((page_no, unit_no)) AS s FROM marked WHERE event = 1 GROUP BY doc_key),
np2 AS (SELECT doc_key, CAST(sum(CAST(preserve AS BIGINT)) AS BIGINT) AS n_preserved FROM marked GROUP BY doc_key)
SELECT doc_key, n_preserved, s[1] AS start_page, s[2] AS start_unit FROM np2 LEFT JOIN st USING (doc_key)""",
    "q_continuations": f"""{_MARKED},
bf AS (SELECT doc_key, page_no, coalesce(median(CASE WHEN font_size > 0 AND length(text) > 80 THEN font_size END), 10.0) AS body FROM kept GROUP BY doc_key, page_no),
cd AS (SELECT marked.*, row_number() OVER (PARTITION BY doc_key, page_no, y1 >= 800 * 0.58 ORDER BY unit_no DESC) AS from_end, row_number() OVER (PARTITION BY doc_key, page_no, y0 <= 800 * 0.42 ORDER BY unit_no) AS from_start
  FROM marked JOIN bf USING (doc_key, page_no) WHERE NOT preserve AND NOT {duck.caption('t', 'font_size', 'body')} AND NOT {duck.heading('t', 'font_size', 'body')}),
lf AS (SELECT * FROM cd WHERE from_end = 1 AND y1 >= 800 * 0.58 AND {duck.unfinished('t')}),
rt AS (SELECT * FROM cd WHERE from_start = 1 AND y0 <= 800 * 0.42 AND {duck.begins('t')}),
m AS (SELECT lf.doc_key, concat('p', lf.page_no, 't', lf.unit_no, '-p', rt.page_no, 't', rt.unit_no) AS group_id, lf.page_no AS left_page, rt.page_no AS right_page, {duck.merge('lf.text', 'rt.text')} AS text FROM lf JOIN rt ON lf.doc_key = rt.doc_key AND rt.page_no = lf.page_no + 1)
SELECT doc_key, group_id, left_page, right_page, md5(text) AS text_md5 FROM m WHERE length(text) <= 3500""",
    "q_ocr_geometry": f"""{DUCK_VIEW}
SELECT doc_key, page_no, line_no, CAST(round(greatest(0.0, least(600.0, x0)) * 100) AS BIGINT) AS x0, CAST(round(greatest(0.0, least(800.0, y0)) * 100) AS BIGINT) AS y0,
  CAST(round(greatest(0.0, least(600.0, x1)) * 100) AS BIGINT) AS x1, CAST(round(greatest(0.0, least(800.0, y1)) * 100) AS BIGINT) AS y1 FROM layout_lines""",
}
