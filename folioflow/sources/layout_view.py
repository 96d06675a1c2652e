"""Line tables with page geometry: derived from plain documents, for tables that have none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators.running import sum_before
from folioflow.plans.stages import bounded, staged

#: Lines of a page; longer documents go on on the next page.
LINES = 15

_SPARK_HEAD = """
WITH base AS (SELECT source, first + CAST(floor(pos / 15) AS INT) + 1 AS page_no, pos % 15 AS pos, line FROM {placed} LATERAL VIEW posexplode(split(text, '\\n')) e AS pos, line),
"""
_DUCK_HEAD = """
WITH l AS (SELECT doc_id, coalesce(source, '') AS source, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
n AS (SELECT doc_id, source, a, CAST(floor((len(a) + 14) / 15) AS INT) AS pages FROM l),
f AS (SELECT *, coalesce(sum(pages) OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM n),
each AS (SELECT source, first, unnest(range(len(a))) AS i, unnest(a) AS line FROM f),
base AS (SELECT source, first + CAST(floor(i / 15) AS INT) + 1 AS page_no, i % 15 AS pos, line FROM each),
"""
#: Running heads, page numbers, section headings and sentences over page ends are put in at fixed pages.
_PAGES = """
pg AS (SELECT DISTINCT source, page_no FROM base),"""
#: In Spark, pages are counted already, and no text is read for them.
_SPARK_PAGES = """
pg AS (SELECT * FROM {paged}),"""
_TAIL = """
body AS (SELECT source, page_no, pos, line,
  CASE WHEN page_no % 2 = 1 THEN 'single' WHEN pos % 7 = 0 THEN 'wide' WHEN pos % 2 = 0 THEN 'left' ELSE 'right' END AS slot,
  90 + 40 * pos + (page_no * 7 + pos * 5) % 11 AS y FROM base WHERE length(trim(line)) > 0),
layout_lines AS (
 SELECT source AS doc_key, CAST(page_no AS INT) AS page_no, CAST(pos AS INT) AS line_no, line AS text,
  CAST(CASE slot WHEN 'single' THEN 60 + CASE WHEN pos % 3 = 0 THEN 12 ELSE 0 END WHEN 'wide' THEN 60 WHEN 'left' THEN 50 ELSE 320 END AS DOUBLE) AS x0,
  CAST(y AS DOUBLE) AS y0,
  CAST(CASE slot WHEN 'single' THEN 540 WHEN 'wide' THEN 560 WHEN 'left' THEN 280 ELSE 550 END AS DOUBLE) AS x1,
  CAST(y + CASE WHEN slot = 'wide' THEN 60 ELSE 30 END AS DOUBLE) AS y1,
  CAST(9 + (length(line) % 4) * 0.5 AS DOUBLE) AS font_size FROM body
 UNION ALL SELECT source, CAST(page_no AS INT), -1, concat('Source ', source, ' page ', CAST(page_no AS STRING)), CAST(60 AS DOUBLE), CAST(30 AS DOUBLE), CAST(540 AS DOUBLE), CAST(42 AS DOUBLE), CAST(8 AS DOUBLE) FROM pg
 UNION ALL SELECT source, CAST(page_no AS INT), 999, CAST(page_no AS STRING), CAST(290 AS DOUBLE), CAST(760 AS DOUBLE), CAST(310 AS DOUBLE), CAST(772 AS DOUBLE), CAST(8 AS DOUBLE) FROM pg
 UNION ALL SELECT source, CAST(page_no AS INT), 997, 'References', CAST(60 AS DOUBLE), CAST(700 AS DOUBLE), CAST(200 AS DOUBLE), CAST(712 AS DOUBLE), CAST(12 AS DOUBLE) FROM pg WHERE page_no % 20 = 12
 UNION ALL SELECT source, CAST(page_no AS INT), 997, 'Appendices', CAST(60 AS DOUBLE), CAST(700 AS DOUBLE), CAST(200 AS DOUBLE), CAST(712 AS DOUBLE), CAST(12 AS DOUBLE) FROM pg WHERE page_no % 20 = 16
 UNION ALL SELECT source, CAST(page_no AS INT), 998, 'this sentence is deliberately left open at the end of the', CAST(60 AS DOUBLE), CAST(700 AS DOUBLE), CAST(540 AS DOUBLE), CAST(712 AS DOUBLE), CAST(9.5 AS DOUBLE) FROM pg WHERE page_no % 10 = 5
 UNION ALL SELECT source, CAST(page_no AS INT), 996, 'page and it continues here without a capital letter.', CAST(60 AS DOUBLE), CAST(82 AS DOUBLE), CAST(560 AS DOUBLE), CAST(88 AS DOUBLE), CAST(9.5 AS DOUBLE) FROM pg WHERE page_no % 10 = 6)
"""
#: The same view for DuckDB, as the start of a WITH clause.
DUCK_VIEW = (_DUCK_HEAD + _PAGES + _TAIL).rstrip()
WIDTH, HEIGHT = 600.0, 800.0


def layout_lines(documents: DataFrame) -> DataFrame:
    """(doc_key, page_no, line_no, text, x0, y0, x1, y1, font_size): a source as one file, its documents (doc_id each its own) as pages of 15 lines.

    Pages are 600 x 800; odd pages have one column, even pages two columns and wide lines. Only ids and
    numbers of pages are put in order, in stretches of ids; no text is. Rows without a doc_id come first,
    rows that share one stand by a hash of doc_id and text; rows that are equal in both follow each other.
    """
    source, text = F.coalesce("source", F.lit("")), F.coalesce("text", F.lit(""))
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64("doc_id", "text").alias("row"), source.alias("source"), text.alias("text"))
    pages = F.floor((F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + LINES) / LINES)
    sized = staged(rows.groupBy(F.col("source").alias("file"), "id", "row").agg(F.count("*").alias("copies"), F.first(pages).alias("pages")).withColumn("all", F.col("pages") * F.col("copies")))
    ids = sum_before(sized.groupBy("file", "id").agg(F.sum("all").alias("of_id")), "file", "id", "of_id", "first", 1 << 16)
    # of rows that share an id, those with the smaller hash come first, whatever their number
    within = sum_before(sized.withColumn("file_id", F.struct("file", "id")), "file_id", "row", "all", "in_id", 1 << 48)
    within = within.join(ids.withColumnsRenamed({"file": "of_file", "id": "at_id"}), (F.col("file") == F.col("of_file")) & (F.col("id") == F.col("at_id")))
    firsts = staged(within.select(F.col("id").alias("at_id"), "file", F.col("row").alias("at_row"), (F.col("first") + F.col("in_id")).cast("int").alias("first"), "copies", "pages"))
    here = (F.col("source") == F.col("file")) & (F.col("id") == F.col("at_id")) & (F.col("row") == F.col("at_row"))
    placed = rows.join(bounded(firsts.filter("copies = 1"), 1_000_000), here).select("source", "text", "first")
    repeated = firsts.filter("copies > 1")
    if not repeated.isEmpty():
        once = rows.join(bounded(repeated, 200_000), here).groupBy("source", "id", "row").agg(*[F.first(c).alias(c) for c in ("text", "first", "copies", "pages")])
        places = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), lambda k: (F.col("first") + k * F.col("pages")).cast("int")))
        placed = placed.unionByName(once.select("source", "text", places.alias("first")))
    paged = firsts.select(F.col("file").alias("source"), F.explode(F.sequence(F.col("first") + 1, (F.col("first") + F.col("pages") * F.col("copies")).cast("int"))).alias("page_no"))
    return documents.sparkSession.sql(_SPARK_HEAD + _SPARK_PAGES + _TAIL + "SELECT * FROM layout_lines", placed=placed, paged=paged)
