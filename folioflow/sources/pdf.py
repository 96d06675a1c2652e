"""PDF files as a Spark data source of lines, and annotations written into them, where PyMuPDF is installed on the workers."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LINES = "doc_key string, page_no int, width double, height double, block_no int, line_no int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, error string"


def line_font(spans: list[dict]) -> float:
    """The median size of spans that aren't blank; zero where there is none."""
    sizes = [s["size"] for s in spans if s["text"].strip()]
    return float(median(sizes)) if sizes else 0.0


def rows_of(path: str, pages: Iterator[tuple[int, float, float, dict]]) -> Iterator[tuple]:
    """Rows of LINES from pages (number, width, height, text as blocks, lines and spans)."""
    for number, width, height, found in pages:
        for b, block in enumerate(x for x in found["blocks"] if x.get("type", 0) == 0):
            for k, line in enumerate(block["lines"]):
                text = "".join(s["text"] for s in line["spans"])
                yield (path, number, width, height, b, k, text, *map(float, line["bbox"]), line_font(line["spans"]), None)


def read_pdf(path: str, password: str | None, first: int, last: int | None) -> Iterator[tuple]:
    """A file that can't be opened gives one row with its error, so that other files are not held up."""
    import fitz

    try:
        with fitz.open(path) as document:
            if document.needs_pass and not (password and document.authenticate(password)):
                raise ValueError("the file needs a password")
            stop = min(len(document), last or len(document))
            pages = ((n + 1, document[n].rect.width, document[n].rect.height, document[n].get_text("dict", sort=False)) for n in range(first - 1, stop))
            yield from rows_of(path, pages)
    except (OSError, RuntimeError, ValueError) as e:
        yield (path, *[None] * 11, f"{type(e).__name__}: {e}")


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = options["paths"].split("\n")
        self.password = options.get("password")
        self.first, self.last = int(options.get("first", "1")), int(options["last"]) if "last" in options else None

    def partitions(self) -> list[_File]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[tuple]:
        return read_pdf(partition.path, self.password, self.first, self.last)


class PdfLines(DataSource):
    """spark.read.format("pdf_lines").option("paths", …).load(): one task a file; options first, last and password."""

    @classmethod
    def name(cls) -> str:
        return "pdf_lines"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PdfLines)


def annotate(content: bytes, notes: list[dict]) -> bytes:
    """A file's bytes with highlights and margin notes, as report.annotations lists them (with quads); encryption is kept."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as document:
        for x in notes:
            page = document[x["page_no"] - 1]
            if x["form"] == "highlight":
                mark = page.add_highlight_annot([fitz.Rect(*q).quad for q in x["quads"]])
                mark.set_colors(stroke=tuple(x["rgb"]))
                mark.set_opacity(x["opacity"])
            else:
                mark = page.add_text_annot(fitz.Point(page.rect.x0 + x["x"], page.rect.y0 + x["y"]), x["content"], icon="Comment")
            mark.set_info(content=x["content"], title=x["title"], subject=x["subject"])
            mark.update()
        return document.tobytes(garbage=3, deflate=True, encryption=fitz.PDF_ENCRYPT_KEEP)


def annotated(contents: DataFrame, notes: DataFrame) -> DataFrame:
    """(doc_key, content) of files (doc_key, content) with their notes (doc_key, page_no, form, quads, x, y, rgb, opacity, title, subject, content): one file a row, as a PDF is rewritten whole."""
    fields = ["page_no", "form", "quads", "x", "y", "rgb", "opacity", "title", "subject", "content"]
    quads = F.transform("quads", lambda q: F.array(q["x0"], q["y0"], q["x1"], q["y1"])).alias("quads")
    listed = notes.withColumn("quads", quads).groupBy("doc_key").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("notes"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_key": frame["doc_key"], "content": [annotate(c, [dict(n) for n in x]) for c, x in zip(frame["content"], frame["notes"], strict=True)]})

    return contents.join(listed, "doc_key").mapInPandas(write, "doc_key string, content binary")
