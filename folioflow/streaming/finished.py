"""Documents that become whole on a stream of pages: a state a document, of its open pages, until all of them came."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioflow.operators.report import FINAL

PAGES = "doc_key string, n_pages int, page_no int, n_units long, n_translated long, n_kept long, n_open long, n_reviews long"
#: What is summed over a document's pages.
SUMS = ("n_units", "n_translated", "n_kept", "n_open", "n_reviews")
DOCUMENTS = "doc_key string, n_pages int, n_units long, n_translated long, n_kept long, n_open long, n_reviews long, empty_pages array<int>, state string"
_STATE = "came array<int>, empty array<int>, done boolean, " + ", ".join(f"{c} long" for c in SUMS)


def page_totals(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """PAGES of all pages (doc_key, page_no) with their units (state, flags): what a batch hands on once a page is worked off. A page without units has zeros."""
    n = lambda when, name: F.count_if(when).alias(name)
    each = rows.groupBy("doc_key", "page_no").agg(F.count("*").alias("n_units"), n(F.col("state") == "traduzido", "n_translated"), n(F.col("state") == "preservado", "n_kept"), n(~F.col("state").isin(*FINAL), "n_open"), n(F.size("flags") > 0, "n_reviews"))
    known = pages.select("doc_key", "page_no").distinct()
    sizes = known.groupBy("doc_key").agg(F.count("*").cast("int").alias("n_pages"))
    out = known.join(each, ["doc_key", "page_no"], "left").join(sizes, "doc_key").fillna(0, list(SUMS))
    return out.select(*[x.split()[0] for x in PAGES.split(", ")])


def documents_of(pages: DataFrame) -> DataFrame:
    """DOCUMENTS of those whose pages are all there, in one batch; a page that is there twice counts once, its first row by all columns."""
    once = pages.groupBy("doc_key", "page_no").agg(F.min(F.struct("n_pages", *SUMS)).alias("p")).select("doc_key", "page_no", "p.*")
    empty = F.array_sort(F.collect_list(F.when(F.col("n_units") == 0, F.col("page_no"))))
    found = once.groupBy("doc_key").agg(F.max("n_pages").alias("n_pages"), F.count("*").alias("came"), *[F.sum(c).alias(c) for c in SUMS], empty.alias("empty_pages")).filter("came >= n_pages")
    state = F.when((F.col("n_open") > 0) | (F.size("empty_pages") > 0), "concluido_com_pendencias").otherwise("concluido")
    return found.select("doc_key", "n_pages", *SUMS, "empty_pages", state.alias("state"))


def _grow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """New pages of one document: sums and pages that came go on in the state; with the last one the document is given out, once."""
    came, empty, done, *sums = state.get if state.exists else ([], [], False, *[0] * len(SUMS))
    came, empty, sums, n_pages = set(came), list(empty), list(sums), 0
    for frame in frames:
        for row in frame.itertuples(index=False):
            n_pages = max(n_pages, row.n_pages)
            if row.page_no in came:
                continue
            came.add(row.page_no)
            sums = [a + getattr(row, c) for a, c in zip(sums, SUMS, strict=True)]
            empty += [row.page_no] if row.n_units == 0 else []
    whole = not done and len(came) >= n_pages
    state.update((sorted(came), sorted(empty), done or whole, *map(int, sums)))
    if whole:
        open_ = sums[SUMS.index("n_open")] or empty
        yield pd.DataFrame([(key[0], n_pages, *sums, sorted(empty), "concluido_com_pendencias" if open_ else "concluido")], columns=[x.split()[0] for x in DOCUMENTS.split(", ")])


def finished(pages: DataFrame) -> DataFrame:
    """DOCUMENTS of a stream of PAGES, each once, in the batch that brings its last page. Repeated pages count once. The state of a document is its pages' numbers and sums."""
    return pages.filter("doc_key is not null").groupBy("doc_key").applyInPandasWithState(_grow, DOCUMENTS, _STATE, "append", GroupStateTimeout.NoTimeout)


def start(spark: SparkSession, inbox: str, results_path: str, state_path: str, files_per_batch: int = 100) -> StreamingQuery:
    """A query over all files of PAGES that are in inbox now; started again with the same state_path, it goes on where it stopped."""
    pages = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(inbox)
    out = finished(pages).writeStream.format("parquet").option("path", results_path).option("checkpointLocation", state_path)
    return out.outputMode("append").trigger(availableNow=True).start()
