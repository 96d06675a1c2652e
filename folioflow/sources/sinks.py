"""Results as tables and as JSON. Spark's commit protocol is what makes a write whole or unseen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators import report


def append_cache(added: DataFrame, path: str) -> None:
    """New entries behind those in path; nothing is written again, and equal keys are told apart when read."""
    added.select("key", "value").write.mode("append").parquet(path)


def write_run(rows: DataFrame, pages: DataFrame, target: str, path: str) -> None:
    """Units, annotations, totals and one JSON report a document, each in its own folder under path."""
    rows.write.mode("overwrite").parquet(f"{path}/units")
    rows = rows.sparkSession.read.parquet(f"{path}/units")
    report.annotations(rows, target).write.mode("overwrite").parquet(f"{path}/annotations")
    report.reviews(rows).write.mode("overwrite").parquet(f"{path}/reviews")
    report.pending(rows).select("doc_key", "page_no", "unit_no", "state", "error").write.mode("overwrite").parquet(f"{path}/pending")
    report.report_json(pages, rows).select(F.to_json(F.struct("doc_key", "report")).alias("value")).write.mode("overwrite").text(f"{path}/reports")


def add_to_ocr_cache(units: DataFrame, cache: DataFrame | None, path: str) -> None:
    """Append units (sha256, page_no, nth, text) of documents that cache doesn't have to the Parquet cache at path; written whole or not at all by Spark's commit."""
    new = units if cache is None else units.join(cache.select("sha256").distinct(), "sha256", "left_anti")
    new.select("sha256", "page_no", "nth", "text").write.mode("append").parquet(path)
