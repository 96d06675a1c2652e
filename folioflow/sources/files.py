"""Folders of PDF files, their outputs, and what is skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as tx

#: File names of outputs, which are never inputs.
OUTPUT_NAME = r"(?i)_traduzido_[a-z-]+$"


def listed(files: DataFrame, root: str, output: str, target: str, recursive: bool = False) -> DataFrame:
    """(path, rel_path, output_path) of files (path): PDFs under root but not under output, and no outputs of earlier runs.

    Without recursive only files of root itself. Ordered by path without regard to case.
    """
    base = root.rstrip("/") + "/"
    at = F.instr("path", base)
    rows = files.withColumn("rel_path", F.when(at > 0, F.substring(F.col("path"), at + len(base), F.lit(1 << 20)))).filter("rel_path is not null")
    stem = F.regexp_replace(F.regexp_extract("rel_path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    rows = rows.filter(F.col("rel_path").rlike(r"(?i)\.pdf$") & ~stem.rlike(OUTPUT_NAME))
    rows = rows.filter(F.instr("path", output.rstrip("/") + "/") == 0)
    if not recursive:
        rows = rows.filter(~F.contains("rel_path", F.lit("/")))
    to = F.concat(F.lit(output.rstrip("/") + "/"), tx.output_name("rel_path", F.lit(target)))
    return rows.withColumn("output_path", to).orderBy(F.lower("rel_path"), "rel_path")


def scan(spark: SparkSession, root: str, output: str, target: str, recursive: bool = False) -> DataFrame:
    """listed() of a folder that Spark can read, with length; contents are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", str(recursive).lower())
    return listed(reader.load(root).select("path", "length"), root, output, target, recursive)


def hashed(spark: SparkSession, root: str, recursive: bool = False) -> DataFrame:
    """(path, sha256, content) of each PDF in a folder, one file a task or several."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(root).select("path", F.sha2("content", 256).alias("sha256"), "content")


def has_translation(annotations: DataFrame) -> DataFrame:
    """(doc_key) of documents with an annotation (title, subject) of a translation."""
    title, subject = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("subject", F.lit("")))
    return annotations.filter(F.contains(title, F.lit("tradução automática")) | subject.startswith("tradução ")).select("doc_key").distinct()


def file_states(files: DataFrame, existing: DataFrame, translated: DataFrame, overwrite: bool = False, skip_translated: bool = True) -> DataFrame:
    """files (doc_key, output_path) with state: pendente, or why a file is left out. existing: output_path; translated: doc_key."""
    there = existing.select("output_path").distinct().withColumn("there", F.lit(True))
    done = translated.select("doc_key").distinct().withColumn("done", F.lit(True))
    rows = files.join(there, "output_path", "left").join(done, "doc_key", "left")
    state = F.when(F.col("there").isNotNull() & F.lit(not overwrite), "ignorado_existente").when(F.col("done").isNotNull() & F.lit(skip_translated), "ignorado_ja_traduzido").otherwise("pendente")
    return rows.withColumn("state", state).drop("there", "done")


def cache_from_json(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of caches kept as JSON objects of texts, one file each; files that aren't such give no row."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))
