"""Queries of the scalar text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as tx
from folioflow.queries import duck


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, pos, line) of all documents."""
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", "lang", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))


_LINES = "(SELECT doc_id, lang, unnest(range(len(a))) AS pos, unnest(a) AS line FROM (SELECT doc_id, lang, string_split(coalesce(text, ''), chr(10)) AS a FROM documents))"


def q_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", tx.normalize_spaces(F.coalesce("text", F.lit(""))).alias("t"))
    return t.select("doc_id", F.length("t").alias("n_chars_kept"), F.md5("t").alias("text_md5"), F.element_at(F.split("t", "\n"), 1).alias("first_line"))


def q_noise_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("t", tx.normalize_spaces("line"))
    noise = tx.is_noise("line").cast("long")
    return rows.groupBy("lang").agg(F.count("*").alias("n_lines"), F.sum(noise).alias("n_noise"), F.sum(tx.latin_letters("t").cast("long")).alias("n_letters"), F.sum(tx.latin_words("t").cast("long")).alias("n_words"))


def q_join_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", tx.join_lines(F.split(F.coalesce("text", F.lit("")), "\n")).alias("t"))
    return rows.select("doc_id", F.length("t").alias("n_chars_joined"), F.md5("t").alias("joined_md5"))


def q_line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tx.normalize_spaces("line")
    font = 9 + F.length("line") % 4
    classes = {
        "n_heading": tx.is_heading("line", font.cast("double"), F.lit(10.0)), "n_math": tx.is_standalone_math(t), "n_reference": tx.is_reference_heading("line", "line"),
        "n_annex": tx.ends_references("line"), "n_caption": tx.is_caption_or_footnote("line", font.cast("double"), F.lit(10.0)), "n_unfinished": tx.looks_unfinished("line"),
        "n_continuing": tx.begins_as_continuation("line"), "n_error": tx.is_error_reply("line"), "n_valid": tx.is_valid_translation("line"),
    }
    return lines(spark, sf_dir).groupBy("lang").agg(*[F.sum(c.cast("long")).alias(k) for k, c in classes.items()])


def q_cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.cache_key(F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit("")), F.lit("pt")).alias("cache_key"))


def q_output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[a-z]+://|[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", tx.output_name(path, F.lit("pt")).alias("output_name"))


_t = duck.norm("line")
_font = "CAST(9 + length(line) % 4 AS DOUBLE)"
_sum = lambda expr, name: f"CAST(sum(CAST({expr} AS BIGINT)) AS BIGINT) AS {name}"
_f, _v = tx.MATH_FUNCTION, tx.MATH_VARIABLE
_atom = f"^(?:{_f}|{_v}|d{_v}|{_f}?{_v}d{_v}|{_f}{_v})$"
_math = f"(regexp_matches(t, '{tx.MATH_SIGN}') AND len(list_filter(regexp_extract_all(t, '\\p{{L}}+'), lambda w: NOT regexp_matches(w, '{_atom}'))) = 0)"
_path = "regexp_replace(coalesce(url, ''), '^[a-z]+://|[?#].*$', '', 'g')"

QUERIES = {
    "q_noise_profile": q_noise_profile,
    "q_normalize": q_normalize,
    "q_join_lines": q_join_lines,
    "q_line_classes": q_line_classes,
    "q_cache_keys": q_cache_keys,
    "q_output_names": q_output_names,
}
ORACLE = {
    "q_noise_profile": f"SELECT lang, count(*) AS n_lines, {_sum(duck.noise('t'), 'n_noise')}, {_sum(duck.letters('t'), 'n_letters')}, {_sum(duck.words('t'), 'n_words')} FROM (SELECT lang, {_t} AS t FROM {_LINES}) GROUP BY lang",
    "q_normalize": f"SELECT doc_id, CAST(length(t) AS INT) AS n_chars_kept, md5(t) AS text_md5, string_split(t, chr(10))[1] AS first_line FROM (SELECT doc_id, {duck.norm("coalesce(text, '')")} AS t FROM documents)",
    "q_join_lines": f"SELECT doc_id, CAST(length(t) AS INT) AS n_chars_joined, md5(t) AS joined_md5 FROM (SELECT doc_id, {duck.join_lines("string_split(coalesce(text, ''), chr(10))")} AS t FROM documents)",
    "q_line_classes": f"""SELECT lang, {_sum(duck.heading('t', 'font', '10.0'), 'n_heading')}, {_sum(_math, 'n_math')}, {_sum(duck.reference_heading('t', 't'), 'n_reference')},
  {_sum(duck.matches('t', f'(?i){tx.AFTER_REFERENCES}'), 'n_annex')}, {_sum(duck.caption('t', 'font', '10.0'), 'n_caption')}, {_sum(duck.unfinished('t'), 'n_unfinished')},
  {_sum(duck.begins('t'), 'n_continuing')}, {_sum(duck.error_reply('line'), 'n_error')}, {_sum(duck.valid('line'), 'n_valid')}
FROM (SELECT lang, line, {_t} AS t, {_font} AS font FROM {_LINES}) GROUP BY lang""",
    "q_cache_keys": "SELECT doc_id, sha256(concat(coalesce(lang, ''), chr(0), 'pt', chr(0), coalesce(text, ''))) AS cache_key FROM documents",
    "q_output_names": f"SELECT page_id, concat(regexp_replace(p, '(\\.[^./]*)?$', ''), '_traduzido_pt', regexp_extract(p, '(\\.[^./]*)$', 1)) AS output_name FROM (SELECT page_id, {_path} AS p FROM pages)",
}
