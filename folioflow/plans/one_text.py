"""One text through the same plan as documents."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from folioflow.config import Options
from folioflow.functions import language as lg
from folioflow.operators.backends import Runner
from folioflow.operators.translate import CACHE, translate


def translate_text(spark: SparkSession, text: str, runner: Runner, options: Options) -> str:
    """The translation of a text, without a cache. In mixed or auto mode its own words tell the language; a text in the target language stays as it is (mixed only)."""
    rows = spark.createDataFrame([(text,)], "text string")
    if isinstance(options.source, str) and options.source != "auto":
        rows = rows.withColumn("lang", F.lit(options.source))
    else:
        codes = list(dict.fromkeys([*(options.source if options.mixed else lg.FUNCTION_WORDS), options.target]))
        main = next((k for k in codes if k != options.target), options.target)
        rows = rows.withColumn("lang", lg.unit_language("text", codes, F.lit(main))["code"])
        if options.mixed and rows.first()["lang"] == options.target:
            return text
    results, _ = translate(rows, spark.createDataFrame([], CACHE), runner, options.target, runner.namespace, profile=options.profile, custom=options.glossary, variant=options.variant, protect_elements=options.protect)
    found = results.first()
    if found["error"] is not None:
        raise ValueError(found["error"])
    return found["translation"]
