"""Translation of units as they arrive in a folder, each batch against the cache that those before left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from folioflow.operators.backends import Runner
from folioflow.operators.translate import translate
from folioflow.sources.cache_store import CacheStore


def start(spark: SparkSession, inbox: str, schema: str, cache_path: str, results_path: str, state_path: str, runner: Runner, target: str, namespace: str | None = None, files_per_batch: int = 100) -> StreamingQuery:
    """A query over all files that are in inbox now; started again, it takes those that came since.

    The cache is a CacheStore, of which a batch reads what it asks for alone. A batch that is repeated after
    a failure writes its results over those of its first run, under its number, and adds entries to the
    cache that count once with those already there.
    """
    store = CacheStore(spark, cache_path)

    def each(batch: DataFrame, number: int) -> None:
        results, added = translate(batch, store, runner, target, namespace or runner.namespace)
        results.write.mode("overwrite").parquet(f"{results_path}/batch={number}")
        store.add(added, number)

    units = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(inbox)
    return units.writeStream.foreachBatch(each).option("checkpointLocation", state_path).trigger(availableNow=True).start()
