"""The cache as a store: rounds, repeats, versions, plans without an exchange on its side, and translation against it."""

import pytest
from pyspark.sql import functions as F

from folioflow.operators import backends
from folioflow.operators.translate import full_key, translate
from folioflow.sources.cache_store import CacheStore

KV = "key string, value string"


def of(spark, rows):
    return spark.createDataFrame(rows, KV)


def found(store, spark, keys):
    return sorted(tuple(r) for r in store.lookup(of(spark, [(k, "") for k in keys])).collect())


@pytest.fixture
def store(spark, tmp_path):
    store = CacheStore(spark, str(tmp_path / "cache"), 4)
    yield store
    store.close()


def test_rounds(spark, store):
    assert found(store, spark, ["a", None]) == []
    store.add(of(spark, [("a", "x"), ("b", "y"), (None, "z"), ("c", "<html><body>503"), ("d", " "), ("e", None)]), 1)
    store.add(of(spark, [("a", "q"), ("a", "p")]), 3)
    store.add(of(spark, [("a", "q"), ("a", "p")]), 3)  # a round that ran twice
    store.add(of(spark, [("a", "late but older")]), 2)
    store.add(of(spark, []), 4)
    expected = [("a", "p"), ("b", "y")]
    assert found(store, spark, ["a", "a", "b", "c", "d", "e", "f", None]) == expected
    store.compact()
    assert store.entries().count() == 2
    assert found(store, spark, ["a", "b", "c"]) == expected
    store.add(of(spark, [("b", "new")]), 5)
    again = CacheStore(spark, store.path)
    assert again.buckets == 4 and len(again.versions) == 2
    assert found(again, spark, ["a", "b"]) == [("a", "p"), ("b", "new")]
    again.vacuum()
    assert len(CacheStore(spark, store.path).versions) == 1
    assert found(again, spark, ["a", "b"]) == [("a", "p"), ("b", "new")]


def test_two_compactions_at_once(spark, store):
    other = CacheStore(spark, store.path)
    store.compact()
    with pytest.raises(ValueError, match="another writer"):
        other.compact()


def test_many_keys_in_few_buckets(spark, store):
    rows = spark.range(5_000).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("value"))
    for number in range(3):
        store.add(rows.filter(F.pmod(F.xxhash64("key"), F.lit(3)) == number), number)
    asked = rows.sample(0.2, 5).union(rows.limit(10))
    n = asked.select("key").distinct().count()
    assert store.lookup(asked).join(rows, ["key", "value"]).count() == n
    store.compact()
    assert store.lookup(asked).join(rows, ["key", "value"]).count() == n


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.count("Exchange "), plan


def test_no_exchange_on_the_side_of_the_cache(spark, store):
    store.add(of(spark, [("a", "x")]), 1)
    store.compact()
    n, plan = exchanges(store.lookup(of(spark, [("a", "")])))
    assert n == 1 and "Bucketed: true" in plan, plan  # that of the asked keys
    n, plan = exchanges(store._latest(store.entries()))
    assert n == 0, plan


class Upper(backends.LexicalModel):
    def translate(self, texts, source, target, beam):
        return [t.replace("ZXQKEEP", "") if "drop" in t else t.upper() for t in texts]


def test_translation_against_a_store(spark, store):
    units = spark.createDataFrame([(t, "fr") for t in ["bonjour", "le chat", "le chat", "please drop ABC here", None]], "text string, lang string")
    key = spark.range(1).select(full_key("ns", F.lit("bonjour"), F.lit("fr"), "pt").alias("key"), F.lit("olá").alias("value"))
    store.add(key, 0)
    run = backends.runner("upper", Upper, "pt")
    results, added = translate(units, store, run, "pt", "ns")
    rows = {r["text"]: r for r in results.collect()}
    assert (rows["bonjour"]["translation"], rows["bonjour"]["n_cached"]) == ("olá", 1)
    assert rows["le chat"]["translation"] == "LE CHAT"
    assert rows["please drop ABC here"]["translation"] == "please drop ABC HERE"
    store.add(added, 1)
    store.compact()
    results, added = translate(units, store, run, "pt", "ns")
    assert added.filter("value = 'LE CHAT'").isEmpty()
    assert {r["text"]: r["translation"] for r in results.collect()} == {k: r["translation"] for k, r in rows.items()}
