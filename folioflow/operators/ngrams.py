"""The language of texts by naive Bayes over hashed letter n-grams of words: a table that Spark learns, and scores by sums of its rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.language import SAMPLE_CHARS
from folioflow.plans.stages import staged

#: Classes that n-grams of 1 to 3 letters are hashed to; the table has a row for each at most, which bounds its broadcast.
BUCKETS = 1 << 16
#: What letters count in an n-gram's hash, and what its length adds.
FACTORS, LENGTH = (1, 263, 69_169), 7_919
#: Logarithms are kept as whole thousandths, so that sums don't depend on their order.
UNIT = 1_000


@dataclass
class LanguageModel:
    """weights: (bucket, w), of each n-gram class the logarithm of its share in each of codes; unseen: that of a class which no text had."""

    codes: list[str]
    weights: DataFrame
    unseen: list[int]


def words(text: str | Column) -> Column:
    """Runs of letters in lower case, of the part of a text that is looked at."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.substring(text, 1, SAMPLE_CHARS)), F.lit(r"\p{L}+"), F.lit(0))


def ngram_buckets(word: str | Column) -> Column:
    """The classes of all runs of 1 to 3 letters of a word that a blank stands before and behind."""
    word = F.col(word) if isinstance(word, str) else word
    letters = F.transform(F.filter(F.split(F.concat(F.lit(" "), word, F.lit(" ")), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))

    def runs(codes: Column, n: int) -> Column:
        at = lambda k: sum((F.get(codes, (k + j).cast("int")) * FACTORS[j] for j in range(1, n)), F.get(codes, k.cast("int")) * FACTORS[0])
        of = F.transform(F.sequence(F.lit(0), F.size(codes) - n), lambda k: F.pmod(at(k) + n * LENGTH, F.lit(BUCKETS)).cast("int"))
        return F.when(F.size(codes) >= n, of).otherwise(F.array().cast("array<int>"))

    both = F.transform(F.array(letters), lambda codes: F.concat(*[runs(codes, n) for n in (1, 2, 3)]))
    return F.get(both, 0)


def words_joined(text: str | Column) -> Column:
    """The words of a text with one blank between them, before the first and behind the last; two blanks where there is none."""
    text = F.col(text) if isinstance(text, str) else text
    kept = F.regexp_replace(F.lower(F.substring(text, 1, SAMPLE_CHARS)), r"\P{L}+", " ")
    return F.concat(F.lit(" "), F.trim(kept), F.lit(" "))


def joined_buckets(joined: str) -> list[np.ndarray]:
    """The classes that ngram_buckets has for all words of words_joined together: blanks but the outer ones belong to two words, and no run of 3 reaches over one."""
    codes = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.int64)
    inner = np.full(np.count_nonzero(codes == 32) - 2, 32, np.int64)
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    runs = (np.concatenate([codes, inner]), codes[:-1] + FACTORS[1] * codes[1:], (a + FACTORS[1] * b + FACTORS[2] * c)[b != 32])
    return [(run + n * LENGTH) % BUCKETS for n, run in enumerate(runs, 1)]


def learn(texts: DataFrame, codes: list[str]) -> LanguageModel:
    """A model of the languages codes from all rows of texts (text, lang) that have both; rows of other languages are left out.

    Each task counts the classes of its texts and gives one row a class, so no word is moved. Every class
    counts one more than it was seen. Languages are taken as equally frequent.
    """
    n, names = len(codes), [f"n{i}" for i in range(len(codes))]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((n, BUCKETS), np.int64)
        for batch in batches:
            for lang, joined in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if (joined := joined.as_py()).strip(" "):
                    counts[codes.index(lang)] += np.bincount(np.concatenate(joined_buckets(joined)), minlength=BUCKETS)
        seen = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), *[pa.array(counts[i][seen]) for i in range(n)]], ["bucket", *names])

    rows = texts.filter(F.col("lang").isin(*codes) & F.col("text").isNotNull()).select("lang", words_joined("text").alias("joined"))
    each = rows.mapInArrow(counted, ", ".join(["bucket int", *[f"{k} long" for k in names]]))
    counts = staged(each.groupBy("bucket").agg(*[F.sum(k).alias(k) for k in names]))
    sums = counts.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in names]).first()
    log = lambda n, i: F.round(F.log((n + 1.0) / F.lit(float(sums[i] + BUCKETS))) * UNIT).cast("long")
    unseen = list(texts.sparkSession.range(1).select(*[log(F.lit(0), i) for i in range(len(codes))]).first())
    return LanguageModel(list(codes), staged(counts.select("bucket", F.array(*[log(F.col(f"n{i}"), i) for i in range(len(codes))]).alias("w"))), unseen)


def scored(rows: DataFrame, text: str, model: LanguageModel, name: str = "lang_scores") -> DataFrame:
    """rows with name: an array of (code, score) in the order of the model's codes, scores the posterior probabilities of the text in column text; all equal for texts without a letter.

    The table, which has BUCKETS rows at most whatever it was learned from, goes to every task, and a text's
    weights are summed where it lies: no text and no word is moved.
    """
    n = len(model.codes)
    table = np.tile(np.array(model.unseen, np.int64), (BUCKETS, 1))
    for row in model.weights.toLocalIterator():
        table[row["bucket"]] = row["w"]

    @F.pandas_udf("array<double>")
    def summed(joined: pd.Series) -> pd.Series:
        return joined.map(lambda x: None if x is None or not x.strip(" ") else sum(table[of].sum(axis=0) for of in joined_buckets(x)).astype(float))

    kept = rows.withColumn("sums", summed(words_joined(text)))
    power = F.transform("sums", lambda s: F.exp((s - F.array_max("sums")) / UNIT))
    kept = kept.withColumn("powers", F.coalesce(power, F.array_repeat(F.lit(1.0), n)))
    total = F.aggregate("powers", F.lit(0.0), lambda a, b: a + b)
    scores = F.array(*[F.struct(F.lit(k).alias("code"), (F.get("powers", F.lit(i)) / total).alias("score")) for i, k in enumerate(model.codes)])
    return kept.withColumn(name, scores).drop("sums", "powers")


def given(name: str = "lang_scores"):
    """For functions that take a score of texts: the scores that scored has put into a column."""
    return lambda text, codes: F.col(name)
