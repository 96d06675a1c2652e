"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.shared import in_workers

#: Characters of which n-grams are made at a time.
CHUNK = 1 << 20
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    """Of every code point, whether it is a letter; made once a worker."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(k).isalpha() for k in range(0x110000)), np.bool_, 0x110000)
    return _letters


def _codes(low: str) -> np.ndarray:
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(_is_letter()[codes], codes, 32).astype(np.uint64)


def n_grams(text: str, orders: tuple[int, ...], n_buckets: int) -> Iterator[np.ndarray]:
    """Buckets of all character n-grams of a lower-cased text between two blanks, in which runs of other characters than letters are one blank.

    Given chunk by chunk; each starts with the last characters of the one before, so that n-grams over
    the border are there, and once.
    """
    low, longest = text.lower(), max(orders)
    before = np.zeros(0, np.uint64)
    for k in range(0, max(1, len(low)), CHUNK):
        first, last = [np.full(int(end), 32, np.uint64) for end in (k == 0, k + CHUNK >= len(low))]
        codes = np.concatenate([before, first, _codes(low[k : k + CHUNK]), last])
        blank = codes == 32
        stay = ~blank | np.concatenate([[True], ~blank[:-1]])
        stay[: len(before)] = True
        codes, known = codes[stay], len(before)
        mixed = codes * np.uint64(0)
        for n in range(1, longest + 1):
            if len(codes) < n:
                break
            mixed = mixed[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
            if n in orders:
                new = mixed[max(0, known - n + 1) :]
                yield ((new ^ new >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40) & np.uint64(n_buckets - 1)).astype(np.int64)
        before = codes[len(codes) - max(1, longest - 1) :] if len(codes) else codes


def _counts(text: str, orders: tuple[int, ...], n_buckets: int) -> np.ndarray:
    """Counts by bucket of the whole text."""
    total = np.zeros(n_buckets, np.int64)
    for found in n_grams(text, orders, n_buckets):
        total += np.bincount(found, minlength=n_buckets)
    return total


class LanguageModel:
    """Log probabilities by language and bucket: of bounded size, max_languages x n_buckets doubles, whatever the corpus."""

    def __init__(self, languages: list[str], log_prior: np.ndarray, log_given: np.ndarray, orders: tuple[int, ...]) -> None:
        self.languages, self.log_prior, self.log_given, self.orders = languages, log_prior, log_given, orders

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language and its posterior probability of each text, the first by name of equals; und and 0 where it has no letter or nothing was learned."""
        names, scores = [], []
        for text in texts:
            if text is None or not self.languages or not any(map(str.isalpha, text)):
                names.append("und")
                scores.append(0.0)
                continue
            counts = _counts(text, self.orders, self.log_given.shape[0])
            some = np.flatnonzero(counts)
            logs = self.log_prior + counts[some] @ self.log_given[some]
            best = int(np.argmax(logs))
            names.append(self.languages[best])
            scores.append(float(1 / np.exp(logs - logs[best]).sum()))
        return names, scores


def fit(documents: DataFrame, per_language: int = 5_000, orders: tuple[int, ...] = (1, 2, 3), n_buckets: int = 1 << 15, max_languages: int = 256, alpha: float = 0.1) -> LanguageModel:
    """Learn from (text, lang) of rows where neither is null, on a sample of about per_language different texts of each language.

    The bound is per_language. Texts are chosen by their hash, so they are the same at any dealing, and
    each counts once however many rows have it: copies neither crowd others out nor leave a language
    without a text, and all texts are taken where there are no more. Priors are the shares of all rows,
    not of the sample. Counts are summed by Spark; the driver gets at most languages x n_buckets of
    them. More than max_languages languages is an error.
    """
    rows = documents.select("text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).withColumn("of", F.xxhash64("text")).withColumn("at", F.pmod("of", F.lit(1 << 30)))
    texts = rows.groupBy("lang", "of", "at").agg(F.count("*").alias("n"))
    found = texts.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("texts"), F.min("at").alias("least")).orderBy("lang").limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    sizes = {r["lang"]: r["n"] for r in found}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros(0), np.zeros((n_buckets, 0)), orders)
    below = {r["lang"]: max(int(min(1.0, per_language / r["texts"]) * (1 << 30)), r["least"] + 1) for r in found}  # one text at least
    bound = F.element_at(F.create_map(*[F.lit(x) for pair in below.items() for x in pair]), F.col("lang"))
    sample = rows.filter(F.col("at") < bound).groupBy("lang", "of").agg(F.first("text").alias("text")).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in totals:
                    totals[lang] = np.zeros(n_buckets, np.int64)
                totals[lang] += _counts(text, orders, n_buckets)
        for lang, total in totals.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(total[some])], ["lang", "bucket", "n"])

    found = in_workers(sample, count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    given = np.full((n_buckets, len(languages)), alpha)
    given[found["bucket"].to_numpy(np.int64), np.searchsorted(np.array(languages, object), found["lang"].to_numpy(object))] += found["n"].to_numpy(np.float64)
    prior = np.array([sizes[k] for k in languages], np.float64)
    return LanguageModel(languages, np.log(prior / prior.sum()), np.log(given / given.sum(axis=0)), orders)


def identify(documents: DataFrame, model: LanguageModel, text: str = "text", drop_text: bool = False) -> DataFrame:
    """documents with lang_pred and score (0 to 1), without the text if drop_text; the model is broadcast.

    und with score 0 where the text is null or has no letter. Columns of these names are replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.drop("lang_pred", "score")
    at = rows.columns.index(text)
    kept = [k for k in range(len(rows.columns)) if k != at or not drop_text]
    names = [*(rows.columns[k] for k in kept), "lang_pred", "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, scores = shared.value.score(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(found, pa.string()), pa.array(scores, pa.float64())], names)

    fields = [*(rows.schema.fields[k] for k in kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return in_workers(rows, score, T.StructType(fields))
