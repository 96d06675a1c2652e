"""Language identification against a naive Bayes written out letter by letter."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioflow.llm import langid

M = (1 << 64) - 1


def buckets(text, orders=(1, 2, 3), n_buckets=1 << 15):
    flat = "".join(c if c.isalpha() else " " for c in text.lower())
    flat = f" {' '.join(flat.split())} " if flat.strip() else " "
    found = Counter()
    for k in range(len(flat)):
        mixed = 0
        for n in range(1, max(orders) + 1):
            if k + n > len(flat):
                break
            mixed = (mixed * 0x9E3779B97F4A7C15 + ord(flat[k + n - 1]) + n) & M
            if n in orders:
                found[(((mixed ^ mixed >> 29) * 0xBF58476D1CE4E5B9) & M) >> 40 & (n_buckets - 1)] += 1
    return found


def plain(learn, texts, alpha=0.1, n_buckets=1 << 15):
    counts, rows, seen = defaultdict(Counter), Counter(), set()
    for text, lang in learn:
        if text is None or lang is None:
            continue
        rows[lang] += 1
        if (text, lang) not in seen:
            seen.add((text, lang))
            counts[lang].update(buckets(text))
    out = []
    for text in texts:
        if text is None or not any(map(str.isalpha, text)):
            out.append(("und", 0.0))
            continue
        logs = {}
        for lang in sorted(rows):
            total = sum(counts[lang].values()) + alpha * n_buckets
            logs[lang] = math.log(rows[lang] / sum(rows.values())) + sum(n * math.log((counts[lang][b] + alpha) / total) for b, n in buckets(text).items())
        best = max(sorted(logs), key=lambda k: logs[k])
        out.append((best, 1 / sum(math.exp(x - logs[best]) for x in logs.values())))
    return out


def made():
    rng = random.Random(5)
    words = {"en": "the house of a river and stone", "fr": "la maison é une rivière où ça", "de": "das Haus über dem Fluß und Stein"}
    prose = lambda k, n: " ".join(rng.choice(words[k].split()) for _ in range(n))
    learn = [(prose(k, rng.randrange(1, 30)), k) for k in words for _ in range(15)] + [("zqxj wkzq", "aa"), ("zqxj wkzq", "bb")] + [("copied text", "en")] * 9 + [(None, "en"), ("x", None), ("", "fr")]
    texts = [prose(rng.choice(sorted(words)), rng.randrange(1, 12)) for _ in range(25)] + ["zqxj", "ZQXJ!", "ΟΔΥΣΣΕΥΣ İi", "12", "", None, "a", "  the--house\n\nof  "]
    return learn, texts


@pytest.mark.parametrize("chunk", [1 << 20, 1, 7])
def test_equals_plain_version(spark, monkeypatch, chunk):
    learn, texts = made()
    model = langid.fit(spark.createDataFrame(learn, "text string, lang string"))
    monkeypatch.setattr(langid, "CHUNK", chunk)
    names, scores = model.score(texts)
    expected = plain(learn, texts)
    assert names == [x[0] for x in expected]
    assert np.allclose(scores, [x[1] for x in expected], rtol=1e-9)
    assert names[texts.index("zqxj")] == "aa"  # a tie


def test_long_text_and_borders():
    rng = random.Random(2)
    text = "".join(rng.choice("abc é.  ") for _ in range(langid.CHUNK + 5000))
    found = langid._counts(text, (1, 2, 3), 1 << 15)
    assert {k: n for k, n in enumerate(found.tolist()) if n} == dict(buckets(text))


def test_copies_neither_crowd_out_nor_empty(spark):
    for k in range(4):
        learn = spark.range(3000).selectExpr(f"'hot text number {k}' AS text", "'en' AS lang").unionByName(spark.range(40).selectExpr("concat('texte froid ', id) AS text", "'fr' AS lang"))
        model = langid.fit(learn, per_language=1)
        assert model.languages == ["en", "fr"]
        en = np.exp(model.log_given[:, 0])
        assert np.count_nonzero(en > en.min() * 1.5) > 5  # something was learned of it
        assert np.isclose(np.exp(model.log_prior), [3000 / 3040, 40 / 3040]).all()
