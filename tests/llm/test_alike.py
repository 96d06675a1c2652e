"""The near-duplicate stage against all pairs of documents, compared one by one."""

import random

import numpy as np
import pytest

import corpus_pipeline
from folioflow.llm import alike
from folioflow.llm.simhash import fingerprint


def set_of(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def first_ones(rows):
    """The smallest doc_id of each component over pairs that share 0.8 or more."""
    sets, up = {k: set_of(t) for k, t in rows}, {k: k for k, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return sorted({root(k) for k in up if sets[k]})


def test_stage_takes_lighter_near_copies(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(60):
        text = [rng.choice(words) for _ in range(rng.choice([3, 60, 120, 300]))]
        for _ in range(3):
            rows.append((len(rows) + 1, " ".join(text)))
            text = [*text]
            for _ in range(max(1, len(text) // rng.choice([15, 40, 60, 100]))):
                text[rng.randrange(len(text))] = "new" + rng.choice(words)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = first_ones(rows)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == want
    texts = dict(rows)
    gone = [k for k in texts if k not in want]
    assert any(all((fingerprint(texts[k], 4) ^ fingerprint(texts[j], 4)).bit_count() > 4 for j in texts if j != k) for k in gone)


@pytest.mark.parametrize("copies", [3, 150])
def test_long_runs_are_compared_whole(spark, copies, monkeypatch):
    monkeypatch.setattr(alike, "LONG_RUN", 4)
    monkeypatch.setattr(alike, "PER_COPY", 8)
    rng = random.Random(copies)
    middle = [f"m{k}" for k in range(150)]
    rows = [(1000, " ".join(middle))]
    for k in range(copies):
        text = [*middle]
        for at in rng.sample(range(150), rng.choice([1, 2, 3, 4])):
            text[at] = f"x{rng.randrange(9)}"
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame([*rows, (None, "alone here"), (None, None)], "doc_id long, text string")
    found = [r["doc_id"] for r in alike.keep_one_alike(docs).collect()]
    assert sorted(k for k in found if k is not None) == first_ones(rows)
    assert found.count(None) == 2


def test_counts_bound_what_sets_share():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 400).tolist()
    sets = [set(base[: 400 - 9 * k]) | set(rng.integers(0, 1 << 62, 9 * k).tolist()) for k in range(9)] + [{512 * k for k in range(300)}, {512 * k for k in range(100, 400)}]
    counts = np.array([np.minimum(np.bincount(np.array(list(x)) % alike.COUNTS, minlength=alike.COUNTS), alike.FULL) for x in sets], np.uint8)
    i, j = np.triu_indices(len(sets), 1)
    most = alike._most_common(counts[i], counts[j])
    assert all(m >= len(sets[x] & sets[y]) for m, x, y in zip(most.tolist(), i.tolist(), j.tolist(), strict=True))
    assert most[-1] == np.inf


def test_copies_changed_each_in_its_own_way_give_few_pairs(spark, monkeypatch):
    rng = random.Random(8)
    middle, rows = [f"m{k}" for k in range(150)], []
    for k in range(300):
        text = [*middle]
        for n, at in enumerate(rng.sample(range(150), 2 if k < 20 else rng.randint(6, 8))):
            text[at] = f"own{k}x{n}"
        rows.append((k, " ".join(text)))
    whole = []
    real = alike.candidates

    def seen(runs, least, all_of_them):
        out = real(runs, least, all_of_them)
        if all_of_them:
            whole.append(out.count())
        return out

    monkeypatch.setattr(alike, "candidates", seen)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in alike.keep_one_alike(docs).collect()) == first_ones(rows)
    assert whole and whole[0] < 10 * len(rows)
