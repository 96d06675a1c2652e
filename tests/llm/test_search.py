"""Exact top-k search and hard negatives against plain versions, with nulls, ties, repeats, vectors of odd lengths and clashing columns."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioflow.llm import bitslices, vantage

EMBEDDINGS = "vec_id long, embedding array<float>, label int, row string, score string"


def quantised(v, scale):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return tuple(max(-bitslices.LARGEST, min(bitslices.LARGEST, math.floor(scale * x))) for x in v)


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def made(seed=2, n=150, d=6):
    rng = random.Random(seed)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(d)], rng.randrange(3)) for k in range(n)]
    same = [0.5] * d
    rows += [(1000 + k, same, k % 3) for k in range(60)]  # a common vector
    rows += [(2000, None, 1), (2020, [0.1, None, 0.3], 1), (2040, [float("nan")] * d, 2), (2060, [float("inf")] * d, 0), (None, same, 1), (None, None, None)]
    rows += [(20, [0.25, -1.0], 0), (20, rows[20][1], rows[20][2]), (3000, [], 1), (3001, [0.0] * d, 1), (4000, [1e30] * 2, 2), (-40, [0.5] * (d + 3), None), (-100, [-3.0] * d, 2), (100, [0.1] * d, None)]
    rng.shuffle(rows)
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], EMBEDDINGS).repartition(5)


def plain_top_k(rows, every, k, scale):
    kept = sorted({(i, q) for i, v, _ in rows if i is not None and (q := quantised(v, scale)) is not None})
    out = []
    for n, (i, q) in enumerate(kept):
        if i % every == 0:
            best = sorted((-dot(q, c), j) for m, (j, c) in enumerate(kept) if m != n)[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize(("k", "block_rows"), [(20, 4096), (3, 7), (500, 64)])
def test_top_k(spark, k, block_rows, monkeypatch):
    monkeypatch.setattr(bitslices, "TOGETHER", 5)
    rows = made()
    found = bitslices.top_k(frame(spark, rows), F.col("vec_id") % 20 == 0, k, 64, block_rows)
    assert sorted(tuple(r) for r in found.collect()) == plain_top_k(rows, 20, k, 64)


def test_many_groups(spark, monkeypatch):
    met = bitslices.met
    monkeypatch.setattr(bitslices, "met", lambda *a: met(*a, queries_together=3, blocks_together=2))
    rows = made(7, 90, 3)
    found = bitslices.top_k(frame(spark, rows), F.col("vec_id") % 4 == 0, 6, 16, 10)
    assert sorted(tuple(r) for r in found.collect()) == plain_top_k(rows, 4, 6, 16)


def test_slices_hold_what_they_are_made_of():
    rng = np.random.default_rng(3)
    for n, d in ((1, 1), (63, 3), (64, 2), (200, 5)):
        comps = rng.integers(-70, 50, (n, d)) * rng.integers(0, 2, d)
        comps[0, 0] = -bitslices.LARGEST
        widths, slices = bitslices.slices_of(comps)
        flags = np.unpackbits(slices.view(np.uint8), axis=1, bitorder="little")[:, :n].astype(np.int64)
        starts = np.cumsum(widths) - widths
        for j, w in enumerate(widths.tolist()):
            back = sum(flags[starts[j] + b] << b for b in range(w - 1)) - (flags[starts[j] + w - 1] << (w - 1))
            assert back.tolist() == comps[:, j].tolist()


def test_adder_and_selection():
    rng = np.random.default_rng(5)
    for _ in range(20):
        n, d, q = int(rng.integers(1, 150)), int(rng.integers(1, 9)), int(rng.integers(1, 5))
        comps, asked = rng.integers(-9, 10, (n, d)), rng.integers(-6, 7, (q, d))
        widths, slices = bitslices.slices_of(comps)
        adder = bitslices.Adder(asked, widths)
        sums = adder.sums(bitslices._widened(widths, slices, widths, n))
        flags = [np.unpackbits(s.view(np.uint8), axis=1, bitorder="little")[:, :n].astype(np.int64) for s in sums]
        scores = sum((f << b for b, f in enumerate(flags)), np.zeros((q, n), np.int64)) + adder.constants[:, None]
        assert np.array_equal(scores, asked @ comps.T)
        k = int(rng.integers(1, 12))
        rows = np.tile(bitslices.packed_rows(np.ones((n, 1), np.uint8)), (q, 1))
        of, row = bitslices.select(sums, rows, k, n)
        for i in range(q):
            assert sorted(row[of == i].tolist()) == sorted(sorted(range(n), key=lambda r: (-scores[i, r], r))[:k])


def plain_negatives(rows, every, n_positives, k, low, high, scale):
    kept = sorted({(i, label, q) for i, v, label in rows if i is not None and label is not None and (q := quantised(v, scale)) is not None})
    out = []
    for n, (i, label, q) in enumerate(kept):
        if i % every == 0:
            scores = [(dot(q, c), j, other) for m, (j, other, c) in enumerate(kept) if m != n]
            for s, j in sorted((-s, j) for s, j, other in scores if other == label)[:n_positives]:
                p = -s
                inside = sorted((-s, x) for s, x, other in scores if other != label and low * p <= 100 * s <= high * p)[:k]
                out += [(i, j, rank, x, p, -s) for rank, (s, x) in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize(("tree_rows", "leaf"), [(8192, 128), (40, 4), (9, 1)])
def test_hard_negatives(spark, monkeypatch, tree_rows, leaf):
    monkeypatch.setattr(vantage, "LEAF", leaf)
    met = bitslices.met
    monkeypatch.setattr(vantage, "met", lambda a, b, n, m, f, s, *_: met(a, b, n, m, f, s, 4, 2))
    rows = made(11, 120, 4)
    found = vantage.hard_negatives(frame(spark, rows), F.col("label"), F.col("vec_id") % 10 == 0, 3, 4, 60, 100, 32, tree_rows)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in found.collect()) == plain_negatives(rows, 10, 3, 4, 60, 100, 32)


def test_tree_gives_all_rows_of_an_annulus_nearest_first(monkeypatch):
    monkeypatch.setattr(vantage, "LEAF", 3)
    rng = np.random.default_rng(9)
    for n, spread in itertools.product((0, 1, 4, 90), (1, 40)):
        comps = rng.integers(-spread, spread + 1, (n, 4))
        ids = np.arange(n) * 3
        tree = vantage.Tree.read(vantage.Tree(ids.copy(), ids.copy(), ids % 3, comps.copy()).stored()) if n else vantage.Tree(ids, ids, ids, comps)
        vector = rng.integers(-spread, spread + 1, 4)
        scores = comps @ vector
        for least, most in ((-np.inf, np.inf), (-spread, spread * 2), (5, 5)):
            asked = vantage.Asked(tree, vector)
            found = [(s, int(tree.ids[r])) for s, r in asked.best(least, most, np.ones(n, bool), n)]
            assert found == sorted(((int(s), int(i)) for s, i in zip(scores, ids) if least <= s <= most), key=lambda x: (-x[0], x[1]))


def test_narrow_windows_open_few_leaves(monkeypatch):
    monkeypatch.setattr(vantage, "LEAF", 8)
    comps = np.array([[k, 0] for k in range(-2000, 2000)])
    ids = np.arange(len(comps))
    asked = vantage.Asked(vantage.Tree(ids.copy(), ids.copy(), ids, comps), np.array([1, 0]))
    assert [s for s, _ in asked.best(100, 110, np.ones(len(ids), bool), 5)] == [110, 109, 108, 107, 106]
    assert len(asked.known) < 60


def test_empty(spark):
    none = spark.createDataFrame([], EMBEDDINGS)
    assert bitslices.top_k(none, F.col("vec_id") % 20 == 0).count() == 0
    assert vantage.hard_negatives(none, F.col("label"), F.col("vec_id") % 20 == 0).count() == 0


def test_blocks():
    batches = [pa.RecordBatch.from_pydict({"x": list(range(k, k + n))}) for k, n in ((0, 5), (5, 0), (5, 7), (12, 1))]
    assert [b["x"].to_pylist() for b in bitslices.blocks_of(iter(batches), 4)] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11], [12]]
