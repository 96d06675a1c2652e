"""The prefix trie of conversations against a plain version, over many partitions, with nulls, ties, repeats and conversations without turns."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from folioflow.llm import trie

TURNS = "conv_id long, turn long, role string, text string, key string, name string"


def made(seed, n=120, alphabet=3):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        kind = rng.randrange(4)
        length = 4 if kind == 0 else rng.randrange(0, 14)
        for k in range(length):
            text = "hot" if kind == 0 or rng.random() < 0.5 else f"{rng.randrange(alphabet)}é" * rng.randrange(1, 4)
            rows.append((c - 10, k if rng.random() > 0.1 else None, rng.choice(["user", "user", "bot", None]) if kind == 3 else "user", text))
    rows += [(500, None, None, None), (500, 3, "a", ""), (500, 3, "a", ""), (501, 3, "", "a"), (501, 3, "a", ""), (None, 1, "user", "x"), (None, None, None, None), (777, 1, "user", "L" * 50_000)]
    rows += [(900 + k, j, "user", "deep") for k in range(40) for j in range(5)]
    rng.shuffle(rows)
    return rows


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def plain_sequences(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, digest(role, text), role, text))
    own = {c: [(role, text) for *_, role, text in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def plain_trie(seqs):
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[x] for x in children[p])
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(seqs[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def of(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], TURNS).repartition(3)
    id_ = F.col("conv_id")
    return trie.rebuilt(trie.numbered(df), id_ - id_ % 5, F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(9)).cast("int"), 8)


@pytest.mark.parametrize(("seed", "partitions", "piece"), [(1, 1, 512), (2, 5, 3), (3, 40, 1), (4, 170, 2)])
def test_trie(spark, monkeypatch, seed, partitions, piece):
    monkeypatch.setattr(trie, "PIECE", piece)
    rows = made(seed)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = trie.prefix_trie(trie.sequences(of(spark, rows)))
        assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_trie(plain_sequences(rows))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def sweep(parts):
    """The nodes of sorted sequences in any partitions, without Spark."""
    nodes, edges, pieces = [], [], []
    for part in parts:
        out = trie.Sweep()
        for key, conv_id, sizes in part:
            nodes += out.add(key, conv_id, sizes)
        if edge := out.end():
            edges.append(edge)
        pieces += out.pieces
    batch = trie._output([], edges, []).select(["edge"]) if edges else None
    for found in trie._stitched(iter([batch] if batch else [])):
        nodes += found.to_pylist()
    runs = defaultdict(list)
    for p in pieces:
        runs[p["name"]].append((p["first_id"], p["nth"], p["ids"]))
    for n in nodes:
        if n["name"] in runs:
            n["ends_sha256"] = hashlib.sha256(",".join(x[2] for x in sorted(runs[n["name"]])).encode()).hexdigest()
    names = {n["name"]: n["conv_id"] for n in nodes}
    nothing = hashlib.sha256(b"").hexdigest()
    return sorted(((n["conv_id"], n["depth"], names.get(n["parent"]) if n["depth"] else None, n["n_convs"], n["n_children"], n["n_leaves"], n["saved_tokens"], n["ends_sha256"] or nothing) for n in nodes), key=repr)


def test_partitions_cut_anywhere(monkeypatch):
    rng = random.Random(8)
    for n in range(300):
        monkeypatch.setattr(trie, "PIECE", rng.randrange(1, 4))
        seqs = {c: [("user", rng.choice("ab")) for _ in range(rng.choice([0, 1, 2, 3, 6]))] for c in range(rng.randrange(1, 25))}
        rows = sorted((b"".join(bytes.fromhex(digest(*t))[: trie.TURN] for t in s), c, [len(t[1]) for t in s]) for c, s in seqs.items())
        cuts = sorted(rng.randrange(len(rows) + 1) for _ in range(rng.randrange(6)))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        assert sweep(parts) == plain_trie(seqs), n


def test_common_turns():
    rng = random.Random(4)
    for _ in range(300):
        a, b = (bytes(rng.choice([0, 1]) for _ in range(rng.randrange(5)) for _ in [0]) for _ in range(2))
        wide = [b"".join(bytes([x]) * trie.TURN for x in y) for y in (a, b)]
        n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert trie.common_turns(*wide) == n


def test_long_conversation_and_nothing(spark):
    rows = [(5 * k, j, "user", str(j % 7)) for k in range(2) for j in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = trie.prefix_trie(trie.sequences(trie.rebuilt(trie.numbered(df), F.col("conv_id"), F.lit(0), 8)))
    assert [tuple(found.agg(F.count("*"), F.max("depth"), F.min("n_convs"), F.max("saved_tokens")).first())] == [(3001, 3000, 2, 3000)]
    none = spark.createDataFrame([], TURNS)
    assert trie.prefix_trie(trie.sequences(trie.rebuilt(trie.numbered(none), F.col("conv_id"), F.lit(0), 8))).count() == 0
