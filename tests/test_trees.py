"""Order of tree nodes by doubling against a depth-first walk: deep, wide and odd documents; snapshots settled on."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators import axtree, running, trees

NODES = "doc_key string, node_id string, child_ids array<string>, pos long"


def walk(children, root):
    """Nodes below root depth first, each once, with the last of each one's own."""
    order, last = [], {}
    stack = [(root, iter(children.get(root, ())))]
    seen = {root}
    while stack:
        node, rest = stack[-1]
        child = next((c for c in rest if c not in seen and c in children), None)
        if child is None:
            stack.pop()
            last[node] = len(order)
        else:
            seen.add(child)
            order.append(child)
            stack.append((child, iter(children[child])))
    return [(n, last[n]) for n in order]


def found(spark, docs, roots):
    rows = [(d, n, kids, k) for d, children in docs.items() for k, (n, kids) in enumerate(children.items())]
    df = spark.createDataFrame(rows, NODES).repartition(3)
    asked = spark.createDataFrame(roots, "doc_key string, root string")
    out = {}
    for r in sorted(trees.descendants(df, asked).collect(), key=lambda r: (r["doc_key"], r["root"], r["pre"])):
        out.setdefault((r["doc_key"], r["root"]), []).append(r)
    return {k: [(r["node_id"], sum(x["pre"] <= r["last"] for x in v)) for r in v] for k, v in out.items()}


def tree(rng, n, deep):
    children = {"0": []}
    for k in range(1, n):
        up = str(k - 1 if rng.random() < deep else rng.randrange(k))
        children[up].insert(rng.randrange(len(children[up]) + 1), str(k))
        children[str(k)] = []
    return children


def test_trees(spark):
    rng = random.Random(2)
    docs = {f"d{n}": tree(rng, n, deep) for n, deep in ((1, 0), (2, 1), (30, 0.3), (200, 1.0), (300, 0.99), (150, 0.0))}
    docs["gone"] = {"0": ["1", "no such node", "1"], "1": None, "2": ["0"]}
    roots = [(d, "0") for d in docs] + [("d30", str(k)) for k in range(1, 30, 4)] + [("d300", "150"), ("none", "0")]
    expected = {(d, r): walk({n: kids or [] for n, kids in docs[d].items()}, r) for d, r in roots if d in docs}
    assert found(spark, docs, roots) == {k: v for k, v in expected.items() if v}


def test_depth_costs_few_rounds(spark, monkeypatch):
    calls = []
    real = trees.rewritten
    monkeypatch.setattr(trees, "rewritten", lambda *a: calls.append(1) or real(*a))
    n = 3_000
    nodes = spark.range(n).select(F.lit("line").alias("doc_key"), F.col("id").cast("string").alias("node_id"), F.array((F.col("id") + 1).cast("string")).alias("child_ids"))
    roots = spark.createDataFrame([("line", "0")], "doc_key string, root string")
    got = trees.descendants(nodes, roots).orderBy("pre").collect()
    assert [r["node_id"] for r in got] == [str(k) for k in range(1, n)]
    assert len({r["last"] for r in got}) == 1
    assert len(calls) < 30


@pytest.mark.parametrize("children", [
    {"a": ["b", "c"], "b": ["d"], "c": ["d", "e"], "d": ["f"], "e": [], "f": []},  # two parents
    {"a": ["b"], "b": ["c"], "c": ["a", "d"], "d": []},  # a ring through the root
    {"a": ["b"], "b": ["b", "c"], "c": []},  # its own parent
    {"x": ["y"], "y": ["x"], "a": ["b"], "b": []},  # a ring beside a tree
])
def test_odd_documents(spark, children):
    docs = {"odd": children, "even": {"a": ["b", "c"], "b": [], "c": []}}
    got = found(spark, docs, [("odd", "a"), ("even", "a")])
    assert got["odd", "a"] == walk(children, "a")
    assert got["even", "a"] == [("b", 1), ("c", 2)]


def test_nested_paragraphs_and_pages(spark):
    rows = [
        ("d", 0, "p1", "region", "Page 1", ["h1", "p2", "t9"]), ("d", 1, "h1", "heading", "", ["t1", "h2"]), ("d", 2, "t1", "staticText", "outer text", []),
        ("d", 3, "h2", "paragraph", "", ["t2"]), ("d", 4, "t2", "staticText", "inner text", []), ("d", 5, "p2", "region", "Page 2", ["t3", "t4"]),
        ("d", 6, "t3", "staticText", "left over one.", []), ("d", 7, "t4", "staticText", "left over two", []), ("d", 8, "t9", "staticText", "behind the page", []),
    ]
    nodes = spark.createDataFrame(rows, "doc_key string, pos long, node_id string, role string, name string, child_ids array<string>")
    units = sorted((r["page_no"], r["nth"], r["text"]) for r in axtree.node_units(nodes).collect())
    assert units == [(1, 1, "outer text inner text"), (1, 2, "left over one."), (1, 3, "left over two behind the page"), (2, 1, "left over one."), (2, 2, "left over two")]


def test_most_before(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), k, rng.choice([None, 1, 5, 9, -3])) for k in range(-40, 60)]
    df = spark.createDataFrame(rows, "key string, place long, v int")
    for r in running.most_before(df, "key", "place", F.col("v"), "m", 7).collect():
        before = [v for key, k, v in rows if key == r["key"] and k < r["place"] and v is not None]
        assert r["m"] == (max(before) if before else None)


def plain_choice(scores, full):
    best, stable, top = -1, 0, None
    for snapshot, score in scores:
        if score > best:
            best, stable, top = score, 0, snapshot
        else:
            stable += 1
        if full[snapshot] and stable >= 1:
            return snapshot, True
    return top, False


def test_snapshots(spark):
    rng = random.Random(6)
    units, asked, expected = [], [], {}
    for d in range(40):
        pages = [1, 2][: rng.randrange(1, 3)]
        asked += [(f"d{d}", p) for p in pages]
        scores, full = [], {}
        for s in range(rng.randrange(1, 9)):
            n = {p: rng.choice([0, 10, 35, 36, 60]) for p in pages}
            units += [(f"d{d}", s, p, "x" * k) for p, k in n.items() if k] + [(f"d{d}", s, 9, "not asked for" * rng.randrange(9))]
            scores.append((s, sum(n.values())))
            full[s] = all(k >= 35 for k in n.values())
        expected[f"d{d}"] = plain_choice(scores, full)
    df = spark.createDataFrame(units, "doc_key string, snapshot long, page_no int, text string")
    pages = spark.createDataFrame(asked, "doc_key string, page_no int")
    chosen = axtree.chosen_snapshots(axtree.snapshot_runs(df, pages))
    assert {r["doc_key"]: (r["snapshot"], r["settled"]) for r in chosen.collect()} == expected
    assert {s for _, s in expected.values()} == {True, False}
    taken = axtree.read_pages(df, pages, chosen).collect()
    assert {(r["doc_key"], r["snapshot"]) for r in taken} == {(d, s) for d, (s, settled) in expected.items() if settled}
    assert all(r["page_no"] != 9 for r in taken)
