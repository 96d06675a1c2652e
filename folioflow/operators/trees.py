"""Order and nesting of tree nodes by list ranking: rounds that double what a pointer spans, so a tree of any depth takes as many as its size has bits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.plans.stages import rewritten, staged


#: Nodes of a document that is put in order in one task.
WHOLE_NODES = 20_000
#: Documents that are Python objects at once.
DOCUMENTS = 32
ORDERED = "doc_key string, root string, node_id string, pre long, last long"
_ORDERED = pa.schema([("doc_key", pa.string()), ("root", pa.string()), ("node_id", pa.string()), ("pre", pa.int64()), ("last", pa.int64())])


def small_tree(nodes: list[dict]) -> tuple[list[str], dict[str, tuple[int, int]]] | None:
    """A document's node ids depth first, and of each its place and the last place of its subtree; None if it isn't made of trees."""
    listed, below = {x["node_id"]: x["child_ids"] for x in nodes}, set()
    if len(listed) < len(nodes):
        return None
    kids: dict[str, list[str]] = {}
    for node, children in listed.items():
        kids[node] = [c for c in dict.fromkeys(children or ()) if c in listed]
        if node in kids[node] or not below.isdisjoint(kids[node]):
            return None
        below.update(kids[node])
    order: list[str] = []
    places: dict[str, tuple[int, int]] = {}
    stack = [(node, False) for node in listed if node not in below]
    while stack:
        node, leaves = stack.pop()
        if leaves:
            places[node] = (places[node][0], len(order) - 1)
        else:
            places[node] = (len(order), -1)
            order.append(node)
            stack.append((node, True))
            stack += [(c, False) for c in reversed(kids[node])]
    return (order, places) if len(order) == len(listed) else None  # what isn't reached lies on a ring


def _small_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ORDERED of documents (doc_key, nodes, roots); a row without a node for those that aren't made of trees."""
    for batch in batches:
        for start in range(0, batch.num_rows, DOCUMENTS):
            out: list[tuple] = []
            for doc in batch.slice(start, DOCUMENTS).to_pylist():
                if (tree := small_tree(doc["nodes"])) is None:
                    out.append((doc["doc_key"], None, None, None, None))
                    continue
                order, places = tree
                for root in doc["roots"]:
                    first, last = places.get(root, (0, -1))
                    out += [(doc["doc_key"], root, node, *places[node]) for node in order[first + 1 : last + 1]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * 5, _ORDERED, strict=True)], schema=_ORDERED)


def parents(nodes: DataFrame) -> DataFrame:
    """(doc_key, parent, k, child): of nodes (doc_key, node_id, child_ids) the edges to nodes that are there, a child once a parent."""
    each = nodes.select("doc_key", F.col("node_id").alias("parent"), F.posexplode(F.coalesce("child_ids", F.array().cast("array<string>"))).alias("k", "child"))
    once = each.groupBy("doc_key", "parent", "child").agg(F.min("k").alias("k"))
    there = nodes.select("doc_key", F.col("node_id").alias("child")).distinct()
    return once.join(there, ["doc_key", "child"]).select("doc_key", "parent", "k", "child")


def tangled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_key) of documents that aren't made of trees: a node stands twice, or is listed by several parents or itself. Rings of parents are found by ranked()."""
    twice = nodes.groupBy("doc_key", "node_id").agg(F.count("*").alias("n")).filter("n > 1")
    several = edges.groupBy("doc_key", "child").agg(F.count("*").alias("n")).filter("n > 1")
    own = edges.filter("parent = child")
    return twice.select("doc_key").unionByName(several.select("doc_key")).unionByName(own.select("doc_key")).distinct()


def _rounds(nodes: DataFrame) -> int:
    """Doublings after which every pointer of a document's tour has met its end, if it has one."""
    most = nodes.groupBy("doc_key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return (2 * most).bit_length() + 1


def ranked(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_key, node_id, parent, pre, last) of trees, and (doc_key) of documents with rings of parents, which have no order.

    Within a tree pre grows depth first, children in their parents' order, and a node's subtree are those
    with pre from its own to last. A tour enters and leaves every node; its steps are ranked by doubling.
    """
    order = Window.partitionBy("doc_key", "parent").orderBy("k")
    beside = edges.select("doc_key", F.col("child").alias("node_id"), "parent", F.lead("child").over(order).alias("beside"))
    below = edges.groupBy("doc_key", "parent").agg(F.min_by("child", "k").alias("below")).withColumnRenamed("parent", "node_id")
    rows = staged(nodes.select("doc_key", "node_id").join(beside, ["doc_key", "node_id"], "left").join(below, ["doc_key", "node_id"], "left"))
    step = lambda node, leaves: F.struct(node.alias("node_id"), F.lit(leaves).alias("leaves"))
    none = F.lit(None).cast("struct<node_id:string,leaves:boolean>")
    enter = F.when(F.col("below").isNotNull(), step(F.col("below"), False)).otherwise(step(F.col("node_id"), True))
    leave = F.when(F.col("beside").isNotNull(), step(F.col("beside"), False)).when(F.col("parent").isNotNull(), step(F.col("parent"), True)).otherwise(none)
    steps = rows.select("doc_key", F.explode(F.array(F.struct(step(F.col("node_id"), False).alias("at"), enter.alias("to"), F.lit(1).cast("long").alias("n")), F.struct(step(F.col("node_id"), True).alias("at"), leave.alias("to"), F.lit(0).cast("long").alias("n")))).alias("s"))
    steps, at = rewritten(steps.select("doc_key", "s.*"))
    for _ in range(_rounds(nodes)):
        if steps.filter("to is not null").isEmpty():
            break
        there = steps.select("doc_key", F.col("at").alias("to"), F.col("to").alias("then"), F.col("n").alias("more"))
        steps, at = rewritten(steps.join(there, ["doc_key", "to"], "left").select("doc_key", "at", F.col("then").alias("to"), (F.col("n") + F.coalesce("more", F.lit(0).cast("long"))).alias("n")), at)
    rings = staged(steps.filter("to is not null").select("doc_key").distinct())
    ends = steps.groupBy("doc_key", F.col("at.node_id").alias("node_id")).agg(F.max(F.when(~F.col("at.leaves"), -F.col("n"))).alias("pre"), F.max(F.when(F.col("at.leaves"), -F.col("n") - 1)).alias("last"))
    found = rows.select("doc_key", "node_id", "parent").join(ends, ["doc_key", "node_id"]).join(rings, "doc_key", "left_anti")
    return staged(found.select("doc_key", "node_id", "parent", "pre", "last")), rings


def nearest(nodes: DataFrame, marked: DataFrame) -> DataFrame:
    """(doc_key, node_id, mark) of ranked nodes: the nearest of marked (doc_key, node_id) above a node, for nodes that have one, by doubling the way up."""
    marks = marked.select("doc_key", F.col("node_id").alias("parent"), F.col("node_id").alias("mark"))
    rows, at = rewritten(nodes.select("doc_key", "node_id", "parent").join(marks, ["doc_key", "parent"], "left").withColumn("up", F.when(F.col("mark").isNull(), F.col("parent"))).select("doc_key", "node_id", "up", "mark"))
    while not rows.filter("up is not null").isEmpty():  # ends, as ranked nodes have no rings
        there = rows.select("doc_key", F.col("node_id").alias("up"), F.col("up").alias("then"), F.col("mark").alias("found"))
        rows, at = rewritten(rows.join(there, ["doc_key", "up"], "left").select("doc_key", "node_id", F.col("then").alias("up"), F.coalesce("mark", "found").alias("mark")), at)
    return rows.filter("mark is not null").select("doc_key", "node_id", "mark")


def _of_trees(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    order, rings = ranked(nodes, edges)
    above = nearest(order, roots.select("doc_key", F.col("root").alias("node_id")))
    pairs = found = above.select("doc_key", "node_id", F.col("mark").alias("root"))
    over = above.select("doc_key", F.col("node_id").alias("root"), "mark")
    while not pairs.isEmpty():  # a round for each root around another
        pairs, _ = rewritten(pairs.join(over, ["doc_key", "root"]).select("doc_key", "node_id", F.col("mark").alias("root")))
        found = found.unionByName(pairs)
    return found.join(order, ["doc_key", "node_id"]).select("doc_key", "root", "node_id", "pre", "last"), rings


def _by_levels(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """The same for documents of any form, a round a level: a node is where the first way depth first leads, and a way ends at a node that is on it already."""
    edges = staged(parents(nodes.dropDuplicates(["doc_key", "node_id"])))
    level = roots.select("doc_key", "root", F.col("root").alias("node_id"), F.array().cast("array<int>").alias("path"), F.array("root").alias("above"))
    known = level.select("doc_key", "root", "node_id", "path").limit(0)
    while True:
        below = level.join(edges.withColumnRenamed("parent", "node_id"), ["doc_key", "node_id"]).filter(~F.array_contains("above", F.col("child")))
        level = below.select("doc_key", "root", F.col("child").alias("node_id"), F.array_append("path", F.col("k")).alias("path"), F.array_append("above", F.col("child")).alias("above"))
        level, _ = rewritten(level.groupBy("doc_key", "root", "node_id").agg(F.min_by(F.struct("path", "above"), "path").alias("b")).select("doc_key", "root", "node_id", "b.*"))
        if level.isEmpty():
            break
        known = known.unionByName(level.select("doc_key", "root", "node_id", "path"))
    once = known.groupBy("doc_key", "root", "node_id").agg(F.min("path").alias("path"))
    once = staged(once.withColumn("pre", F.row_number().over(Window.partitionBy("doc_key", "root").orderBy("path")).cast("long")))
    inner = once.select("doc_key", "root", F.col("path").alias("inner"), F.col("pre").alias("at"))
    last = once.join(inner, ["doc_key", "root"]).filter(F.slice("inner", F.lit(1), F.greatest(F.size("path"), F.lit(1))) == F.col("path"))
    return last.groupBy("doc_key", "root", "node_id").agg(F.first("pre").alias("pre"), F.max("at").alias("last"))


def descendants(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_key, root, node_id, pre, last): every node below each root (doc_key, root), pre sorting them depth first, those of a node's subtree having pre up to its last.

    nodes: doc_key, node_id, child_ids; ids of children that are no nodes don't count. Documents of up to
    WHOLE_NODES nodes that are made of trees are ordered each in one task. Larger ones
    take a number of rounds that grows with the logarithm of their size. Others, in which a node
    is listed by several parents or by one below it, take a round a level, and one reached
    twice keeps its first place.
    """
    nodes = staged(nodes.filter("node_id is not null").select("doc_key", "node_id", "child_ids"))
    sizes = staged(nodes.groupBy("doc_key").agg(F.count("*").alias("n")).filter(F.col("n") > WHOLE_NODES).select("doc_key"))
    few = F.array_agg(F.struct("node_id", "child_ids")).alias("nodes")
    docs = nodes.join(sizes, "doc_key", "left_anti").groupBy("doc_key").agg(few)
    docs = docs.join(roots.groupBy("doc_key").agg(F.array_agg("root").alias("roots")), "doc_key")
    ordered = staged(docs.mapInArrow(_small_trees, ORDERED))
    found = ordered.filter("node_id is not null")
    others = staged(ordered.filter("node_id is null").select("doc_key").unionByName(sizes))
    if others.isEmpty():
        return found
    return found.unionByName(_descendants(nodes.join(others, "doc_key", "left_semi"), roots.join(others, "doc_key", "left_semi")))


def _descendants(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """descendants() of documents of any size and form, in rounds over all of them."""
    edges = staged(parents(nodes))
    odd = staged(tangled(nodes, edges))
    plain = staged(nodes.join(odd, "doc_key", "left_anti"))
    found, rings = _of_trees(plain, edges.join(odd, "doc_key", "left_anti"), roots.join(odd, "doc_key", "left_anti"))
    odd = staged(odd.unionByName(rings))
    found = found.join(rings, "doc_key", "left_anti")
    if odd.isEmpty():
        return found
    return found.unionByName(_by_levels(nodes.join(odd, "doc_key", "left_semi"), roots.join(odd, "doc_key", "left_semi")))
