"""Prefix trie of conversations: turn arrays in one sorted order over all partitions, lengths of common prefixes, a sweep with a stack, and open stacks stitched where partitions meet."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.shared import stored, text_or_empty

#: Bytes of a turn's digest: as many first ones of the SHA-256 of its role and text.
TURN = 16
#: Ids in a piece of a run that may go on in the next partition.
PIECE = 512


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, turn, bytes): every turn with its digest and the UTF-8 bytes of its text, numbered from 1 in the order of turn, null first.

    Null roles and texts are empty. Turns with equal numbers stand in the order of their SHA-256;
    repeated rows are repeated turns. Rows without a conv_id belong to no conversation and are left out.
    """
    role, text = text_or_empty("role"), text_or_empty("text")
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("at"), digest.alias("sha"), F.octet_length(text).cast("long").alias("bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.col("at").asc_nulls_first(), "sha")
    return rows.select("conv_id", F.row_number().over(order).alias("place"), F.left("sha", F.lit(2 * TURN)).alias("turn"), "bytes")


def rebuilt(turns: DataFrame, base: Column, n_first: Column, most_first: int) -> DataFrame:
    """(conv_id, place, turn, bytes) of turns as numbered gives them: the first n_first turns of the conversation base, and then a conversation's own turns behind its first n_first. One row without a turn stands for each conversation.

    base and n_first are made of conv_id; n_first is most_first at most. So no conversation gets more than
    most_first turns of another, and no row more than one place beside its own.
    """
    each = turns.filter("place = 1").select("conv_id", base.alias("base"), n_first.alias("n_first"))
    heads = turns.filter(F.col("place") <= most_first).select(F.col("conv_id").alias("base"), "place", "turn", "bytes")
    taken = each.join(heads, "base").filter("place <= n_first").select("conv_id", "place", "turn", "bytes")
    own = turns.filter(F.col("place") > n_first)
    none = each.select("conv_id", *[F.lit(None).cast(t).alias(n) for n, t in (("place", "int"), ("turn", "string"), ("bytes", "long"))])
    return own.unionByName(taken).unionByName(none)


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, key, bytes): each conversation's digests one after the other, and the bytes of its turns; both empty without a turn."""
    listed = F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "turn", "bytes"))))
    rows = turns.groupBy("conv_id").agg(listed.alias("all"))
    return rows.select("conv_id", F.unhex(F.array_join("all.turn", "")).alias("key"), F.col("all.bytes").alias("bytes"))


@dataclass
class Node:
    """A node on the stack: what its closed children and its own ends gave so far."""

    depth: int
    name: bytes
    bytes: int
    on_left: bool = False
    conv_id: int | None = None
    n_convs: int = 0
    n_children: int = 0
    n_leaves: int = 0
    saved: int = 0
    ends: str | None = None
    run: object = field(default=None, repr=False)

    def saw(self, conv_id: int | None, n: int) -> None:
        if n:
            self.conv_id = conv_id if self.conv_id is None else min(self.conv_id, conv_id)
            self.n_convs += n

    def close(self) -> None:
        """All of its members and children are known."""
        self.n_leaves = self.n_leaves or 1
        self.saved += (self.n_convs - 1) * self.bytes

    def take(self, child: Node) -> None:
        self.saw(child.conv_id, child.n_convs)
        self.n_children += 1
        self.n_leaves += child.n_leaves
        self.saved += child.saved

    def also(self, other: Node) -> None:
        """The same node as another partition has it open."""
        self.saw(other.conv_id, other.n_convs)
        self.n_children += other.n_children
        self.n_leaves += other.n_leaves
        self.saved += other.saved
        self.ends = self.ends or other.ends

    def row(self, parent: Node | None) -> dict:
        return {
            "name": self.name, "parent": parent.name if parent else None, "depth": self.depth, "conv_id": self.conv_id, "n_convs": self.n_convs,
            "n_children": self.n_children, "n_leaves": self.n_leaves, "saved_tokens": self.saved, "ends_sha256": self.ends,
        }

    def open(self) -> dict:
        return {"depth": self.depth, "name": self.name, "bytes": self.bytes, "conv_id": self.conv_id, "n_convs": self.n_convs, "n_children": self.n_children, "n_leaves": self.n_leaves, "saved": self.saved, "ends": self.ends}


NODE = "name binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_OPEN = "struct<depth: long, name: binary, bytes: long, conv_id: long, n_convs: long, n_children: long, n_leaves: long, saved: long, ends: string>"
SWEPT = f"node struct<{NODE.replace(' ', ': ').replace(',: ', ', ')}>, edge struct<first: binary, first_id: long, last: binary, shared: long, left: array<{_OPEN}>, right: array<{_OPEN}>>, piece struct<name: binary, first_id: long, nth: long, ids: string>"
_NODE_TYPE = pa.struct([("name", pa.binary()), ("parent", pa.binary()), *[(n, pa.int64()) for n in ("depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")], ("ends_sha256", pa.string())])
_OPEN_TYPE = pa.struct([("depth", pa.int64()), ("name", pa.binary()), *[(n, pa.int64()) for n in ("bytes", "conv_id", "n_convs", "n_children", "n_leaves", "saved")], ("ends", pa.string())])
_EDGE_TYPE = pa.struct([("first", pa.binary()), ("first_id", pa.int64()), ("last", pa.binary()), ("shared", pa.int64()), ("left", pa.list_(_OPEN_TYPE)), ("right", pa.list_(_OPEN_TYPE))])
_PIECE_TYPE = pa.struct([("name", pa.binary()), ("first_id", pa.int64()), ("nth", pa.int64()), ("ids", pa.string())])


def common_turns(a: bytes, b: bytes) -> int:
    """How many first turns two keys share."""
    low, high = 0, min(len(a), len(b)) // TURN
    if a[: high * TURN] == b[: high * TURN]:
        return high
    while high - low > 1:  # low turns are shared, high aren't
        middle = (low + high) // 2
        low, high = (middle, high) if a[low * TURN : middle * TURN] == b[low * TURN : middle * TURN] else (low, middle)
    return low


def child_name(parent: bytes, turn: bytes) -> bytes:
    return hashlib.sha256(parent + turn).digest()[:TURN]


class Sweep:
    """One partition's sorted sequences swept with a stack of the prefixes of the last one.

    Nodes that hold neither the first nor the last sequence are closed here. The others may go on in
    other partitions: those of the first sequence are handed on as the left edge, those of the last
    one as the right edge, each with what its closed children gave.
    """

    def __init__(self) -> None:
        self.stack: list[Node] = []
        self.left: list[Node] = []
        self.first: bytes | None = None
        self.first_id = self.last_id = 0
        self.last = b""
        self.run: list[str] = []
        self.pieces: list[dict] = []
        self.n_pieces = 0

    def add(self, key: bytes, conv_id: int, sizes: list[int]) -> Iterator[dict]:
        """The nodes that end before this sequence."""
        if self.first is None:
            self.first, self.first_id = key, conv_id
            self.stack.append(Node(0, b"", 0, on_left=True))
            shared = 0
        else:
            shared = common_turns(self.last, key)
            if key != self.last:
                self._end_run(last=False)
            yield from self._pop(shared)
        for depth in range(shared + 1, len(key) // TURN + 1):
            turn = key[(depth - 1) * TURN : depth * TURN]
            self.stack.append(Node(depth, child_name(self.stack[-1].name, turn), sizes[depth - 1], on_left=key is self.first))
        self.last, self.last_id = key, conv_id
        self.stack[-1].saw(conv_id, 1)
        self.run.append(str(conv_id))
        if len(self.run) >= PIECE:
            self._flush(first=self.last == self.first)

    def _flush(self, first: bool) -> None:
        """Ids of a run that began with the partition go on as pieces; those of any other are hashed, and kept as pieces too in case that the partition ends with it."""
        if not self.run:
            return
        node, text = self.stack[-1], ",".join(self.run)
        piece = {"name": node.name, "first_id": int(self.run[0]), "nth": self.n_pieces, "ids": text}
        self.n_pieces += 1
        if not first:
            if node.run is None:
                node.run = hashlib.sha256(text.encode())
            else:
                node.run.update(b"," + text.encode())
        self.pieces.append(piece)
        self.run = []

    def _end_run(self, last: bool) -> None:
        first = self.last == self.first
        self._flush(first)
        if not first and not last:
            node = self.stack[-1]
            node.ends, node.run = node.run.hexdigest(), None
            self.pieces = [p for p in self.pieces if p["name"] != node.name]

    def _pop(self, depth: int) -> Iterator[dict]:
        while self.stack[-1].depth > depth:
            node = self.stack.pop()
            if node.on_left:
                self.left.append(node)
                continue
            node.close()
            self.stack[-1].take(node)
            yield node.row(self.stack[-1])

    def end(self) -> dict | None:
        """The partition's edges; self.pieces has the runs of ids that may go on."""
        if self.first is None:
            return None
        self._end_run(last=True)
        shared = common_turns(self.first, self.last)
        left, right = [n for n in self.left if n.depth > shared], self.stack
        return {"first": self.first, "first_id": self.first_id, "last": self.last, "shared": shared, "left": [n.open() for n in sorted(left, key=lambda n: n.depth)], "right": [n.open() for n in right]}


def _output(nodes: list[dict], edges: list[dict], pieces: list[dict]) -> pa.RecordBatch:
    n = len(nodes) + len(edges) + len(pieces)
    columns = [
        pa.array(nodes + [None] * (n - len(nodes)), _NODE_TYPE),
        pa.array([None] * len(nodes) + edges + [None] * len(pieces), _EDGE_TYPE),
        pa.array([None] * (n - len(pieces)) + pieces, _PIECE_TYPE),
    ]
    return pa.RecordBatch.from_arrays(columns, ["node", "edge", "piece"])


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sweep, nodes = Sweep(), []
    for batch in batches:
        for key, conv_id, sizes in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            nodes.extend(sweep.add(key.as_py(), conv_id.as_py(), sizes.as_py()))
            if len(nodes) >= 10_000:
                yield _output(nodes, [], [])
                nodes = []
            if len(sweep.pieces) >= 64 and sweep.last == sweep.first:
                yield _output([], [], sweep.pieces)
                sweep.pieces = []
    edge = sweep.end()
    yield _output(nodes, [edge] if edge else [], sweep.pieces)


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes that partitions left open, from their edges in order: the stack of one partition's right edge meets the next one's left edge."""
    stack: list[Node] = []
    last, nodes = b"", []

    def pop(depth: int) -> None:
        while stack and stack[-1].depth > depth:
            node = stack.pop()
            node.close()
            if stack:
                stack[-1].take(node)
            nodes.append(node.row(stack[-1] if stack else None))

    def put(opened: list[dict]) -> None:
        """Nodes of one path, some of which are open here."""
        for x in opened:
            node = Node(**x)
            if node.depth < len(stack):
                stack[node.depth].also(node)
            else:
                stack.append(node)

    for batch in batches:
        for edge in batch.column(0).to_pylist():
            pop(common_turns(last, edge["first"]))
            put(edge["right"][: edge["shared"] + 1])
            put(edge["left"])
            pop(edge["shared"])
            put(edge["right"][edge["shared"] + 1 :])
            last = edge["last"]
            yield pa.RecordBatch.from_arrays([pa.array([n[c] for n in nodes], _NODE_TYPE.field(c).type) for c in _NODE_TYPE.names], _NODE_TYPE.names)
            nodes.clear()
    pop(-1)
    yield pa.RecordBatch.from_arrays([pa.array([n[c] for n in nodes], _NODE_TYPE.field(c).type) for c in _NODE_TYPE.names], _NODE_TYPE.names)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, sha) of runs of ids, from their pieces in order."""
    name, run, found = None, None, []
    for batch in batches:
        for of, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if of != name:
                if run is not None:
                    found.append((name, run.hexdigest()))
                name, run = of, hashlib.sha256(ids.as_py().encode())
            else:
                run.update(b"," + ids.as_py().encode())
    if run is not None:
        found.append((name, run.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.string())], ["name", "sha"])


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node of the trie of sequences (conv_id, key, bytes).

    A node is a different sequence of first turns, the root that of none. conv_id is its smallest member,
    parent_conv_id its parent's. saved_tokens sums (n_convs - 1) times the bytes of the last turn over the
    subtree. ends_sha256 is that of the ids of the members that end there, ascending and parted by commas.

    Sequences are sorted over all partitions by (key, conv_id), so a node is a stretch of rows and copies
    of one conversation part anywhere. Each partition is swept with a stack as deep as its longest
    sequence; nodes inside are done there. What is open at its two edges, as many nodes as two sequences
    have turns, goes to one task that stitches the edges of all partitions in order: its work grows with
    the number of partitions, not with their rows. Runs of ids that touch an edge are hashed from pieces
    of PIECE ids, in a stream, as SHA-256 has to see them in order. Parents' ids come by a join on names
    of nodes, 16 bytes of a chain of SHA-256, which the engine may split where a node has many children.

    A conversation is one row, of 24 bytes a turn, so the longest has to fit in a task; no text is moved.
    """
    rows = stored(sequences.select("key", "conv_id", "bytes"), "sequences").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    swept = stored(rows.mapInArrow(_swept, SWEPT), "swept")
    edges = swept.filter("edge is not null").select("edge").repartition(1).sortWithinPartitions("edge.first", "edge.first_id")
    open_ = stored(edges.mapInArrow(_stitched, NODE), "open")
    pieces = swept.filter("piece is not null").select("piece.*").repartition("name").sortWithinPartitions("name", "first_id", "nth").select("name", "ids")
    open_ = open_.join(pieces.mapInArrow(_hashed, "name binary, sha string"), "name", "left").withColumn("ends_sha256", F.coalesce("sha", "ends_sha256")).drop("sha")
    nodes = stored(swept.filter("node is not null").select("node.*").unionByName(open_), "nodes")
    parents = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nothing = hashlib.sha256(b"").hexdigest()
    out = nodes.join(parents, "parent", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
