"""Near duplicates by SimHash: fingerprints, their links within a few bits, and connected documents."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.components import connected
from folioflow.llm.decontaminate import bounded
from folioflow.llm.shared import cut, text_or_empty

#: Reference fingerprints: complements and halves of bit patterns of growing period, then random ones.
PIVOTS = np.concatenate([
    np.array([sum(1 << k for k in range(64) if k >> level & 1) for level in range(6)], np.uint64),
    np.random.default_rng(7).integers(0, 1 << 64, 10, np.uint64, endpoint=False),
])
#: Shingles whose bits are summed at a time.
CHUNK = 1 << 16
#: Runs of a key longer than this are searched from pivots of their own; others by comparing neighbours.
LONG_RUN = 256


def fingerprint(text: str, width: int) -> int:
    """Of the XXH64 (seed 42) of all shingles of width words, repeats included, the bits set in over half; zero without words."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    stops = ends[min(width, len(words)) - 1 :].tolist()
    starts = [0, *(ends[: len(stops) - 1] + 1).tolist()]
    return set_fingerprint(np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts)))


def set_fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half of hashes; zero of none."""
    sums = np.zeros(64, np.int64)
    for k in range(0, len(hashes), CHUNK):
        sums += np.unpackbits(hashes[k : k + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, row, fp): the fingerprint of every whole text as a long; null and empty texts have zero. row, a hash of doc_id and text, tells rows apart that share a doc_id."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x, width) for x in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "row", "fp"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), text_or_empty("text").alias("text"))
    return rows.mapInArrow(of, "doc_id long, row long, fp long")


def block_masks(most_bits: int, n_blocks: int) -> list[int]:
    """Masks of which two fingerprints within most_bits agree on one at least: n_blocks blocks, of which n_blocks - most_bits stay equal."""
    edges = [64 * k // n_blocks for k in range(n_blocks + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(blocks, n_blocks - most_bits)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def finer(mask: int, most_bits: int) -> list[int]:
    """mask with each of most_bits + 1 parts of the bits that it leaves out: two fingerprints that agree on mask and are within most_bits agree on one of these."""
    left = [k for k in range(64) if not mask >> k & 1]
    n = most_bits + 1
    return [mask | sum(1 << k for k in left[len(left) * p // n : len(left) * (p + 1) // n]) for p in range(n)]


def dealt(distinct: DataFrame, most_bits: int, n_blocks: int, most_in_key: int) -> DataFrame:
    """(key, fp): fingerprints within most_bits share a key at least once. Keys with more than most_in_key are parted again, until none has.

    A key stands for a mask and the bits under it; a part's mask has more bits, so this ends: under a
    mask that leaves b bits out there are 2 ** b fingerprints at most.
    """
    masks = block_masks(most_bits, n_blocks)
    of = lambda m: F.struct(F.lit(_signed(m)).alias("mask"), F.xxhash64(F.lit(_signed(m)), F.col("fp").bitwiseAND(F.lit(_signed(m)))).alias("key"))
    keyed = distinct.select(F.explode(F.array(*map(of, masks))).alias("k"), "fp").select("k.mask", "k.key", "fp")
    done = []
    while True:
        hot = cut(keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).filter(F.col("n") > most_in_key).select("mask", "key", F.lit(True).alias("hot")))
        found = [r["mask"] % (1 << 64) for r in hot.select("mask").distinct().collect()]  # few, as masks are
        if not found:
            return reduce(DataFrame.unionByName, [*done, keyed.select("key", "fp")])
        joined = keyed.join(bounded(hot, 200_000), ["mask", "key"], "left")
        done.append(joined.filter("hot is null").select("key", "fp"))
        parts = F.create_map(*[x for m in found for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(p)) for p in finer(m, most_bits)]))])
        keyed = joined.filter("hot").select(F.explode(F.element_at(parts, F.col("mask"))).alias("mask"), "fp")
        keyed = cut(keyed.select("mask", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp").distinct())


class _Forest:
    """Union of rows by number; the smaller is the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def distances(fps: np.ndarray) -> np.ndarray:
    """The table of each fingerprint's distances to the pivots."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def close(fps: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, most_bits: int) -> np.ndarray:
    """Which of the pairs (i, j) are within most_bits. A pair is discarded if its distances to any pivot differ by more."""
    stay = np.arange(len(i))
    for k in range(0, table.shape[1], 4):
        apart = np.abs(table[i[stay], k : k + 4] - table[j[stay], k : k + 4]).max(axis=1)
        stay = stay[apart <= most_bits]
    return stay[np.bitwise_count(fps[i[stay]] ^ fps[j[stay]]) <= most_bits]


def _long_run(fps: np.ndarray, table: np.ndarray, first: int, stop: int, most_bits: int, forest: _Forest) -> None:
    """Links of one long run. A row's neighbours become one tree with it; then only rows within twice the bits can touch that tree."""
    rest = np.arange(first, stop)
    while len(rest) > 1:
        pivot = rest[0]
        far = np.bitwise_count(fps[rest] ^ fps[pivot])
        star, ring = rest[far <= most_bits], rest[(far > most_bits) & (far <= 2 * most_bits)]
        for x in star[1:].tolist():
            forest.join(int(pivot), x)
        border = star[np.bitwise_count(fps[star] ^ fps[pivot]) > 0]
        for k in range(0, len(border), 64):
            if not len(ring):
                break
            some = border[k : k + 64]
            i, j = np.repeat(some, len(ring)), np.tile(np.arange(len(ring)), len(some))
            met = np.unique(j[close(fps, table, i, ring[j], most_bits)])
            for x in ring[met].tolist():
                forest.join(int(pivot), x)
            ring = np.delete(ring, met)
        rest = rest[far > most_bits]


def run_links(keys: np.ndarray, fps: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of fingerprints that make the same components as all links within runs of equal keys; one a row at most."""
    table = distances(fps)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(starts, append=len(keys))
    forest = _Forest()
    for first, n in zip(starts[sizes > LONG_RUN].tolist(), sizes[sizes > LONG_RUN].tolist(), strict=True):
        _long_run(fps, table, first, first + n, most_bits, forest)
    left = np.repeat(np.where(sizes > LONG_RUN, 0, sizes), sizes) - (np.arange(len(keys)) - np.repeat(starts, sizes)) - 1
    rows, shift = np.flatnonzero(left > 0), 1
    while len(rows):
        for x in rows[close(fps, table, rows, rows + shift, most_bits)].tolist():
            forest.join(x, x + shift)
        shift += 1
        rows = rows[left[rows] >= shift]
    of = [(x, forest.root(x)) for x in list(forest.up)]
    of = [(x, r) for x, r in of if x != r and fps[x] != fps[r]]
    return fps[[x for x, _ in of]] if of else fps[:0], fps[[r for _, r in of]] if of else fps[:0]


def links(distinct: DataFrame, most_bits: int = 4, n_blocks: int | None = None, most_in_key: int = 20_000) -> DataFrame:
    """(a, b): fingerprints of distinct (fp), linked so that components are those of all pairs within most_bits.

    n_blocks is by default such that the keys' bits are as many as the logarithm of the number of
    fingerprints, or so, whatever it is: more blocks mean more keys a fingerprint and fewer in each.
    """
    if n_blocks is None:
        n = distinct.count()
        n_blocks = most_bits + 2
        while n_blocks < most_bits + 4 and n > 8 * 2 ** (64 * (n_blocks - most_bits) // n_blocks):
            n_blocks += 1
    rows = dealt(distinct, most_bits, n_blocks, most_in_key).repartition("key").sortWithinPartitions("key")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def found(stop: int) -> pa.RecordBatch:
            a, b = run_links(keys[:stop], fps[:stop], most_bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            if len(keys) > 200_000 and (stop := int(np.searchsorted(keys, keys[-1]))):
                yield found(stop)
                keys, fps = keys[stop:], fps[stop:]
        if len(keys):
            yield found(len(keys))

    return rows.mapInArrow(search, "a long, b long").distinct()


def groups(documents: DataFrame, width: int, most_bits: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, row, fp), and of each fingerprint its component (fp, root, least): the component's smallest fingerprint, and the fingerprint's own smallest doc_id."""
    rows = cut(fingerprints(documents, width))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected(links(nodes.select("fp"), most_bits))
    named = nodes.join(bounded(roots, 200_000), nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return rows, cut(named)


def near_duplicates(documents: DataFrame, width: int = 4, most_bits: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) of every row of documents (doc_id, text); component_id: the smallest doc_id reachable over links.

    Equal fingerprints are one node, so copies are never compared. Texts without words have fingerprint
    zero and are linked like any other. A null doc_id is never a component_id unless a component has no
    other. Rows may repeat; other columns are ignored.
    """
    rows, named = groups(documents, width, most_bits)
    several = named.filter("fp <> root").select("root").distinct()
    parts = cut(named.join(several, "root", "left_semi").groupBy("root").agg(F.min("least").alias("component")))
    named = named.join(bounded(parts, 200_000), "root", "left").select(F.col("fp"), F.coalesce("component", "least").alias("component_id"))
    return rows.join(cut(named), "fp").select("doc_id", "fp", "component_id")


def keep_one(documents: DataFrame, width: int, most_bits: int) -> DataFrame:
    """One row of each component of documents: that with the smallest doc_id, rows without one last; of those that share it, the one whose hash is smallest."""
    rows, named = groups(documents, width, most_bits)
    return first_of_each(documents, rows, named)


def first_of_each(documents: DataFrame, rows: DataFrame, named: DataFrame) -> DataFrame:
    """keep_one's row of each component, from rows (doc_id, row, fp) and named (fp, root)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first")
    kept = rows.join(named.select("fp", "root"), "fp").groupBy("root").agg(first).select("first.last", F.coalesce("first.doc_id", F.lit(0).cast("long")).alias("id"), "first.row")
    id_ = F.col("doc_id").cast("long")
    whole = documents.select(F.struct("*").alias("doc"), id_.isNull().alias("last"), F.coalesce(id_, F.lit(0).cast("long")).alias("id"), F.xxhash64("doc_id", "text").alias("row"))
    # equal rows are where the join has put them, so texts are shuffled once
    return whole.join(kept, ["last", "id", "row"], "left_semi").dropDuplicates(["last", "id", "row"]).select("doc.*")
