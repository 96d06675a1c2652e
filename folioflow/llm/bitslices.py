"""Exact top-k search by integer inner product, over a bit-sliced index of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.shared import stored

#: Components are held between these after scaling, so that a sum over 2^14 of their products is a long.
LARGEST = 1 << 24
#: Rows of a block of the index, a bit each in every slice.
BLOCK = 4096
#: Queries and blocks that meet in one group, on average: what a task holds at a time.
QUERIES, BLOCKS = 1024, 8
#: Queries that are added up together.
TOGETHER = 16

ROW = "vec_id long, row long, comps array<int>"


def quantised(embeddings: DataFrame, scale: int, *more: str | Column) -> DataFrame:
    """(vec_id, row, comps, more): each component as floor(scale * x), x as double; row, a hash of all of it, tells apart rows that share a vec_id.

    Rows without a vec_id or vector, and with a null or non-finite component, take no part. Scaled
    components beyond LARGEST stand at it. Rows that are equal in all of this count once.
    """
    x = lambda c: c.cast("double")
    whole = F.forall("embedding", lambda c: F.coalesce(F.abs(x(c)) < float("inf"), F.lit(False)) & ~F.isnan(x(c)))
    comps = F.transform("embedding", lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x(c) * scale))).cast("int"))
    rows = embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(whole)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), comps.alias("comps"), *more).distinct()
    others = [c for c in rows.columns if c not in ("vec_id", "comps")]
    return rows.select("vec_id", F.xxhash64(*rows.columns).alias("row"), "comps", *others)


def matrix(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """Lists of numbers as rows of a matrix; shorter ones end in zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width if width is not None else int(sizes.max(initial=0))), np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def packed_rows(bits: np.ndarray) -> np.ndarray:
    """(rows, n) of truth values -> (n, words): a bitmap over the rows for each column."""
    rows, n = bits.shape
    out = np.zeros((n, -(-rows // 64) * 8), np.uint8)
    out[:, : -(-rows // 8)] = np.packbits(bits, axis=0, bitorder="little").T
    return out.view("<u8")


def slices_of(comps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(widths, slices): of each attribute as many bitmaps as its values need in two's complement, lowest bit first and sign last."""
    reach = np.maximum(comps.max(axis=0, initial=0), -comps.min(axis=0, initial=0) - 1)
    widths = np.array([int(m).bit_length() + 1 for m in reach], np.int64)
    planes = [packed_rows((comps >> b) & 1) for b in range(int(widths.max(initial=0)))]
    flat = [planes[b][j] for j, w in enumerate(widths.tolist()) for b in range(w)]
    return widths, np.array(flat, np.uint64).reshape(len(flat), -(-len(comps) // 64))


def index(rows: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """(block, n, ids, hashes, widths, slices) of rows (vec_id, row, comps): block by block, rows in the order of vec_id, the bitmaps of each attribute's bits.

    Rows are dealt by hash, so no id or vector is a task's own, and a task holds one block.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks_of(batches, block_rows):
            comps = matrix(part.column(2).combine_chunks())
            widths, slices = slices_of(comps)
            ids, hashes = (part.column(k).to_numpy() for k in (0, 1))
            columns = [[int(hashes[0])], [len(ids)], *[[x.tobytes()] for x in (ids.astype("<i8"), hashes.astype("<i8"), widths.astype("<i8"), slices)]]
            types = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["block", "n", "ids", "hashes", "widths", "slices"])

    dealt = rows.select("vec_id", "row", "comps").repartition("row").sortWithinPartitions("vec_id", "row")
    return dealt.mapInArrow(of, "block long, n int, ids binary, hashes binary, widths binary, slices binary")


def blocks_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows of batches in tables of most rows, and one of what is left."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while n + batch.num_rows >= most:
            yield pa.Table.from_batches([*held, batch.slice(0, most - n)])
            batch, held, n = batch.slice(most - n), [], 0
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


class Adder:
    """What some queries add up: which slices, or complements of slices, stand in which binary place of their sums.

    An attribute of w bits is taken as x + 2^(w-1), which is not negative, and where the query's component
    is negative as the complement of that; constants make up for both. A component's every set bit
    then adds all slices of its attribute, shifted.
    """

    def __init__(self, queries: np.ndarray, widths: np.ndarray) -> None:
        self.widths, self.n = widths, len(queries)
        starts = np.cumsum(widths) - widths
        total = int(widths.sum())
        none = 2 * total
        size, negative = np.abs(queries), queries < 0
        full = (1 << widths) - 1
        self.constants = -(queries * (1 << (widths - 1))).sum(axis=1) - np.where(negative, size * full, 0).sum(axis=1)
        columns: dict[int, list[np.ndarray]] = {}
        for bit in range(int(size.max(initial=0)).bit_length()):
            wanted = (size >> bit & 1).astype(bool)
            for s in range(int(widths.max(initial=0))):
                at = np.where(wanted & (widths > s), starts + s + np.where(negative, total, 0), none)
                columns.setdefault(bit + s, []).append(at)
        self.columns = []
        for place in range(max(columns, default=-1) + 1):
            at = np.sort(np.concatenate(columns[place], axis=1), axis=1)
            self.columns.append(at[:, : int((at < none).sum(axis=1).max(initial=0))])

    def sums(self, table: np.ndarray) -> list[np.ndarray]:
        """The slices (queries, words) of all sums, lowest first, by full adders on bitmaps; table: slices, their complements, and an empty one."""
        out, carries = [], []
        k = 0
        while k < len(self.columns) or carries:
            parts = [table[self.columns[k]]] if k < len(self.columns) else []
            left, carries = np.concatenate([*parts, *carries], axis=1), []
            while (m := left.shape[1]) > 2:
                third = m // 3
                a, b, c = left[:, :third], left[:, third : 2 * third], left[:, 2 * third : 3 * third]
                both = a ^ b
                carries.append((a & b) | (both & c))
                both ^= c
                left = both if m == 3 * third else np.concatenate([both, left[:, 3 * third :]], axis=1)
            if m == 2:
                carries.append(left[:, :1] & left[:, 1:])
                left = left[:, :1] ^ left[:, 1:]
            out.append(left[:, 0] if m else np.zeros((self.n, table.shape[1]), np.uint64))
            k += 1
        return out


def select(sums: list[np.ndarray], rows: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the k largest sums of each query among rows (queries, words), from the highest slice down; of rows equal to the last one the first stay."""
    tied, sure, count = rows.copy(), np.zeros_like(rows), np.zeros(len(rows), np.int64)
    for bits in reversed(sums):
        high = tied & bits
        more = count + np.bitwise_count(high).sum(axis=1, dtype=np.int64)
        over = (more > k)[:, None]
        sure = np.where(over, sure, sure | high)
        tied = np.where(over, high, tied & ~bits)
        count = np.where(over[:, 0], count, more)
    flags = lambda words: np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)
    last = flags(tied)
    last &= np.cumsum(last, axis=1) <= (k - count)[:, None]
    return np.nonzero(flags(sure) | last)


def _widened(widths: np.ndarray, slices: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    """An Adder's table for attributes of to bits: slices with the sign repeated and then complemented at the top, their complements, and an empty slice."""
    starts = np.cumsum(widths) - widths
    at = np.concatenate([starts[j] + np.minimum(np.arange(t), widths[j] - 1) for j, t in enumerate(to.tolist())]) if len(to) else np.zeros(0, np.int64)
    there = packed_rows(np.ones((n, 1), np.uint8))[0]
    plain = slices[at].reshape(len(at), len(there))
    plain[np.cumsum(to) - 1] ^= there
    return np.concatenate([plain, plain ^ there, np.zeros((1, len(there)), np.uint64)])


def best_of_blocks(queries: pa.Table, blocks: pa.Table, k: int) -> pa.Table:
    """(query_id, query_row, vec_id, row, score) of the k best rows of blocks for each of queries (vec_id, row, comps), but the query's own."""
    asked, names = matrix(queries["comps"].combine_chunks()), ["query_id", "query_row", "vec_id", "row", "score"]
    query_ids, query_rows = (queries[c].to_numpy() for c in ("vec_id", "row"))
    read = [{c: np.frombuffer(b[c].as_py(), "<u8" if c == "slices" else "<i8") for c in ("ids", "hashes", "widths", "slices")} for b in _rows(blocks)]
    found: list[list[np.ndarray]] = []
    d = max([asked.shape[1], *(len(b["widths"]) for b in read)])
    asked = np.pad(asked, ((0, 0), (0, d - asked.shape[1])))
    widths = np.ones(d, np.int64)
    for b in read:
        b["own"] = np.pad(b["widths"], (0, d - len(b["widths"])), constant_values=1)
        widths = np.maximum(widths, b["own"])
    tables = []
    for b in read:
        n = len(b["ids"])
        slices = b["slices"].reshape(-1, -(-n // 64))
        slices = np.concatenate([slices, np.zeros((d - len(b["widths"]), slices.shape[1]), np.uint64)])
        tables.append(_widened(b["own"], slices, widths, n))
    for first in range(0, len(asked), TOGETHER):
        adder = Adder(asked[first : first + TOGETHER], widths)
        ids, rows = query_ids[first : first + TOGETHER], query_rows[first : first + TOGETHER]
        for b, table in zip(read, tables, strict=True):
            n = len(b["ids"])
            sums = adder.sums(table)
            open_ = np.tile(packed_rows(np.ones((n, 1), np.uint8)), (adder.n, 1))
            own, at = np.nonzero((b["ids"][None, :] == ids[:, None]) & (b["hashes"][None, :] == rows[:, None]))
            open_[own, at >> 6] &= ~(np.uint64(1) << (at & 63).astype(np.uint64))
            of, row = select(sums, open_, k, n)
            word, off = row >> 6, (row & 63).astype(np.uint64)
            score = adder.constants[of]
            for place, bits in enumerate(sums):
                score += ((bits[of, word] >> off & np.uint64(1)) << np.uint64(place)).astype(np.int64)
            found.append([ids[of], rows[of], b["ids"][row], b["hashes"][row], score])
    columns = [np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(5)]
    order = np.lexsort([columns[3], columns[2], -columns[4], columns[1], columns[0]])
    columns = [c[order] for c in columns]
    new = np.concatenate([[True], (np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0)])[: len(order)]
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return pa.table([pa.array(c[place < k]) for c in columns], names)


def _rows(table: pa.Table) -> Iterator[dict[str, pa.Scalar]]:
    for k in range(table.num_rows):
        yield {c: table.column(c)[k] for c in table.column_names}


def met(queries: DataFrame, blocks: DataFrame, n_queries: int, n_blocks: int, search, schema: str, queries_together: int = QUERIES, blocks_together: int = BLOCKS) -> DataFrame:
    """What search(queries, blocks) gives for groups of both, dealt by hash so that all queries (row) meet all blocks (block), each once.

    A group holds about so many of either, whatever the size of the tables.
    """
    chunks, spans = max(1, -(-n_queries // queries_together)), max(1, -(-n_blocks // blocks_together))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("*", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int").alias("chunk"), numbers(spans).alias("span"))
    held = blocks.select("*", F.pmod(F.xxhash64("block"), F.lit(spans)).cast("int").alias("span"), numbers(chunks).alias("chunk"))
    return asked.groupBy("chunk", "span").cogroup(held.groupBy("chunk", "span")).applyInArrow(search, schema)


def ranked(found: DataFrame, of: list[str], k: int, score: str, id_: str, row: str) -> DataFrame:
    """found with rank, the first k rows of each of the keys: higher score first, then smaller id."""
    order = Window.partitionBy(*of).orderBy(F.col(score).desc(), id_, row)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(embeddings: DataFrame, is_query: Column, k: int = 20, scale: int = 64, block_rows: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): of every row of embeddings (vec_id, embedding) for which is_query holds, the k other rows with the highest integer inner products; ties to the smaller vec_id.

    Components are floor(scale * x). Of each attribute the index has a bitmap for each bit over a block's
    rows. A query's sums come as bitmaps too: slices are added where its components have set bits, by
    full adders, and the best rows chosen from the highest slice of the sums down; of rows that tie at
    the last place the smallest vec_ids stay. Blocks and queries meet in groups of bounded size, and
    each group gives k rows a query at most. Nothing is approximate.

    Which rows take part says quantised. Vectors of different lengths are filled up with zeros. Rows that
    share a vec_id but not the vector are queries and candidates of their own. Other columns are
    ignored; an empty table gives no rows.
    """
    rows = stored(quantised(embeddings, scale), "vectors")
    blocks = stored(index(rows, block_rows), "slices")
    queries = rows.filter(is_query)
    schema = "query_id long, query_row long, vec_id long, row long, score long"
    found = met(queries, blocks, queries.count(), blocks.count(), lambda q, b: best_of_blocks(q, b, k), schema)
    return ranked(found, ["query_id", "query_row"], k, "score", "vec_id", "row").select("query_id", "rank", "vec_id", "score")
