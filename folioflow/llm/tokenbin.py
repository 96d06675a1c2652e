"""Token ids in binary files: each id in as many bits as the vocabulary needs, blocks with offsets."""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.shared import SEPARATOR, cut, read_bytes, scratch, text_or_empty, write_bytes

MAGIC = b"TIDB"
#: magic, bits of an id, documents, ids
HEAD = struct.Struct("<4sIQQ")
#: Longest pieces that are kept once encoded.
KEPT_CHARS = 64


def bits_for(n_vocabulary: int) -> int:
    return max(1, (n_vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> np.ndarray:
    """ids as a row of width-bit fields, the first in the lowest bits, in unsigned 64-bit words; one word more than needed."""
    out = np.zeros(len(ids) * width // 64 + 2, np.uint64)
    if not len(ids):
        return out
    bit = np.arange(len(ids), dtype=np.int64) * width
    word, off = bit >> 6, (bit & 63).astype(np.uint64)
    ids = ids.astype(np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] = np.bitwise_or.reduceat(ids << off, first)
    over = np.flatnonzero(off > 64 - width)
    out[word[over] + 1] |= ids[over] >> (np.uint64(64) - off[over])
    return out


def unpack(words: np.ndarray, width: int, start: int, stop: int) -> np.ndarray:
    """The ids from start to stop (without it), any part of a block."""
    bit = np.arange(start, stop, dtype=np.int64) * width
    word, off = bit >> 6, (bit & 63).astype(np.uint64)
    high = np.where(off > 0, words[word + 1] << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
    return ((words[word] >> off | high) & np.uint64((1 << width) - 1)).astype(np.uint32)


def block(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, width: int) -> bytes:
    """Head, doc_ids, counts, a bit for each document that has no doc_id, and the packed ids."""
    none = np.packbits([x is None for x in doc_ids]).tobytes()
    numbers = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array(counts, "<i8").tobytes()
    return HEAD.pack(MAGIC, width, len(doc_ids), len(ids)) + numbers + none + pack(ids, width).astype("<u8").tobytes()


def footer(blocks: list[tuple[int, int]]) -> bytes:
    """Of each block its place in the file and the number of ids before it; then the number of blocks and the magic."""
    return np.array(blocks, "<i8").tobytes() + struct.pack("<Q4s", len(blocks), MAGIC)


class TokenFile:
    """A file's bytes: documents block by block, or any range of its ids."""

    def __init__(self, data: memoryview) -> None:
        self.data = data
        n, magic = struct.unpack_from("<Q4s", data, len(data) - 13)
        if magic != MAGIC or data[len(data) - 1] != SEPARATOR[0]:
            raise ValueError("not a file of token ids")
        self.index = np.frombuffer(data, "<i8", 2 * n, len(data) - 13 - 16 * n).reshape(n, 2)

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, int]:
        """doc_ids, which of them are none, counts, packed words, bits of an id and number of ids."""
        at = int(self.index[k, 0])
        magic, width, docs, ids = HEAD.unpack_from(self.data, at)
        if magic != MAGIC:
            raise ValueError("a block doesn't start with its mark")
        at += HEAD.size
        doc_ids, counts = (np.frombuffer(self.data, "<i8", docs, at + 8 * docs * i) for i in (0, 1))
        at += 16 * docs
        none = np.unpackbits(np.frombuffer(self.data, np.uint8, -(-docs // 8), at), count=docs).astype(bool)
        return doc_ids, none, counts, np.frombuffer(self.data, "<u8", ids * width // 64 + 2, at - (-docs // 8)), width, ids

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop (without it) of the file, from those blocks alone that hold them."""
        parts = [np.zeros(0, np.uint32)]
        for k in range(max(0, int(np.searchsorted(self.index[:, 1], start, "right")) - 1), len(self.index)):
            if (first := int(self.index[k, 1])) >= stop:
                break
            *_, words, width, n = self.block(k)
            if (low := max(0, start - first)) < (high := min(n, stop - first)):
                parts.append(unpack(words, width, low, high))
        return np.concatenate(parts)


class Encoder(dict):
    """White-space piece -> bytes of its ids as little-endian 32-bit numbers, each piece encoded once and kept.

    A piece of letters alone is one word to the tokenizer's model and goes to that model directly,
    lower-cased letter by letter and spelled in byte characters; a full stop or comma behind it is a
    word of its own. Anything else goes through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [k for k in range(256) if k not in plain]
        self.spelling = {k: chr(k) for k in plain} | {k: chr(256 + n) for n, k in enumerate(rest)}
        self.marks = {mark: self.whole(mark) for mark in ".,"}

    def whole(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, piece: str) -> bytes | None:
        if not piece.isalpha():
            return None
        lower = piece.lower() if piece.isascii() else "".join([c.lower() for c in unicodedata.normalize("NFC", piece)])
        if not lower.isalpha():
            return None
        spelled = lower if lower.isascii() else lower.encode().decode("latin-1").translate(self.spelling)
        return struct.pack(f"<{len(found := self.model.tokenize(spelled))}I", *[t.id for t in found])

    def __missing__(self, piece: str) -> bytes:
        ids = self.word(piece)
        if ids is None and piece[-1:] in self.marks:
            before = piece[:-1]
            known = self.get(before) if before.isascii() and before.isalpha() else None
            if (ids := known or self.word(before)) is not None:
                ids += self.marks[piece[-1]]
        if ids is None:
            ids = self.whole(piece)
        if len(piece) <= KEPT_CHARS:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One a worker, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_token_ids(documents: DataFrame, path: str, tokenizer: str, n_vocabulary: int, end_id: int, ids_per_block: int = 1 << 18, blocks_per_file: int = 128, words_kept: int = 600_000) -> None:
    """Encode every text of documents (doc_id, text), end_id behind each, and write files in ascending doc_id order.

    The tokenizer has to drop white space, part tokens at it and lower-case, as word_bpe_49k does. Null and
    empty texts are the end id alone. Rows without a doc_id come first; rows with equal doc_id stand
    by their text's hash. Other columns are ignored; an empty table gives no documents.

    Texts are dealt by ranges of doc_id, each range one file or several: blocks_per_file blocks of
    ids_per_block ids, 64 MB, with their own index each (a text of more ids is one block). Only one
    block and the kept words (at most words_kept, of KEPT_CHARS characters or fewer) are in a task's
    memory.
    """
    width = bits_for(max(n_vocabulary, end_id + 1))
    rows = documents.select("doc_id", text_or_empty("text").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        at = before = waiting = 0
        index: list[tuple[int, int]] = []
        doc_ids, counts, parts = [], [], []

        def close() -> pa.RecordBatch:
            nonlocal at, before, waiting
            out = block(doc_ids, counts, np.frombuffer(b"".join(parts), "<u4"), width)
            index.append((at, before))
            at, before, waiting = at + len(out) + 1, before + waiting, 0
            doc_ids.clear(), counts.clear(), parts.clear()
            return pa.RecordBatch.from_pydict({"block": pa.array([out], pa.binary())})

        def end_file() -> pa.RecordBatch:
            """The index of blocks, behind which the writer starts a new file."""
            nonlocal at, before
            out = footer(index)
            index.clear()
            at = before = 0
            return pa.RecordBatch.from_pydict({"block": pa.array([out], pa.binary())})

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if len(encoder) > words_kept:
                    encoder.clear()
                ids = encoder.encode(text.as_py())
                doc_ids.append(doc_id)
                counts.append(len(ids) // 4 + 1)
                parts += [ids, end]
                waiting += counts[-1]
                if waiting >= ids_per_block:
                    yield close()
                if len(index) == blocks_per_file:
                    yield end_file()
        if doc_ids:
            yield close()
        if index:
            yield end_file()

    write_bytes(rows.mapInArrow(encode, "block binary"), "block", path, blocks_per_file + 1)


def read_token_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(file, nth, doc_id, in_file, n_tokens, ids_crc32, ids) of each document; in_file: ids before it in its file, nth: its place there."""
    schema = "file struct<part: long, piece: long>, nth long, doc_id long, in_file long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    names = ["file", "nth", "doc_id", "in_file", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                tokens, nth = TokenFile(memoryview(content.as_buffer())), 0
                for k in range(len(tokens.index)):
                    doc_ids, none, counts, words, width, n = tokens.block(k)
                    ids = unpack(words, width, 0, n)
                    ends = np.cumsum(counts)
                    data = ids.astype("<u4").tobytes()
                    crc = [zlib.crc32(data[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                    offsets = np.concatenate([[0], ends]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([file.as_py()] * len(counts), batch.column(0).type), pa.array(np.arange(nth, nth + len(counts))),
                            pa.array(doc_ids, mask=none), pa.array(ends - counts + tokens.index[k, 1]), pa.array(counts),
                            pa.array(crc, pa.int64()), *[pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.view(np.int32)))] * with_ids,
                        ],
                        names,
                    )
                    nth += len(counts)

    return read_bytes(spark, path).mapInArrow(decode, schema)


def positions(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: start counts the ids of all files before and of the file up to the document.

    The running sum over files has one row a file; all else stays dealt out.
    """
    read = cut(read.select("file", "doc_id", "in_file", "n_tokens", "ids_crc32"))
    files = read.groupBy("file").agg(F.sum("n_tokens").alias("ids"))
    before = F.sum("ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("file", F.coalesce(before, F.lit(0)).alias("before"))
    joined = read.join(F.broadcast(files), "file")
    return joined.select("doc_id", (F.col("before") + F.col("in_file")).alias("start"), "n_tokens", "ids_crc32")


def token_ids(documents: DataFrame, tokenizer: str, n_vocabulary: int, end_id: int) -> DataFrame:
    """Write documents' ids as files in the shared folder, read them back, and place each document."""
    path = scratch(documents.sparkSession, "token-ids")
    write_token_ids(documents, path, tokenizer, n_vocabulary, end_id)
    return positions(read_token_ids(documents.sparkSession, path, with_ids=False))
