"""SentencePiece encoding and decoding: distinct marked words in trie order, forward states shared by common prefixes."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.shared import in_workers, kept, text_or_empty

MARK = "▁"
_WORDS = re.compile(f"{MARK}+[^{MARK}]*")
#: Entries of the tables of words and of pairs that a worker keeps.
WORDS_KEPT, PAIRS_KEPT = 600_000, 600_000
#: Characters of documents worked on and given back at a time, so that a worker's memory doesn't follow the Arrow batch.
SLICE = 2_000_000


class Pieces:
    """The pieces of a SentencePiece BPE model with byte fallback, and the segmentation they give.

    Merges never join across a valid boundary, and a row of pieces is the model's segmentation if each
    two neighbours are that of their own string. So every prefix of a word has one last piece, found
    from shorter prefixes: a forward pass as in Viterbi's method, in which the score is whether the
    pair is valid. (The best sum of scores, as for a unigram model, isn't what BPE merges give.)
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(k) for k in range(n)]
        self.bytes = {int(x[3:5], 16): k for k, x in enumerate(names) if model.is_byte(k)}
        if len(self.bytes) < 256:
            raise ValueError("only models with byte fallback")
        self.ids = {x: k for k, x in enumerate(names) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))}
        if any(MARK in x.lstrip(MARK) for x in self.ids):
            raise ValueError("pieces that go over the start of a word")
        self.rank = {x: -model.get_score(k) for x, k in self.ids.items()}
        #: Each end of a piece, with the piece's number if it is one itself, else -1: no piece is longer than a string that isn't there.
        self.ends = dict.fromkeys((x[k:] for x in self.ids for k in range(1, len(x))), -1) | self.ids
        spelled = {k: bytes([b]) for b, k in self.bytes.items()}
        self.spelling = [spelled.get(k, b"" if x not in self.ids else x.replace(MARK, " ").encode()) for k, x in enumerate(names)]
        self.names, self.size = names, n
        self.valid: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Segmentation by merging, best pair first and leftmost of equals: for short strings, those of pieces and pairs."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank[x], k) for k in range(len(parts) - 1) if (x := parts[k] + parts[k + 1]) in self.rank), default=None)
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def fits(self, before: int, piece: int) -> bool:
        """Whether piece may stand behind before (size: at a word's start)."""
        key = before * (self.size + 1) + piece
        if (found := self.valid.get(key)) is None:
            if len(self.valid) >= PAIRS_KEPT:
                self.valid.clear()
            pair = [self.names[piece]] if before == self.size else [self.names[before], self.names[piece]]
            found = self.valid[key] = self.merged("".join(pair)) == pair
        return found

    def learn(self, words: list[str]) -> None:
        """Segment words, sorted, and keep their ids: as in a trie's depth-first walk each starts from the states of the prefix it shares with the one before."""
        ends, valid, fits, span = self.ends.get, self.valid.get, self.fits, self.size + 1
        starts, last, previous = [0], [self.size], ""
        for word in sorted(words):
            shared = 0
            for a, b in zip(word, previous, strict=False):
                if a != b:
                    break
                shared += 1
            del starts[shared + 1 :], last[shared + 1 :]
            for stop in range(shared + 1, len(word) + 1):
                at, piece = stop - 1, -1
                for start in range(stop - 1, -1, -1):  # at most one of these is valid
                    if (k := ends(word[start:stop])) is None:
                        break
                    if k >= 0:
                        before = last[start]
                        if (known := before < 0 or valid(before * span + k)) is None:
                            known = fits(before, k)
                        if known:
                            at, piece = start, k
                            break
                starts.append(at)
                last.append(piece)
            found, stop = [], len(word)
            while stop:
                if last[stop] < 0:
                    found += [self.bytes[b] for b in reversed(word[starts[stop] : stop].encode("utf-8", "surrogatepass"))]
                else:
                    found.append(last[stop])
                stop = starts[stop]
            found.reverse()
            self.words[word] = pack(f"<{len(found)}i", *found)
            previous = word

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Of each text its ids as little-endian 32-bit numbers; an empty one has none."""
        split = [_WORDS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        words = set().union(*split)
        new = words.difference(self.words)
        if len(self.words) + len(new) > WORDS_KEPT:
            self.words = {x: self.words[x] for x in words.difference(new)}  # those met here hold the frequent ones
        self.learn(list(new))
        for row in split:
            yield b"".join(map(self.words.__getitem__, row))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the blank that marks its start."""
        data = b"".join(map(self.spelling.__getitem__, ids.tolist()))
        return data.removeprefix(b" ").decode("utf-8", "replace")


def pieces(path: str) -> Pieces:
    """One a worker, kept from task to task while these encode."""
    return kept(path, lambda: Pieces(path))


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Places (start, stop) of runs of texts of up to SLICE characters, or of one longer text."""
    start = size = 0
    for k, text in enumerate(texts):
        if k > start and size + len(text) > SLICE:
            yield start, k
            start, size = k, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def encode_documents(documents: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded_sha256, lossless, ids) of every whole text of documents (doc_id, text).

    ids_crc32 is that of the ids as little-endian 32-bit numbers, decoded_sha256 and lossless are of
    the text decoded from them. Null and empty texts have no pieces and decode to the empty text.
    Texts that hold the mark character itself decode to blanks there, and aren't lossless. Rows may
    repeat; other columns are ignored. model is a path that all executors can read.
    """
    names = ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "lossless", "ids"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_ = pieces(model)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            for start, stop in slices(texts):
                some = texts[start:stop]
                data = list(model_.encode(some))
                decoded = [model_.decode(np.frombuffer(x, "<i4")) for x in data]
                sizes = np.array([len(x) // 4 for x in data], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids.slice(start, len(some)), pa.array(sizes), pa.array([zlib.crc32(x) for x in data], pa.int64()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()), pa.array([x == y for x, y in zip(decoded, some, strict=True)], pa.bool_()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(data), "<i4"))),
                    ],
                    names,
                )

    rows = documents.select(F.col("doc_id").cast("long"), text_or_empty("text").alias("text"))
    return in_workers(rows, of, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean, ids array<int>", model)
