"""Substring dedup: word windows that also start earlier in the corpus, found by suffix automata over shards of reference passages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.decontaminate import bounded
from folioflow.llm.shared import cut, in_workers, scratch, space, stored, text_or_empty

#: Words of an anchor: of the anchors in a window, that with the least hash stands for it.
ANCHOR = 6
_ODD = 0x9E3779B97F4A7C15
#: Runs of words are hashed twice, as sums of powers of a base modulo a prime: a home-made sum modulo 2 ** 64 has collisions whatever the base.
_PRIME = (1 << 61) - 1
_BASES = tuple(int(x) % _PRIME for x in np.random.default_rng(3).integers(1 << 40, _PRIME, 2, np.uint64))
_LOW61, _LOW31, _LOW30 = np.uint64(_PRIME), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_30, _31, _61 = np.uint64(30), np.uint64(31), np.uint64(61)
_powers: dict[int, np.ndarray] = {}
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: Bytes of a word that are a number below the prime, and what is left of eight bytes if so many count.
CHUNK = 7
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(CHUNK + 1)], np.uint64)
#: Bytes of text that are hashed together.
TOGETHER = 1 << 20


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime."""
    x = (x >> _61) + (x & _LOW61)
    return np.where(x >= _LOW61, x - _LOW61, x)


def _times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x * y modulo the prime, both below it, by halves that fit 64 bits."""
    high_x, low_x, high_y, low_y = x >> _31, x & _LOW31, y >> _31, y & _LOW31
    middle = low_x * high_y + high_x * low_y
    return _reduced(((high_x * high_y) << np.uint64(1)) + (middle >> _30) + ((middle & _LOW30) << _31) + low_x * low_y)


def _power(n: int, base: int) -> np.ndarray:
    """The first n powers of a base modulo the prime."""
    known = _powers.get(base, np.ones(1, np.uint64))
    while len(known) < n:
        known = np.concatenate([known, _times(known, np.full(len(known), pow(base, len(known), _PRIME), np.uint64))])
    _powers[base] = known
    return known[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the words of a text's bytes."""
    blank = np.concatenate([[True], _BLANK[data], [True]])
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    return edges[::2], edges[1::2]


class Words:
    """Two independent hashes of any run of a text's words, by differences of running sums.

    A word of up to CHUNK bytes is a number by itself, with its length; of longer ones, chunks are summed by
    powers of the base, and then the length.
    """

    def __init__(self, text: bytes) -> None:
        self.starts, stops = _words(np.frombuffer(text, np.uint8))
        self.n = len(self.starts)
        eight = np.ndarray(len(text) + 1, "<u8", text + bytes(8), strides=(1,))
        sizes = stops - self.starts
        first = (eight[self.starts] & _FIRST[np.minimum(sizes, CHUNK)]) + (np.minimum(sizes, CHUNK + 1).astype(np.uint64) << np.uint64(8 * CHUNK))
        long_ = np.flatnonzero(sizes > CHUNK)
        self.sums = []
        for base in _BASES:
            each = first.copy()
            rest, at = long_, CHUNK
            while len(rest):
                more = eight[self.starts[rest] + at] & _FIRST[np.minimum(sizes[rest] - at, CHUNK)]
                each[rest] = _reduced(_times(each[rest], np.full(len(rest), base, np.uint64)) + more)
                at += CHUNK
                rest = rest[sizes[rest] > at]
            each[long_] = _reduced(_times(each[long_], np.full(len(long_), base, np.uint64)) + sizes[long_].astype(np.uint64))
            terms = _times(each, _power(self.n, base))
            low, high = np.cumsum(terms & _LOW31, dtype=np.uint64), np.cumsum(terms >> _31, dtype=np.uint64)
            high = _reduced(high)
            self.sums.append(np.concatenate([[np.uint64(0)], _reduced(_reduced(low) + (((high & _LOW30) << _31) | (high >> _30)))]))

    def runs(self, start: np.ndarray, stop: np.ndarray, which: int = 0) -> np.ndarray:
        back = _power(self.n + 1, pow(_BASES[which], -1, _PRIME))[start]
        return _mixed(_times(_reduced(self.sums[which][stop] + (_LOW61 - self.sums[which][start])), back) + (stop - start).astype(np.uint64))

    def pair(self, start: np.ndarray, stop: np.ndarray) -> pa.StructArray:
        """Both hashes of each run: what tells pieces apart."""
        return pa.StructArray.from_arrays([pa.array(self.runs(start, stop, k).view(np.int64)) for k in (0, 1)], ["a", "b"])

    def pieces(self, length: int, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor's hash, first window and number of windows of each run of windows that share an anchor; the first of equal anchors counts. No window has words of two texts, where of tells the text of each word."""
        n = self.n - length + 1
        if n < 1:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        anchors = np.arange(self.n - ANCHOR + 1)
        grams = self.runs(anchors, anchors + ANCHOR)
        least = np.lib.stride_tricks.sliding_window_view(grams, length - ANCHOR + 1).argmin(axis=1) + np.arange(n)
        windows = np.arange(n) if of is None else np.flatnonzero(of[:n] == of[length - 1 :])
        least = least[windows]
        new = np.diff(least, prepend=-1) != 0
        new[1:] |= np.diff(windows) > 1
        first = np.flatnonzero(new)
        return grams[least[first]], windows[first], np.diff(first, append=len(windows))


class Automaton:
    """Suffix automaton of several sequences, extended as they come."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, symbol: int, q: int) -> int:
        """The state of p's longest string and symbol, cut out of q."""
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = twin
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = twin
            p = self.link[p]
        return twin

    def add(self, sequence: list[int]) -> None:
        last = 0
        for symbol in sequence:
            if (q := self.next[last].get(symbol)) is not None:
                last = self._split(last, symbol, q)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, symbol, self.next[p][symbol])
            last = new

    def statistics(self, sequence: list[int]) -> list[int]:
        """At each place, the length of the longest run ending there that some sequence holds."""
        state, n, out = 0, 0, []
        for symbol in sequence:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if (to := self.next[state].get(symbol)) is not None:
                state, n = to, n + 1
            out.append(n)
        return out


def seen_in(automaton: Automaton, words: list[int], length: int) -> list[int]:
    """The windows of words (by first word) that the automaton holds; what of them is new is then added to it."""
    found = [k - length + 1 for k, n in enumerate(automaton.statistics(words)) if n >= length]
    start = 0
    for k in [*found, len(words) - length + 1]:
        if k > start:
            automaton.add(words[start : k + length - 1])
        start = k + 1
    return found


class _Ids(dict):
    """Numbers of words in the order they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


#: Both hashes of a run of words.
PIECE = pa.struct([("a", pa.int64()), ("b", pa.int64())])


def _occurrences(rows: DataFrame, length: int) -> DataFrame:
    """(anchor, piece, doc_id, row, at, n) of every document: runs of n windows from word at on; piece: two hashes of all of its words."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, first = [], 0, 0
            for k in range(batch.num_rows):
                held.append(batch.column(2)[k].as_py().encode())
                size += len(held[-1])
                if size >= TOGETHER or k + 1 == batch.num_rows:
                    yield pieces(batch.slice(first, len(held)), held)
                    held, size, first = [], 0, k + 1

    def pieces(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        """The pieces of some texts, which are hashed as one."""
        words, text = _together(texts)
        anchor, at, n = words.pieces(length, text)
        each = text[at] if len(at) else at
        whole = words.pair(at, at + n + length - 1)
        at = at - np.searchsorted(text, each)
        where = pa.array(each)
        columns = [pa.array(anchor.view(np.int64)), whole, batch.column(0).take(where), batch.column(1).take(where), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, ["anchor", "piece", "doc_id", "row", "at", "n"])

    return in_workers(rows, of, "anchor long, piece struct<a: long, b: long>, doc_id long, row long, at int, n int")


PASSAGE = "key long, piece struct<a: long, b: long>, doc_id long, row long, at int, text binary"


def _passages(rows: DataFrame, firsts: DataFrame, length: int) -> DataFrame:
    """The text of each of firsts (key, piece, doc_id, row, at, n), words parted by one blank, as rows of PASSAGE."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words, places = batch.column(2)[k].as_py().encode().split(), batch.column(3)[k].values
                at, n = (places.field(c).to_numpy().tolist() for c in ("at", "n"))
                texts = pa.array([b" ".join(words[x : x + y + length - 1]) for x, y in zip(at, n, strict=True)], pa.binary())
                whose = [pa.repeat(batch.column(c)[k], len(places)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([places.field("key"), places.field("piece"), *whose, places.field("at"), texts], ["key", "piece", "doc_id", "row", "at", "text"])

    wanted = firsts.groupBy(F.col("doc_id").alias("of_id"), F.col("row").alias("of_row")).agg(F.collect_list(F.struct("key", "piece", "at", "n")).alias("places"))
    # merged at every size, as lists of places have no bound
    joined = rows.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("row") == F.col("of_row")))
    return in_workers(joined.select("doc_id", "row", "text", "places"), of, PASSAGE)


def _together(texts: list[bytes]) -> tuple[Words, np.ndarray]:
    """Some texts hashed as one, and the text of each word."""
    words = Words(b" ".join(texts))
    return words, np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), words.starts, "right")


def _finer(passages: DataFrame, length: int) -> DataFrame:
    """passages parted once more, as (up_key, up_piece, off) and the columns of PASSAGE: each window by that of its six-word runs which the fewest passages of its key hold.

    Equal windows have equal runs and so the same part. off is the part's first window in the passage.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, text = _together(batch.column(5).to_pylist())
            at = np.arange(max(0, words.n - ANCHOR + 1))
            at = at[text[at] == text[at + ANCHOR - 1]]
            offsets = np.searchsorted(text[at], np.arange(batch.num_rows + 1)).astype(np.int32)
            grams = pa.ListArray.from_arrays(pa.array(offsets), pa.array(words.runs(at, at + ANCHOR).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, grams], [*batch.schema.names, "grams"])

    of = stored(in_workers(passages, runs, f"{PASSAGE}, grams array<long>"), "grams")
    # most runs are in one passage of their key alone, and need not be joined
    counts = of.select("key", F.explode(F.array_distinct("grams")).alias("gram")).groupBy("key", "gram").agg(F.count("*").alias("n")).filter("n > 1")
    each = of.select("key", "piece", F.posexplode("grams").alias("pos", "gram")).join(counts, ["key", "gram"])
    listed = each.groupBy("key", "piece").agg(F.collect_list("pos").alias("shared"), F.collect_list("n").alias("counts"))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            of = {n: batch.column(n) for n in batch.schema.names}
            texts = of["text"].to_pylist()
            words, text = _together(texts)
            bases = np.searchsorted(text, np.arange(len(texts)))
            firsts, stops, grams_of, whose, out = [], [], [], [], []
            for k, tokens in enumerate(x.split(b" ") for x in texts):
                grams = of["grams"][k].values.to_numpy().view(np.uint64)
                n, counts = len(tokens) - length + 1, np.ones(len(grams), np.int64)
                if of["shared"][k].is_valid:
                    counts[of["shared"][k].values.to_numpy()] = of["counts"][k].values.to_numpy()
                order = np.lexsort([np.arange(len(grams)), grams, counts])
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                least = np.lib.stride_tricks.sliding_window_view(rank, length - ANCHOR + 1).argmin(axis=1) + np.arange(n)
                first = np.flatnonzero(np.diff(least, prepend=-1))
                stop = np.append(first[1:], n)
                firsts.append(first)
                stops.append(stop)
                grams_of.append(grams[least[first]])
                whose.append(np.full(len(first), k))
                out += [b" ".join(tokens[a : b + length - 1]) for a, b in zip(first.tolist(), stop.tolist(), strict=True)]
            first, stop, grams, k = (np.concatenate(x) for x in (firsts, stops, grams_of, whose))
            up = {n: of[n].take(pa.array(k)) for n in ("key", "piece", "doc_id", "row", "at")}
            keys = _mixed(grams ^ up["key"].to_numpy().view(np.uint64) * np.uint64(_ODD)).view(np.int64)
            whole = words.pair(bases[k] + first, bases[k] + stop + length - 1)
            at = pa.array((up["at"].to_numpy() + first).astype(np.int32))
            names = ["up_key", "up_piece", "off", "key", "piece", "doc_id", "row", "at", "text"]
            yield pa.RecordBatch.from_arrays([up["key"], up["piece"], pa.array(first.astype(np.int32)), pa.array(keys), whole, up["doc_id"], up["row"], at, pa.array(out, pa.binary())], names)

    return in_workers(of.join(listed, ["key", "piece"], "left"), parts, f"up_key long, up_piece struct<a: long, b: long>, off int, {PASSAGE}")


def _automata(passages: DataFrame, length: int, shard_words: int) -> DataFrame:
    """(key, piece, first, starts, stops): of each passage the runs of windows that passages of its key before it hold.

    A task takes its passages by key and place. They are the shards of reference: each passage streams
    through the suffix automaton of those before it, which gives its matching statistics, and what is
    new in it is added. A shard ends at the key with which it has shard_words. A key's only passage meets
    no other, as equal windows have equal keys, and is in no automaton.
    """
    rows = passages.repartition("key").sortWithinPartitions("key", "doc_id", "row", "at", "piece")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, ids, size, last, alone = Automaton(), _Ids(), 0, (None, None), b""
        for batch in batches:
            stay, starts, stops = [], [], []
            for k, (key, piece) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if (key, piece) == last:
                    continue  # an equal row of the table
                text = batch.column(5)[k].as_py()
                if key != last[0]:
                    if size >= shard_words:
                        automaton, ids, size = Automaton(), _Ids(), 0
                    found, alone = [], text
                else:
                    for passage in (alone, text) if alone else (text,):
                        words = list(map(ids.__getitem__, passage.split(b" ")))
                        found = seen_in(automaton, words, length)
                        size += len(words)
                    alone = b""
                last, seen = (key, piece), set(found)
                stay.append(k)
                starts.append([x for x in found if x - 1 not in seen])
                stops.append([x + 1 for x in found if x + 1 not in seen])
            kept = batch.take(pa.array(stay, pa.int32()))
            first = pa.StructArray.from_arrays([kept.column(2), kept.column(3), kept.column(4)], ["doc_id", "row", "at"])
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), first, pa.array(starts, pa.list_(pa.int32())), pa.array(stops, pa.list_(pa.int32()))], ["key", "piece", "first", "starts", "stops"])

    return in_workers(rows, of, "key long, piece struct<a: long, b: long>, first struct<doc_id: long, row: long, at: int>, starts array<int>, stops array<int>")


def resolved(passages: DataFrame, length: int, most_kinds: int, shard_words: int, hot_before: int | None = None) -> DataFrame:
    """What _automata gives, for stored passages with any number of kinds to a key: where a key has more than most_kinds, they are parted by _finer, and equal parts count once.

    It ends, as parting goes on only while it leaves fewer passages under such keys than before.
    """
    hot = cut(passages.groupBy("key").agg(F.count("*").alias("kinds")).filter(F.col("kinds") > most_kinds))
    n_hot = hot.agg(F.sum("kinds")).first()[0] or 0
    if not n_hot or (hot_before is not None and n_hot >= hot_before):
        return _automata(passages, length, shard_words)
    keys = bounded(hot.select("key"), 1_000_000)
    parts = stored(_finer(passages.join(keys, "key", "left_semi").dropDuplicates(["key", "piece"]), length), "parts")
    place = F.struct("doc_id", "row", "at")
    one = stored(parts.groupBy("key", "piece").agg(F.min(F.struct("doc_id", "row", "at", "text")).alias("x")).select("key", "piece", "x.*"), "kinds")
    known = resolved(one, length, most_kinds, shard_words, n_hot)
    joined = parts.select("up_key", "up_piece", "off", "key", "piece", "doc_id", "row", "at", F.expr(f"size(split(text, ' ')) - {length - 1}").alias("n")).join(known, ["key", "piece"])
    later = place > F.col("first")
    starts = F.when(later, F.array("off")).otherwise(F.transform("starts", lambda x: x + F.col("off")))
    stops = F.when(later, F.array(F.col("off") + F.col("n"))).otherwise(F.transform("stops", lambda x: x + F.col("off")))
    back = joined.select("up_key", "up_piece", place.alias("place"), "off", starts.alias("starts"), stops.alias("stops"))
    of = lambda name: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("off", name))), lambda x: x[name])).alias(name)
    first = F.min_by("place", "off").alias("first")
    hot_seen = back.groupBy(F.col("up_key").alias("key"), F.col("up_piece").alias("piece")).agg(first, of("starts"), of("stops"))
    return _automata(passages.join(keys, "key", "left_anti"), length, shard_words).unionByName(hot_seen)


def repeated_spans(documents: DataFrame, length: int = 20, most_kinds: int = 256, shard_words: int = 60_000, broadcast_rows: int = 2_000_000) -> DataFrame:
    """(doc_id, row, spans): of rows of documents (doc_id, text, row) the spans of words (start, stop) under windows that start earlier too.

    Only windows whose anchor occurs twice can repeat; equal windows have equal anchors at equal
    places. Of pieces, runs of windows with a common anchor, each kind whose anchor occurs twice is a
    reference passage, by the text at its first place. Passages are dealt by anchor into shards, and
    suffix automata over these tell which windows of each are there before it; a copy has its kind's
    matching statistics, of which its own later place makes all windows repeats. Shards go to the tasks
    that need them rather than to all: all documents against all shards would grow with the square of
    the corpus.
    """
    spark, rows, place = documents.sparkSession, documents.select("doc_id", "row", "text"), F.struct("doc_id", "row", "at")
    at, to = scratch(spark, "again"), scratch(spark, "known")
    with space(spark):
        pieces = stored(_occurrences(rows, length), "pieces")
        counted = stored(pieces.groupBy("anchor").agg(F.count("*").alias("times")).filter("times > 1").select("anchor"), "anchors")
        again = stored(pieces.join(bounded(counted, broadcast_rows), "anchor", "left_semi").withColumnRenamed("anchor", "key"), "again", path=at)
    with space(spark):
        firsts = stored(again.groupBy("key", "piece").agg(F.min(place).alias("first"), F.max("n").alias("n")).select("key", "piece", "first.*", "n"), "firsts")
        passages = stored(_passages(rows, firsts, length), "passages", "zstd")
        known = stored(resolved(passages, length, most_kinds, shard_words), "known", path=to)
    whole = F.array(F.struct(F.col("at").alias("start"), (F.col("at") + F.col("n") + length - 1).alias("stop")))
    some = F.expr(f"transform(arrays_zip(starts, stops), x -> struct(at + x.starts AS start, at + x.stops - 1 + {length} AS stop))")
    spans = F.when(place > F.col("first"), whole).otherwise(some)
    found = again.join(known, ["key", "piece"]).select("doc_id", "row", spans.alias("spans")).filter(F.size("spans") > 0)
    return found.groupBy("doc_id", "row").agg(F.flatten(F.collect_list("spans")).alias("spans"))


#: Characters of texts given back at a time, so that a worker's memory doesn't follow the Arrow batch.
SLICE = 4_000_000


def _kept(text: str, start: np.ndarray, stop: np.ndarray) -> tuple[int, int, bytes]:
    """Number of words, number of those in spans from start to stop, and the others joined by blanks."""
    words = text.encode().split()
    if not len(start):
        return len(words), 0, b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, stop, -1)
    keep = np.cumsum(change)[:-1] == 0
    return len(words), int((~keep).sum()), b" ".join(compress(words, keep.tolist()))


def _texts(batch: pa.RecordBatch, text: int, spans: int) -> Iterator[tuple[str | None, np.ndarray, np.ndarray]]:
    """Text, starts and stops of each row, one text at a time and spans as numbers; no starts where spans are null."""
    lists = batch.column(spans)
    offsets, flat = lists.offsets.to_numpy(), lists.values
    start, stop = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("start", "stop"))
    some = lists.is_valid().to_numpy(zero_copy_only=False)
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        b = b if some[k] else a
        yield batch.column(text)[k].as_py(), start[a:b], stop[a:b]


def _with_spans(documents: DataFrame, length: int) -> DataFrame:
    """(row, doc, spans): documents' rows as structs, so that no name of theirs clashes, with what repeats in them."""
    rows = documents.select(F.struct("*").alias("doc"), F.xxhash64("doc_id", "text").alias("row"))
    spans = repeated_spans(rows.select(F.col("doc.doc_id").cast("long").alias("doc_id"), "row", text_or_empty(F.col("doc.text")).alias("text")), length)
    spans = spans.withColumnsRenamed({"doc_id": "of_id", "row": "of_row"})
    return rows.join(spans, F.col("doc.doc_id").cast("long").eqNullSafe(F.col("of_id")) & (F.col("row") == F.col("of_row")), "left").select("row", "doc", "spans")


def digests(documents: DataFrame, length: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of documents (doc_id, text).

    Words are parted by ASCII blanks. A word is removed if it is in a window of length words that also
    starts at a smaller doc_id, or earlier in its document. Null and empty texts have no words. Rows
    without a doc_id come before all others; of rows that share one, those with the smaller hash of
    doc_id and text come first, and equal rows are one document. Other columns are ignored.
    """
    rows = _with_spans(documents.select("doc_id", "text"), length).select(F.col("doc.doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("doc.text")).alias("text"), "spans")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, start, stop in _texts(batch, 1, 2):
                n, gone, kept = _kept(text, start, stop)
                found.append((n, gone, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return in_workers(rows, of, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(documents: DataFrame, length: int = 20) -> DataFrame:
    """documents with repeated words removed from text, as in digests; texts that lose no word stay as they are. n_chars, where there is one, follows."""
    names = documents.columns
    rows = _with_spans(documents, length).select(*[F.col(f"doc.`{n}`").alias(f"c{k}") for k, n in enumerate(names)], "spans")
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str | None] = []
            sizes: list[int | None] = []
            size = first = 0

            def part(stop: int) -> pa.RecordBatch:
                columns = [batch.column(k).slice(first, stop - first) for k in range(len(names))]
                columns[text_at] = pa.array(texts, pa.string())
                if chars_at is not None:
                    old = columns[chars_at]
                    columns[chars_at] = pa.array([o if n is None else n for o, n in zip(old.to_pylist(), sizes, strict=True)], old.type)
                return pa.RecordBatch.from_arrays(columns, names)

            for k, (text, start, stop) in enumerate(_texts(batch, text_at, len(names))):
                new = _kept(text or "", start, stop)[2].decode() if len(start) else text
                texts.append(new)
                sizes.append(len(new) if len(start) else None)
                size += len(new or "")
                if size > SLICE:
                    yield part(k + 1)
                    texts, sizes, size, first = [], [], 0, k + 1
            if texts:
                yield part(batch.num_rows)

    return in_workers(rows, of, documents.schema)
