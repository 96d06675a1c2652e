"""Every numbered operator against a plain version of its definition, on small tables with nulls, ties, repeats and clashing columns."""

import base64
import gzip
import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from folioflow.llm import chat, decontaminate, langid, media, sentencepieces, simhash, substrings, tokenbin, urlrank, warc
from folioflow.llm.queries import ORACLE, QUERIES
from tests.compare import SF, of_duckdb, of_spark

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, fp long, n string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def made_texts(seed=3, n=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["é", "Ünd", "日本", "A1"]
    passage = " ".join(rng.choice(words) for _ in range(45))
    loop = " ".join(["same"] * 30)
    out = ["", " \t\n", "one", passage, passage, loop]
    for k in range(n):
        own = [rng.choice(words) for _ in range(rng.randrange(1, 80))]
        if k % 3 == 0:
            at = rng.randrange(len(own))
            part = passage.split()
            a = rng.randrange(10)
            own[at:at] = part[a : a + rng.randrange(15, 35)]
        out.append((" " if k % 2 else "\n ").join(own))
    return out + [out[10], out[12] + " x", None]


@pytest.fixture(scope="module")
def documents(spark):
    texts = made_texts()
    rows = [(k * 3 + 1, t, ["en", "fr", None][k % 3], "s", len(t or ""), "r", k, "x") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


def as_rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    assert of_spark(QUERIES[name](spark, SF)) == of_duckdb(ORACLE[name])


# 1 -------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a.b/x y", "<p>é</p>"), (5, None, "<p>é</p>"), (2, "http://c", None), (3, "u", ""), (4, "u", "long " * 40_000), (None, "n", "lonely"), (9, "r", "twice"), (9, "r", "twice")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, payload string")
    warc.write_warc(df, str(tmp_path / "w"), archive_bytes=400)
    read = {(r["page_id"], r["target_uri"], r["record_type"]): r for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    kinds = sorted((str(k[0]), k[2]) for k in read)
    assert kinds == sorted([("1", "revisit"), ("5", "response"), ("2", "revisit"), ("3", "response"), ("4", "response"), ("None", "response"), ("9", "response")])
    assert read[1, "http://a.b/x%20y", "revisit"]["refers_to"] == 5
    assert bytes(read[4, "u", "response"]["payload"]) == b"long " * 40_000
    for r in read.values():
        html = {"1": "<p>é</p>", "5": "<p>é</p>", "2": "", "3": "", "4": "long " * 40_000, "None": "lonely", "9": "twice"}[str(r["page_id"])].encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html), base64.b32encode(hashlib.sha1(html).digest()).decode())
    for file in (tmp_path / "w").glob("part-*"):  # any reader of gzip files reads them
        assert gzip.decompress(file.read_bytes()).startswith(b"WARC/1.1\r\n")


def test_warc_damage():
    one = warc.record(1, "u", b"payload", None, "2000-01-01T00:00:00Z")
    assert next(warc.records(memoryview(one + b"\0" + one)))["payload"] == b"payload"
    plain = gzip.decompress(one)
    for bad in (gzip.compress(plain.replace(b"payload", b"PAYLOAD")), one[: len(one) // 2], gzip.compress(plain + b"x"), gzip.compress(plain.replace(b"WARC/1.1", b"XXXX/1.1"))):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.records(memoryview(bad)))


def test_warc_empty(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "e"))
    assert warc.read_warc(spark, str(tmp_path / "e")).count() == 0


# 2 -------------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    found = QUERIES["op2_language_id"](spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    rows = found.join(truth, "doc_id").filter("held_out and lang is not null").collect()
    told = [r for r in rows if r["lang_pred"] != "und"]
    assert len(told) > 20
    assert np.mean([r["lang_pred"] == r["lang"] for r in told]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in found.select("doc_id", "held_out").collect())


def test_language_edge_cases(spark):
    rows = spark.createDataFrame([("the cat sat on the mat", "en"), ("le chat est sur la table", "fr"), (None, "en"), ("x", None)], "text string, lang string")
    model = langid.fit(rows)
    assert model.languages == ["en", "fr"]
    texts = spark.createDataFrame([(1, None, "old"), (2, "12 !?", "old"), (3, "the cat", "old"), (4, "le chat " * 200_000, "old"), (5, "", None)], "doc_id long, text string, lang_pred string")
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(texts, model).collect()}
    assert found == {1: "und", 2: "und", 3: "en", 4: "fr", 5: "und"}
    nothing = langid.fit(rows.filter("false"))
    assert {r["lang_pred"] for r in langid.identify(texts, nothing).collect()} == {"und"}


# 3 -------------------------------------------------------------------------------------------------


def brute_substrings(rows, length=20):
    seen, out = set(), []
    for doc_id, text in rows:
        words = words_of(text)
        gone = set()
        for k in range(len(words) - length + 1):
            window = tuple(words[k : k + length])
            if window in seen:
                gone |= set(range(k, k + length))
            seen.add(window)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("most_kinds", "shard_words", "broadcast_rows"), [(256, 60_000, 2_000_000), (2, 30, 1)])
def test_substrings(spark, documents, monkeypatch, most_kinds, shard_words, broadcast_rows):
    spans = substrings.repeated_spans
    monkeypatch.setattr(substrings, "repeated_spans", lambda d, length: spans(d, length, most_kinds, shard_words, broadcast_rows))
    rows = sorted((r["doc_id"], r["text"]) for r in documents.collect())
    assert as_rows(substrings.digests(documents), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings(rows)


def test_a_line_in_many_contexts(spark, monkeypatch):
    """One anchor with many kinds, equal rows and rows without a doc_id: parted by rarer words, with equal parts once."""
    rng = random.Random(6)
    line = " ".join(f"line{k}" for k in range(24))
    prose = lambda n: " ".join(f"w{rng.randrange(30)}" for _ in range(n))
    texts = [(k + 1, f"{prose(rng.randrange(12))} {line} {prose(rng.randrange(12))}") for k in range(60)]
    spans = substrings.repeated_spans
    monkeypatch.setattr(substrings, "repeated_spans", lambda d, length: spans(d, length, 4, 100))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert as_rows(substrings.digests(df), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings(texts)
    odd = spark.createDataFrame([(None, texts[0][1]), texts[0], texts[0], (2, texts[0][1]), (2, "other " + line)], "doc_id long, text string")
    found = as_rows(substrings.digests(odd), "doc_id", "n_words", "n_removed")
    assert [r for r in found if r[0] is None][0][2] == 0
    assert len(found) == 5 and all(r[2] > 0 for r in found if r[0] is not None)


def thue_morse(n):
    return [bin(k).count("1") % 2 for k in range(n)]


def test_sequences_that_collide_in_sums_modulo_two_to_the_64(spark):
    """Letters, and words, in the Thue-Morse order and in its complement: sums of powers modulo 2 ** 64 are equal whatever the base."""
    order = thue_morse(1024)
    one, other = ("".join("ab"[x ^ y] for x in order) for y in (0, 1))
    words = [f"w{k}" for k in range(30)]
    texts = [[one if k == 10 else w for k, w in enumerate(words)], [other if k == 10 else w for k, w in enumerate(words)]]
    order = thue_morse(2048)
    texts += [[["red", "blue"][x ^ y] for x in order] for y in (0, 1)]
    texts += [["y" * 100_000, *words], ["y" * 99_999 + "z", *words], ["y" * 100_000, *words]]
    odd = ["a", "a\0", "\0a", "a\0\0", "abcdefg", "abcdefg\0", "abcdefgh", "abcdefg\0\0\0\0\0\0\0", "abcdefghabcdefg", "abcdefgabcdefg"]
    texts += [[x, *[f"o{k}" for k in range(19)]] for x in odd]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = brute_substrings(rows)
    assert as_rows(substrings.digests(df), "doc_id", "n_words", "n_removed", "kept_sha256") == expected
    assert [r[2] for r in expected[:2]] == [0, 0]


def test_texts_hashed_together_are_apart(monkeypatch):
    rng = random.Random(12)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 12) for _ in range(rng.choice([0, 3, 19, 20, 21, 60]))) for _ in range(40)]
    both = b" ".join(t.encode() for t in texts)
    words = substrings.Words(both)
    of = np.searchsorted(np.cumsum([len(t.encode()) + 1 for t in texts]), words.starts, "right")
    anchor, at, n = words.pieces(20, of)
    together = [(int(of[a]), int(h), int(a - np.searchsorted(of, of[a])), int(c)) for h, a, c in zip(anchor, at, n)]
    alone = [(k, int(h), int(a), int(c)) for k, t in enumerate(texts) for h, a, c in zip(*substrings.Words(t.encode()).pieces(20))]
    assert together == alone


def test_hashes_of_runs():
    rng = random.Random(5)
    text = [rng.choice("abc") for _ in range(400)]
    words = substrings.Words(" ".join(text).encode())
    start = np.array([rng.randrange(380) for _ in range(3000)])
    stop = start + np.array([rng.randrange(1, 12) for _ in range(3000)])
    for which in (0, 1):
        by = defaultdict(set)
        for a, b, h in zip(start.tolist(), stop.tolist(), words.runs(start, stop, which).tolist()):
            by[h].add(tuple(text[a:b]))
        assert all(len(v) == 1 for v in by.values())
        assert len(by) == len({tuple(text[a:b]) for a, b in zip(start.tolist(), stop.tolist())})
    x, y = (np.array([rng.randrange(substrings._PRIME) for _ in range(500)], np.uint64) for _ in range(2))
    assert substrings._times(x, y).tolist() == [a * b % substrings._PRIME for a, b in zip(x.tolist(), y.tolist())]
    assert substrings._power(300, 12345).tolist() == [pow(12345, k, substrings._PRIME) for k in range(300)]


def test_substrings_all_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    assert as_rows(substrings.digests(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings(rows)


@pytest.mark.parametrize("slice_chars", [4_000_000, 100])
def test_repeats_removed(spark, documents, monkeypatch, slice_chars):
    monkeypatch.setattr(substrings, "SLICE", slice_chars)
    # a row's hash is what tells rows apart, and the fixture's own column of that name has to stay
    rows = {r["doc_id"]: r for r in documents.collect()}
    expected = {r[0]: r for r in brute_substrings(sorted((k, r["text"]) for k, r in rows.items()))}
    found = substrings.remove_repeats(documents)
    assert found.columns == documents.columns
    for r in found.collect():
        old, (_, _, gone, kept) = rows[r["doc_id"]], expected[r["doc_id"]]
        if gone:
            assert hashlib.sha256(r["text"].encode()).hexdigest() == kept
            assert r["n_chars"] == len(r["text"])
        else:
            assert (r["text"], r["n_chars"]) == (old["text"], old["n_chars"])
        assert (r["row"], r["fp"], r["lang"]) == (old["row"], old["fp"], old["lang"])


def test_substrings_empty(spark):
    assert substrings.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_automaton():
    rng = random.Random(1)
    for _ in range(40):
        passages = [[rng.randrange(3) for _ in range(rng.randrange(0, 30))] for _ in range(5)]
        seen, expected = set(), []
        for p in passages:
            windows = [tuple(p[k : k + 4]) for k in range(len(p) - 3)]
            expected.append([k for k, w in enumerate(windows) if w in seen])
            seen |= set(windows)
        automaton = substrings.Automaton()
        assert [substrings.seen_in(automaton, p, 4) for p in passages] == expected


# 4 -------------------------------------------------------------------------------------------------


def test_media(spark, documents):
    found = {r["doc_id"]: r for r in media.media_features(media.store_text_media(documents)).collect()}
    for r in documents.collect():
        data = (r["text"] or "").encode()
        padded = data + b" " * (-len(data) % 192 if data else 192)
        got = found[r["doc_id"]]
        assert (got["n_bytes"], got["payload_bytes"], got["payload_sha256"], got["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert len(got["feature"]) == 16


def test_filters_are_used_and_features_follow_pixels(spark):
    text = "".join(chr(97 + k % 26) for k in range(192 * 12)) + "x" * 192 * 3
    row = media.media_features(media.store_text_media(spark.createDataFrame([(1, text), (2, text), (3, None)], "doc_id long, text string"))).orderBy("doc_id").collect()
    assert row[0]["media_sha256"] == row[1]["media_sha256"] and row[0]["feature"] == row[1]["feature"]
    samples = np.frombuffer(text.encode(), np.uint8).reshape(-1, 192)
    assert len(set(media.least_kinds(samples, 3).tolist())) > 1
    grey = samples.reshape(len(samples), 64, 3).astype(float).mean(axis=2)
    small = np.array([[grey[i * len(grey) // 32 if len(grey) < 32 else i, 2 * j : 2 * j + 2].mean() for j in range(32)] for i in range(32)])
    low = np.array([[sum(small[y, x] * np.cos(np.pi * u * (2 * y + 1) / 64) * np.cos(np.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]).ravel()
    bits = np.round(low, 6) > np.median(np.round(low, 6)[1:])
    assert np.packbits(bits).tobytes().hex() == row[0]["feature"]
    png = media.encode_png(text.encode(), 64)
    assert (row[0]["media_bytes"], row[0]["media_sha256"]) == (len(png), hashlib.sha256(png).hexdigest())
    assert media.media_features(media.store_text_media(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_png():
    rng = np.random.default_rng(2)
    samples = rng.integers(0, 256, 40 * 8 * 3, np.uint8).tobytes()
    for kinds in [None, *[np.full(40, k) for k in range(5)], rng.integers(0, 5, 40), rng.integers(0, 3, 40)]:
        png = media.encode_png(samples, 8, kinds=kinds)
        assert media.decode_png(png).tobytes() == samples
    with pytest.raises(ValueError):
        media.decode_png(png[:40] + bytes([png[40] ^ 1]) + png[41:])
    with pytest.raises(ValueError):
        media.decode_png(png[:-5])


# 5 -------------------------------------------------------------------------------------------------

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def test_url_parts_and_rules(spark):
    urls = ["http://A.Example.NET/en/x?y", "https://x.net", "http://example.com/de/a#b", "http://example.com/fr", "ftp://a.org/fr/1", None, "no scheme", "http://netx/", "http://e.net?q://z/"]
    rows = spark.createDataFrame([(k, u, None, "clash") for k, u in enumerate(urls)], "page_id long, url string, html string, host string")
    found = {r["page_id"]: r for r in urlrank.judge(rows, RULES).collect()}
    assert [(found[k]["host"], found[k]["path"], found[k]["rule"]) for k in range(len(urls))] == [
        ("a.example.net", "/en/x", "example.net/en/"), ("x.net", "", None), ("example.com", "/de/a", "example.com/de/"), ("example.com", "/fr", None), ("a.org", "/fr/1", "org/fr/"),
        ("", "", None), ("", "", None), ("netx", "/", None), ("e.net", "", None),
    ]
    assert found[0]["verdict"] == "allow"
    assert found[2]["verdict"] == "block"
    assert urlrank.judge(rows.filter("false"), RULES).count() == 0


def test_propagation(spark):
    links = {("a", "b"): 1.0, ("b", "c"): 0.5, ("b", "a"): 0.5, ("c", "d"): 1.0}
    edges = spark.createDataFrame([("allow", a, b, s) for (a, b), s in links.items()], "kind string, source string, target string, share double")
    seeds = spark.createDataFrame([("allow", "a", 1.0)], "kind string, host string, seed double")
    got = {r["host"]: r["score"] for r in urlrank.propagate(edges, seeds, 0.85, 1e-12).collect()}
    names = "abcd"
    rank = np.array([1.0, 0, 0, 0])
    for _ in range(300):
        moved = np.zeros(4)
        for (a, b), s in links.items():
            moved[names.index(b)] += 0.85 * s * rank[names.index(a)]
        moved[0] += 1 - moved.sum()
        rank = moved
    assert np.allclose([got[n] for n in names], rank, atol=1e-9)


# 6 -------------------------------------------------------------------------------------------------


def test_decontamination_edge_cases(spark):
    item = " ".join(f"b{k}" for k in range(15))
    bench = spark.createDataFrame([(1, item), (2, "Short é item"), (3, None), (4, "!!"), (None, item), (10, item), (5, "b0 b0")], "item_id long, text string")
    texts = [item.upper() + " more", "x short, É! item y short é item", None, "", "b0 b0 b0", " ".join(f"b{k}" for k in range(12)), "z " * 500 + item, "b0 b0 b0"]
    docs = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)] + [(None, item, "c"), (7, "b0 b0 b0", "c")], "doc_id long, text string, row string")

    def expected(text):
        lower = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        w, hit, items = lower(text), set(), set()
        for item_id, t in [(1, item), (2, "Short é item"), (4, "!!"), (10, item), (5, "b0 b0")]:
            b = lower(t)
            for k in range(max(1, len(b) - 12) if b else 0):
                part = b[k : k + 13]
                for at in range(len(w) - len(part) + 1):
                    if w[at : at + len(part)] == part:
                        hit |= set(range(at, at + len(part)))
                        items.add(str(item_id))
        return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)

    found = as_rows(decontaminate.decontaminate(docs, bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert found == sorted([(r["doc_id"], *expected(r["text"])) for r in docs.collect()], key=repr)
    assert decontaminate.decontaminate(docs, bench.filter("false")).filter("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(docs.filter("false"), bench).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "c x a b"), (2, "a b x x c"), (3, "a b")], "doc_id long, text string")
    phrases = spark.createDataFrame([("a b c", ["a", "b", "c"])], "phrase string, words array<string>")
    index, selected = decontaminate.build(docs, phrases, 3, 3)
    assert {r["doc_id"] for r in decontaminate.proximity_matches(index, selected, 4).collect()} == {1}


# 7 -------------------------------------------------------------------------------------------------


def test_chat(spark):
    turns = [(1, 1, "user", "a"), (1, 2, "assistant", "b"), (2, 1, "user", "a"), (2, 2, "assistant", "b"), (2, 3, "user", "c"), (3, 1, "user", "a"), (3, 2, "assistant", "x"), (4, 5, "user", "a"), (4, 6, "assistant", "x"), (5, 1, None, None), (5, 1, None, None), (None, 1, "user", "q"), (None, 2, "user", "q"), (None, 1, "user", "a")]
    df = spark.createDataFrame([(*t, 0, 0) for t in turns], "conv_id long, turn long, role string, text string, a int, n_turns int")
    found = {r["conv_id"]: (r["n_turns"], r["n_copies"], r["text"]) for r in chat.collapse(df).collect()}
    assert set(found) == {2, 3, 5, None}
    assert found[3][:2] == (2, 2)
    assert found[2][2] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
    assert found[5][2] == "<|im_start|>\n<|im_end|>\n"
    assert found[None] == (1, 2, "<|im_start|>user\nq<|im_end|>\n")
    assert chat.collapse(df.filter("false")).count() == 0


# 8 -------------------------------------------------------------------------------------------------


def test_sentencepiece(spark, documents):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    more = ["The quick brown fox ", "  two  blanks", "日本語のテキスト", "a" * 3000, "naïve café 😀 \t tab\nline", "1234567890 " * 30, "x▁y"]
    extra = spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(more)], "doc_id long, text string")
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for df in (documents, extra, table):
        texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        for r in sentencepieces.encode_documents(df, path).collect():
            text = texts[r["doc_id"]]
            expected = library.encode(text)
            assert list(r["ids"]) == expected, text[:80]
            assert r["n_pieces"] == len(expected)
            assert r["ids_crc32"] == zlib.crc32(np.array(expected, "<i4").tobytes())
            assert r["lossless"] == ("▁" not in text)
            assert r["decoded_sha256"] == hashlib.sha256(text.replace("▁", " ").encode()).hexdigest()


def test_slices(monkeypatch):
    monkeypatch.setattr(sentencepieces, "SLICE", 5)
    assert list(sentencepieces.slices(["aaa", "bb", "c", "dddddddd", "", "e"])) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(sentencepieces.slices([])) == []


# 9 -------------------------------------------------------------------------------------------------


def test_token_ids(spark, documents):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = ["Ünïcode Straße İstanbul ﬁne", "don't stop!!", "a<|endoftext|>b", "\u00a0nbsp\ttab\r\nx", "123 4.5,6", "日本 Ǆ ß", "e\u0301te", "Σίσυφος ΣΑΣ", "word,", "word.", "'s"]
    extra = spark.createDataFrame([(20_000 + k, t) for k, t in enumerate(odd)], "doc_id long, text string")
    df = documents.select("doc_id", "text").unionByName(extra).unionByName(spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 50_000).alias("doc_id"), "text"))
    found = {r["doc_id"]: r for r in tokenbin.token_ids(df, path, 49_408, 2).collect()}
    start = 0
    for r in sorted(df.collect(), key=lambda r: r["doc_id"]):
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        got = found[r["doc_id"]]
        assert (got["start"], got["n_tokens"], got["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), r["text"]
        start += len(ids)


def test_bit_packing(spark, tmp_path, documents):
    rng = np.random.default_rng(4)
    for width in (1, 7, 16, 17, 31, 32):
        for n in (0, 1, 63, 64, 65, 1000):
            ids = rng.integers(0, 1 << width, n, np.uint64).astype(np.uint32)
            words = tokenbin.pack(ids, width)
            assert np.array_equal(tokenbin.unpack(words, width, 0, n), ids)
            assert np.array_equal(tokenbin.unpack(words, width, n // 3, n), ids[n // 3 :])
    tokenbin.write_token_ids(documents, str(tmp_path / "t"), public_tokenizers.path("word_bpe_49k.json"), 49_408, 2, ids_per_block=50, blocks_per_file=3)
    read = tokenbin.read_token_ids(spark, str(tmp_path / "t")).orderBy("file", "nth").collect()
    for file in Path(tmp_path / "t").glob("part-*"):
        tokens = tokenbin.TokenFile(memoryview(file.read_bytes()))
        part, piece = map(int, re.search(r"part-(\d+)-.*-c(\d+)(?:\.[^/]*)?$", file.name).groups())
        flat = [x for r in read if (r["file"]["part"], r["file"]["piece"]) == (part, piece) for x in r["ids"]]
        assert tokens.ids(0, len(flat)).tolist() == flat
        assert tokens.ids(17, 130).tolist() == flat[17:130]


def test_files_are_numbered_by_the_end_of_their_names(spark, tmp_path, documents):
    """Spark's random part of a file's name may itself hold -c and a digit."""
    at = tmp_path / "t"
    tokenbin.write_token_ids(documents.repartition(2), str(at), public_tokenizers.path("word_bpe_49k.json"), 49_408, 2, ids_per_block=20, blocks_per_file=1)
    names = {f: f.with_name(re.sub(r"-[0-9a-f-]{36}-", "-0a1b2c3d-c512-4e5f-8a9b-c0d1e2f3a4b5-", f.name)) for f in at.glob("part-*")}
    assert len({(re.match(r"part-(\d+)", f.name)[0]) for f in names}) < len(names) and all(f.name != to.name for f, to in names.items())
    before = as_rows(tokenbin.positions(tokenbin.read_token_ids(spark, str(at))), "doc_id", "start", "n_tokens")
    for f, to in names.items():
        f.rename(to)
    for crc in at.glob(".*.crc"):
        crc.unlink()
    after = as_rows(tokenbin.positions(tokenbin.read_token_ids(spark, str(at))), "doc_id", "start", "n_tokens")
    assert before == after
    flat = sorted(after, key=lambda r: r[1])
    assert [r[1] for r in flat] == [sum(x[2] for x in flat[:k]) for k in range(len(flat))]


def test_ids_of_any_value_and_repeats(spark, tmp_path):
    """The least long, nulls and repeated doc_ids, an empty table, long pieces."""
    path = public_tokenizers.path("word_bpe_49k.json")
    low = -(1 << 63)
    texts = [(None, "no id"), (low, "least"), (5, "b c"), (5, "a"), (5, "a"), (0, None), (7, "z" * 500)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found = tokenbin.token_ids(df, path, 49_408, 2).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [None, low, 0, 5, 5, 5, 7]
    start = 0
    for r in found:
        assert r["start"] == start
        start += r["n_tokens"]
    assert tokenbin.token_ids(df.filter("false"), path, 49_408, 2).count() == 0


# 10 ------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    up = {d: d for d, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, x), (b, y) in itertools.combinations(rows, 2):
        if (x ^ y).bit_count() <= 4 and root(a) != root(b):
            up[max(root(a), root(b))] = min(root(a), root(b))
    return {d: root(d) for d, _ in rows}


def test_simhash(spark, documents):
    table = spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 5_000).alias("doc_id"), "text")
    df = documents.select("doc_id", "text").unionByName(table)
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in df.collect()]
    of = brute_components(rows)
    found = simhash.near_duplicates(df).collect()
    assert {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in found} == {d: (fp, of[d]) for d, fp in rows}
    assert simhash.near_duplicates(df.filter("false")).count() == 0


@pytest.mark.parametrize("most_in_key", [20_000, 100])
def test_simhash_links(spark, most_in_key):
    """Chains, stars and a dense cluster, with keys both few and hot, against all pairs."""
    rng = random.Random(9)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(40):
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                x ^= 1 << b
            fps.add(x)
    base = rng.getrandbits(64)
    fps |= {base ^ 1 << a ^ 1 << b for a in range(20) for b in range(20)}
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    up = dict(zip(fps, fps, strict=True))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in simhash.links(df, most_in_key=most_in_key).collect():
        a, b = (v % (1 << 64) for v in (r["a"], r["b"]))
        up[root(a)] = root(b)
    expected = brute_components(list(zip(range(len(fps)), fps, strict=True)))
    groups = defaultdict(set)
    for k, x in enumerate(fps):
        groups[expected[k]].add(root(x))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)
