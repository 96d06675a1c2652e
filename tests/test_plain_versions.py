"""Queries that SQL can't express, against plain Python over the whole table: spans, sentences, splitting, Brazilian Portuguese, altered elements."""

import hashlib
import re
from urllib.parse import quote_plus

import pytest

from folioflow.functions import portuguese, protect
from folioflow.queries import QUERIES
from folioflow.queries.audit import european, pairs, texts
from tests.compare import SF


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def norm(text):
    text = re.sub(r"[ \t]+", " ", text.replace("\xad", ""))
    return re.sub(r"\s*\n\s*", "\n", text).strip()


def spans(text):
    found = [(m.start(), -m.end(), k, kind, m[0]) for k, (kind, pattern) in enumerate(protect.KINDS) for m in re.finditer(pattern, text)]
    out, end = [], 0
    for start, back, _, kind, original in sorted(found):
        if start >= end:
            out.append((start, -back, kind, original))
            end = -back
    return out


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] for r in texts(spark, SF).collect()}


def test_protect_spans(spark, documents):
    found = sorted((r["doc_id"], r["nth"], r["start"], r["stop"], r["kind"], r["original_md5"]) for r in QUERIES["q_protect_spans"](spark, SF).collect())
    assert found == sorted((d, k, a, b, kind, md5(x)) for d, t in documents.items() for k, (a, b, kind, x) in enumerate(spans(t)))


def test_sentences(spark, documents):
    opening = "A-ZÀ-ÖØ-Þ0-9“\"("
    for r in QUERIES["q_sentences"](spark, SF).collect():
        text = documents[r["doc_id"]]
        with_bullets = [x.strip() for x in re.split(rf"(?<=[.!?])\s+(?=[{opening}•●▪◦‣])", text.strip()) if x.strip()] or [text.strip()]
        assert (r["n_sentences"], r["n_kept"], r["sentences_md5"]) == (len(re.split(rf"(?<=[.!?])\s+(?=[{opening}])", text)), len(with_bullets), md5("\n".join(with_bullets)))


def parted(text, limit=3500, encoded=5500):
    """By what a form would send: as much as fits, back to the last sentence end or else blank, if that is past its half."""
    out, text = [], norm(text)
    while text:
        n, size = 0, 0
        while n < len(text) and n < limit:
            size += len(quote_plus(text[n]))
            if size > encoded and n:
                break
            n += 1
        if n < len(text):
            ends = [m.end() for m in re.finditer(r"[.!?;:]\s+", text[:n])]
            cut = ends[-1] if ends else text[:n].rfind(" ")
            n = cut if cut >= n / 2 else n
        out += [text[:n].strip()] if text[:n].strip() else []
        text = text[n:].lstrip()
    return out


def test_split_text(spark, documents):
    found = sorted((r["doc_id"], r["part_no"], r["part_md5"]) for r in QUERIES["q_split_text"](spark, SF).collect())
    assert found == sorted((d, k, md5(x)) for d, t in documents.items() for k, x in enumerate(parted(t)))


def like(found, word):
    if found.isupper():
        return word.upper()
    return word.capitalize() if found[:1].isupper() and found[1:].islower() else word


#: What is replaced behind words and progressive forms, in this order.
STEPS = [
    (r"(?i)\bprecisa\s+mente\b", "precisamente"), (r"(?i)\bhipó[ -]?sistemas?\b", lambda m: "Hipossistemas" if m[0][0].isupper() else "hipossistemas"),
    (r"(?i)\b([A-Za-zÀ-ÖØ-öø-ÿ]+)mos-nos\b", r"\1mo-nos"), (r"(?i)\baté aos\b", "até os"), (r"(?i)\baté ao\b", "até o"), (r"(?i)\baté às\b", "até as"), (r"(?i)\baté à\b", "até a"),
    (r"(?i)\bmodela-la\b", "modelá-la"), (r"(?i)\bfração mais pequena\b", lambda m: like(m[0], "menor fração")), (r"(?i)\bbem sucedid([oa]s?)\b", r"bem-sucedid\1"),
    (r"\s+([,.;:!?])", r"\1"), (r"([.!?;:])(?=[A-ZÀ-ÖØ-Þ])", r"\1 "),
]


def brazilian(text):
    def gerund(verb):
        low = verb.lower()
        return like(verb, portuguese.IRREGULAR.get(low) or (low[:-1] + "ndo" if low[-2:] in ("ar", "er", "ir") else low))

    def one(part):
        part = re.sub(r"\w+", lambda m: like(m[0], portuguese.WORDS[m[0].lower()]) if m[0].lower() in portuguese.WORDS else m[0], part)
        part = re.sub(rf"(?i)\b({'|'.join(portuguese.ESTAR)})\s+a\s+([A-Za-zÀ-ÖØ-öø-ÿ]+(?:ar|er|ir)|pôr)\b", lambda m: f"{m[1]} {gerund(m[2])}", part)
        for pattern, to in STEPS:
            part = re.sub(pattern, to, part)
        return part

    at, out = 0, []
    for m in re.finditer(portuguese.PROTECTED, text, re.I):
        out += [one(text[at : m.start()]), m[0]]
        at = m.end()
    return "".join(out) + one(text[at:])


def test_brazilian(spark):
    source = {r["doc_id"]: r["text"] for r in european(spark, SF).collect()}
    for r in QUERIES["q_ptbr_normalize"](spark, SF).collect():
        expected = brazilian(source[r["doc_id"]])
        assert (r["n_chars_adapted"], r["adapted_md5"]) == (len(expected), md5(expected)), r["doc_id"]


def test_altered_elements(spark):
    found = {(r["conv_id"], r["turn"]): r["message"] for r in QUERIES["q_audit_messages"](spark, SF).collect() if r["code"] == "elemento_tecnico_alterado"}
    expected = {}
    for r in pairs(spark, SF).collect():
        s, t = norm(r["source"] or ""), norm(r["target"] or "")
        if missing := [x for *_, x in spans(s) if x not in t]:
            expected[r["conv_id"], r["turn"]] = "Elemento técnico ausente ou alterado: " + ", ".join(missing[:3])
    assert found == expected
