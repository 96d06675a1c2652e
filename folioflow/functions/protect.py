"""Formulas, citations and identifiers: found by ten patterns, masked by markers, and put back."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import col, normalize_spaces

# Kinds of protected elements in the order of priority, and their patterns.
_TAIL = r"(?:\d+|[₀-₉⁰¹²³⁴⁵⁶⁷⁸⁹]+)?"
_LETTER = "[A-Za-zΑ-Ωα-ω]"
_ATOM = rf"(?:{_LETTER}{_TAIL}|{_LETTER}\s*\([^()\n]{{1,60}}\)|\([^()\n]{{1,60}}\)|\d+(?:[.,]\d+)?(?:[eE][+-]?\d+)?(?:{_LETTER}{_TAIL})?)"
_RELATION = r"(?:=|≠|≤|≥|<|>|→|↦|≈|∼|±|∓|∈|∉|⊂|⊆|\+|−|×|÷|/|\^)"
KINDS = (
    ("url", r"(?i)https?://[^\s<>()]+|www\.[^\s<>()]+"),
    ("email", r"\b[^\s@]+@[^\s@]+\.[^\s@]+\b"),
    ("doi", r"(?i)(?:doi\s*:\s*)?10\.\d{4,9}/[^\s<>()]+"),
    ("latex", r"\$[^$\n]+\$|\\\([^\n]*?\\\)|\\\[[^\n]*?\\\]"),
    ("citacao", r"\([^()\n]{0,220}\b(?:18|19|20)\d{2}[a-z]?\b[^()\n]{0,220}\)"),
    ("conjunto", r"\{[^{}\n]{1,160}\}"),
    ("formula", rf"(?<!\w){_ATOM}(?:\s*{_RELATION}\s*{_ATOM})+(?!\w)"),
    ("intervalo", r"(?<!\w)\d+\s*[–—-]\s*\d+(?!\w)"),
    ("rotulo", r"\b[A-Z]\d+\b"),
    ("sigla", r"\b[A-Z][A-Z0-9]{1,9}\b"),
)
#: What a text has to hold for a kind to occur, cheaper to look for than the kind.
HINTS = (
    "(?i)https?://|www[.]", "@", "10[.][0-9]", r"\$|\\[(\[]", r"\([^()]*\d{2}", r"\{", _RELATION, r"(?U)\d\s*[–—-]\s*\d", r"(?U)[A-Z]\d", "[A-Z][A-Z0-9]",
)
MARKER = ("ZXQKEEP", "QXZ")
_SPAN = "array<struct<start:int,stop:int,priority:int,kind:string,original:string>>"


def _flagged(pattern: str) -> str:
    return f"(?iU){pattern[4:]}" if pattern.startswith("(?i)") else f"(?U){pattern}"


def spans_of(text: str | Column, priority: int) -> Column:
    """All matches of one kind with their places: lengths of what stands between and of the matches, summed."""
    t, (kind, pattern) = col(text), KINDS[priority]
    pattern = _flagged(pattern)
    each = F.arrays_zip(F.split(t, pattern, -1).alias("between"), F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1)).alias("hit"))

    def step(out: Column, x: Column) -> Column:
        start = out["at"] + F.length(x["between"])
        stop = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), stop.alias("stop"), F.lit(priority).alias("priority"), F.lit(kind).alias("kind"), x["hit"].alias("original"))
        return F.struct(stop.alias("at"), F.when(x["hit"].isNull(), out["spans"]).otherwise(F.array_append(out["spans"], span)).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))
    found = F.aggregate(each, start, step, lambda out: out["spans"])
    return F.when(t.rlike(HINTS[priority]), found).when(t.isNotNull(), F.array().cast(_SPAN))


#: Some of these, lower-cased, a text of the kind holds; looked for before its hint, as they are cheaper still.
_NEEDED = (("http", "www."), ("@",), ("10.",), ("$", "\\(", "\\["), ("(",), ("{",), (), (), (), ())


class Lexer:
    """Finds all kinds in a text: candidates of each kind from one pass of its pattern, then one sweep over them in order."""

    def __init__(self) -> None:
        self.kinds = [
            (k, kind, re.compile(pattern), needed, re.compile(hint.replace("(?U)", "")))
            for k, ((kind, pattern), needed, hint) in enumerate(zip(KINDS, _NEEDED, HINTS, strict=True))
        ]

    def elements(self, text: str) -> list[dict]:
        low, found = text.lower(), []
        for k, kind, pattern, needed, hint in self.kinds:
            if (not needed or any(x in low for x in needed)) and hint.search(text):
                found += [(m.start(), -m.end(), k, kind, m[0]) for m in pattern.finditer(text)]
        found.sort()
        out, end = [], 0
        for start, back, k, kind, original in found:
            if start >= end:
                end = -back
                out.append({"start": start, "stop": end, "priority": k, "kind": kind, "original": original})
        return out


@lru_cache(maxsize=1)
def _lexer() -> Lexer:
    """One a worker, kept from task to task."""
    return Lexer()


def protected(text: str | Column) -> Column:
    """The chosen elements, in order: leftmost first, then longest, then by priority, none over another; null for null.

    Kinds are searched each by itself, one pass over the text for each kind that it may hold, in Arrow
    batches. Not for use inside of other columns' lambdas.
    """

    @F.pandas_udf(_SPAN)
    def chosen(texts: pd.Series) -> pd.Series:
        elements = _lexer().elements
        return pd.Series([None if x is None else elements(x) for x in texts], dtype=object)

    return chosen(col(text))


def marker(k: Column) -> Column:
    return F.concat(F.lit(MARKER[0]), F.lpad(k.cast("string"), 4, "0"), F.lit(MARKER[1]))


def segments(text: str | Column, spans: str | Column) -> Column:
    """Array of structs (hit, text, nth): elements and the plain text between them, none of it empty; nth counts the elements."""
    t, s = col(text), col(spans)
    n = F.size(s)
    start = lambda k: F.when(k > 0, F.get(s, k - 1)["stop"]).otherwise(0)
    stop = lambda k: F.when(k < n, F.get(s, k)["start"]).otherwise(F.length(t))
    plain = lambda k: F.struct(F.lit(False).alias("hit"), F.substring(t, start(k) + 1, stop(k) - start(k)).alias("text"), k.alias("nth"))
    hit = lambda k: F.struct(F.lit(True).alias("hit"), F.coalesce(F.get(s, k)["original"], F.lit("")).alias("text"), k.alias("nth"))
    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), n), lambda k: F.array(plain(k), hit(k)))), lambda x: x["text"] != "")


def masked(parts: str | Column) -> Column:
    """Segments as one text, markers for elements."""
    return F.array_join(F.transform(col(parts), lambda x: F.when(x["hit"], marker(x["nth"])).otherwise(x["text"])), "")


def restored(text: str | Column, spans: str | Column) -> Column:
    """text with markers replaced by the elements; null unless each is there exactly once, blanks in it allowed, and none is left."""
    t, s = col(text), col(spans)

    def put(out: Column, x: Column, k: Column) -> Column:
        mark = marker(k)
        exact = F.size(F.split(out, mark, -1)) - 1
        loose = F.concat(F.lit("(?iU)"), F.regexp_replace(mark, r"(.)(?!$)", r"$1\\s*"))
        first = F.call_function("regexp_extract", out, loose, F.lit(0))
        at = F.instr(out, first)
        spread = F.concat(F.substring(out, F.lit(1), at - 1), x, F.substring(out, at + F.length(first), F.lit(1 << 30)))
        return F.when(exact == 1, F.replace(out, mark, x)).when((exact == 0) & (first != ""), spread)

    step = lambda out, x: F.struct((out["k"] + 1).alias("k"), put(out["t"], x["original"], out["k"]).alias("t"))
    whole = F.aggregate(s, F.struct(F.lit(0).alias("k"), t.alias("t")), step, lambda out: out["t"])
    return F.when(~whole.rlike(r"(?iU)ZXQ\s*KEEP"), normalize_spaces(whole))


def exposed(text: str | Column) -> Column:
    return col(text).rlike(r"(?iU)ZXQ\s*KEEP")
