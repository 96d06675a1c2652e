"""Splitting of texts: into requests of bounded size, and into sentences."""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import UPPER_LATIN, col, let, normalize_spaces, strip

#: Most characters of one request, and most of its form-encoded length.
REQUEST_CHARS, ENCODED_CHARS = 3500, 5500
#: Characters that form encoding leaves as one.
PLAIN = "A-Za-z0-9_.~ -"
_NOT_PLAIN = {k: None for k in range(128) if not re.match(f"[{PLAIN}]", chr(k))}
_STOP = re.compile(r"[.!?;:]\s+")
_OPENING = f"{UPPER_LATIN}0-9“\"("


def encoded_length(text: str | Column) -> Column:
    """Length of a text as a form value: plain characters count one, all others three for each byte."""
    plain = F.length(F.regexp_replace(col(text), f"[^{PLAIN}]+", ""))
    return plain + 3 * (F.octet_length(col(text)) - plain)


def pieces_of(text: str, limit: int) -> list[str]:
    """A normalised text parted greedily: behind the last sentence end or blank of what fits, if that is past its half."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    plain = np.isin(codes, np.frombuffer("".join(map(chr, range(128))).translate(_NOT_PLAIN).encode("utf-32-le"), "<u4"))
    sizes = [0, *np.cumsum(np.where(plain, 1, 3 * (1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)))).tolist()]
    out, start = [], 0
    while start < len(text):
        stop = max(start + 1, min(start + limit, bisect_right(sizes, sizes[start] + ENCODED_CHARS) - 1))
        if stop < len(text):
            ends = [m.end() for m in _STOP.finditer(text, start, stop)]
            cut = ends[-1] if ends else text.rfind(" ", start, stop)
            if cut - start >= (stop - start) / 2:
                stop = cut
        if part := text[start:stop].strip():
            out.append(part)
        while stop < len(text) and text[stop].isspace():
            stop += 1
        start = stop
    return out


def split_text(text: str | Column, limit: int = REQUEST_CHARS) -> Column:
    """Array of the parts of a text, each within limit characters and the encoded length. Only texts that need it go through Python; empty and null ones have no part."""
    if not isinstance(limit, int) or limit < 20:
        raise ValueError("the limit has to be a whole number of 20 or more")

    @F.pandas_udf("array<string>")
    def parted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else pieces_of(t, limit))

    # a text whose bytes count three each and still fit needs no closer look
    sized = lambda t: (F.length(t) <= limit) & ((3 * F.octet_length(t) <= ENCODED_CHARS) | (encoded_length(t) <= ENCODED_CHARS))
    found = let(normalize_spaces(text), lambda t: F.struct(t.alias("t"), sized(t).alias("fits")))
    none = F.array().cast("array<string>")
    whole = let(found, lambda x: F.when(F.coalesce(x["t"], F.lit("")) == "", none).when(x["fits"], F.array(x["t"])))
    return F.coalesce(whole, parted(let(found, lambda x: F.when(~x["fits"], x["t"]))))


def sentences(text: str | Column, bullets: bool = False) -> Column:
    """Array of sentences: parted at white space behind . ! ? before a capital, a digit, a quote or a parenthesis, or a bullet if so asked.

    With bullets, sentences are stripped and empty ones go, but one always stays.
    """
    opening = _OPENING + ("•●▪◦‣" if bullets else "")
    parts = F.split(strip(text) if bullets else col(text), rf"(?U)(?<=[.!?])\s+(?=[{opening}])")
    if not bullets:
        return parts
    kept = F.filter(F.transform(parts, strip), lambda x: x != "")
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(strip(text)))
