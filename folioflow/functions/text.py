"""Scalar text functions as Spark columns. All of them are null for null input unless they say otherwise.

Java's \\s, \\w and \\b know only ASCII without the flag (?U), which is set where it matters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and patterns that results depend on.
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
UPPER_LATIN = "A-ZÀ-ÖØ-Þ"
#: All that (?U)\\s matches, as characters to trim.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
CLOSERS = "”\"»’)"
SENTENCE_END = f"[.!?][0-9{CLOSERS}]*\\s*$"
OPENERS = " «“\"'(\\[{"
DOI = r"(?:doi\s*:\s*)?10\.\d{4,9}/\S+"
REFERENCE_HEADING = (
    r"(?:\d+(?:\.\d+)*[.)]?\s*)?(?:bibliograph(?:ie|y)|bibliografia|références?(?:\s+bibliographiques?)?|references?|"
    r"referências?(?:\s+bibliográficas?)?|works cited|obras citadas)\s*[:.]?\s*"
)
REFERENCE_START = (
    r"^((?:\d+(?:\.\d+)*[.)]?\s*)?(?:bibliograph(?:ie|y)|bibliografia|références?|references?|referências?|works cited|obras citadas))\b"
)
AFTER_REFERENCES = r"^(?:annexes?|appendices?|apêndices?|supplementary material|material suplementar)\b"
CAPTION = r"^(?:fig(?:ure|ura)?\.?|tableau|tabela|quadro)\s*\d*\b"
OPEN_WORDS = (
    "a", "au", "aux", "avec", "de", "des", "du", "et", "la", "le", "les", "ou", "par", "pour", "que", "qui", "un", "une",
    "da", "das", "do", "dos", "e", "o", "os",
)
ERROR_REPLY = (
    r"^(?:<!doctype\s+html|<html\b|<head\b|<body\b|(?:error|http)\s*[45]\d\d\b|[45]\d\d\s*\((?:server|client) error\)|"
    r"server error:|too many requests(?:[.!]|$)|our systems have detected unusual traffic|todos os motores disponíveis falharam)"
)
BULLET = r"^[•●▪◦‣*-]\s+"
MATH_SIGN = "[=⇒⇔∫∑√≤≥]"
MATH_FUNCTION = "(?:arcsin|arccos|arctan|sin|cos|tan|log|ln|exp|lim)"
MATH_VARIABLE = "[a-zA-Zα-ωΑ-Ω]"


def col(text: str | Column) -> Column:
    return F.col(text) if isinstance(text, str) else text


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value worked out once however often of names it, inside other lambdas too."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def once(text: str | Column, of: Callable[[Column], Column]) -> Column:
    """of(text), with text worked out once where it isn't a column's name."""
    return of(F.col(text)) if isinstance(text, str) else let(text, of)


def rx(text: Column, pattern: str) -> Column:
    """Whether pattern occurs in text, Unicode classes, any case where it starts with (?i)."""
    return text.rlike(f"(?U){pattern}" if not pattern.startswith("(?i)") else f"(?iU){pattern[4:]}")


def strip(text: str | Column) -> Column:
    """Without white space at both ends, NBSP and line ends included; trim() knows the blank alone."""
    return F.btrim(col(text), F.lit(WHITE))


def has_any(text: Column, parts: Iterable[str]) -> Column:
    """Whether one of parts stands in text: a search of bytes, which costs far less than a pattern."""
    return reduce(or_, [text.contains(x) for x in parts])


def normalize_spaces(text: str | Column) -> Column:
    """Soft hyphens gone, runs of blanks and tabs one blank, line ends without white space around, both ends stripped."""

    def flat(t: Column) -> Column:
        # single blanks and single line ends are as they should be: a pattern is tried only where a text holds what it starts from
        single = F.when(has_any(t, ("\t", "  ", "\xad")), F.regexp_replace(F.replace(t, F.lit("\xad"), F.lit("")), r"[ \t]{2,}|\t", " ")).otherwise(t)
        return F.when(has_any(t, ("\n", "\t", "  ", "\xad")), F.regexp_replace(single, r"(?U)\s+\n\s*|\n\s+", "\n")).otherwise(t)

    return strip(once(text, flat))


def latin_letters(text: str | Column) -> Column:
    return F.length(F.regexp_replace(col(text), f"[^{LATIN}]+", ""))


def latin_words(text: str | Column) -> Column:
    return F.regexp_count(col(text), F.lit(f"[{LATIN}]+"))


def last_word(text: str | Column) -> Column:
    """The last run of Latin letters, lower-cased; empty where there is none."""
    # tried from a run's head alone and never backwards, so that a text is read once
    return F.regexp_extract(F.lower(col(text)), f"(?<![{LATIN}])([{LATIN}]++)[^{LATIN}]*+$", 1)


def starts_lower(text: str | Column) -> Column:
    return col(text).rlike(r"^\p{Ll}")


def merge_text(a: str | Column, b: str | Column) -> Column:
    """b behind a: at a hyphen and a small letter the word is closed, else a blank stands between."""
    a, b = col(a), col(b)
    return F.when(a.endswith("-") & starts_lower(b), F.concat(F.regexp_replace(a, "-$", ""), b)).otherwise(F.concat(a, F.lit(" "), b))


def join_lines(lines: str | Column, clean: bool = False) -> Column:
    """An array of lines as running text: blank lines go, bullets start a line, hyphens at line ends close words. clean lines are normalised already."""
    kept = F.filter(col(lines) if clean else F.transform(col(lines), normalize_spaces), lambda x: x != "")
    folded = F.aggregate(
        kept, F.lit("").cast("string"),
        lambda out, x: F.when(out == "", x).when(rx(x, BULLET), F.concat(out, F.lit("\n"), x)).otherwise(merge_text(out, x)),
    )
    return normalize_spaces(folded)


def margin_key(text: str | Column) -> Column:
    """What running heads and feet have in common: lower case, numbers as #, blanks as one, marks at the ends gone."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(normalize_spaces(text)), r"(?U)\b\d+\b", "#"), r"(?U)\s+", " ")
    return F.regexp_replace(flat, r"^[ |–—\-.,;:]+|[ |–—\-.,;:]+$", "")


def cache_key(text: str | Column, source: str | Column, target: str | Column) -> Column:
    zero = F.lit("\0")
    return F.sha2(F.concat(col(source), zero, col(target), zero, col(text)), 256)


def is_noise(text: str | Column) -> Column:
    """Nothing to translate: under three Latin letters, or only a page number, address or identifier. Null is noise."""
    alone = rf"(?iU)^(?:\s*(?:page\s*)?\d+(?:\s*(?:/|of)\s*\d+)?\s*|(?:https?://|www\.)\S+|{DOI}|\S+@\S+\.\S+)$"

    def told(t: Column) -> Column:
        words = F.size(F.filter(F.split(t, r"(?U)\s+"), lambda x: x != ""))
        return ~t.rlike(f"(?s)(?:[{LATIN}][^{LATIN}]*+){{3}}") | t.rlike(alone) | (F.lower(t).contains("orcid.org/") & (words <= 3))

    return F.coalesce(let(normalize_spaces(text), told), F.lit(True))


def is_heading(text: str | Column, font: str | Column, body: str | Column) -> Column:
    """A larger font, or a short line mostly of capitals; never over 180 characters."""
    count = lambda t, others: F.length(F.regexp_replace(t, others, ""))

    def told(t: Column) -> Column:
        letters = count(t, r"\P{L}+")
        words = F.size(F.filter(F.split(t, r"(?U)\s+"), lambda x: x != ""))
        loud = (words <= 12) & (letters > 0) & (count(t, r"\P{Lu}+") / F.greatest(letters, F.lit(1)) > 0.72)
        return (t != "") & (F.length(t) <= 180) & ((col(font) > col(body) * 1.15) | loud)

    return let(normalize_spaces(text), told)


def is_standalone_math(text: str | Column) -> Column:
    """A relation or operator sign, and no letters but variables, differentials and function names."""
    f, v = MATH_FUNCTION, MATH_VARIABLE
    atom = f"^(?:{f}|{v}|d{v}|{f}?{v}d{v}|{f}{v})$"
    runs = lambda t: F.regexp_extract_all(t, F.lit(r"(?U)([^\W\d_]+)"), F.lit(1))
    return once(text, lambda t: has_any(t, MATH_SIGN.strip("[]")) & F.forall(runs(t), lambda x: x.rlike(atom)))


def is_reference_heading(first_line: str | Column, text: str | Column) -> Column:
    whole = f"(?iU)^{REFERENCE_HEADING}$"

    def short(t: Column) -> Column:
        head = F.regexp_extract(t, f"(?iU){REFERENCE_START}", 1)
        return (head != "") & (F.size(F.filter(F.split(head, r"(?U)\s+"), lambda x: x != "")) <= 3)

    if isinstance(first_line, str) and first_line == text:
        return let(normalize_spaces(text), lambda t: t.rlike(whole) | short(t))
    return normalize_spaces(first_line).rlike(whole) | let(normalize_spaces(text), short)


def ends_references(first_line: str | Column) -> Column:
    return rx(normalize_spaces(first_line), f"(?i){AFTER_REFERENCES}")


def is_caption_or_footnote(text: str | Column, font: str | Column, body: str | Column) -> Column:
    """A caption's first word, a far smaller font, or a number in front in a smaller font. A null font counts as the body's."""
    size = F.coalesce(col(font), col(body))
    return let(normalize_spaces(text), lambda t: rx(t, f"(?i){CAPTION}") | (size < col(body) * 0.82) | (rx(t, r"^\d+\s+") & (size < col(body) * 0.95)))


def looks_unfinished(text: str | Column) -> Column:
    def told(t: Column) -> Column:
        ends = rx(t, f"[.!?][{CLOSERS}]*$")
        stops = rx(t, f"[.;!?][{CLOSERS}]*$")
        return (F.length(t) >= 35) & (t.endswith("-") | (~ends & (~stops | last_word(t).isin(*OPEN_WORDS))))

    return let(normalize_spaces(text), told)


def begins_as_continuation(text: str | Column) -> Column:
    t = F.regexp_replace(normalize_spaces(text), f"^[{OPENERS}—–-]+", "")
    return let(t, lambda t: starts_lower(t) | t.rlike(r"^[,;:)\]]"))


def is_error_reply(text: str | Column) -> Column:
    """An error page or message of a translation service in place of a translation; false for null."""
    return F.coalesce(rx(strip(text), f"(?i){ERROR_REPLY}"), F.lit(False))


def is_valid_translation(text: str | Column) -> Column:
    return F.coalesce(strip(text) != "", F.lit(False)) & ~is_error_reply(text)


def copy_case(source: str | Column, word: str | Column) -> Column:
    """word in capitals or with a capital as source is; else as it stands."""
    s, w = col(source), col(word)
    cased = s.rlike(r"[\p{Lu}\p{Ll}]")
    title = s.rlike(r"^\p{Lu}") & (F.substring(s, 2, 1 << 30) == F.lower(F.substring(s, 2, 1 << 30))) & s.rlike(r"^.[^\p{Ll}]*\p{Ll}")
    return F.when(cased & (s == F.upper(s)), F.upper(w)).when(title, F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))).otherwise(w)


def first_line(lines: str | Column, text: str | Column) -> Column:
    """The first of an array of lines, or what stands before text's first line end where there is none."""
    first = F.when(F.size(col(lines)) > 0, F.element_at(col(lines), 1)).otherwise(F.element_at(F.split(col(text), "\n"), 1))
    return normalize_spaces(first)


def is_complete(source: str | Column, target: str | Column) -> Column:
    """Whether target has words enough for source: no demand under 9 words, 30 % from there on, 48 % from 18 on."""
    n, m = latin_words(source), latin_words(target)
    least = F.when(n >= 18, 0.48).when(n >= 9, 0.30)
    return F.coalesce(m / F.greatest(n, F.lit(1)) >= least, F.lit(True))


def output_name(path: str | Column, target: str | Column) -> Column:
    """The file name with _traduzido_ and the language before the suffix."""
    return F.concat(F.regexp_replace(col(path), r"(\.[^./]*)?$", ""), F.lit("_traduzido_"), col(target), F.regexp_extract(col(path), r"(\.[^./]*)$", 1))
