"""Pieces of DuckDB SQL that state the text functions once more, for comparison.

RE2 knows neither Unicode white space nor Unicode word borders, so both are written out.
"""

from __future__ import annotations

from folioflow.functions import text as tx

S = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NS = S.replace("[", "[^", 1)


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """A pattern of the text functions as RE2 has it: white space written out."""
    return pattern.replace(r"\s", S).replace(r"\S", NS)


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(re2(pattern))})"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{S}+|{S}+$')}, '', 'g')"


def norm(x: str) -> str:
    flat = f"regexp_replace(replace({x}, chr(173), ''), '[ \\t]+', ' ', 'g')"
    return strip(f"regexp_replace({flat}, {q(f'{S}*\\n{S}*')}, chr(10), 'g')")


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(re2(pattern))}))"


def letters(x: str) -> str:
    return count(x, f"[{tx.LATIN}]")


def words(x: str) -> str:
    return count(x, f"[{tx.LATIN}]+")


def tokens(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, {q(S + '+')}), lambda w: w <> ''))"


def noise(x: str) -> str:
    """Of normalised text."""
    alone = [matches(x, r"(?i)^\s*(?:page\s*)?\d+(?:\s*(?:/|of)\s*\d+)?\s*$"), matches(x, r"(?i)^(?:https?://|www\.)\S+$"), matches(x, rf"(?i)^{tx.DOI}$"), f"(contains(lower({x}), 'orcid.org/') AND {tokens(x)} <= 3)", matches(x, r"^\S+@\S+\.\S+$")]
    return f"coalesce({letters(x)} < 3 OR {' OR '.join(alone)}, true)"


def last_word(x: str) -> str:
    return f"regexp_extract(lower({x}), {q(f'([{tx.LATIN}]+)[^{tx.LATIN}]*$')}, 1)"


def margin_key(x: str) -> str:
    """Of normalised text. Digits next to Latin letters are no numbers of their own."""
    low = f"lower({x})"
    marked = f"regexp_replace({low}, {q(f'(^|[^0-9_{tx.LATIN}])[0-9]+([^0-9_{tx.LATIN}]|$)')}, '\\1#\\2', 'g')"
    twice = f"regexp_replace({marked}, {q(f'(^|[^0-9_{tx.LATIN}])[0-9]+([^0-9_{tx.LATIN}]|$)')}, '\\1#\\2', 'g')"
    return f"regexp_replace(regexp_replace({twice}, {q(S + '+')}, ' ', 'g'), '^[ |–—\\-.,;:]+|[ |–—\\-.,;:]+$', '', 'g')"


def heading(x: str, font: str, body: str) -> str:
    capitals, all_letters = count(x, r"\p{Lu}"), count(x, r"\p{L}")
    return f"({x} <> '' AND length({x}) <= 180 AND ({font} > {body} * 1.15 OR ({tokens(x)} <= 12 AND {all_letters} > 0 AND {capitals} / greatest({all_letters}, 1) > 0.72)))"


def reference_heading(first: str, x: str) -> str:
    head = f"regexp_extract({x}, {q(re2('(?i)' + tx.REFERENCE_START))}, 1)"
    return f"({matches(first, f'(?i)^{tx.REFERENCE_HEADING}$')} OR ({head} <> '' AND {tokens(head)} <= 3))"


def caption(x: str, font: str, body: str) -> str:
    return f"({matches(x, f'(?i){tx.CAPTION}')} OR {font} < {body} * 0.82 OR ({matches(x, r'^\d+\s+')} AND {font} < {body} * 0.95))"


def unfinished(x: str) -> str:
    listed = ", ".join(q(w) for w in tx.OPEN_WORDS)
    ends, stops = matches(x, f"[.!?][{tx.CLOSERS}]*$"), matches(x, f"[.;!?][{tx.CLOSERS}]*$")
    return f"(length({x}) >= 35 AND ({x} LIKE '%-' OR (NOT {ends} AND (NOT {stops} OR {last_word(x)} IN ({listed})))))"


def begins(x: str) -> str:
    t = f"regexp_replace({x}, {q(f'^[{tx.OPENERS}—–-]+')}, '')"
    return f"(regexp_matches({t}, '^\\p{{Ll}}') OR regexp_matches({t}, '^[,;:)\\]]'))"


def merge(a: str, b: str) -> str:
    return f"CASE WHEN {a} LIKE '%-' AND regexp_matches({b}, '^\\p{{Ll}}') THEN concat(left({a}, length({a}) - 1), {b}) ELSE concat({a}, ' ', {b}) END"


def join_lines(lines: str) -> str:
    kept = f"list_filter(list_transform({lines}, lambda l: {norm('l')}), lambda l: l <> '')"
    step = f"CASE WHEN acc = '' THEN x WHEN {matches('x', tx.BULLET)} THEN concat(acc, chr(10), x) ELSE {merge('acc', 'x')} END"
    return norm(f"list_reduce(list_prepend('', {kept}), lambda acc, x: {step})")


def error_reply(x: str) -> str:
    return f"coalesce({matches(strip(x), f'(?i){tx.ERROR_REPLY}')}, false)"


def valid(x: str) -> str:
    return f"(coalesce({strip(x)} <> '', false) AND NOT {error_reply(x)})"
