"""Many terms at once: an automaton over a text's words, and rewriting of terms in their order. Plain Python, for use in Arrow batches."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable
from functools import lru_cache

TOKEN = re.compile(r"\w+|\W")
WORD = re.compile(r"\w+")
#: Letters that count as others where case is ignored, beyond their lower case.
_ALIKE = {ord(a): b for a, b in (("İ", "i"), ("ı", "i"), ("ſ", "s"), ("ς", "σ"), ("µ", "μ"))}
_RARE = re.compile("[" + "".join(map(chr, _ALIKE)) + "]")


def fold(text: str) -> str:
    """text in lower case, letter by letter, so that places stay what they are."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join([c if len(c.lower()) > 1 else c.lower() for c in text])
    return low if low.isascii() or not _RARE.search(low) else low.translate(_ALIKE)


def like(found: str, term: str) -> str:
    """term in capitals, or with one at its head, if found is so."""
    if found.isupper():
        return term.upper()
    return term[:1].upper() + term[1:] if found[:1].isupper() and found[1:].islower() else term


class Automaton:
    """Finds all of many terms in one pass over a text's words.

    A state is a run of words and signs that some term begins with. From each, what doesn't go on is
    looked for behind the longest of its own ends that is a state too, so a text is read once however many terms there
    are. Case is ignored. A term's ends are borders: no letter, digit or underscore goes on there. Terms without
    any character are never found.
    """

    def __init__(self, terms: Iterable[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.numbers: list[list[int]] = [[]]
        depth = [0]
        self.vocabulary: set[str] = set()
        #: A word of each term, so that most texts without any are known by their words alone.
        self.needed: set[str] = set()
        self.bare = False
        for number, term in enumerate(terms):
            tokens = TOKEN.findall(fold(term))
            words = [t for t in tokens if WORD.match(t)]
            if words:
                self.needed.add(max(words, key=len))
                self.vocabulary.update(words)
            elif tokens:
                self.bare = True
            at = 0
            for token in tokens:
                if token not in self.next[at]:
                    self.next[at][token] = len(self.next)
                    self.next.append({})
                    self.numbers.append([])
                    depth.append(depth[at] + 1)
                at = self.next[at][token]
            if at:
                self.numbers[at].append(number)
        self.length = depth
        #: Terms of one word each are looked for by those words that a text has.
        self.single = not self.bare and max(depth) == 1
        self.fail = [0] * len(self.next)
        #: The nearest shorter end of a state at which a term ends; 0 if there is none.
        self.shorter = [0] * len(self.next)
        level = list(self.next[0].values())
        while level:
            below = []
            for state in level:
                for token, child in self.next[state].items():
                    back = self.fail[state]
                    while back and token not in self.next[back]:
                        back = self.fail[back]
                    back = self.next[back].get(token, 0)
                    self.fail[child] = back
                    self.shorter[child] = back if self.numbers[back] else self.shorter[back]
                    below.append(child)
            level = below

    def found(self, text: str, after: int = -1) -> list[tuple[int, int, int]]:
        """(start, stop, number) of every place of a term with a number above after, overlapping ones too; of equal terms the smallest such number."""
        low = fold(text)
        here = () if self.bare else self.needed.intersection(WORD.findall(low))
        if not here and not self.bare:
            return []
        out: list[tuple[int, int, int]] = []
        if self.single:
            for m in _any_of(frozenset(here)).finditer(low):
                numbers = self.numbers[self.next[0][m[0]]]
                if (k := bisect_right(numbers, after)) < len(numbers):
                    out.append((m.start(), m.end(), numbers[k]))
            return out
        starts: list[int] = []
        state = 0
        root, following = self.next[0], self.next
        tokens = TOKEN.findall(low)
        place = 0
        for token in tokens:
            starts.append(place)
            place += len(token)
            if not state:
                state = root.get(token, 0)
            else:
                while state and token not in following[state]:
                    state = self.fail[state]
                state = following[state].get(token, 0)
            end = state if self.numbers[state] else self.shorter[state]
            while end:
                numbers = self.numbers[end]
                k = bisect_right(numbers, after)
                if k < len(numbers) and self._bordered(low, start := starts[-self.length[end]], place):
                    out.append((start, place, numbers[k]))
                end = self.shorter[end]
        return out

    @staticmethod
    def _bordered(low: str, start: int, stop: int) -> bool:
        return not (start and WORD.match(low[start - 1])) and not (stop < len(low) and WORD.match(low[stop]))


@lru_cache(maxsize=1024)
def _any_of(words: frozenset[str]) -> re.Pattern:
    return re.compile(rf"\b(?:{'|'.join(sorted(words))})\b")


class Terms:
    """Terms and what each becomes: every term is replaced everywhere, one term after the other in their order, in the case of what it replaces.

    What a term becomes may hold later terms, and terms may overlap, so the order counts. Where nothing of that can
    happen in a text, all places are replaced at once; else a pass of the automaton is made for each term that occurs.
    """

    def __init__(self, pairs: Iterable[tuple[str, str]]) -> None:
        pairs = [(a, b) for a, b in pairs if a]
        self.automaton = Automaton(a for a, _ in pairs)
        self.becomes = [b for _, b in pairs]
        framed = lambda x: bool(x and WORD.match(x[0]) and WORD.match(x[-1]))
        words = self.automaton.vocabulary
        self.alone = [not self.automaton.bare and framed(a) and framed(b) and words.isdisjoint(WORD.findall(fold(b))) for a, b in pairs]

    def put(self, text: str) -> tuple[str, int]:
        """text with the terms replaced, and in how many places."""
        found = self.automaton.found(text)
        if not found:
            return text, 0
        found.sort()
        if all(self.alone[k] for *_, k in found) and all(a[1] <= b[0] for a, b in zip(found, found[1:])):  # noqa: B905
            return self._at(text, found), len(found)
        total = 0
        while found:
            number = min(k for *_, k in found)
            places, end = [], 0
            for start, stop, k in found:
                if k == number and start >= end:
                    places.append((start, stop, k))
                    end = stop
            text, total = self._at(text, places), total + len(places)
            found = sorted(self.automaton.found(text, number))
        return text, total

    def _at(self, text: str, places: list[tuple[int, int, int]]) -> str:
        out, at = [], 0
        for start, stop, k in places:
            out += [text[at:start], like(text[start:stop], self.becomes[k])]
            at = stop
        return "".join([*out, text[at:]])


@lru_cache(maxsize=4)
def terms_of(pairs: tuple[tuple[str, str], ...]) -> Terms:
    """One automaton a worker, kept from task to task."""
    return Terms(pairs)


def word_needed(pattern: str) -> str | None:
    """A word that every text with a match of pattern holds whole, if the pattern's own letters show one.

    For patterns of words, alternatives in (?:), letters in [] and optional ones, without other signs.
    """
    plain = re.sub(r"\(\?:[^()]*\)\??|\[[^\]]*\][*?]?|.\?", "\0", pattern.replace(r"\b", " "))
    return max(re.findall(r"(?<![\w\0])\w+(?![\w\0])", fold(plain)), key=len, default=None)
