"""Translation models behind one interface, asked for different parts of texts in batches.

A stage takes a text apart into parts that fit its model, runs of words or of tokens, and is asked for
parts. What becomes of parts that fail is a plan's work: operators.recovery.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd

# Share of the source's words that a translation has to have, by the source's words.
LEAST_SHARES = ((18, 0.48), (9, 0.30))
#: Tokens of a part at most, parts asked for at a time, and the first beam.
MOST_TOKENS, BATCH, BEAM = 220, 8, 4
#: Tries for a part that fails, and how often it is halved.
TRIES, DEPTH = 10, 3
_WORDS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_SENTENCES = re.compile(r"(?<=[.!?])\s+(?=[A-ZÀ-ÖØ-Þ0-9“\"(•●▪◦‣])")


class Model(Protocol):
    """What a whole-text model has: as many translations as texts, and the number of a text's tokens, which grows with it."""

    label: str

    def translate(self, texts: list[str], source: str, target: str, beam: int) -> list[str]: ...

    def count_tokens(self, text: str) -> int: ...


class Parts(Protocol):
    """What a stage is made of. ask gives None for a part that isn't translated in full; other faults are exceptions."""

    def split(self, text: str) -> list[list[str]]: ...

    def ask(self, parts: list[list[str]], source: str, target: str, beam: int) -> list[str | None]: ...


class ChunkError(ValueError):
    """A part that the model did not translate in full."""


def complete(source: str, target: str) -> bool:
    """Whether target has words enough for source."""
    n = len(_WORDS.findall(source))
    least = next((share for words, share in LEAST_SHARES if n >= words), 0.0)
    return bool(target.strip()) and len(_WORDS.findall(target)) >= least * n


def fitting(words: list[str], model: Model, most: int) -> int:
    """How many first words fit, one at least: tokens grow with words, so the place is searched by halves."""
    return max(1, bisect_right(range(1, len(words) + 1), most, key=lambda k: model.count_tokens(" ".join(words[:k]))))


def packed(text: str, model: Model, most: int) -> list[list[str]]:
    """The words of a text's sentences, those with more tokens than most parted where they are full."""
    out = []
    for sentence in _SENTENCES.split(text.strip()):
        words = sentence.split()
        while words:
            k = fitting(words, model, most)
            out.append(words[:k])
            words = words[k:]
    return out


class WordParts:
    """A whole-text model asked for runs of words."""

    def __init__(self, model: Model, most_tokens: int) -> None:
        self.model, self.most_tokens = model, most_tokens

    def split(self, text: str) -> list[list[str]]:
        return packed(text, self.model, self.most_tokens)

    def ask(self, parts: list[list[str]], source: str, target: str, beam: int) -> list[str | None]:
        texts = [" ".join(p) for p in parts]
        found = self.model.translate(texts, source, target, beam)
        if len(found) != len(texts):
            raise RuntimeError("the model gave back another number of texts")
        return [y.strip() if complete(x, y) else None for x, y in zip(texts, found, strict=True)]


_made: dict[str, Parts] = {}

PARTS = "key string, lang string, nth int, units array<string>, error string"
ANSWERS = "key string, nth int, path string, lang string, units array<string>, value string, error string, again boolean"
Frames = Iterator[pd.DataFrame]
#: Between units of a part that is one text, and before a part that had to be JSON for that.
BETWEEN, ODD = "\0", "\1"


def apart(text: str) -> list[str]:
    """The units of a part that operators.recovery.together made one text."""
    return json.loads(text[1:]) if text.startswith(ODD) else text.split(BETWEEN)


@dataclass(frozen=True)
class Stage:
    """One model or package of a runner. make is called once a worker, what it gives is kept by name. tries are each part's own, or shared by all parts of a text."""

    name: str
    make: Callable[[], Parts]
    on_words: bool = True
    tries: int = TRIES
    depth: int = DEPTH
    shared: bool = False
    batch: int = BATCH
    beam: int = BEAM

    def made(self) -> Parts:
        if self.name not in _made:
            _made[self.name] = self.make()
        return _made[self.name]

    def split(self, frames: Frames) -> Frames:
        """For mapInPandas over (key, lang, text): PARTS in order, or one row with an error."""
        for frame in frames:
            out = []
            for key, lang, text in zip(frame["key"], frame["lang"], frame["text"], strict=True):
                try:
                    parts, error = self.made().split(text), None
                except Exception as e:  # a model's own errors are of any kind, and are the row's result
                    parts, error = [], f"{type(e).__name__}: {e}"
                if not parts:
                    out.append((key, lang, 0, None, error or "ChunkError: the text has no parts"))
                out += [(key, lang, k, p, None) for k, p in enumerate(parts)]
            yield pd.DataFrame(out, columns=["key", "lang", "nth", "units", "error"])

    def answers(self, parts: list[list[str]], lang: str, target: str, beam: int) -> list[tuple[str | None, str | None, bool]]:
        """(value, error, again) of each part; where asking for several fails, each is asked for alone."""
        try:
            found = self.made().ask(parts, lang, target, beam)
            return [(v, None, False) if v is not None else (None, "ChunkError: not translated in full", True) for v in found]
        except Exception as e:  # as above
            if len(parts) == 1:
                return [(None, f"{type(e).__name__}: {e}", isinstance(e, ChunkError))]
        return [x for p in parts for x in self.answers([p], lang, target, beam)]

    def asker(self, target: str, beam: int) -> Callable[[Frames], Frames]:
        """For mapInPandas over (key, nth, path, lang, part, error), equal parts, each as one text, one behind the other: ANSWERS, each different part asked for once.

        A part that fails is a row, never a failed task. units are given back only of parts that may be asked for again. Rows that have an error keep it.
        """

        def ask(frames: Frames) -> Frames:
            last: dict[tuple, tuple] = {}  # the part that the frame before ended with
            for frame in frames:
                for lang, rows in frame.groupby("lang", sort=False, dropna=False):
                    parts = rows["part"].tolist()
                    known = {p: last[lang, p] for p in parts[:1] if (lang, p) in last} | {None: (None, None, False)}
                    new = [p for p in dict.fromkeys(parts) if p not in known]
                    units = {p: apart(p) for p in new}
                    found = [x for k in range(0, len(new), self.batch) for x in self.answers([units[p] for p in new[k : k + self.batch]], lang, target, beam)]
                    known |= dict(zip(new, found, strict=True))
                    each = [known[p] for p in parts]
                    last = {(lang, parts[-1]): each[-1]}
                    failed = [(units.get(p) or apart(p)) if x[2] else None for p, x in zip(parts, each, strict=True)]
                    why = [e if p is None else x[1] for p, e, x in zip(parts, rows["error"], each, strict=True)]
                    yield rows[["key", "nth", "path", "lang"]].assign(units=failed, value=[x[0] for x in each], error=why, again=[x[2] for x in each])

        return ask


@dataclass(frozen=True)
class Runner:
    """The stages that a text goes through, one after the other. namespace is what keys of a cache begin with."""

    stages: tuple[Stage, ...]
    target: str
    namespace: str


def runner(name: str, make: Callable[[], Model], target: str, max_tokens: int = MOST_TOKENS, known: str | None = None, **more: object) -> Runner:
    """A whole-text model as a runner; known is its namespace, by default its name. more goes to its stage."""
    return Runner((Stage(f"{name}|{max_tokens}", lambda: WordParts(make(), max_tokens), **more),), target, known or name)


class LexicalModel:
    """A deterministic stand-in, no translator: words of a small table are replaced, all else stays, markers too."""

    label = "stand-in"
    # A few words, so that results differ from their sources.
    TABLE = {"the": "o", "of": "de", "and": "e", "is": "é", "in": "em", "le": "o", "la": "a", "les": "os", "et": "e", "der": "o", "die": "a", "und": "e", "el": "o", "los": "os", "y": "e"}

    def translate(self, texts: list[str], source: str, target: str, beam: int) -> list[str]:
        return [re.sub(r"\w+", lambda m: self.TABLE.get(m[0].lower(), m[0]), t) for t in texts]

    def count_tokens(self, text: str) -> int:
        return len(text.split())


class SeqModel:
    """A CTranslate2 model with SentencePiece pieces, from a directory; loaded on first use, on a worker that has the package."""

    def __init__(self, path: str, max_output: int = 512, threads: int = 1, prefix: str = "") -> None:
        import ctranslate2
        import sentencepiece

        self.label, self.max_output, self.prefix = f"local:{path.rstrip('/').rsplit('/', 1)[-1]}", max_output, prefix
        self.model = ctranslate2.Translator(f"{path}/model", intra_threads=threads)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=f"{path}/sentencepiece.model")

    def translate(self, texts: list[str], source: str, target: str, beam: int) -> list[str]:
        rows = [self.pieces.encode(t, out_type=str) for t in texts]
        start = [[self.prefix]] * len(rows) if self.prefix else None
        found = self.model.translate_batch(rows, target_prefix=start, beam_size=beam, length_penalty=1.0, max_decoding_length=self.max_output)
        out = []
        for result in found:
            tokens = result.hypotheses[0]
            full = not tokens or len(tokens) >= self.max_output
            out.append("" if full else self.pieces.decode([t for t in tokens if t != self.prefix]))
        return out

    def count_tokens(self, text: str) -> int:
        return len(self.pieces.encode(text))


def namespace(backend: str, metadata: object, precision: str, beam: int | None = None) -> str:
    """What cache keys of a model begin with: another model, precision or beam is another namespace."""
    known = json.dumps([backend, metadata, precision, beam], sort_keys=True, ensure_ascii=False)
    return f"{backend}-{hashlib.sha256(known.encode()).hexdigest()[:16]}"
