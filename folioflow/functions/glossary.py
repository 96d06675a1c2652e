"""Terms put right after translation: rules of a profile by source language, and a user's own pairs."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.portuguese import TEXTS
from folioflow.functions.terms import WORD, fold, like, terms_of, word_needed
from folioflow.functions.text import col

# By source language, what the source says, what a translation then may say, and what it
# should say. Rules apply one after the other, in this order.
FRENCH = (
    (r"\bdidactique des mathématiques\b", (r"\bo ensino (?:de|da) matemática\b",), "a didática da matemática"),
    (r"\bdidactique des mathématiques\b", (r"\bensino (?:de|da) matemática\b", r"\bdidática (?:de|das) matemáticas?\b", r"\bdidática matemática\b"), "didática da matemática"),
    (r"\bsituations didactiques de recherche de problèmes\b", (r"\bsituações (?:pedagógicas|didáticas) de (?:pesquisa|investigação) de problemas\b",), "situações didáticas de pesquisa de problemas"),
    (r"\bsituation didactique de recherche de problèmes\b", (r"\bsituação (?:pedagógica|didática) de (?:pesquisa|investigação) de problemas\b",), "situação didática de pesquisa de problemas"),
    (r"\bsituations didactiques\b", (r"\bsituações pedagógicas\b",), "situações didáticas"),
    (r"\bsituation didactique\b", (r"\bsituação pedagógica\b",), "situação didática"),
    (r"\bactivités didactiques\b", (r"\batividades (?:pedagógicas|didáticas)\b",), "atividades didáticas"),
    (r"\bactivité didactique\b", (r"\batividade (?:pedagógica|didática)\b",), "atividade didática"),
    (r"\bactivités d[’']enseignement\b", (r"\batividades (?:docentes|pedagógicas|de ensino)\b",), "atividades de ensino"),
    (r"\bactivité d[’']enseignement\b", (r"\batividade (?:docente|pedagógica|de ensino)\b",), "atividade de ensino"),
    (r"\beffet [«\" ]*jourdain\b", (r"\befeit[oa] (?:Jordan|Jordão|Jourdain)\b",), "efeito Jourdain"),
    (r"\bglissement métadidactique\b", (r"\b(?:desvio|deslize|deslizamento) metadidático\b",), "deslizamento metadidático"),
    (r"\bsituations a-?didactiques\b", (r"\bsituações a-?didáticas\b", r"\bsituações adidáticas\b"), "situações adidáticas"),
    (r"\bsituation a-?didactique\b", (r"\bsituação a-?didática\b", r"\bsituação adidática\b"), "situação adidática"),
    (r"\bsituation fondamentale\b", (r"\bsituação (?:básica|fundamental)\b",), "situação fundamental"),
    (r"\bsituations fondamentales\b", (r"\bsituações (?:básicas|fundamentais)\b",), "situações fundamentais"),
    (r"\btransposition didactique\b", (r"\btransposição didática\b",), "transposição didática"),
    (r"\bcontrat didactique\b", (r"\bcontrato (?:de ensino|docente|didático)\b",), "contrato didático"),
    (r"\bsavoir savant\b", (r"\b(?:conhecimento|saber) (?:erudito|científico|sábio)\b",), "saber sábio"),
    (r"\bsavoirs? et (?:les )?connaissances?\b", (r"\b(?:os )?conhecimentos e (?:os )?conhecimentos\b",), "os saberes e os conhecimentos"),
    (r"\bconnaissances? et (?:les )?savoirs?\b", (r"\b(?:os )?conhecimentos e (?:os )?conhecimentos\b",), "os conhecimentos e os saberes"),
    (r"\bénoncés\b", (r"\bas (?:afirmações|declarações)\b",), "os enunciados"),
    (r"\bénoncés\b", (r"\bafirmações\b", r"\bdeclarações\b"), "enunciados"),
    (r"\bénoncé\b", (r"\ba (?:afirmação|declaração)\b",), "o enunciado"),
    (r"\bénoncé\b", (r"\bafirmação\b", r"\bdeclaração\b"), "enunciado"),
    (r"\bdécroissance\b", (r"\ba (?:descreção|descrição|diminuição)\b",), "o decrescimento"),
    (r"\bdécroissance\b", (r"\b(?:descreção|descrição|diminuição)\b",), "decrescimento"),
    (r"\bmathématisation verticale\b", (r"\b(?:matemática|matematização) vertical\b",), "matematização vertical"),
    (r"\brétroactions\b", (r"\bfeedbacks?\b",), "retroações"),
    (r"\brétroaction\b", (r"\bfeedback\b",), "retroação"),
    (r"\bmilieux\b", (r"\bos ambientes\b",), "os meios"),
    (r"\bmilieux\b", (r"\bambientes\b",), "meios"),
    (r"\bmilieu\b", (r"\bo ambiente\b",), "o meio"),
    (r"\bmilieu\b", (r"\bambiente\b",), "meio"),
    (r"\bmaître\b", (r"\b(?:capitão|mestre)\b",), "professor"),
    (r"\bjeux principaux du maître\b", (r"\b(?:desafios|jogos) (?:principais )?do capitão\b",), "jogos principais do professor"),
    (r"\brecherche de problèmes\b", (r"\binvestigação de problemas\b",), "pesquisa de problemas"),
    (r"\bpreuves\b", (r"\bevidências\b",), "provas"),
    (r"\bpreuve\b", (r"\bevidência\b",), "prova"),
    (r"\bhyposystèmes?\b", (r"\bhipó[ -]?sistemas?\b", r"\bhipossistemas?\b"), "hipossistemas"),
    (r"\bde plus en plus nombreux\b", (r"\bcada vez mais breves\b", r"\bcada vez mais numerosos\b"), "cada vez mais numerosos"),
)
ITALIAN = (
    (r"\bsituazioni didattiche\b", (r"\bsituações pedagógicas\b",), "situações didáticas"),
    (r"\bsituazione didattica\b", (r"\bsituação pedagógica\b",), "situação didática"),
)
ENGLISH = (
    (r"\bdidactical situations\b", (r"\bsituações pedagógicas\b",), "situações didáticas"),
    (r"\bdidactical situation\b", (r"\bsituação pedagógica\b",), "situação didática"),
)
PROFILES = {"didatica_matematica": {"fr": FRENCH, "it": ITALIAN, "en": ENGLISH}}


class Profile:
    """The rules of a profile for one source language. A source's words tell which rules can apply at all; only those look at it."""

    def __init__(self, rules: tuple) -> None:
        self.rules = [(word_needed(says), re.compile(says, re.I), [re.compile(o, re.I) for o in options], term) for says, options, term in rules]

    def put(self, source: str, target: str) -> tuple[str, int]:
        """target with the first match of each rule's first option that has one replaced, and how many were."""
        words, total = set(WORD.findall(fold(source))), 0
        for needed, says, options, term in self.rules:
            if (needed is None or needed in words) and says.search(source):
                match = next((m for o in options if (m := o.search(target))), None)
                if match:
                    target = target[: match.start()] + like(match[0], term) + target[match.end() :]
                    total += 1
        return target, total


@lru_cache(maxsize=4)
def profile_of(name: str) -> dict[str, Profile]:
    return {lang: Profile(rules) for lang, rules in PROFILES[name].items()}


def has_terms(lang: str | Column, profile: str | None = None, custom: dict[str, str] | None = None) -> Column:
    """Whether glossary asks for a source in the language."""
    return F.lit(True) if custom else F.coalesce(col(lang).isin(*PROFILES[profile]), F.lit(False)) if profile else F.lit(False)


def glossary(source: str | Column, target: str | Column, lang: str | Column, profile: str | None = None, custom: dict[str, str] | None = None) -> Column:
    """Struct (text, n): target with terms put right, and how often. Null targets stay null.

    A profile's rules come first, then the user's own terms, each in their order. All of the user's terms are found by
    one automaton, so a text is read once for any number of them; it is made once a worker. Rows of languages
    without rules go through Python only if there are terms of the user's. A few texts at once are Python objects.
    """
    own = tuple((custom or {}).items())
    t, code = col(target), col(lang)
    if not profile and not own:
        return F.struct(t.alias("text"), F.lit(0).alias("n"))

    @F.arrow_udf("struct<text:string,n:int>")
    def rewritten(sources: pa.Array, texts: pa.Array, langs: pa.Array) -> pa.Array:
        by_lang, terms = profile_of(profile) if profile else {}, terms_of(own)

        def one(source: str | None, text: str | None, lang: str | None) -> tuple[str | None, int]:
            if text is None:
                return None, 0
            text, n = by_lang[lang].put(source or "", text) if lang in by_lang else (text, 0)
            text, more = terms.put(text)
            return text, n + more

        parts = [pa.StructArray.from_arrays([pa.array([], pa.string()), pa.array([], pa.int32())], ["text", "n"])]
        for k in range(0, len(texts), TEXTS):
            found = [one(*row) for row in zip(*(c.slice(k, TEXTS).to_pylist() for c in (sources, texts, langs)), strict=True)]
            parts.append(pa.StructArray.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([n for _, n in found], pa.int32())], ["text", "n"]))
        return pa.concat_arrays(parts)

    if own:
        return rewritten(col(source), t, code)
    touched = F.coalesce(code.isin(*PROFILES[profile]), F.lit(False))
    found = rewritten(F.when(touched, col(source)), F.when(touched, t), code)
    return F.when(touched, found).otherwise(F.struct(t.alias("text"), F.lit(0).alias("n")))
