"""The language of a unit: hints of headings, a count of function words, and the document's language where these don't tell.

A model can stand in for the count: whatever gives an array of structs (code, score) does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import col, let, normalize_spaces

# First words of a heading that tell the language.
HEADING_HINTS = {
    "en": ("abstract", "keywords", "key words"),
    "fr": ("résumé", "resume", "mots-clés", "mots cles"),
    "it": ("riassunto", "parole chiave"),
    "pt": ("resumo", "palavras-chave", "palavras chave"),
    "es": ("resumen", "palabras clave"),
    "de": ("zusammenfassung", "schlüsselwörter", "schlusselworter"),
}
#: Frequent function words, few of them shared.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on are as with his they at be this from have or by not but what were we when your which their will",
    "fr": "le la les de des du et est une un dans que qui pour pas sur avec ce cette il elle nous vous sont au aux par plus ne se ou mais où",
    "it": "il lo la gli le di della delle dei e è una un che per non con sono nel nella si da come anche più ma questo questa alla degli",
    "es": "el la los las de del y es una un que en por para no con se su lo como más pero sus al este esta son entre cuando muy sin",
    "pt": "o a os as de do da dos das e é uma um que em para não com se no na por mais como mas ao foi são pelo pela",
    "de": "der die das und ist ein eine in den von zu mit sich des auf für nicht dem als auch es an werden aus er hat dass sie nach wird bei",
}
#: Most characters of a text that are looked at, as by a language model.
SAMPLE_CHARS = 15_000
Scores = Callable[[Column, list[str]], Column]


def letters(text: str | Column) -> Column:
    return F.length(F.regexp_replace(col(text), r"\P{L}+", ""))


def _among(listed: list[str]) -> Callable[[Column], Column]:
    return lambda w: w.isin(*listed)


def word_scores(text: Column, codes: list[str]) -> Column:
    """Array of (code, score) in the order of codes: the share of each language's function words in those of all of them, smoothed by one."""
    words = F.regexp_extract_all(F.lower(F.substring(text, 1, SAMPLE_CHARS)), F.lit(r"\p{L}+"), F.lit(0))
    counts = let(words, lambda w: F.array(*[F.size(F.filter(w, _among(FUNCTION_WORDS.get(k, "").split()))) for k in codes]))
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, b: a + b)
    of = lambda c, n, k: F.struct(F.get(F.array(*map(F.lit, codes)), k).alias("code"), ((n + 1.0 / len(codes)) / (total(c) + 1)).alias("score"))
    return let(counts, lambda c: F.transform(c, lambda n, k: of(c, n, k)))


def best(scores: Column) -> Column:
    """The struct of the highest score, the first of equals."""
    start = F.lit(None).cast("struct<code:string,score:double>")
    return F.aggregate(scores, start, lambda a, b: F.when(a.isNull() | (b["score"] > a["score"]), b).otherwise(a))


def heading_hint(text: str | Column, codes: list[str]) -> Column:
    """The first of codes, in their order, of which a hint starts the text behind its numbering; else null."""
    return _hint(normalize_spaces(text), codes)


def _hint(clean: Column, codes: list[str]) -> Column:
    def told(t: Column) -> Column:
        out = F.lit(None).cast("string")
        for k in reversed(codes):
            if k in HEADING_HINTS:
                out = F.when(t.rlike(f"^(?:{'|'.join(HEADING_HINTS[k])})"), F.lit(k)).otherwise(out)
        return out

    return let(F.regexp_replace(F.lower(clean), r"^[0-9.:\-–—()\[\] ]+", ""), told)


def unit_language(text: str | Column, codes: list[str], dominant: str | Column, scores: Scores = word_scores, clean: bool = False) -> Column:
    """Struct (code, score, reason) of a unit. Short or unsure ones have the document's language, dominant.

    Accepted are scores from 0.80 on with 40 letters, from 0.96 on with 15; below 8 letters nothing is
    asked. Null texts count as empty. A clean text is normalised already.
    """
    of = lambda code, score, reason: F.struct(code.alias("code"), score.alias("score"), F.lit(reason).alias("reason"))
    main = F.lit(dominant) if isinstance(dominant, str) and len(dominant) == 2 else col(dominant)

    def told(x: Column) -> Column:
        n, hint, top = x["n"], x["hint"], x["top"]
        sure = ((n >= 40) & (top["score"] >= 0.80)) | ((n >= 15) & (top["score"] >= 0.96))
        return (
            F.when(hint.isNotNull(), of(hint, F.lit(1.0), "cabecalho"))
            .when(n < 8, of(main, F.lit(None).cast("double"), "predominante_texto_curto"))
            .when(sure, of(top["code"], top["score"], "estatistica_trecho"))
            .otherwise(of(main, top["score"], "predominante_baixa_confianca"))
        )

    facts = lambda t: F.struct(letters(t).alias("n"), _hint(t, codes).alias("hint"), best(scores(t, codes)).alias("top"))
    return let(let(col(text) if clean else normalize_spaces(F.coalesce(col(text), F.lit(""))), facts), told)
