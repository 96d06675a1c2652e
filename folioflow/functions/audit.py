"""Doubts about a translation, as codes with messages: they recommend a review and never block."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions import portuguese, protect
from folioflow.functions import text as tx

# Words that no sentence ends with; terms of a source that a translation must not render so.
END_WORDS = ("a", "as", "com", "como", "da", "das", "de", "do", "dos", "e", "em", "na", "nas", "no", "nos", "o", "os", "para", "por", "que", "se", "um", "uma")
SUSPECT_TERMS = (
    (r"\bmaître\b", r"\bcapitão\b", "maître foi traduzido como capitão"),
    (r"\bdécroissance\b", r"\b(?:descreção|descrição)\b", "décroissance exige decrescimento"),
    (r"\beffet\s+jourdain\b", r"\befeit[oa]\s+(?:jordão|jordan)\b", "manter efeito Jourdain"),
    (r"\bmathématisation verticale\b", r"\bmatemática vertical\b", "usar matematização vertical"),
)
SENTENCE_STOP = f"[.!?][{tx.CLOSERS}]*$"


def _flag(code: str, message: Column, when: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(code).alias("code"), message.alias("message")))


def audit(source: str | Column, target: str | Column, lang: str | Column, technical: bool = True) -> Column:
    """Array of structs (code, message), each code once at most; empty for a translation without doubts.

    Null texts count as empty. technical=False leaves out the search for altered technical elements.
    """
    empty = lambda x: tx.normalize_spaces(F.coalesce(tx.col(x), F.lit("")))
    elements = F.transform(protect.protected(empty(source)), lambda x: x["original"]) if technical else F.lit(None).cast("array<string>")
    both = F.struct(empty(source).alias("s"), empty(target).alias("t"), elements.alias("elements"))
    return tx.let(both, lambda p: _flags(p["s"], p["t"], tx.col(lang), p["elements"] if technical else None))


def _flags(s: Column, t: Column, lang: Column, elements: Column | None) -> Column:
    """audit() of normalised texts, the source's technical elements among them if they are to be looked for."""
    counts = F.struct(tx.latin_words(s).alias("n"), tx.latin_words(t).alias("m"), tx.last_word(s).alias("s_last"), tx.last_word(t).alias("t_last"), tx.rx(s, SENTENCE_STOP).alias("s_stops"))
    shape = tx.let(counts, lambda c: _shape_flags(s, t, c))
    european = lambda words: _flag(
        "portugues_europeu",
        F.when(F.size(words) > 0, F.concat(F.lit("Forma não brasileira: "), F.array_join(words, ", "))).otherwise(F.lit("Construção progressiva de português europeu ainda presente.")),
        (F.size(words) > 0) | portuguese.has_progressive(t),
    )
    suspect = F.lit(None).cast("string")
    for says, renders, message in reversed(SUSPECT_TERMS):
        suspect = F.when(tx.rx(s, f"(?i){says}") & tx.rx(t, f"(?i){renders}"), F.lit(message)).otherwise(suspect)
    more = []
    if elements is not None:
        missing = F.filter(elements, lambda x: ~F.contains(t, x))
        more.append(tx.let(missing, lambda x: _flag("elemento_tecnico_alterado", F.concat(F.lit("Elemento técnico ausente ou alterado: "), F.array_join(F.slice(x, 1, 3), ", ")), F.size(x) > 0)))
    more += [
        _flag("marcador_exposto", F.lit("Um marcador interno apareceu na tradução."), protect.exposed(t)),
        tx.let(portuguese.european_words(t), european),
        _flag("termo_suspeito", suspect, (lang == "fr") & suspect.isNotNull()),
    ]
    return F.array_compact(F.concat(shape, F.array(*more)))


def _shape_flags(s: Column, t: Column, c: Column) -> Column:
    """Doubts that lengths and ends raise."""
    n, m = c["n"], c["m"]
    ratio = m / F.greatest(n, F.lit(1))
    share = F.concat(F.bround(ratio * 100).cast("int").cast("string"), F.lit("%"))
    open_end = s.rlike(r"[-,;:]$") | c["s_last"].isin(*END_WORDS) | ((c["s_last"] != "") & (F.length(c["s_last"]) <= 3) & ~c["s_stops"])
    return F.array(
        _flag("saida_curta", F.concat(F.lit("Tradução curta em relação ao original ("), share, F.lit(").")), (n >= 18) & (ratio < 0.62)),
        _flag("saida_longa", F.concat(F.lit("Tradução longa em relação ao original ("), share, F.lit(").")), (n >= 18) & (ratio > 1.75)),
        _flag("final_suspenso", F.concat(F.lit("A tradução termina em “"), c["t_last"], F.lit("”.")), (m >= 8) & c["t_last"].isin(*END_WORDS)),
        _flag("pontuacao_final", F.lit("O original termina a frase, mas a tradução não."), (n >= 12) & c["s_stops"] & ~tx.rx(t, SENTENCE_STOP)),
        _flag("origem_fragmentada", F.lit("O bloco original parece terminar no meio da frase."), tx.looks_unfinished(s) & open_end),
    )
