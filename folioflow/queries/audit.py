"""Queries of protection, adaptation, terms and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import portuguese, protect
from folioflow.functions import text as tx
from folioflow.functions.audit import END_WORDS, SENTENCE_STOP, audit
from folioflow.functions.glossary import glossary
from folioflow.functions.split import sentences, split_text
from folioflow.queries import duck
from folioflow.queries.text import table


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, source, target): each user turn with the assistant's turn behind it."""
    rows = table(spark, sf_dir, "conversations")
    asked = rows.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
    given = rows.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    return asked.join(given, ["conv_id", "turn"])


def q_audit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All doubts but altered technical elements, which SQL without lookbehind can't find."""
    flags = audit("source", "target", F.lit("fr"), technical=False)
    return pairs(spark, sf_dir).select("conv_id", "turn", F.array_join(F.transform(flags, lambda x: x["code"]), ",").alias("codes"))


def q_audit_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("conv_id", "turn", F.explode(audit("source", "target", F.lit("fr"))).alias("f")).select("conv_id", "turn", "f.*")


def q_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("conv_id", "turn", tx.latin_words("source").alias("n_source"), tx.latin_words("target").alias("n_target"), tx.is_complete("source", "target").alias("complete"))


_KINDS = ("url", "doi", "latex", "citacao", "conjunto", "rotulo", "sigla")


def q_protect_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = {kind: k for k, (kind, _) in enumerate(protect.KINDS)}
    return texts(spark, sf_dir).select("doc_id", *[F.size(protect.spans_of("text", at[kind])).alias(f"n_{kind}") for kind in _KINDS])


def q_protect_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts(spark, sf_dir).select("doc_id", F.posexplode(protect.protected("text")).alias("nth", "s"))
    return rows.select("doc_id", "nth", F.col("s.start").alias("start"), F.col("s.stop").alias("stop"), F.col("s.kind").alias("kind"), F.md5("s.original").alias("original_md5"))


def q_mask_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masking and restoring give the normalised text back, by its digest."""
    rows = texts(spark, sf_dir).withColumn("spans", protect.protected("text"))
    return rows.select("doc_id", F.md5(protect.restored(protect.masked(protect.segments("text", "spans")), "spans")).alias("restored_md5"))


#: Documents made to hold European Portuguese, as none of them is in that language.
_SWAPS = ((" the ", " o facto "), (" of ", " está a mudar "), (" and ", " Objectivos "), (" la ", " ACÇÃO "), (" der ", " a equipa "))


def european(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    for a, b in _SWAPS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return texts(spark, sf_dir).withColumn("text", t)


def q_european_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return european(spark, sf_dir).select("doc_id", F.array_join(portuguese.european_words("text"), ",").alias("words"), portuguese.has_progressive("text").alias("progressive"))


def q_ptbr_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = european(spark, sf_dir).select("doc_id", portuguese.brazilian("text").alias("t"))
    return rows.select("doc_id", F.length("t").alias("n_chars_adapted"), F.md5("t").alias("adapted_md5"), F.size(portuguese.european_words("t")).alias("n_left"))


def q_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of a French source, each document's text as the translation, with a user's own term."""
    t = F.replace(F.replace("text", F.lit(" the "), F.lit(" o ambiente ")), F.lit(" les "), F.lit(" Feedback "))
    found = glossary(F.lit("le milieu et la rétroaction"), t, F.lit("fr"), "didatica_matematica", {"data": "dados"})
    return texts(spark, sf_dir).select("doc_id", found.alias("g")).select("doc_id", F.col("g.n").alias("n_terms"), F.md5("g.text").alias("text_md5"))


def q_split_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts(spark, sf_dir).select("doc_id", F.posexplode(split_text("text")).alias("part_no", "part"))
    return rows.select("doc_id", "part_no", F.length("part").alias("n_part_chars"), F.md5("part").alias("part_md5"))


def q_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts(spark, sf_dir).select("doc_id", sentences("text").alias("a"), sentences("text", bullets=True).alias("b"))
    return rows.select("doc_id", F.size("a").alias("n_sentences"), F.size("b").alias("n_kept"), F.md5(F.array_join("b", "\n")).alias("sentences_md5"))


_PAIRS = "(SELECT u.conv_id, u.turn, u.text AS source, a.text AS target FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn - 1 = u.turn AND a.role = 'assistant' WHERE u.role = 'user')"
_NORMED = f"(SELECT conv_id, turn, {duck.norm("coalesce(source, '')")} AS s, {duck.norm("coalesce(target, '')")} AS t FROM {_PAIRS})"
_ends = ", ".join(f"'{w}'" for w in END_WORDS)
_stops = lambda x: duck.matches(x, SENTENCE_STOP)
_tokens = lambda x: f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')"
_lexicon = "[" + ", ".join(f"'{w}'" for w in sorted(portuguese.lexicon())) + "]"
_words_found = lambda x: f"list_sort(list_distinct(list_intersect({_tokens(x)}, {_lexicon})))"
_estar = "|".join(portuguese.ESTAR)
_progressive = lambda x: f"regexp_matches({x}, '(?i)(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])(?:{_estar}){duck.S}+a{duck.S}+(?:[{tx.LATIN}]+(?:ar|er|ir)|pôr)([^\\p{{L}}\\p{{M}}\\p{{N}}_]|$)')"
_fragment = f"({duck.unfinished('s')} AND (regexp_matches(s, '[-,;:]$') OR {duck.last_word('s')} IN ({_ends}) OR ({duck.last_word('s')} <> '' AND length({duck.last_word('s')}) <= 3 AND NOT {_stops('s')})))"
_flag = lambda code, when: f"CASE WHEN {when} THEN '{code}' END"
#: The pairs of terms once more, each source term with its own renderings.
_suspect = " OR ".join(f"(regexp_matches(s, '(?i)\\b{a}\\b') AND regexp_matches(t, '(?i)\\b{b}\\b'))" for a, b in (
    ("maître", "capitão"), ("décroissance", "(?:descreção|descrição)"), (r"effet\s+jourdain", r"efeit[oa]\s+(?:jordão|jordan)"), ("mathématisation verticale", "matemática vertical"),
))
_swapped = "coalesce(text, '')"
for _a, _b in _SWAPS:
    _swapped = f"replace({_swapped}, '{_a}', '{_b}')"
_count = {
    "url": r"https?://[^\s<>()]+|www\.[^\s<>()]+", "doi": r"(?:doi\s*:\s*)?10\.\d{4,9}/[^\s<>()]+", "latex": r"\$[^$\n]+\$|\\\([^\n]*?\\\)|\\\[[^\n]*?\\\]",
    "citacao": r"\([^()\n]{0,220}\b(?:18|19|20)\d{2}[a-z]?\b[^()\n]{0,220}\)", "conjunto": r"\{[^{}\n]{1,160}\}",
}
_whole = lambda p: f"len(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '{p}')))"

QUERIES = {
    "q_audit_flags": q_audit_flags,
    "q_audit_messages": q_audit_messages,
    "q_completeness": q_completeness,
    "q_protect_counts": q_protect_counts,
    "q_protect_spans": q_protect_spans,
    "q_mask_roundtrip": q_mask_roundtrip,
    "q_european_words": q_european_words,
    "q_ptbr_normalize": q_ptbr_normalize,
    "q_glossary": q_glossary,
    "q_split_text": q_split_text,
    "q_sentences": q_sentences,
}
ORACLE = {
    "q_audit_flags": f"""SELECT conv_id, turn, array_to_string(list_filter([
  {_flag('saida_curta', 'n >= 18 AND m / greatest(n, 1) < 0.62')}, {_flag('saida_longa', 'n >= 18 AND m / greatest(n, 1) > 1.75')},
  {_flag('final_suspenso', f"m >= 8 AND {duck.last_word('t')} IN ({_ends})")}, {_flag('pontuacao_final', f"n >= 12 AND {_stops('s')} AND NOT {_stops('t')}")},
  {_flag('origem_fragmentada', _fragment)}, {_flag('marcador_exposto', duck.matches('t', r'(?i)ZXQ\s*KEEP'))}, {_flag('portugues_europeu', f"len({_words_found('t')}) > 0 OR {_progressive('t')}")},
  {_flag('termo_suspeito', _suspect)}], lambda x: x IS NOT NULL), ',') AS codes
FROM (SELECT *, {duck.words('s')} AS n, {duck.words('t')} AS m FROM {_NORMED})""",
    "q_completeness": f"SELECT conv_id, turn, CAST(n AS INT) AS n_source, CAST(m AS INT) AS n_target, CASE WHEN n >= 18 THEN m / n >= 0.48 WHEN n >= 9 THEN m / n >= 0.30 ELSE true END AS complete FROM (SELECT conv_id, turn, {duck.words('source')} AS n, {duck.words('target')} AS m FROM {_PAIRS})",
    "q_protect_counts": "SELECT doc_id, " + ", ".join(f"CAST({duck.count('text', '(?i)' + p if k in ('url', 'doi') else p)} AS INT) AS n_{k}" for k, p in _count.items())
    + f", CAST({_whole('[A-Z][0-9]+')} AS INT) AS n_rotulo, CAST({_whole('[A-Z][A-Z0-9]{1,9}')} AS INT) AS n_sigla FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
    "q_mask_roundtrip": f"SELECT doc_id, md5({duck.norm("coalesce(text, '')")}) AS restored_md5 FROM documents",
    "q_european_words": f"SELECT doc_id, array_to_string({_words_found('t')}, ',') AS words, {_progressive('t')} AS progressive FROM (SELECT doc_id, {_swapped} AS t FROM documents)",
}
