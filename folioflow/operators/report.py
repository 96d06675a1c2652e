"""States of units, documents and batches; totals, pending work, reviews and annotations, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as tx
from folioflow.functions.audit import audit

PAGE = ["doc_key", "page_no"]
FINAL = ("traduzido", "preservado")
# Texts and looks of annotations.
AUTHOR = "Tradução automática"
FAILED_TEXT = "Trecho sem tradução após múltiplas tentativas."
DONE_COLOR, DONE_OPACITY = (1.0, 0.96, 0.55), 0.13
FAILED_COLOR, FAILED_OPACITY = (1.0, 0.25, 0.25), 0.30
REASONS = {
    "referencia": "Referência bibliográfica mantida exatamente como no original.",
    "notacao": "Notação matemática isolada; mantida no original.",
    "idioma_destino": "Trecho já está no idioma de destino; original preservado.",
}
SKIPPED = "Restante da página pulado após erro de tradução."
#: Notes without geometry stand in columns of so many on the page's margin.
NOTES_IN_COLUMN = 38


def preserved_kind(text: str | Column, preserve: str | Column) -> Column:
    """What is kept before any model is asked: references, then notation; else null."""
    return F.when(tx.col(preserve), "referencia").when(tx.is_standalone_math(text), "notacao")


def states(units: DataFrame, target: str, mixed: bool, policy: str = "continuar") -> DataFrame:
    """units (page_no, unit_no, kind, lang, translation, error) with state, kind and reason.

    In this order: kept as reference or notation, failed, kept as it is in the target language (only
    where languages are told unit by unit), translated. With pular_pagina everything behind a page's
    first failure is skipped, whatever it would have been.
    """
    kind = F.coalesce("kind", F.when(F.lit(mixed) & F.col("error").isNull() & (F.col("lang") == target), F.lit("idioma_destino")))
    state = F.when(F.col("kind").isNotNull(), "preservado").when(F.col("error").isNotNull() | (kind.isNull() & F.col("translation").isNull()), "falhou").when(kind.isNotNull(), "preservado").otherwise("traduzido")
    rows = units.withColumns({"state": state, "kind": kind})
    if policy == "pular_pagina":
        first = F.min(F.when(F.col("state") == "falhou", F.col("unit_no"))).over(Window.partitionBy(*PAGE))
        late = F.coalesce(F.col("unit_no") > first, F.lit(False))
        rows = rows.withColumn("late", late).withColumns({"state": F.when(F.col("late"), "pulado").otherwise(F.col("state")), "kind": F.when(~F.col("late"), F.col("kind")), "error": F.when(F.col("late"), SKIPPED).otherwise(F.col("error"))}).drop("late")
    if policy == "parar":
        stop = F.when(F.col("state") == "falhou", F.raise_error(F.concat(F.lit("translation failed: "), F.coalesce("error", F.lit("")))))
        rows = rows.withColumn("state", F.coalesce(stop.cast("string"), F.col("state")))
    reason = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in REASONS.items()])
    done = F.col("state") == "traduzido"
    return rows.withColumns({"reason": F.when(F.col("state") == "preservado", reason), "translation": F.when(done, F.col("translation"))})


def audited(rows: DataFrame, source: str = "input") -> DataFrame:
    """rows with flags: doubts about each translated unit; of a paragraph over two pages only its first unit has them."""
    wanted = (F.col("state") == "traduzido") & F.col("owner")
    flags = audit(source, "translation", "lang")
    return rows.withColumn("flags", F.when(wanted, flags).otherwise(F.array().cast("array<struct<code:string,message:string>>")))


def totals(rows: DataFrame) -> DataFrame:
    """Counts of each document's units by what became of them."""
    n = lambda when, name: F.count_if(when).alias(name)
    kept = lambda kind: (F.col("state") == "preservado") & (F.col("kind") == kind)
    return rows.groupBy("doc_key").agg(
        n(F.col("state") == "traduzido", "traduzidos"), n(kept("notacao"), "notacoes_preservadas"), n(kept("idioma_destino"), "idioma_destino_preservados"),
        n(kept("referencia"), "referencias_preservadas"), n(F.size("flags") > 0, "revisao_recomendada"), n(~F.col("state").isin(*FINAL), "pendentes"),
    )


def document_states(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_key, state, empty_pages): a page without units, or any unit that isn't final, leaves a document with pending work."""
    units = rows.groupBy(*PAGE).agg(F.bool_or(~F.col("state").isin(*FINAL)).alias("open"))
    joined = pages.select(*PAGE).distinct().join(units, PAGE, "left")
    found = joined.groupBy("doc_key").agg(F.bool_or(F.coalesce("open", F.lit(True))).alias("open"), F.array_sort(F.collect_list(F.when(F.col("open").isNull(), F.col("page_no")))).alias("empty_pages"))
    return found.select("doc_key", F.when(F.col("open"), "concluido_com_pendencias").otherwise("concluido").alias("state"), "empty_pages")


def unvisited(requested: DataFrame, visited: DataFrame) -> DataFrame:
    """Pages asked for that were not worked on."""
    return requested.select(*PAGE).join(visited.select(*PAGE).distinct(), PAGE, "left_anti")


def pending(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("state").isin(*FINAL))


def reviews(rows: DataFrame) -> DataFrame:
    return rows.filter(F.size("flags") > 0).select(*PAGE, "unit_no", "flags", "text", "translation")


def batch_totals(files: DataFrame) -> DataFrame:
    """One row for all files (state, n_reviews): counts by state, and the batch's own state."""
    n = lambda state, name: F.count_if(F.col("state") == state).alias(name)
    found = files.agg(
        F.count("*").alias("arquivos"), n("concluido", "concluidos"), n("concluido_com_pendencias", "com_pendencias"), n("ignorado_existente", "ignorados_existentes"),
        n("ignorado_ja_traduzido", "ignorados_ja_traduzidos"), n("erro", "erros"), F.coalesce(F.sum("n_reviews"), F.lit(0)).cast("long").alias("trechos_para_revisao"),
    )
    state = F.when(F.col("arquivos") == 0, "sem_arquivos").when(F.col("erros") > 0, "concluido_com_erros").when(F.col("com_pendencias") > 0, "concluido_com_pendencias").otherwise("concluido")
    return found.withColumn("estado", state)


def subject(lang: str | Column, target: str, provider: Column | None = None, ocr: str | Column | None = None) -> Column:
    """An annotation's subject: the languages, or that the source is told automatically, and the provider."""
    code = F.coalesce(tx.col(lang), F.lit("fr"))
    to = F.lit(f" → {target.upper()}")
    plain = F.when(code == "auto", F.concat(F.lit("Tradução automática"), to)).otherwise(F.concat(F.lit("Tradução "), F.upper(code), to))
    if provider is not None:
        plain = F.when(provider != "", F.concat_ws(" | ", plain, provider)).otherwise(plain)
    return plain if ocr is None else F.when(tx.col(ocr), F.concat(F.lit("Chrome OCR | tradução "), F.upper(code), to)).otherwise(plain)


def note_place(index: str | Column, width: str | Column, height: str | Column) -> tuple[Column, Column]:
    """Where the index-th note of a page stands, from the upper right corner down and then to the left."""
    k = F.greatest(F.lit(1), tx.col(index)) - 1
    column, row = F.floor(k / NOTES_IN_COLUMN), k % NOTES_IN_COLUMN
    return F.greatest(F.lit(8.0), tx.col(width) - 14 - 16 * column), F.least(tx.col(height) - 12, 18.0 + row * 20)


def annotations(rows: DataFrame, target: str, author: str = AUTHOR) -> DataFrame:
    """What to write into pages: (doc_key, page_no, unit_no, kind, form, title, subject, content, opacity, rgb, x, y).

    rows: state, lang, translation, providers, quads, width, height, ocr and group_pages. A unit with
    geometry has a highlight, one without a note on the margin; failed and skipped units are marked
    without the error's text. Preserved units have none.
    """
    failed = F.col("state").isin("falhou", "pulado")
    pages = F.when(F.col("group_pages").isNotNull(), F.concat(F.lit("[Parágrafo contínuo entre páginas "), F.array_join("group_pages", "–"), F.lit("]\n")))
    content = F.when(failed, FAILED_TEXT).otherwise(F.concat(F.coalesce(pages, F.lit("")), F.col("translation")))
    title = F.when(failed, F.when(F.col("ocr"), "Chrome OCR | tradução pendente").otherwise("Tradução pendente")).otherwise(subject("lang", target, F.array_join("providers", " + "), "ocr"))
    shown = F.size(F.coalesce("quads", F.array().cast(rows.schema["quads"].dataType))) > 0
    x, y = note_place("unit_no", "width", "height")
    number = lambda a, b: F.when(failed, b).otherwise(a)
    colour = F.when(failed, F.array(*map(F.lit, FAILED_COLOR))).otherwise(F.array(*map(F.lit, DONE_COLOR)))
    return rows.filter(failed | (F.col("state") == "traduzido")).select(
        *PAGE, "unit_no", F.when(failed, "failed").otherwise("translated").alias("kind"), F.when(shown, "highlight").otherwise("note").alias("form"), F.lit(author).alias("title"),
        title.alias("subject"), content.alias("content"), number(F.lit(DONE_OPACITY), F.lit(FAILED_OPACITY)).alias("opacity"), colour.alias("rgb"),
        F.when(~shown, x).alias("x"), F.when(~shown, y).alias("y"),
    )


def report_json(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_key, report): each document's state, totals, pending units and pages without text as one JSON text.

    A document's pending units are listed in its report, so reports of very large documents are better
    read from the tables; this is the form for people.
    """
    found = document_states(pages, rows).join(totals(rows), "doc_key", "left")
    listed = pending(rows).groupBy("doc_key").agg(F.array_sort(F.collect_list(F.struct(F.col("page_no").alias("pagina"), F.col("unit_no").alias("trecho"), F.col("state").alias("estado"), F.col("error").alias("erro")))).alias("trechos"))
    joined = found.join(listed, "doc_key", "left")
    sums = F.struct("traduzidos", "notacoes_preservadas", "idioma_destino_preservados", "referencias_preservadas", "revisao_recomendada", "pendentes")
    return joined.select("doc_key", F.to_json(F.struct(F.col("state").alias("estado"), sums.alias("totais"), F.coalesce("trechos", F.array().cast("array<struct<pagina:int,trecho:int,estado:string,erro:string>>")).alias("trechos"), F.col("empty_pages").alias("paginas_sem_texto"))).alias("report"))


def model_stats(results: DataFrame) -> DataFrame:
    """One row of sums over translate()'s results: parts, those from the cache, protected elements, recoveries and terms, whole texts from the cache, and labels of models."""
    whole = (F.col("n_parts") > 0) & (F.col("n_cached") == F.col("n_parts"))
    return results.agg(
        F.sum("n_parts").alias("fragmentos_locais"), F.sum("n_cached").alias("fragmentos_cache"), F.sum("n_protected").alias("elementos_protegidos"),
        F.sum("n_recovered").alias("recuperacoes_marcadores"), F.sum("n_terms").alias("ajustes_glossario"), F.count_if(whole).alias("trechos_cache"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("providers")))).alias("motores"),
    )
