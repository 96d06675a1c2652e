"""Expected values worked out by hand from what each function is to do."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.functions import language as lg
from folioflow.functions import portuguese, protect
from folioflow.functions import text as tx
from folioflow.functions.audit import audit
from folioflow.functions.glossary import glossary
from folioflow.functions.split import ENCODED_CHARS, encoded_length, pieces_of, sentences, split_text


def values(spark, texts, of):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r[0] for r in rows.orderBy("k").select(of("t")).collect()]


def test_normalize_spaces(spark):
    assert values(spark, ["a­b\tc \n  d ", " x ", "", None], tx.normalize_spaces) == ["ab c\nd", "x", "", None]


def test_join_lines(spark):
    rows = spark.createDataFrame([(["intro-", "dução", "• item", "fim"],), (["", " "],), ([],)], "a array<string>")
    assert [r[0] for r in rows.select(tx.join_lines("a")).collect()] == ["introdução\n• item fim", "", ""]


def test_margin_key(spark):
    assert values(spark, ["Page 12 — Journal of X.", "é12é 12", " | 3 | "], tx.margin_key) == ["page # — journal of x", "é12é #", "#"]


def test_merge_text(spark):
    rows = spark.createDataFrame([("trans-", "lation"), ("trans-", "Lation"), ("a", "b")], "a string, b string")
    assert [r[0] for r in rows.select(tx.merge_text("a", "b")).collect()] == ["translation", "trans- Lation", "a b"]


def test_cache_key(spark):
    assert values(spark, ["é"], lambda t: tx.cache_key(t, F.lit("fr"), F.lit("pt"))) == ["39d97f22ce5b6dbd3ef94ee8e0181ccc5bdb007242269d3f72bb31535ddeeb5e"]


def test_noise(spark):
    texts = ["Page 3 of 12", "p. 4", "Привет мир", "doi: 10.1000/abc", "see https://x.org", "https://x.org/a", "a@b.cc", "three words here", None, ""]
    assert values(spark, texts, tx.is_noise) == [True, True, True, True, False, True, True, False, True, True]


def test_math(spark):
    assert values(spark, ["x = 2", "sin x ≤ 1", "área = 2", "2 + 2", "= 3"], tx.is_standalone_math) == [True, True, False, False, True]


def test_reference_headings(spark):
    assert values(spark, ["3. References", "Reference values were low", "References", "See references"], lambda t: tx.is_reference_heading(t, t))[2:] == [True, False]


def test_copy_case(spark):
    assert values(spark, ["FACTO", "Facto", "fAcTo", "facto"], lambda t: tx.copy_case(t, F.lit("fato"))) == ["FATO", "Fato", "fato", "fato"]


def test_portuguese(spark):
    texts = ["O facto está a mudar.", "U.S.A", "até ao fim", "`facto` e ACÇÃO em https://x.org/facto", "estou a fazer", "", None]
    assert values(spark, texts, portuguese.brazilian) == ["O fato está mudando.", "U. S. A", "até o fim", "`facto` e AÇÃO em https://x.org/facto", "estou fazendo", "", None]
    assert values(spark, ["fazer", "Cantar", "pôr"], portuguese.gerund) == ["fazendo", "Cantando", "pondo"]


def test_lexicon_has_lower_case_words():
    found = portuguese.lexicon()
    assert len(found) == 168
    assert all(a == a.lower() and a != b for a, b in found.items())


def test_protection(spark):
    rows = spark.createDataFrame([("ver (Silva, 2001) e ABC",)], "t string").withColumn("s", protect.protected("t")).withColumn("m", protect.masked(protect.segments("t", "s")))
    row = rows.first()
    assert row["m"] == "ver ZXQKEEP0000QXZ e ZXQKEEP0001QXZ"
    assert [x["kind"] for x in row["s"]] == ["citacao", "sigla"]
    back = lambda text: rows.select(protect.restored(F.lit(text), "s")).first()[0]
    assert back(row["m"]) == "ver (Silva, 2001) e ABC"
    assert back("v Z X Q KEEP0000QXZ, zxqkeep0001qxz") == "v (Silva, 2001), ABC"
    assert back("ver  e ZXQKEEP0001QXZ") is None  # one is lost
    assert back("ZXQKEEP0000QXZ ZXQKEEP0000QXZ ZXQKEEP0001QXZ") is None  # one is there twice


def brute_split(text, limit):
    from urllib.parse import quote_plus
    import re

    out = []
    while text:
        n = max([k for k in range(1, min(limit, len(text)) + 1) if len(quote_plus(text[:k])) <= ENCODED_CHARS] or [1])
        if n < len(text):
            ends = [m.end() for m in re.finditer(r"[.!?;:]\s+", text[:n])]
            cut = ends[-1] if ends else text[:n].rfind(" ")
            n = cut if cut >= n / 2 else n
        out, text = [*out, text[:n].strip()], text[n:].lstrip()
    return [x for x in out if x]


def test_split(spark):
    assert values(spark, ["aaaa bbbb. cccc dddd eeee ffff", "", None], lambda t: split_text(t, 20)) == [["aaaa bbbb.", "cccc dddd eeee ffff"], [], []]
    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice(["a", "é", " ", ". ", "日", "b", "~"]) for _ in range(rng.randrange(1, 400))).strip()
        assert pieces_of(text, 50) == brute_split(text, 50)
    long = "日本 " * 900
    assert pieces_of(long.strip(), 3500) == brute_split(long.strip(), 3500)
    assert values(spark, ["a é~*"], encoded_length) == [len("a+%C3%A9~%2A")]
    with pytest.raises(ValueError):
        split_text(F.lit("a"), 19)


def test_sentences(spark):
    assert values(spark, ["One. Two? (Three) x. four", "  "], lambda t: sentences(t, bullets=True)) == [["One.", "Two?", "(Three) x. four"], [""]]


def test_glossary(spark):
    rows = spark.createDataFrame([("le Milieu", "O ambiente e o ambiente", "fr"), ("x", "o ambiente", "fr"), ("le milieu", None, "fr"), ("x", "Dado, dados", "en")], "s string, t string, l string")
    found = [tuple(r[0]) for r in rows.select(glossary("s", "t", "l", "didatica_matematica", {"dado": "item"})).collect()]
    # the longer rule first, then the shorter one on what is left; each rule replaces one place
    assert found == [("O meio e o meio", 2), ("o ambiente", 0), (None, 0), ("Item, dados", 1)]


def test_audit(spark):
    long = " ".join(["palavra"] * 20)
    rows = spark.createDataFrame([(long + ".", "curta."), (long + ".", long + " de"), ("Olá.", "O facto ZXQKEEP0000QXZ"), ("le maître ABC (x, 2001)", "o capitão"), (None, None)], "s string, t string")
    found = [[x["code"] for x in r[0]] for r in rows.select(audit("s", "t", F.lit("fr"))).collect()]
    assert found == [["saida_curta"], ["final_suspenso", "pontuacao_final"], ["marcador_exposto", "portugues_europeu"], ["elemento_tecnico_alterado", "termo_suspeito"], []]


def test_completeness(spark):
    rows = spark.createDataFrame([("a " * 18, "b " * 8), ("a " * 18, "b " * 9), ("a " * 9, "b " * 2), ("a " * 8, "")], "s string, t string")
    assert [r[0] for r in rows.select(tx.is_complete("s", "t")).collect()] == [False, True, False, True]


def test_unit_language(spark):
    texts = ["Resumen del artículo", "abc", "the of and to in is that it was for on are as with his they", None]
    found = values(spark, texts, lambda t: lg.unit_language(t, ["fr", "en", "it", "es", "pt"], F.lit("it")))
    assert [(x["code"], x["reason"]) for x in found] == [("fr", "cabecalho"), ("it", "predominante_texto_curto"), ("en", "estatistica_trecho"), ("it", "predominante_texto_curto")]
