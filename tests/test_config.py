import pytest

from folioflow import config as c


@pytest.mark.parametrize(("value", "expected"), [("10 até 20", (10, 20)), ("pg 7", (7, 7)), ("10-20", (10, 20)), ("10:20", (10, 20)), ("páginas 1 a 2", (1, 2)), (3, (3, 3)), ((2, 5), (2, 5)), (None, None)])
def test_page_range(value, expected):
    assert c.page_range(value) == expected


@pytest.mark.parametrize("value", ["0", 0, (5, 2), "x", "3-", 1.5, [1]])
def test_bad_page_range(value):
    with pytest.raises(ValueError):
        c.page_range(value)


def test_sources():
    assert c.source_languages(None) == "auto"
    assert c.source_languages("misto") == c.MIXED
    assert c.source_languages("fr, en,fr") == ("fr", "en")
    assert c.source_languages({"it", "en"}) == ("en", "it")
    assert c.source_label(("fr", "en")) == "misto[fr,en]"
    with pytest.raises(ValueError):
        c.source_languages(["f"])


def test_choices():
    assert c.portuguese_variant("Brasil", "pt") == "pt-BR"
    assert c.portuguese_variant("pt-BR", "es") is None
    assert c.terminology_profile("TSD") == "didatica_matematica"
    assert c.error_policy("skip") == "continuar"
    assert c.text_engine(None) == "auto"
    assert c.translation_mode("NLLB") == "local"
    assert c.custom_glossary({" a ": "b", "": "c"}) == {"a": "b"}
    assert c.model_language("pt_BR") == "pb"
    for bad in (lambda: c.portuguese_variant("x", "pt"), lambda: c.error_policy("x"), lambda: c.text_engine("x"), lambda: c.finite_number("nan", "n", 0), lambda: c.translation_mode("web")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        c.custom_glossary([1])


def test_options():
    found = c.Options(source="fr,en", variant="br", pages="2-3", policy="stop")
    assert (found.mixed, found.variant, found.pages, found.policy) == (True, "pt-BR", (2, 3), "parar")
