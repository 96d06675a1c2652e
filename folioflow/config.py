"""Options as users give them, brought to one form or refused."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

MIXED = ("fr", "en", "it", "es", "pt")


def _word(value: object) -> str:
    return str(value).strip().lower()


def _choice(value: object, names: dict[str, str | None], what: str) -> str | None:
    if value not in names:
        raise ValueError(f"{what}: {', '.join(sorted({str(x) for x in names.values()}))} are known, not {value!r}")
    return names[value]


def source_languages(value: object) -> str | tuple[str, ...]:
    """One code, auto, or several codes for documents of mixed languages: a list, codes with commas, or misto."""
    if isinstance(value, (list, tuple, set)):
        codes = tuple(dict.fromkeys(_word(x) for x in (sorted(value) if isinstance(value, set) else value)))
        if not codes or not all(re.fullmatch("[a-z]{2,5}", x) for x in codes):
            raise ValueError("languages are codes such as fr, en, it")
        return codes
    word = "" if value is None else _word(value)
    if word in ("", "auto", "automatico", "automático", "detect", "detectar"):
        return "auto"
    if word in ("misto", "mixed", "multilingue", "multilíngue", "fr_en", "fr+en"):
        return MIXED
    return source_languages(word.split(",")) if "," in word else word


def source_label(source: str | tuple[str, ...]) -> str:
    return source if isinstance(source, str) else f"misto[{','.join(source)}]"


def portuguese_variant(value: object, target: str) -> str | None:
    """pt-BR or None; only Portuguese has variants."""
    if _word(target) != "pt" or value is None or value is False:
        return None
    off, brazil = ("", "nenhuma", "nenhum", "desativado", "off", "generic", "genérico", "pt"), ("pt-br", "br", "brasil", "brasileiro", "português-brasileiro")
    return _choice(_word(value).replace("_", "-"), dict.fromkeys(off) | dict.fromkeys(brazil, "pt-BR"), "variant")


def terminology_profile(value: object) -> str | None:
    if value is None or value is False:
        return None
    off, on = ("", "nenhum", "none", "off", "geral", "generico", "genérico"), ("didatica", "didatica_matematica", "tsd", "tad_tsd")
    return _choice(_word(value).replace("-", "_").replace(" ", "_"), dict.fromkeys(off) | dict.fromkeys(on, "didatica_matematica"), "profile")


def custom_glossary(value: dict | None) -> dict[str, str]:
    if value is None:
        return {}
    if not isinstance(value, dict):
        raise TypeError("a glossary is a dictionary")
    pairs = {str(a).strip(): str(b).strip() for a, b in value.items()}
    return {a: b for a, b in pairs.items() if a and b}


def text_engine(value: object) -> str:
    names = {"auto": "auto", "automatico": "auto", "automático": "auto", "nativo": "nativo", "native": "nativo", "pymupdf": "nativo", "chrome": "chrome", "ocr": "chrome", "chrome_ocr": "chrome"}
    return _choice(_word(value or "auto"), names, "engine")


def translation_mode(value: object) -> str:
    return _choice(_word(value or "local").replace("-", "_"), dict.fromkeys(("local", "offline", "nllb", "argos"), "local"), "mode")


def error_policy(value: object) -> str:
    names = {k: k for k in ("continuar", "pular_pagina", "parar")}
    names |= {"seguir": "continuar", "ignorar": "continuar", "skip": "continuar", "pagina": "pular_pagina", "página": "pular_pagina", "stop": "parar"}
    return _choice(_word(value).replace("-", "_"), names, "policy")


def finite_number(value: object, name: str, least: float) -> float:
    number = float(value)
    if not math.isfinite(number) or number < least:
        raise ValueError(f"{name} has to be a finite number of {least} or more")
    return number


def page_range(value: object) -> tuple[int, int] | None:
    """First and last page of a number, a pair, or a text such as 10, 10-20, 10:20, 10 a 20, with or without the word for page; None for all."""
    if value is None:
        return None
    if isinstance(value, str):
        found = re.fullmatch(r"(\d+)(?:\s*(?:-|:|até|ate|a)\s*(\d+))?", re.sub(r"p[áa]ginas?|pg\.?", "", value.lower()).strip())
        if not found:
            raise ValueError("pages are given as 10, 10-20, 10:20 or 10 a 20")
        first, last = int(found[1]), int(found[2] or found[1])
    elif isinstance(value, int):
        first = last = value
    elif isinstance(value, (list, tuple)) and len(value) == 2:
        first, last = map(int, value)
    else:
        raise ValueError("pages are given as a number, a pair or a text")
    if first < 1 or last < first:
        raise ValueError("not a range of pages")
    return first, last


def model_language(code: str) -> str:
    """A language's code among models."""
    word = _word(code).replace("_", "-")
    return {"pt-br": "pb", "pt-pt": "pt", "english": "en", "french": "fr"}.get(word, word)


@dataclass(frozen=True)
class Options:
    """Options of a translation run, checked on creation."""

    target: str = "pt"
    source: str | tuple[str, ...] = "auto"
    variant: str | None = None
    profile: str | None = None
    glossary: dict[str, str] = field(default_factory=dict)
    protect: bool = True
    policy: str = "continuar"
    unit_chars: int = 1200
    merge_blocks: bool = True
    pages: tuple[int, int] | None = None
    preserve_references: bool = True
    join_pages: bool = True
    audit: bool = True
    author: str = "Tradução automática"

    def __post_init__(self) -> None:
        put = lambda name, value: object.__setattr__(self, name, value)
        put("target", _word(self.target))
        put("source", source_languages(self.source))
        put("variant", portuguese_variant(self.variant, self.target))
        put("profile", terminology_profile(self.profile))
        put("glossary", custom_glossary(self.glossary))
        put("policy", error_policy(self.policy))
        put("pages", page_range(self.pages))
        put("unit_chars", int(finite_number(self.unit_chars, "unit_chars", 200)))

    @property
    def mixed(self) -> bool:
        return isinstance(self.source, tuple)
