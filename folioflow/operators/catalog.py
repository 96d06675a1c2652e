"""Known models and their languages, as constant tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Models by name, in the order of recommendation, with the settings that fit them.
MODELS = (
    ("nllb_1_3b", "NLLB-200 distilled 1.3B", "nllb", "alta; melhor equilíbrio para artigos acadêmicos", "média", "float16", 4, 6, 220),
    ("nllb_600m", "NLLB-200 distilled 600M", "nllb", "boa", "rápida", "float16", 4, 10, 220),
    ("argos", "Argos/OpenNMT", "argos", "razoável; rotas indiretas podem perder precisão", "muito rápida", "float32", 4, 8, 200),
)
COLUMNS = "name string, title string, backend string, quality string, speed string, precision string, beam int, batch int, max_tokens int"
ALIASES = {"nllb": "nllb_1_3b", "nllb_13b": "nllb_1_3b", "nllb_1_3": "nllb_1_3b", "nllb_600": "nllb_600m", "local": "nllb_1_3b", "offline": "nllb_1_3b"}
# Languages and their codes among NLLB's.
NLLB_CODES = dict(
    ar="arb_Arab", bg="bul_Cyrl", ca="cat_Latn", cs="ces_Latn", da="dan_Latn", de="deu_Latn", el="ell_Grek", en="eng_Latn", es="spa_Latn", fi="fin_Latn",
    fr="fra_Latn", he="heb_Hebr", hi="hin_Deva", hu="hun_Latn", id="ind_Latn", it="ita_Latn", ja="jpn_Jpan", ko="kor_Hang", nl="nld_Latn", no="nob_Latn",
    pl="pol_Latn", pt="por_Latn", ro="ron_Latn", ru="rus_Cyrl", sv="swe_Latn", tr="tur_Latn", uk="ukr_Cyrl", vi="vie_Latn", zh="zho_Hans",
)


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, COLUMNS)


def model_name(value: object) -> str:
    word = str(value or MODELS[0][0]).strip().lower().replace("-", "_").replace(".", "_")
    name = ALIASES.get(word, word)
    if name not in {m[0] for m in MODELS}:
        raise ValueError(f"no model is called {value!r}")
    return name


def nllb_code(lang: str) -> str:
    """A language among NLLB's; those it lacks, variants of Portuguese too, are an error."""
    if lang not in NLLB_CODES:
        raise ValueError(f"the model has no language {lang!r}")
    return NLLB_CODES[lang]
