"""The automaton of terms and what is built on it, against plain regular expressions applied one after the other."""

import hashlib
import random
import re

from folioflow.functions import glossary as gl
from folioflow.functions import portuguese
from folioflow.functions.terms import Automaton, Terms, fold, like, word_needed
from folioflow.queries import QUERIES
from folioflow.queries.audit import texts
from tests.compare import SF


def one_by_one(text, pairs):
    total = 0
    for term, to in pairs:
        if term:
            text, n = re.subn(rf"(?<!\w){re.escape(term)}(?!\w)", lambda m, to=to: like(m[0], to), text, flags=re.I)
            total += n
    return text, total


def by_profile(source, text, lang, profile="didatica_matematica"):
    total = 0
    for says, options, term in gl.PROFILES[profile].get(lang, ()):
        if re.search(says, source, re.I):
            for option in options:
                text, n = re.subn(option, lambda m, t=term: like(m[0], t), text, count=1, flags=re.I)
                total += n
                if n:
                    break
    return text, total


def test_places():
    terms = ["a b", "b", "b c", "c++", "A b c d", "", "b", "+"]
    found = Automaton(terms).found("A b c++ ab b_ b")
    assert sorted(found) == [(0, 3, 0), (2, 3, 1), (2, 5, 2), (4, 7, 3), (6, 7, 7), (14, 15, 1)]
    assert Automaton(terms).found("b", after=1) == [(0, 1, 6)]
    assert Automaton([]).found("a") == [] and Automaton(["a"]).found("") == []


def test_overlaps_against_plain():
    rng = random.Random(7)
    draw = lambda n: "".join(rng.choice(["a", "b", "A", " ", "+", "é", "a b", "b "]) for _ in range(rng.randrange(n)))
    for _ in range(3000):
        pairs = list(dict((draw(4), draw(4)) for _ in range(rng.randrange(1, 6))).items())
        text = draw(14)
        assert Terms(pairs).put(text) == one_by_one(text, pairs), (pairs, text)


def test_chain_of_terms():
    # what a term becomes is a later term's, an earlier one's, or its own
    assert Terms([("a", "b"), ("b", "c")]).put("a b") == ("c c", 3)
    assert Terms([("b", "c"), ("a", "b")]).put("a b") == ("b c", 2)
    assert Terms([("a", "a a")]).put("a A") == ("a a A A", 2)
    assert Terms([("Straße", "rua")]).put("STRAßE, straße, Straße") == ("rua, rua, Rua", 3)


def test_many_terms():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    pairs = list({" ".join(word() for _ in range(rng.randrange(1, 4))): word().upper() + "x" for _ in range(100_000)}.items())
    terms = Terms(pairs)
    inside = rng.sample(pairs, 40)
    text = " , ".join(f"{word()}z {a} {word()}z" for a, _ in inside)
    words = set(re.findall(r"\w+", text.lower()))
    possible = [(a, b) for a, b in pairs if words.issuperset(a.split())]
    assert terms.put(text) == one_by_one(text, possible) and terms.put(text)[1] >= 40


def test_long_text():
    text = "facto " * 200_000
    assert portuguese.Brazilian().whole(text + " " * 300_000 + "x") == "fato " * 200_000 + " " * 300_000 + "x"


def test_fold_keeps_places():
    text = "İstanbul ſ ΑΣ Kelvin ı"
    assert len(fold(text)) == len(text) and fold(text) == "istanbul s ασ kelvin i"


def test_needed_words():
    """A rule whose needed word a source lacks can't apply: held on sources made of the rules' own letters."""
    assert word_needed(r"\bsituations a-?didactiques\b") == "situations" and word_needed(r"\bhyposystèmes?\b") is None
    made = []
    for rules in gl.PROFILES["didatica_matematica"].values():
        for says, *_ in rules:
            plain = re.sub(r"\(\?:([^()]*)\)\?|\[(.)[^\]]*\]\*?", r"\1\2", says.replace(r"\b", "")).replace("?", "")
            made += [plain, plain.upper(), re.sub(r"s\b", "", plain)]
    for lang, rules in gl.PROFILES["didatica_matematica"].items():
        for says, *_ in rules:
            for source in made:
                if re.search(says, source, re.I):
                    assert word_needed(says) is None or word_needed(says) in fold(source).replace("-", " ").split() or word_needed(says) in re.findall(r"\w+", fold(source)), (lang, says, source)


def test_profile_against_plain():
    rng = random.Random(11)
    for lang, rules in gl.PROFILES["didatica_matematica"].items():
        profile = gl.Profile(rules)
        bits = [re.sub(r"\(\?:([^()|]*)[^()]*\)\??|\[(.)[^\]]*\][*?]?", r"\1\2", x.replace(r"\b", "")).replace("?", "") for says, options, _ in rules for x in (says, *options)]
        for _ in range(300):
            source, target = (" ".join(rng.choice([b, b.upper(), b.capitalize(), "x"]) for b in rng.choices(bits, k=6)) for _ in range(2))
            assert profile.put(source, target) == by_profile(source, target, lang)


def test_glossary_over_the_table(spark):
    expected = {}
    for r in texts(spark, SF).collect():
        text = r["text"].replace(" the ", " o ambiente ").replace(" les ", " Feedback ")
        text, n = by_profile("le milieu et la rétroaction", text, "fr")
        text, more = one_by_one(text, [("data", "dados")])
        expected[r["doc_id"]] = (n + more, hashlib.md5(text.encode()).hexdigest())
    assert {r["doc_id"]: (r["n_terms"], r["text_md5"]) for r in QUERIES["q_glossary"](spark, SF).collect()} == expected


def test_null_and_empty(spark):
    rows = spark.createDataFrame([(None, "dado", None), ("x", None, "fr"), ("", "", "fr"), (None, "o ambiente", "fr")], "s string, t string, l string")
    of = lambda *a: [tuple(r[0]) for r in rows.select(gl.glossary("s", "t", "l", *a)).collect()]
    assert of("didatica_matematica", {"dado": "item"}) == [("item", 1), (None, 0), ("", 0), ("o ambiente", 0)]
    assert of("didatica_matematica") == [("dado", 0), (None, 0), ("", 0), ("o ambiente", 0)]
    assert of() == [("dado", 0), (None, 0), ("", 0), ("o ambiente", 0)]
    assert rows.filter("false").select(gl.glossary("s", "t", "l", None, {"dado": "item"})).collect() == []
    assert [r[0] for r in rows.select(portuguese.brazilian("t")).collect()] == ["dado", None, "", "o ambiente"]
