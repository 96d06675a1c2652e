"""The table of words of op8: what leaves it when it is full, and how far back a piece is looked for."""

import numpy as np
import public_tokenizers
import sentencepiece

from folioflow.llm import sentencepieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_words_met_again_stay_when_the_table_is_full(monkeypatch):
    monkeypatch.setattr(sentencepieces, "WORDS_KEPT", 40)
    model, library = sentencepieces.Pieces(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    learned, learn = [], model.learn
    monkeypatch.setattr(model, "learn", lambda words: learned.extend(words) or learn(words))
    texts = ["the same words, again and again " + " ".join(f"{chr(97 + k)}zq{k}é{n}中𝒳" for n in range(12)) for k in range(9)]
    for text in texts:
        (data,) = model.encode([text])
        assert np.frombuffer(data, "<i4").tolist() == library.encode(text)
        assert len(model.words) <= 40
    assert learned.count("▁again") == 1 and len(learned) == len(set(learned))


def test_ends_hold_every_end_of_every_piece():
    model = sentencepieces.Pieces(PATH)
    assert {k for k in model.ends.values() if k >= 0} == set(model.ids.values())
    assert all(x[k:] in model.ends for x in model.ids for k in range(len(x)))
