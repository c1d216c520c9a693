"""Texts between two languages are ambiguous, at any number of languages."""

import random

import pytest

from sitefold.llm import langid

STYLES = {"aa": "ba be bi bo".split(), "bb": "tra tre tri tro".split(), "cc": "éé üü öö ñé".split()}


@pytest.mark.parametrize("langs", [("aa", "bb"), ("aa", "bb", "cc")])
def test_two_way_ties(spark, langs):
    rng = random.Random(6)
    word = lambda y: "".join(rng.choice(STYLES[y]) for _ in range(3))
    rows = [(i, " ".join(word(langs[i % len(langs)]) for _ in range(30)), langs[i % len(langs)]) for i in range(300)]
    # bilingual texts from one side of the tie to the other, a word at a time
    rows += [(1000 + k, " ".join([word("aa") for _ in range(k)] + [word("bb") for _ in range(400 - k)]), None) for k in range(100, 300)]
    out = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not any(out[i].ambiguous for i in range(300))
    tied = [k for k in range(100, 300) if out[1000 + k].ambiguous]
    assert tied and {out[1000 + k].lang_pred for k in (100, 299)} == {"aa", "bb"}


def test_decoding_ties():
    import numpy as np

    for n in (2, 3, 5, 9):
        model = langid.Model({f"l{i}": np.bincount([i], minlength=langid.CELLS) for i in range(n)})
        sides = 2.0 * model.code - 1
        tie, clear = (sides[:1] + sides[1:2]) / 2, sides[:1]
        assert model.decode(tie)[2][0] >= langid.AMBIGUOUS > model.decode(clear)[2][0]
