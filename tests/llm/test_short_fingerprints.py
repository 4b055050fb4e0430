"""Texts of few words that happen to have no syncmer."""

import random

from conftest import prose
from tidelog.llm import syncmers


def test_only_texts_without_words_have_no_anchor(spark):
    rnd = random.Random(12)
    texts = [prose(rnd, n) for n in (1, 4, 5, 6, 7, 8) for _ in range(30)]
    df = spark.createDataFrame([*enumerate(texts), (900, ""), (901, None), (902, " \n")], "doc_id long, text string")
    got = dict(syncmers.fingerprints(df).collect())
    assert {i for i, f in got.items() if not f} == {900, 901, 902}
    assert len({got[i] for i in range(60, len(texts))}) == len(set(texts[60:]))
