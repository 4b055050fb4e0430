import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = ["an", "bo", "ci", "de", "er", "fu", "gra", "hi", "jo", "ka", "lu", "me", "no", "pi", "ru", "sta", "ta", "un", "ve", "zo"]


def prose(rnd: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        out.append("".join(rnd.choice(SYLLABLES) for _ in range(rnd.randrange(1, 4))))
        out[-1] += rnd.choice(["", "", "", ",", ".", ".\n"])
    return " ".join(out).replace("\n ", "\n").capitalize()


def rows() -> list[tuple]:
    """Nulls in every column, empty, blank, very short and very long texts, copies, near copies, repeated rows."""
    rnd = random.Random(5)
    texts = [prose(rnd, n) for n in (60, 80, 120, 300, 5000, 3, 2, 1, 200, 400)]
    texts += [texts[0], texts[3], texts[9].replace("bo", "BO", 1), texts[4] + " more", "", None, "   \n\t\n", "\n\n", "x", "It's  <b> İß \U0001f600 中文</b>\x0bz 'S <|endoftext|>"]
    texts += [prose(rnd, 70) + "\nThe very same long line here.\n" + prose(rnd, 5) + "\n  the VERY same long line here. " for _ in range(6)]
    out = [(3 * i, t, ["en", "de", None][i % 3], ["s1", "s2", "s3", "sé", None][i % 5], None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [out[2], out[2], (None, texts[8], None, None, None), (None, None, None, None, None), (6, "another text of the same id", "en", "s1", 27)]
    return out


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with all that may go wrong, and a column whose name clashes with results."""
    return spark.createDataFrame([(*r, "mine", 7) for r in rows()], SCHEMA + ", score string, size int").repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
