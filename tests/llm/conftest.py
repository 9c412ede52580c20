import random

import pytest

CLASHING = ["row", "score", "fingerprint", "chunk", "held", "home", "id", "late", "target", "key", "fp", "n_words"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def low(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def edge_rows():
    """Null, empty, blank, tiny, odd, repeated, tied and very long texts."""
    chance = random.Random(3)
    word = lambda: "".join(chance.choice("abcdeéß漢") for _ in range(chance.randint(1, 7)))
    texts = [None, "", " \n\t ", "One", "two words", "The SAME text, here it is! It's 12's 'll", "\x00nul\x00 byte", "😀 emoji 😀😀", "İstanbul ǅ", "a b c\u0085d", "tie tie tie tie", " ".join(word() for _ in range(40_000))]
    texts += [" ".join(word() for _ in range(chance.randint(5, 120))) for _ in range(20)]
    rows = [(k, t, ("en", "fr", None)[k % 3], f"src{k % 2}", len(t or "")) for k, t in enumerate(texts)]
    base = texts[-1].split()
    for k in range(6):
        base[chance.randrange(len(base))] = word()
        rows.append((100 + k, " ".join(base), "en", None, None))
    rows += [rows[5], rows[5], (200, texts[5], "en", "s", 1), (None, "no id here", "en", None, None)]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(edge_rows(), SCHEMA)
    return docs.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
