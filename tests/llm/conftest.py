import random

import pytest

NEWS = "id long, title string, summary string, source string, ticker string, text string, size int, key string, same string, host string, words int, component_id int, recipe int, label int"


@pytest.fixture(scope="session")
def make_news(spark):
    """News rows from (id, text) or (id, text, source), with further columns whose names the operators use themselves."""

    def make(rows):
        out = []
        for r in rows:
            text = r[1]
            title, _, summary = (text, None, None) if text is None else (text, None, None) if "\n" not in text else text.partition("\n")
            out.append((r[0], title, summary, r[2] if len(r) > 2 else "wire", "HDFC", "clash", 1, "k", "s", "h", 2, 3, 4, 5))
        return spark.createDataFrame(out, NEWS).repartition(3)

    return make


def prose(seed, n, vocabulary=5000):
    """n invented words."""
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}x" for _ in range(n)]


ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (4, "one"), (None, "null id"), (None, None), (5, "word " * 40_000), (6, "x" * 300_000), (7, "É ß\n\n漢字 <|endoftext|> '’s"), (8, "a\nb\nc"),
]
