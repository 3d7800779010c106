import tracemalloc

import pandas as pd

from barflow.plans.text import length_scorer


def test_scorer_holds_the_words_of_one_text():
    texts = pd.Series([" ".join(f"word{i}" + "x" * (i % 3) for i in range(2000))] * 50 + [None, "", " \t"])
    tracemalloc.start()
    (scores,) = list(length_scorer(iter([texts])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert scores[50:].tolist() == [0.0] * 3 and scores[0] == sum(len(w) > 6 for w in texts[0].split()) / 2000 * 2 - 1
    assert peak < 1_000_000  # one text's words: about 0.1 MB
