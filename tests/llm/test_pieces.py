"""Piece ids and their text against the library of the model file."""

import random
from hashlib import sha256

import numpy as np
import pytest

from barflow.llm import pieces, queries
from barflow.llm.pieces import piece_ids
from barflow.llm.records import table

from .conftest import ODD

ALPHABET = "abcdefgh etaoin  ▁\n\t.,!?é漢字🙂<>s/x0A1234 \x00 ß"


@pytest.fixture(scope="module")
def model():
    return pieces._open(queries.vocabulary("piece_bpe_32k.model"))


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def some_texts(seed, n, model):
    rng = random.Random(seed)
    for _ in range(n):
        k = rng.randrange(60)
        yield rng.choice((
            "".join(rng.choice(ALPHABET) for _ in range(k)),
            "".join(model.library.id_to_piece(rng.randrange(3, 32_000)).replace("▁", " ") for _ in range(k // 4)),
            "".join(rng.choice(" ▁ \nab") for _ in range(k)),
        ))


def test_ids_and_text_are_those_of_the_library(model):
    for text in some_texts(1, 3_000, model):
        want = model.library.encode(text)
        assert ids(model.encode(text)) == want
        assert model.decode([1, *want, 2]) == model.library.decode([1, *want, 2])


def test_any_ids_decode_as_the_library_does(model):
    rng = random.Random(2)
    for _ in range(5_000):
        some = [rng.randrange(300) if rng.random() < 0.5 else rng.randrange(32_000) for _ in range(rng.randrange(8))]
        assert model.decode(some) == model.library.decode(some)


def test_every_prefix_has_the_last_piece_of_its_own_encoding(model):
    for stretch in ("▁international", "▁▁▁▁▁ab", "Lorem▁ipsum", "unbelievablyx", "▁don't"):
        last = model.prefix_table(stretch)
        for end in range(1, len(stretch) + 1):
            assert ids(model._encode(stretch[:end]))[-1] == model.ids.get(last[end], ids(model._encode(last[end]))[-1])


def test_pairs_that_would_merge_are_not_apart(model):
    rng, some = random.Random(3), sorted(p for p in model.ids if model.steps(p) is not None and "▁" not in p[1:])

    def merged(text):  # plain merging from single characters
        parts = list(text)
        while True:
            best = max(((model.scores.get(a + b), -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in model.scores), default=None)
            if best is None:
                return parts
            parts[-best[1] : 2 - best[1]] = ["".join(parts[-best[1] : 2 - best[1]])]

    for _ in range(3_000):
        a, b = rng.choice(some), rng.choice(some)
        assert model._stay_apart(a, b) == (merged(a + b) == [a, b])


def test_long_words_take_linear_time_and_memory_is_bounded(model, monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(200_000))
    assert ids(model.encode(text)) == model.library.encode(text)
    monkeypatch.setattr(pieces, "CACHED", 3)
    monkeypatch.setattr(pieces, "PAIRS", 3)
    small = pieces.Pieces(model.path)
    for text in some_texts(5, 200, model):
        assert ids(small.encode(text)) == model.library.encode(text)
        assert len(small._cache) <= 5 and len(small._apart) <= 5


def test_articles(make_news, model):
    texts = ["Hello  world", " lead", "<s> </s> <unk> <0x41>", "tail ", "漢字 🙂\x00", "title\nsummary\n\nmore", *(t for _, t in ODD)]
    rows = [(i if i != 3 else None, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    got = piece_ids(make_news(rows), model.path).collect()
    want = sorted((str(i), [1, *model.library.encode(t or ""), 2]) for i, t in rows)
    assert sorted((str(r.id), ids(r.ids)) for r in got) == want
    assert all(r.n_tokens == len(r.ids) // 4 and r.decoded == model.library.decode(ids(r.ids)) for r in got)
    bare = piece_ids(make_news([(1, "Hello"), (2, None)]), model.path, begin=False, end=False).orderBy("id").collect()
    assert [ids(r.ids) for r in bare] == [model.library.encode("Hello"), []]
    assert piece_ids(make_news([]), model.path).collect() == []


def test_the_query_gives_what_the_library_gives(spark, sf_dir, model):
    want = {r.doc_id: model.library.encode(r.text or "", add_bos=True, add_eos=True) for r in table(spark, sf_dir, "documents").collect()}
    got = queries.op11_piece_ids(spark, sf_dir).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(w), sha256(np.array(w, "<u4").tobytes()).hexdigest(), sha256(model.library.decode(w).encode()).hexdigest())
