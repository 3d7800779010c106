"""Deep and wide pages, long names and long runs: linear work, no crash, the same results as the plain way."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barflow.llm import extraction
from barflow.llm.extraction import extract, kept_paths, main_text, pattern, restored, stored
from barflow.llm.pseudonyms import _OTHERS, _EMAIL, LONG_NAME, _Search, permute_symbols, pseudonymise_text, pseudonyms, restore

KEY = b"0123456789abcdef"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abc"), max_size=14))
def test_alignment_by_bits_is_a_longest_common_subsequence(x, y):
    bits, cells = extraction._pairs_by_bits(x, y), extraction._pairs(x, y)
    assert len(bits) == len(cells)
    for pairs in (bits, cells):
        assert all(x[i] == y[j] for i, j in pairs) and all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))


def test_patterns_are_stored_whole():
    for page in ("", "a", "<ul><li>x<b>y</b></ul><p>z", "<div>" * 3000 + "x"):
        assert restored(stored(pattern(page))) == pattern(page)


@pytest.fixture
def entries(spark):
    return lambda pages: spark.createDataFrame([(i, f"https://h{i % 2}.example/{i}", p) for i, p in enumerate(pages)], "id long, link string, summary string")


def test_deep_and_wide_pages(entries):
    rng = random.Random(1)
    deep = "<html><body>" + "<b>" * 5_000 + "deep text</body></html>"
    boxes = "<body>" + "<div>" * 3_000 + "<p>boxed text</p>" + "</div>" * 3_000
    wide = ["<body>" + "".join(f"<{t}>w{i}</{t}>" for i, t in enumerate(rng.choice(("p", "h2", "h3", "h4", "blockquote", "pre")) for _ in range(20_000))) for _ in range(4)]
    t0 = time.time()
    got = {r.id: r.text for r in extract(entries([deep, deep, boxes, boxes, *wide])).collect()}
    assert time.time() - t0 < 120
    assert got[0] == got[1] == "deep text" and got[2] == got[3] == "boxed text"
    for i in range(4):
        assert got[4 + i] == " ".join(f"w{k}" for k in range(20_000))


def test_sizes_and_paths_without_recursion():
    page = "<body><div>" + "<i>" * 4_000 + "x" + "</i>" * 4_000 + "</div><nav><a>menu</a></nav></body>"
    assert main_text(page, kept_paths(pattern(page))) == "x"


def plain_search(text, at):
    """Both patterns from the place on, an address first where they begin together."""
    mail, other = _EMAIL.search(text, at), _OTHERS.search(text, at)
    if mail and (other is None or mail.start() <= other.start()):
        return "email", mail.start(), mail.end(), mail.start(), mail.end()
    return (other.lastgroup, other.start(other.lastgroup), other.end(other.lastgroup), other.start(), other.end()) if other else None


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", "B7", ".", "-", "+", "_", "@", "x.org", "@mail.example.com", " ", "\n", "2024-01-31", "4111 1111 1111 1111", "key=", "0123456789abcdef", "é", "+1 212 555 0100", "10.1.2.3"]), max_size=14), st.integers(0, 6))
def test_search_finds_what_the_patterns_find(parts, step):
    text, at = "".join(parts), 0
    search = _Search(text)
    while True:
        got = search(at)
        assert got == plain_search(text, at)
        if got is None:
            break
        at = max(got[3] + 1, min(got[4], got[3] + step))


@pytest.mark.parametrize("n", [2, 3, LONG_NAME + 1, 1_000, 10_000])
def test_long_names_are_mixed_whole_and_restored(n):
    rng = random.Random(n)
    a = [rng.randrange(36) for _ in range(n)]
    moved = permute_symbols(a, 36, KEY, "email")
    assert permute_symbols(moved, 36, KEY, "email", back=True) == a and all(0 <= x < 36 for x in moved)
    if n > 100:
        for k in (0, n // 2, n - 1):
            b = a.copy()
            b[k] = (b[k] + 1) % 36
            same = sum(x == y for x, y in zip(moved, permute_symbols(b, 36, KEY, "email")))
            assert same < n / 36 * 2 + 20


def test_a_long_name_in_a_text(make_news):
    names = ["q" * 9_999 + "1", "q" * 9_999 + "2"]
    texts = [f"write to {n}@mail.example.org or {n}@mail.example.org." for n in names]
    got = [r.text for r in pseudonyms(make_news(list(enumerate(texts))), KEY).orderBy("id").collect()]
    for text, moved in zip(texts, got):
        a, b = (p.split("@")[0] for p in moved.removeprefix("write to ").split(" or "))
        assert a == b and len(a) == 10_000 and len(moved) == len(text) and pseudonymise_text(moved, KEY, restore)[0] == text
    assert got[0][9:200] != got[1][9:200]


def test_long_runs_are_searched_in_linear_time():
    for run in ("x" * 1_000_000 + " 7", "7a." * 300_000, "7-" * 400_000, "a@" * 300_000 + "7", "." * 500_000 + "7@", "A1B2" * 250_000):
        t0 = time.time()
        pseudonymise_text(run, KEY)
        assert time.time() - t0 < 20, run[:9]
