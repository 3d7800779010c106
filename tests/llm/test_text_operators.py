"""Mixing, token counts, pseudonyms, decontamination, classifiers and extraction."""

import datetime
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from barflow.llm import mixing, tokencount
from barflow.llm.decontaminate import contaminated
from barflow.llm.extraction import extract, expression, main_text, pattern, kept_paths, wrappers
from barflow.llm.mixing import MOST_REPEATS, mixture, shares
from barflow.llm.pseudonyms import luhn_digit, permute, pseudonymise_text, pseudonyms, restore
from barflow.llm.quality import quality_votes
from barflow.llm.tokencount import token_counts
from barflow.llm.toxicity import toxicity

from .conftest import ODD, prose

KEY = b"0123456789abcdef"


# Mixing


def plain_shares(sizes, weights):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, capped = dict.fromkeys(names, 0.0), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = sum(sizes.values()) - sum(MOST_REPEATS * sizes[s] for s in capped)
        target = {s: MOST_REPEATS * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > MOST_REPEATS * sizes[s]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("seed", range(8))
def test_shares_reshare_until_none_is_above(seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 5, 80, 4000]) for i in range(rng.randrange(1, 9))} | ({None: 30} if seed % 2 else {})
    got = {p.source: p.target for p in shares(sizes)}
    assert got == pytest.approx(plain_shares(sizes, (1, 2, 3)))
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def mix_rows():
    rng = random.Random(5)
    sizes = {"a": 40, "b": 3, "c": 60, "é": 1, None: 10}
    return [(len(sizes) * i + n, " ".join(prose(i, rng.choice([0, 1, 3, 30, 900]))), s) for n, (s, k) in enumerate(sizes.items()) for i in range(k)]


@pytest.mark.parametrize("block", [16, 1024])
def test_mixture_takes_the_targets(make_news, block):
    rows = mix_rows()
    got = mixture(make_news(rows), block_words=block).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert 0 <= r.taken <= MOST_REPEATS * r.size and r.size == len(dict((i, t) for i, t, _ in rows)[r.id].split())
    for rs in by.values():
        assert sum(r.size for r in rs) == rs[0].source_size and abs(sum(r.taken for r in rs) - rs[0].target) <= 1
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixture(make_news(rows[::-1]), block_words=block).collect()), key=str)


def test_mixture_schedule_interleaves_and_has_every_slot(spark, make_news):
    parts = shares({"a": 9_000, "b": 20_000, "c": 300})
    ends, slots = mixing._schedule(parts)
    got = mixing.slot_schedule(make_news([]), parts, ends, slots).orderBy("slot").collect()
    words = defaultdict(int)
    for r in got:
        p = parts[r.source_no]
        words[r.source_no] += p.size // p.blocks + (r.block < p.size % p.blocks) if r.words is None else r.words
    assert [words[i] for i in range(3)] == [p.words for p in parts]
    half = [r.source_no for r in got[: len(got) // 2]]
    assert abs(half.count(1) / len(half) - parts[1].slots / sum(p.slots for p in parts)) < 0.1


def test_mixture_of_odd_rows(make_news):
    assert mixture(make_news([])).collect() == []
    rows = [(i, t, s) for (i, t), s in zip(ODD, ["x", None, "", "x", "x"] * 3, strict=False)]
    got = mixture(make_news(rows)).collect()
    assert len(got) == len(rows) and {r.source for r in got} == {"x", None, ""}
    assert {(r.taken, r.target) for r in mixture(make_news([(1, None), (2, " ")])).collect()} == {(0, 0.0)}


# Token counts


def test_token_counts_are_those_of_the_library(make_news):
    from tokenizers import Tokenizer
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [" Hello  world's\n\n x² it'll 12½ªº\x1c\x85\xa0y", "<|endoftext|>a <|endoftext|>", "naïve façade — “quotes” 漢字 🙂", "\t\t tabs \r\n", "É" * 70 + " " * 70, "don't DON'T", *(t or "" for _, t in ODD)]
    rows = [*enumerate(texts), (None, "null id"), (1, "again"), (90, None)]
    tok = Tokenizer.from_file(path)
    got = token_counts(make_news(rows), path, limit=20).collect()
    assert sorted((str(r.id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(
        (str(i), len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 20) for i, t in rows
    )
    assert token_counts(make_news([]), path).collect() == []


def test_every_settled_character_splits_alike(make_news, monkeypatch):
    from tokenizers import Tokenizer
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    chars = "".join(chr(c) for c in range(1, tokencount.SETTLED) if not 0xD800 <= c < 0xE000)
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(chars) for _ in range(200))) for i in range(150)]
    tok = Tokenizer.from_file(path)
    monkeypatch.setattr(tokencount, "CACHED", 10)
    assert {r.id: r.n_tokens for r in token_counts(make_news(rows), path).collect()} == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in rows}


# Pseudonyms


@pytest.mark.parametrize("size", [1, 2, 10, 36, 73_049, 10**10, 1 << 32])
def test_permutation_is_one_to_one_and_has_an_inverse(size):
    some = range(size) if size <= 100 else random.Random(1).sample(range(size), 100)
    moved = [permute(v, size, KEY, "t") for v in some]
    assert len(set(moved)) == len(moved) and all(0 <= m < size for m in moved)
    assert [restore(m, size, KEY, "t") for m in moved] == list(some)


def test_values_keep_their_format_and_go_back():
    card = "453201511283036" + str(luhn_digit("453201511283036"))
    text = f"{card}, {card[:4]} {card[4:8]} {card[8:12]} {card[12:]}; +1 (017) 555-7713 97.51.17.173 2024-02-29 31/12/1999 12/31/1999 Anna.Lee-7@mail.example.com 219-09-9999 GB82 WEST 1234 5698 7654 32 token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\""
    new, seen = pseudonymise_text(text, KEY)
    assert seen == {"card": 2, "phone": 1, "ip": 1, "date": 3, "email": 1, "ssn": 1, "iban": 1, "secret": 1}
    assert len(new) - len(text) == sum(len(x) for x in re.findall(r"[\d.]+\.\d+\.\d+", new)) - len("97.51.17.173")
    a, b = re.match(r"(\d{16}), (\d{4} \d{4} \d{4} \d{4});", new).groups()
    assert a == b.replace(" ", "") != card and luhn_digit(a[:-1]) == int(a[-1])
    datetime.date.fromisoformat(re.search(r"\d{4}-\d\d-\d\d", new)[0])
    assert pseudonymise_text(new, KEY, restore)[0] == text
    assert pseudonymise_text(text, KEY + b"x")[0] != new


def test_what_is_no_valid_value_stays():
    text = "9807915762804490 1.2.3.400 2024-02-30 99/99/2000 000-12-3456 version 1.2.3 room 12-34 GB00 WEST 1234 5698 7654 32 user@host 1234567 4111111111111112"
    assert pseudonymise_text(text, KEY) == (text, {})


def test_values_beside_other_digits_are_found_and_linked():
    new = lambda t, move=permute: pseudonymise_text(t, KEY, move)[0]
    card, spaced, iban = "4111111111111111", "4111 1111 1111 1111", "BE68539007547034"
    for n in range(300):
        for old, beside in [(card, f" {n}/25"), (spaced, f" {n:03d}"), (spaced.replace(" ", "-"), f"-{n:03d}"), (card, f"-{n:02d}")]:
            text = f"paid {old}{beside}"
            assert new(text) == f"paid {new(old)}{beside}" and new(new(text), restore) == text
        text = f"{n % 100:02d} {card}"
        assert new(text) == f"{n % 100:02d} {new(card)}" and new(new(text), restore) == text
        text = f"to {iban} {2000 + n} or GB00 {spaced} end"
        assert new(text).endswith(f" or GB00 {new(spaced)} end") and new(new(text), restore) == text
    assert new(f"{iban} 2024") == f"{new(iban)} 2024" and new(iban) != iban
    assert pseudonymise_text("from 1.2.3.4 secret=abcdefabcdefabcdef", KEY)[1] == {"ip": 1, "secret": 1}
    assert new(new("at 1.2.3.4 key: deadbeefdeadbeef"), restore) == "at 1.2.3.4 key: deadbeefdeadbeef"


def test_pseudonyms_of_odd_rows(make_news):
    got = pseudonyms(make_news([*ODD, (20, "call +1 (017) 555-7713"), (21, "or +1 (017) 555-7713 now")]), KEY).collect()
    assert len(got) == len(ODD) + 2 and pseudonyms(make_news([]), KEY).collect() == []
    assert {(str(r.id), r.text) for r in got if not r.n_phone} == {(str(i), t or "") for i, t in ODD}
    assert len({re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", r.text)[0] for r in got if r.n_phone}) == 1


# Decontamination


def test_leaks_verbatim_and_with_other_slots(spark, make_news):
    question = "In the morning Alice buys 3 kg of apples and 4 lb of pears while Robert sells 12 eggs to Alice for 5 usd"
    other = question.replace("Alice", "Maria").replace("Robert", "Jonas").replace("3 kg", "7 lb").replace(" 12 ", " 40 ").replace("4 lb", "9 kg").replace(" 5 ", " 8 ")
    twisted = other.replace("to Maria", "to Jonas").replace("Jonas sells", "Maria sells").replace("40", "7")
    items = spark.createDataFrame([(1, question), (2, "one two three four five six"), (3, None), (4, ""), (5, "1 2 3 4 5"), (1, question)], "item_id long, text string")
    pad, end = " ".join(prose(1, 40)), " ".join(prose(2, 40))
    rows = [
        (1, f"{pad} {question} {end}"), (2, f"{pad}. {other}. {end}"), (3, f"{pad} {twisted} {end}"), (4, f"{pad} {end}"), (5, f"{pad} One two three, four five six {end}"), (6, question.upper()),
        (7, " ".join(question.split()[:9]) + " " + end), (8, "1 2 3 4 5 6 7 8 9 10"), *((i + 20 if i else None, t) for i, t in ODD), (None, question), (1, f"{pad} {question} {end}"),
    ]
    got = {(r.id, r.item_id): r.same_slots for r in contaminated(make_news(rows), items).collect()}
    assert got == {(1, 1): True, (2, 1): False, (5, 2): True}
    assert contaminated(make_news([]), items).collect() == [] and contaminated(make_news(rows), items.limit(0)).collect() == []


def test_leaks_of_items_made_of_slots(spark, make_news):
    table = "Paris 12 kg 35 usd London 7 kg 3 usd Rome 9 lb 48 usd Oslo 5 lb 66 usd"
    quoted = "so Alice met Robert and they paid Maria with Jonas for bread"
    texts = ["What is 37 + 48?", "Compute 12 + 35 - 7 * 3 / 2", table, quoted, "1 2 3 4 5"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    pad, end = " ".join(prose(1, 40)), " ".join(prose(2, 40))
    rows = [(i, f"{pad} {t} {end}") for i, t in enumerate(texts)]
    rows += [(10, f"{pad} what is 37 + 48 {end}"), (11, f"{pad} What is 37 + 49? {end}"), (12, f"{pad} {table.lower()} {end}"), (13, f"{pad} compute 12 + 35 - 8 * 3 / 2 {end}")]
    rows += [(14, " ".join(f'"{w}' if w in ("Alice", "Robert", "Maria", "Jonas") else w for w in quoted.split()))]
    got = {(r.id, r.item_id): r.same_slots for r in contaminated(make_news(rows), items).collect()}
    assert got == {(0, 0): True, (1, 1): True, (2, 2): True, (3, 3): True, (10, 0): True, (12, 2): True, (14, 3): True}


def test_leaks_beyond_the_broadcast(spark, make_news, monkeypatch):
    from barflow.llm import decontaminate

    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    items = spark.createDataFrame([(i, " ".join(prose(i, 30))) for i in range(20)], "item_id long, text string")
    rows = [(i, " ".join(prose(100 + i, 50) + prose(i % 20, 30) + prose(200 + i, 50))) for i in range(40)]
    assert {(r.id, r.item_id) for r in contaminated(make_news(rows), items).collect()} == {(i, i % 20) for i in range(40)}


# Classifiers


def test_toxic_posts_are_told_from_others(spark):
    rng, rows, labels = random.Random(4), [], []
    for i in range(900):
        w = prose(i, 60, 300)
        kind = rng.choice(["", "", "insult", "threat"])
        for _ in range(3 if kind else 0):
            w[rng.randrange(60)] = f"{kind}{rng.randrange(4)}"
        rows.append((i, " ".join(w), "clash"))
        labels.append((i, int(kind != ""), int(kind == "threat"), 0))
    posts = spark.createDataFrame(rows, "id long, text_snippet string, words string")
    marks = spark.createDataFrame(labels[:600] + [(1, 0, 0, 0), (None, 1, 1, 1)] , "id long, abuse int, threat int, never int")
    got = {r.id: r for r in toxicity(posts, marks, ("abuse", "threat", "never")).collect()}
    unseen = range(600, 900)
    assert np.mean([got[i].rejected == bool(labels[i][1]) for i in unseen]) > 0.97
    assert np.mean([(got[i].p_threat > 0.5) == bool(labels[i][2]) for i in unseen]) > 0.97 and max(r.p_never for r in got.values()) < 0.1
    again = {r.id: r.p_abuse for r in toxicity(posts.repartition(5), marks, ("abuse", "threat", "never")).collect()}
    assert again == pytest.approx({i: r.p_abuse for i, r in got.items()})


def test_toxicity_of_odd_rows(spark):
    posts = spark.createDataFrame(ODD, "id long, text_snippet string")
    none = spark.createDataFrame([], "id long, toxic int")
    got = toxicity(posts, none, ("toxic",)).collect()
    assert len(got) == len(ODD) and not any(r.rejected for r in got)
    assert toxicity(posts.limit(0), none, ("toxic",)).collect() == []


def test_votes_tell_junk_from_prose(spark, make_news):
    rng, rows = random.Random(2), []
    for i in range(400):
        w = prose(i, 80)
        rows.append((i, " ".join(w) if i % 2 else rng.choice([" ".join(x + "$$$" for x in w), " ".join(w).upper(), " ".join(w[:2] * 40), " | ".join(w)])))
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(200)] + [(None, 1, "x"), (3, 1, "x")], "id long, label int, source string")
    got = {r.id: r for r in quality_votes(make_news(rows), labels).collect()}
    assert np.mean([got[i].predicted == i % 2 for i in range(200, 400)]) > 0.95 and all(0 <= r.score <= 1 for r in got.values())
    odd = quality_votes(make_news(ODD), labels.limit(0)).collect()
    assert len(odd) == len(ODD) and {r.score for r in odd} == {0.5} and quality_votes(make_news([]), labels).collect() == []
    assert len(quality_votes(make_news(ODD + rows), labels).collect()) == len(ODD) + len(rows)


# Extraction


def page(title, paragraphs, extra=""):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href=x>More</a></li></ul></nav>"
        f"<div class='cookie-notice'>We use cookies</div><div class=\"ad\">Buy {title}</div><article><h1>{title}</h1>{body}{extra}</article><section id='comments'><p>First!</p></section><aside>Side</aside><form>Mail <input></form><footer>&copy; x</footer></body></html>"
    )


def test_main_text_of_marked_articles(spark):
    rows = [(i, f"https://a.example.org/{i}", page(f"T{i} &amp; more", [f"par  {j}\n of <b>b</b>old{i}" for j in range(i % 4)], "<div class='share-bar'>Share</div>" if i % 2 else "")) for i in range(6)]
    got = {r.id: r.text for r in extract(spark.createDataFrame(rows, "id long, link string, summary string")).collect()}
    assert got == {i: " ".join([f"T{i} & more"] + [f"par {j} of bold{i}" for j in range(i % 4)]) for i in range(6)}


def test_templates_of_one_host_keep_their_own_regions(spark):
    body = lambda i: f"<h1>Head {i}</h1>" + "".join(f"<p>Paragraph {j} of page {i} says something at length.</p>" for j in range(3))
    text = lambda i: " ".join([f"Head {i}"] + [f"Paragraph {j} of page {i} says something at length." for j in range(3)])
    around = [
        "<article>{}</article>", "<main>{}</main>", "<div class=content>{}</div>", "<div>{}</div>", "<main>{}</main><article><a href=x>Teaser</a></article>",
        "<article><p>A teaser.</p></article><main>{}</main><article><p>One more.</p></article>", "<main><article>{}</article><p>Written by someone.</p></main>",
    ]
    for link in ("https://t.example.org/{}", "no host {}"):
        rows = [(i, link.format(i), f"<html><body><nav><a href=/>Home</a></nav>{around[i % 7].format(body(i))}<footer>end</footer></body></html>") for i in range(21)]
        assert {r.id: r.text for r in extract(spark.createDataFrame(rows, "id long, link string, summary string")).collect()} == {i: text(i) for i in range(21)}


def test_unmarked_pages_of_one_host_share_a_wrapper(spark):
    def plain(i):
        links = "".join(f"<td><a href=/{j}>section {j}</a></td>" for j in range(4))
        return f"<html><body><table><tr>{links}</tr></table><div><h2>Head {i}</h2>" + "".join(f"<p>Paragraph {j} of page {i}, with <a href=q>a link</a>.</p>" for j in range(1 + i % 3)) + "</div><div class=footer>All rights</div></body>"

    rows = [(i, f"http://b.example.org:80/{i}", plain(i)) for i in range(5)]
    entries = spark.createDataFrame(rows, "id long, link string, summary string")
    got = {r.id: r.text for r in extract(entries).collect()}
    assert got == {i: " ".join([f"Head {i}"] + [f"Paragraph {j} of page {i}, with a link." for j in range(1 + i % 3)]) for i in range(5)}
    (w,) = wrappers(entries).collect()
    assert w.host == "b.example.org"


def test_patterns_are_union_free():
    a = pattern("<ul><li>x</li><li>y</li></ul><dl><dt>1<dd>2<dt>3<dd>4</dl>")
    assert expression(a) == "<ul>(<li>#</>)+</><dl>(<dt>#</>)+(<dd>#</>)+</>"
    from barflow.llm.extraction import merge

    both = merge(pattern("<p>a</p><hr><table></table>"), pattern("<h1>t</h1><p>a</p><p>b<i>c</i></p>"))
    assert expression(both) == "(<h1>#</>)?(<p>#(<i>#</>)?</>)+(<table></>)?"


def test_broken_pages_and_odd_rows(spark, make_news, monkeypatch):
    from barflow.llm import extraction

    rows = [(1, None, None), (2, "no host", ""), (3, "http://c/", "<article><p>open <b>tags<p>second &lt;x&gt; 3 < 4"), (4, "http://c/", "just text"), (4, "http://c/", "just text"), (None, "http://d/x", "<script>never closed"), (5, "http://e/", "<p>" * 3_000 + "deep"), (6, "http://f/", "<article>" + "<p>w</p>" * 20_000)]
    entries = spark.createDataFrame([(*r, "clash", 1) for r in rows], "id long, link string, summary string, wrapper string, host int")
    got = extract(entries).collect()
    monkeypatch.setattr(extraction, "BROADCAST_HOSTS", 0)
    assert sorted(map(str, extract(entries).collect())) == sorted(map(str, got)) and len(got) == len(rows)
    by = {r.id: r for r in got}
    assert by[3].text == "open tags second <x> 3 < 4" and by[6].n_chars == 39_999 and by[5].text == "deep" and by[1].text == "" and by[None].text == ""
    assert extract(entries.limit(0)).collect() == []
