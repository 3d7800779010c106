"""Format-preserving pseudonyms of personal numbers and dates in articles, by a keyed Feistel permutation."""

from __future__ import annotations

import datetime
import hashlib
import math
import re
import string
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .records import article_text

ROUNDS = 8
KINDS = ("email", "iban", "date", "ip", "ssn", "phone", "secret", "card")
_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
#: Longer names are permuted as strings instead of as one number.
LONG_NAME = 128
_ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyz"
_EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._+\-]*@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}")
_NAME = frozenset(string.ascii_letters + string.digits + "._+-")
#: All kinds but e-mail addresses, whose names may be of any length and are found from their @.
_OTHERS = re.compile(
    r"(?<![A-Za-z0-9])(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
    r"|(?<![\w.\-/])(?P<date>\d{4}([-/.])\d{1,2}\3\d{1,2}|\d{1,2}([-/.])\d{1,2}\4\d{4})(?![\w\-/]|\.\d)"
    r"|(?<![\w.])(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?![\w]|\.\d)"
    r"|(?<![\w\-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w\-])"
    r"|(?<![\w])(?P<phone>\+\d{1,3}[ .\-]?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}|\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}|\+\d{1,3}(?:[ .\-]?\d{2,4}){2,4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?![\w]|-\d)"
    r"|(?i:token|secret|password|api_?key|key)\s*[=:]\s*[\"']?(?P<secret>[0-9a-fA-F]{16,128})(?![\w])"
    r"|(?<![\w.\-])(?P<card>\d(?:[ \-]?\d){12,18})(?![\w]|-\d)"
)
#: What each value has.
_MAYBE = re.compile(r"\d|@|(?i:token|secret|password|key)")
#: The same for one kind each, to try others where a value of one kind failed its check.
_ONE = {
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ssn": re.compile(r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])"),
    "phone": re.compile(r"(?<![\w])(?:\+\d{1,3}[ .\-]?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}|\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}|\+\d{1,3}(?:[ .\-]?\d{2,4}){2,4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?![\w]|-\d)"),
    "card": re.compile(r"(?<![\w.\-])\d(?:[ \-]?\d){12,18}(?![\w]|-\d)"),
}
#: Digits of the groups that cards are printed in, besides one group.
_PRINTED = ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4))


@lru_cache(1 << 16)
def permute(value: int, size: int, key: bytes, kind: str) -> int:
    """Where a keyed permutation of range(size) takes the value: Feistel rounds over the bits, again while the result is outside."""
    half = max(1, math.ceil((size - 1).bit_length() / 2))
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for r in range(ROUNDS):
            block = f"{kind}|{size}|{r}|{right}".encode()
            left, right = right, left ^ (int.from_bytes(hashlib.blake2b(block, key=key, digest_size=64).digest(), "big") & mask)
        value = (right << half) | left
        if value < size:
            return value


def restore(value: int, size: int, key: bytes, kind: str) -> int:
    """The inverse of ``permute``."""
    half = max(1, math.ceil((size - 1).bit_length() / 2))
    mask = (1 << half) - 1
    while True:
        right, left = value >> half, value & mask
        for r in reversed(range(ROUNDS)):
            block = f"{kind}|{size}|{r}|{left}".encode()
            left, right = right ^ (int.from_bytes(hashlib.blake2b(block, key=key, digest_size=64).digest(), "big") & mask), left
        value = (left << half) | right
        if value < size:
            return value


def luhn_digit(body: str) -> int:
    """The check digit behind the digits."""
    total = sum(sum(divmod(int(c) * 2, 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
    return -total % 10


def _stream(symbols: list[int], n: int, key: bytes, kind: str, r: int) -> Iterator[int]:
    """n numbers that depend on all of the symbols."""
    seed = hashlib.blake2b(f"{kind}|{r}|".encode() + bytes(symbols), key=key, digest_size=64).digest()
    for k in range(0, n, 16):
        block = hashlib.blake2b(k.to_bytes(8, "big") + seed, key=key, digest_size=64).digest()
        yield from (int.from_bytes(block[i : i + 4], "big") for i in range(0, 4 * min(16, n - k), 4))


def permute_symbols(symbols: list[int], radix: int, key: bytes, kind: str, back: bool = False) -> list[int]:
    """A keyed permutation of long strings: one half is added to by numbers that all of the other half makes, in turns. Linear in the length."""
    half = len(symbols) // 2
    sides = [symbols[:half], symbols[half:]]
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        own, other = sides[r % 2], sides[1 - r % 2]
        sides[r % 2] = [(x + (-y if back else y)) % radix for x, y in zip(own, _stream(other, len(own), key, kind, r), strict=True)]
    return sides[0] + sides[1]


def _put(shape: str, symbols: str, holds: Callable[[str], bool] = str.isdigit) -> str:
    """The symbols at the places of the shape that ``holds`` accepts; separators stay."""
    fresh = iter(symbols)
    return "".join(next(fresh) if holds(c) else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _decimal(body: str, key: bytes, kind: str, move) -> str:
    return str(move(int(body), 10 ** len(body), key, f"{kind}{len(body)}")).zfill(len(body))


def _card(text: str, key: bytes, move) -> str | None:
    d = _digits(text)
    if luhn_digit(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
        return None
    body = _decimal(d[:-1], key, "card", move)
    return _put(text, body + str(luhn_digit(body)))


def _iban_check(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def _iban(text: str, key: bytes, move) -> str | None:
    s = text.replace(" ", "")
    country, body = s[:2], s[4:]
    if not 15 <= len(s) <= 34 or _iban_check(country, body) != int(s[2:4]) or not any(c.isdigit() for c in body):
        return None
    body = _put(body, _decimal(_digits(body), key, "iban", move))
    return _put(text, f"{country}{_iban_check(country, body):02d}{body}", str.isalnum)


def _date(text: str, key: bytes, move) -> str | None:
    sep = re.search(r"[-/.]", text)[0]
    parts = text.split(sep)
    order = (0, 1, 2) if len(parts[0]) == 4 else (2, 1, 0)
    y, m, d = (int(parts[i]) for i in order)
    swapped = False
    try:
        day = datetime.date(y, m, d)
    except ValueError:
        if order[0] == 0:
            return None
        try:
            day, swapped = datetime.date(y, d, m), True
        except ValueError:
            return None
    if not _FIRST <= day.toordinal() <= _LAST:
        return None
    # A date with the month first has a day above 12, and stays one: it moves among the days of its own kind.
    while True:
        day = datetime.date.fromordinal(_FIRST + move(day.toordinal() - _FIRST, _LAST - _FIRST + 1, key, "date"))
        if not swapped or day.day > 12:
            break
    new = {order[0]: f"{day.year:04d}", order[1]: f"{day.day if swapped else day.month:02d}", order[2]: f"{day.month if swapped else day.day:02d}"}
    return sep.join(new[i] for i in range(3))


def _ip(text: str, key: bytes, move) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255:
        return None
    value = move(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, value.to_bytes(4, "big")))


def _ssn(text: str, key: bytes, move) -> str | None:
    valid = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    d = _digits(text)
    if not valid(d):
        return None
    while True:
        d = _decimal(d, key, "ssn", move)
        if valid(d):
            return _put(text, d)


def _phone(text: str, key: bytes, move) -> str | None:
    d = _digits(text)
    if not 8 <= len(d) <= 15:
        return None
    n = min(10, len(d) - (1 if text[0] == "+" else 0))
    return _put(text, d[:-n] + _decimal(d[-n:], key, "phone", move))


def _symbols(text: str, key: bytes, kind: str, move, radix: int) -> str:
    """Letters and digits as one number of the radix; the case of each place stays."""
    s = "".join(c for c in text if c.isalnum()).lower()
    if len(s) > LONG_NAME:
        moved = permute_symbols([_ALPHABET.index(c) for c in s], radix, key, f"{kind}{len(s)}", back=move is restore)
        out = [_ALPHABET[x] for x in reversed(moved)]
    else:
        value, out = move(int(s, radix), radix ** len(s), key, f"{kind}{len(s)}"), []
        for _ in s:
            value, r = divmod(value, radix)
            out.append(_ALPHABET[r])
    new = _put(text, "".join(reversed(out)), str.isalnum)
    return "".join(b.upper() if a.isupper() else b for a, b in zip(text, new, strict=True))


def _email(text: str, key: bytes, move) -> str | None:
    local, host = text.rsplit("@", 1)
    return f"{_symbols(local, key, 'email', move, 36)}@{host}"


def _secret(text: str, key: bytes, move) -> str | None:
    return _symbols(text, key, "secret", move, 16)


_MOVE = {"email": _email, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "secret": _secret, "card": _card}


class _Search:
    """The next candidate at or after a place: of those that begin first an address, else what ``_OTHERS`` finds. Linear in the text, as either side is looked for again only when the search has passed it."""

    def __init__(self, text: str):
        self.text, self.mail, self.other = text, (-1, -1), None
        self.looked = -1

    def _email(self, at: int) -> tuple[int, int]:
        text, p = self.text, self.text.find("@", at)
        while p >= 0:
            i = p
            while i > at and text[i - 1] in _NAME:
                i -= 1
            while i < p and text[i] in "._+-":
                i += 1
            if i < p and (m := _EMAIL.match(text, i)):
                return i, m.end()
            p = text.find("@", p + 1)
        return len(text) + 1, 0

    def __call__(self, at: int) -> tuple[str, int, int, int, int] | None:
        """kind, begin and end of the value, begin and end of what was matched."""
        if self.mail[0] < at:
            self.mail = self._email(at)
        if self.looked < 0 or self.other is not None and self.other.start() < at:
            self.other, self.looked = _OTHERS.search(self.text, at), at
        m, (a, b) = self.other, self.mail
        if a <= len(self.text) and (m is None or a <= m.start()):
            return "email", a, b, a, b
        return (m.lastgroup, m.start(m.lastgroup), m.end(m.lastgroup), m.start(), m.end()) if m else None


def pseudonymise_text(text: str, key: bytes, move=permute) -> tuple[str, dict[str, int]]:
    """The text with every validated value moved within its format, and how many of each kind. ``move=restore`` undoes it."""
    if not _MAYBE.search(text):
        return text, {}
    seen: dict[str, int] = {}
    out: list[str] = []
    done = at = inner = 0
    failed: list[tuple[int, int, str]] = []
    search = _Search(text)
    while found := search(at):
        kind, start, stop, first, last = found
        others = [(k, o) for k, p in _ONE.items() if k != kind and start == first and (o := p.match(text, start))]
        for k, begin, end in (r for k, e in [(kind, stop), *((k, o.end()) for k, o in others)] for r in _readings(text, k, start, e, start < inner)):
            moved = _MOVE[k](text[begin:end], key, move)
            # A reading that failed must fail beside the new value too, or the value would not be found again.
            while moved is not None and any(_MOVE[f](text[x:begin] + moved[max(0, x - begin) : max(0, y - begin)] + text[end:y], key, move) is not None for x, y, f in failed if x <= begin < y or begin <= x < end):
                moved = _MOVE[k](moved, key, move)
            if moved is not None:
                seen[k] = seen.get(k, 0) + 1
                out += (text[done:begin], moved)
                done = at = end
                break
            failed.append((begin, end, k))
        else:  # the next value may begin within it
            at, inner = first + 1, max(inner, last)
        failed = [f for f in failed if f[1] > at]
    return "".join((*out, text[done:])), seen


def _readings(text: str, kind: str, start: int, end: int, inner: bool) -> Iterator[tuple[str, int, int]]:
    """What a candidate may be, likeliest first: a card as printed, the whole, then shorter ones that end before a separator.

    Only a whole candidate may be a card in groups of any size; a part of one, or one within a failed one (``inner``), has
    four digits or more in all groups but its last, or lists of small numbers would hold cards by chance.
    """
    if kind not in ("card", "iban", "phone"):
        yield kind, start, end
        return
    told: set[tuple[int, int]] = set()
    groups = [(g.start(), g.end()) for g in re.compile(r"\w+").finditer(text, start, end)]
    if kind == "card":
        sizes = [e - s for s, e in groups]
        for i in range(len(groups)):
            for j in range(i + 1, len(groups) + 1):
                if j == i + 1 and 13 <= sizes[i] <= 19 or tuple(sizes[i:j]) in _PRINTED:
                    told.add((groups[i][0], groups[j - 1][1]))
                    yield kind, groups[i][0], groups[j - 1][1]
    for n in range(len(groups), 0, -1):
        e = groups[n - 1][1] if n < len(groups) else end
        part = inner or n < len(groups)
        if (start, e) not in told and (kind != "card" or not part or all(y - x >= 4 for x, y in groups[: n - 1])) and _ONE[kind].fullmatch(text, start, e):
            yield kind, start, e


def _map(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, "text")):
            done = [pseudonymise_text(t, key) for t in batch.column("text").to_pylist()]
            texts = pa.array([t for t, _ in done], pa.string())
            counts = [pa.array([n.get(k, 0) for _, n in done], pa.int32()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([batch.column("id"), texts, *counts], ["id", "text", *(f"n_{k}" for k in KINDS)])

    return run


def pseudonyms(news: DataFrame, key: bytes, id_col: str = "id") -> DataFrame:
    """Articles with personal numbers and dates replaced by pseudonyms of the same format.

    news: ``id``, ``title``, ``summary``; more columns are ignored. Returns one row per input row: ``id``, ``text`` (whole)
    and the number of replaced values of each kind (``n_card``, ``n_date``, ...).

    Only values that pass their format's check are touched: cards (Luhn), IBANs (mod 97), calendar dates 1900-2099, IPv4
    addresses, US social security numbers, telephone numbers, e-mail names and assigned hexadecimal secrets. Each is a number of a
    range and goes through a Feistel permutation of that range under ``key`` (16 to 64 bytes, kept secret), check digits
    made anew. A candidate that fails is read in shorter ways, and the search goes on within it. Equal values have equal pseudonyms in all articles however they are punctuated, different ones different
    pseudonyms, and who has the key can undo it. A value's pseudonym depends on nothing else, so one map pass is all.

    Null title and summary count as empty. Null and repeated ids are handled like others. No rows give no rows.
    """
    texts = news.select(F.col(id_col).alias("id"), article_text(news).alias("text"))
    return texts.mapInArrow(_map(key), f"id {texts.schema['id'].dataType.simpleString()}, text string, {', '.join(f'n_{k} int' for k in KINDS)}")
