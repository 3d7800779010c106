"""Benchmark decontamination: windows of canonical templates, joined by hash, with a check that slots are filled alike."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_OR_PUNCTUATION, U, bit_filter, byte_set, mix, passes, slices, text_bytes, words
from .records import article_text

#: Words of a window, and the least of them that are no slots for a template. An item with fewer words is one window, if it has LITERAL at least.
WINDOW, LITERAL = 8, 4
#: Least share of an item's windows found in an article for it to be contaminated.
SHARE = 0.4
#: Item windows up to this many rows are broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000
# Units of measure that stand for a typed slot.
UNITS = "kg g mg lb km m cm mm mi ft h hr hrs min s sec ms kb mb gb tb percent usd eur gbp inr rs cr lakh crore bps"

_UNIT_HASHES = words(pa.array(UNITS.split()))[0]
_UNIT_NEAR = np.zeros(1 << 16, bool)
_UNIT_NEAR[(_UNIT_HASHES & U(0xFFFF)).astype(np.int64)] = True
_NUMBER, _NAME, _UNIT = (U(x) for x in (0xA5A5A5A5A5A5A501, 0xA5A5A5A5A5A5A502, 0xA5A5A5A5A5A5A503))
_UPPER, _DIGIT = byte_set(bytes(range(65, 91))), byte_set(bytes(range(48, 58)))
_LOWER_NEXT = byte_set(bytes(range(97, 123)) + bytes(range(128, 256)))
_STOP = byte_set(b".!?:;\n\r\"()|*%&$#-")
#: Added to words of plain windows (of windows without a template; of those with one, where a capital first letter counts).
_PLAIN, _CASED, _CAPITAL = (U(x) for x in (0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1, 0x510E527FADE682D1))
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(1024)], U)


def canonical(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template and own hash of every word, its own hash with the case of the first letter, whether it is a slot, and the words of each text.

    Words are runs outside white space and ASCII punctuation. Numbers, units, and capitalised words within a sentence
    (names) become typed slots; all others stay, in lower case. A capital at the start of a text or after a stop is no name.
    """
    spans: list = []
    own, counts = words(texts, SPACE_OR_PUNCTUATION, spans, latin=True)
    data, _ = text_bytes(texts)
    if not len(own):
        return own, own, own, np.zeros(0, bool), counts
    begin, end = (np.concatenate(x) for x in zip(*spans, strict=True))
    first = data[begin]
    opens = np.empty(len(own), bool)
    opens[0] = True
    opens[1:] = _STOP[data[end[:-1]]] | _STOP[data[begin[1:] - 1]]
    starts = np.cumsum(counts) - counts
    opens[starts[counts > 0]] = True
    number = _DIGIT[first]
    name = np.flatnonzero(_UPPER[first] & ~opens & (end - begin > 1))
    name = name[_LOWER_NEXT[data[begin[name] + 1]]]
    unit = np.flatnonzero(_UNIT_NEAR[(own & U(0xFFFF)).astype(np.int64)])
    unit = unit[np.isin(own[unit], _UNIT_HASHES)]
    template, slot = own.copy(), number.copy()
    template[number] = _NUMBER
    for at, kind in ((unit, _UNIT), (name, _NAME)):
        template[at], slot[at] = kind, True
    with np.errstate(over="ignore"):
        cased = own + _CASED + np.where(_UPPER[first], _CAPITAL, U(0))
    return template, own, cased, slot, counts


def windows(template: np.ndarray, slot: np.ndarray, counts: np.ndarray, width: int, least: int = LITERAL) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each window of ``width`` words, ``least`` of them no slots."""
    n = len(template) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    literal = np.concatenate(([0], np.cumsum(~slot)))
    with np.errstate(over="ignore"):
        total = np.full(n, width, U)
        for j in range(width):
            total += template[j : n + j] * _POWERS[j]
        inside = np.repeat(np.cumsum(counts), counts)[:n] - np.arange(n) >= width
        begin = np.flatnonzero(inside & (literal[width:] - literal[:n] >= least))
        return begin, mix(total[begin])


def _of_items(width: int):
    """Windows of each item: id, position, hash, slot values, words. An item may stand within a sentence, where its first word looks like a name, so its first window has that form too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for shift, form in ((0, text), (1, f"x {text.lstrip()[:1].upper()}{text.lstrip()[1:]}")):
                    template, own, cased, slot, counts = canonical(pa.array([form]))
                    template, own, cased, slot, counts = template[shift:], own[shift:], cased[shift:], slot[shift:], counts - shift
                    size = min(width, len(template))
                    if size < LITERAL:
                        continue
                    begin, value = windows(template, slot, counts, size)
                    rows += [(i, int(b), int(v), own[b : b + size][slot[b : b + size]].view(np.int64), size, True) for b, v in zip(begin, value.view(np.int64), strict=True) if not shift or b == 0]
                    if not shift:  # in plain words too; a short item of slots only identifies nothing
                        loose = set(begin.tolist())
                        both = zip(*windows(own + _PLAIN, slot, counts, size, int(size < width)), windows(cased, slot, counts, size, int(size < width))[1], strict=True)
                        rows += [(i, int(b), int((c if b in loose else v).view(np.int64)), [], size, False) for b, v, c in both]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (batch.column("id").type, pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "at", "window", "slots", "size", "template"])

    return run


def _of_articles(sizes: list[int], bitmap):
    """Windows of articles that the bitmap lets pass, in the sizes that the items' windows have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, "text", 1 << 18)):
            template, own, cased, slot, counts = canonical(batch.column("text"))
            ends = np.cumsum(counts)
            for size in sizes:
                for hashes, least in ((template, LITERAL), (own + _PLAIN, 0), (cased, 0)):
                    begin, value = windows(hashes, slot, counts, size, least)
                    keep = np.flatnonzero(passes(bitmap.value, value))
                    begin, value = begin[keep], value[keep]
                    row = np.searchsorted(ends, begin, "right")
                    slots = [own[b : b + size][slot[b : b + size]].view(np.int64) if least else [] for b in begin]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(pa.array(row, pa.int64())), pa.array(begin - (ends - counts)[row]), pa.array(value.view(np.int64)), pa.array(slots, pa.list_(pa.int64()))],
                        ["id", "at", "window", "slots"],
                    )

    return run


def contaminated(news: DataFrame, items: DataFrame, width: int = WINDOW, share: float = SHARE, id_col: str = "id", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Articles that hold an evaluation item, word for word or with other numbers, names and units in it.

    news: ``id``, ``title``, ``summary``; items: ``item_id``, ``text``; more columns are ignored. Returns one row per
    article and item: ``id``, ``item_id``, ``windows`` (of the item), ``matched``, ``share`` (at least ``share``) and
    ``same_slots`` (no slot is filled otherwise than in the item).

    Both texts become templates whose windows of ``width`` words are hashed. A bitmap of fixed size made from the
    items lets the few article windows through that can match; these are hash-joined with the items' windows. Windows
    on one alignment (article position less item position) must fill the item's slots by a one-to-one mapping; if they
    don't, only those with the very values of the item count. Windows also match by their plain words: those with fewer than
    LITERAL words that are no slots whatever their case, the others with the case of first letters. The share is that of the
    item's distinct windows, or of those with a template if that is larger.

    Items of fewer than LITERAL words, and shorter ones than ``width`` of slots only, contaminate nothing. Copies whose names
    are in another case are not found where the windows have templates. Null texts are empty.
    Rows with a null id are left out; repeated rows count once. No rows on either side give no rows.
    """
    of_items = items.select(F.col(item_col).alias("id"), F.col(item_text_col).alias("text")).where("id is not null and text is not null").distinct()
    kind = of_items.schema["id"].dataType.simpleString()
    item_windows = of_items.mapInArrow(_of_items(width), f"id {kind}, at long, window long, slots array<long>, size int, template boolean").distinct().select(
        F.col("id").alias("item_id"), F.col("at").alias("item_at"), "window", F.col("slots").alias("item_slots"), "size", "template"
    )
    sizes = [r["size"] for r in item_windows.select("size").distinct().orderBy("size").collect()]  # LITERAL to ``width``
    bitmap = news.sparkSession.sparkContext.broadcast(bit_filter(item_windows, "window"))
    texts = news.select(F.col(id_col).alias("id"), article_text(news).alias("text")).where("id is not null")
    kind = texts.schema["id"].dataType.simpleString()
    hits = texts.mapInArrow(_of_articles(sizes, bitmap), f"id {kind}, at long, window long, slots array<long>")
    few = item_windows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = hits.join(F.broadcast(item_windows) if few else item_windows, "window").select(
        "id", "item_id", "item_at", (F.col("at") - F.col("item_at")).alias("offset"), F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("s")).alias("filled"),
        (F.col("item_slots") == F.col("slots")).alias("same"),
    )
    pairs = F.array_distinct(F.flatten(F.collect_set("filled")))
    aligned = met.groupBy("id", "item_id", "offset").agg(
        F.collect_set("item_at").alias("all_at"), F.collect_set(F.when(F.col("same"), F.col("item_at"))).alias("same_at"), pairs.alias("pairs"),
    )
    column = lambda n: F.size(F.array_distinct(F.transform("pairs", lambda p: p[n])))
    one_to_one = (column("i") == F.size("pairs")) & (column("s") == F.size("pairs"))
    found = aligned.select("id", "item_id", F.when(one_to_one, F.col("all_at")).otherwise(F.col("same_at")).alias("at"), F.size("same_at").alias("n_same"))
    # Copies with other slots can match templates only, so their windows are a measure of their own.
    per_item = item_windows.groupBy("item_id").agg(F.countDistinct("item_at").alias("n"), F.collect_set(F.when(F.col("template"), F.col("item_at"))).alias("loose"))
    counted = found.groupBy("id", "item_id").agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("at"), F.max("n_same").alias("n_same"))
    loose = F.size(F.array_intersect("at", "loose"))
    by_template = (F.size("loose") > 0) & (loose * F.col("n") > F.size("at") * F.size("loose"))
    measured = counted.join(F.broadcast(per_item) if few else per_item, "item_id").select(
        "id", "item_id", F.when(by_template, F.size("loose")).otherwise(F.col("n")).cast("long").alias("windows"), F.when(by_template, loose).otherwise(F.size("at")).alias("matched"), "n_same",
    )
    return (
        measured.withColumn("share", F.col("matched") / F.col("windows")).where(F.col("share") >= share)
        .select("id", "item_id", "windows", "matched", "share", (F.col("n_same") >= F.col("matched")).alias("same_slots"))
    )
