"""Token counts of articles under a byte-level BPE vocabulary, by a two-tier lookup of pre-token lengths inside the map tasks."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .records import article_text

#: Articles, and characters of each, whose pre-tokens fill the broadcast table, and its entries. The table only saves time: counts don't depend on it.
WARM_ARTICLES, WARM_CHARACTERS, FREQUENT = 2_000, 4_096, 32_768
#: Misses a worker remembers before it starts anew, and the longest pre-token remembered.
CACHED, LONGEST = 500_000, 64
#: Below this code point the classes of letters, numbers and white space are settled in all versions of Unicode.
SETTLED = 0x250


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(SETTLED) if unicodedata.category(chr(c))[0] == kind)


def pre_token_pattern() -> re.Pattern:
    """The vocabulary's split pattern over settled characters: contractions, letters, numbers, others (each after a space), white space."""
    letter, number, space = _class("L"), _class("N"), "\\t-\\r \\x85\\xa0"
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


_unsettled = re.compile(f"[^\\x00-{chr(SETTLED - 1)}]")
_state: dict = {}


def _open(tokenizer_path: str):
    if _state.get("path") != tokenizer_path:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        _state.update(path=tokenizer_path, tokenizer=tokenizer, split=pre_token_pattern(), special=re.compile("|".join(map(re.escape, special))) if special else None, cache={})
    return _state


class _Lengths(dict):
    """Lengths of pre-tokens: the broadcast table first, then what this worker has encoded."""

    def __init__(self, frequent: dict, tokenizer):
        super().__init__(frequent)
        self.frequent, self.tokenizer = frequent, tokenizer

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= LONGEST:
            if len(self) > CACHED + len(self.frequent):
                self.clear()
                self.update(self.frequent)
            self[piece] = n
        return n


def _count(text: str, state: dict, lengths: _Lengths) -> int:
    """Texts with special strings or characters that Unicode versions class differently go to the tokenizer whole."""
    if _unsettled.search(text) or (state["special"] and state["special"].search(text)):
        return len(state["tokenizer"].encode(text, add_special_tokens=False).ids)
    return sum(map(lengths.__getitem__, state["split"].findall(text)))


def _map(tokenizer_path: str, table, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _open(tokenizer_path)
        lengths = state["cache"].get(id(table)) or _Lengths(table.value, state["tokenizer"])
        state["cache"] = {id(table): lengths}
        for batch in (x for b in batches for x in slices(b, "text")):
            n = [_count(t, state, lengths) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(n, pa.int64()), pa.array([x > most for x in n], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    return run


def frequent_lengths(texts: DataFrame, tokenizer_path: str, articles: int = WARM_ARTICLES, most: int = FREQUENT) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens in the beginnings of a few articles (at most ``articles * WARM_CHARACTERS`` characters)."""
    state, seen = _open(tokenizer_path), Counter()
    for row in texts.select(F.left("text", F.lit(WARM_CHARACTERS)).alias("text")).limit(articles).collect():
        seen.update(p for p in state["split"].findall(row["text"]) if len(p) <= LONGEST)
    return {p: len(state["tokenizer"].encode(p, add_special_tokens=False).ids) for p, _ in seen.most_common(most)}


def token_counts(news: DataFrame, tokenizer_path: str, limit: int = 512, articles: int = WARM_ARTICLES, id_col: str = "id") -> DataFrame:
    """Tokens of every whole article as the library of the vocabulary file (byte-level BPE) gives them, without added special tokens.

    news: ``id``, ``title``, ``summary``; more columns are ignored. Returns one row per input row: ``id``, ``n_bytes``
    (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    An article's count is the sum over its pre-tokens. Their lengths come from a compact broadcast table of frequent
    ones (FREQUENT entries of at most LONGEST characters), then from the worker's own cache, and only a miss of both is
    encoded. Nothing is shuffled. Texts with special strings, and texts in scripts whose character classes vary
    between Unicode versions, are encoded whole. ``tokenizer_path`` must exist on every executor.

    Null title and summary count as empty (0 bytes, 0 tokens). Rows with null or repeated ids are counted like others. No rows give no rows.
    """
    texts = news.select(F.col(id_col).alias("id"), article_text(news).alias("text"))
    table = news.sparkSession.sparkContext.broadcast(frequent_lengths(texts, tokenizer_path, articles))
    kind = texts.schema["id"].dataType.simpleString()
    sized = texts.select("id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    return sized.mapInArrow(_map(tokenizer_path, table, limit), f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
