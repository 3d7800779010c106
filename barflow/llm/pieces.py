"""SentencePiece ids of articles and back: the last piece of every prefix, then the ids from the end to the start."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .records import article_text

SPACE_MARK = "▁"
#: Stretches a worker remembers before it starts anew, the longest one remembered, and the pair tests remembered.
CACHED, LONGEST, PAIRS = 400_000, 48, 1_000_000
_state: dict = {}


def _one_by_one(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


class Pieces:
    """A piece model of the merging kind: pieces with scores, single characters, bytes for unknown ones.

    Merging takes, again and again, the neighbours whose union is the piece of the highest score (of equal ones the first).
    Where a cut of the text survives all merges, either side was merged as if alone. So the pieces of a prefix that ends
    at a cut are those of the text, every prefix has one last piece, and a chain of pieces is right if all its neighbours
    would stay apart on their own. That is what the table stores and the pair test decides.
    """

    def __init__(self, model_path: str):
        import ahocorasick
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.path = model_path
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.of_byte: dict[int, int] = {}
        self.bytes: list[bytes] = []
        self.is_byte, self.is_control = [], []
        for i in range(sp.vocab_size()):
            piece, raw = sp.id_to_piece(i), sp.is_byte(i)
            self.is_byte.append(raw)
            self.is_control.append(sp.is_control(i))
            if raw:
                self.of_byte[int(piece[3:-1], 16)] = i
                self.bytes.append(bytes([int(piece[3:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes.append(b"" if sp.is_control(i) else sp.decode([i]).encode())
            else:
                self.ids[piece], self.scores[piece] = i, sp.get_score(i)
                self.bytes.append(piece.replace(SPACE_MARK, " ").encode())
        self.unknown = sp.unk_id()
        self.marks_start = sp.normalize("a").startswith(SPACE_MARK)
        longer = [p for p in self.ids if len(p) > 1]
        self.automaton = ahocorasick.Automaton()
        for p in longer:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.split = self._cuts(longer)
        self._steps: dict[str, tuple | None] = {}
        self._apart: dict[tuple[str, str], bool] = {}
        self._cache: dict[str, bytes] = {}

    @staticmethod
    def _cuts(longer: list[str]) -> re.Pattern:
        """Stretches that no piece reaches across: a character that no longer piece has is alone; one with a mark starts a word unless a piece has the mark elsewhere."""
        joined = "".join(map(re.escape, sorted({c for p in longer for c in p} - {SPACE_MARK})))
        inner = any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in longer)
        some = f"[{joined}{SPACE_MARK if inner else ''}]" if joined or inner else "(?!)"
        return re.compile(f"{some}+|{SPACE_MARK}+|." if inner else f"{SPACE_MARK}*{some}+|{SPACE_MARK}+|.", re.DOTALL)

    def steps(self, piece: str) -> tuple | None:
        """(score, piece at the left end, piece at the right end) after each merge of a piece's characters; None if they don't become the piece."""
        got = self._steps.get(piece, False)
        if got is not False:
            return got
        parts, out = list(piece), []
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            out.append((best, parts[0], parts[-1]))
        got = self._steps[piece] = tuple(out) if len(parts) == 1 else None
        return got

    def apart(self, left: str, right: str) -> bool:
        """Whether two neighbours stay two pieces when their characters are merged: both histories run side by side, and no merge across may come first."""
        key = (left, right)
        got = self._apart.get(key)
        if got is None:
            if len(self._apart) > PAIRS:
                self._apart.clear()
            got = self._apart[key] = self._stay_apart(left, right)
        return got

    def _stay_apart(self, left: str, right: str) -> bool:
        a, b, score = self.steps(left), self.steps(right), self.scores.get
        if a is None or b is None:
            return False
        x, y, i, j = left[-1], right[0], 0, 0
        while True:
            across = score(x + y)
            p = a[i][0] if i < len(a) else None
            q = b[j][0] if j < len(b) else None
            if across is not None and (p is None or across > p) and (q is None or across >= q):
                return False
            if p is None and q is None:
                return True
            if q is None or (p is not None and p >= q):
                x = a[i][2]
                i += 1
            else:
                y = b[j][1]
                j += 1

    def prefix_table(self, stretch: str) -> list[str]:
        """The last piece of every prefix. Of the pieces that end at a place one at most is apart from the last piece before it; else the character is alone."""
        last, settled, known = [""], 0, self._apart.get  # settled: the longest prefix with a last piece
        for end, piece in self.automaton.iter(stretch):
            if settled > end:
                continue
            if settled < end:
                last += stretch[settled:end]
                settled = end
            start = end + 1 - len(piece)
            if start:
                left = last[start]
                apart = known((left, piece))
                if apart is None:
                    apart = self.apart(left, piece)
            else:
                apart = self.steps(piece) is not None
            if apart:
                last.append(piece)
                settled += 1
        last += stretch[settled:]
        return last

    def _encode(self, stretch: str) -> bytes:
        last, at, back, ids = self.prefix_table(stretch), len(stretch), [], self.ids
        while at:
            piece = last[at]
            at -= len(piece)
            i = ids.get(piece)
            if i is not None:
                back.append(i)
            elif self.of_byte:
                back += [self.of_byte[x] for x in reversed(piece.encode())]
            elif not back or back[-1] != self.unknown:
                back.append(self.unknown)
        return pack(f"<{len(back)}I", *reversed(back))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, without begin and end, as little-endian unsigned 32-bit integers."""
        cache, out = self._cache, []
        for stretch in self.split.findall(self.library.normalize(text)):
            got = cache.get(stretch)
            if got is None:
                got = self._encode(stretch)
                if len(stretch) <= LONGEST:
                    if len(cache) > CACHED:
                        cache.clear()
                    cache[stretch] = got
            out.append(got)
        if not self.of_byte and len(out) > 1:  # unknown neighbours are one
            ids = np.frombuffer(b"".join(out), "<u4")
            return ids[np.concatenate(([True], (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)))].tobytes()
        return b"".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: pieces with blanks for marks, the blank before the first word taken away, bytes read as UTF-8 (a wrong one is U+FFFD)."""
        ids = list(ids)
        controls = [k for k, i in enumerate(ids) if self.is_control[i]]
        if len(controls) > 2 or (controls and any(0 < k < len(ids) - 1 for k in controls)):  # bytes on either side are no one character
            ends = [-1, *controls, len(ids)]
            parts = [ids[a + 1 : b] for a, b in zip(ends, ends[1:], strict=False)]
        else:
            parts = [ids]
        raw = [b"".join(map(self.bytes.__getitem__, part)) for part in parts]
        if self.marks_start:
            first = next((i for i in ids if not self.is_control[i]), self.unknown)
            if first != self.unknown and not self.is_byte[first] and self.bytes[first][:1] == b" ":
                k = next(k for k, part in enumerate(raw) if part)
                raw[k] = raw[k][1:]
        try:
            return "".join(part.decode() for part in raw)
        except UnicodeDecodeError:
            return "".join(part.decode("utf-8", "barflow_one_by_one") for part in raw)


def _open(model_path: str) -> Pieces:
    if _state.get("path") != model_path:
        import codecs

        codecs.register_error("barflow_one_by_one", _one_by_one)
        _state.update(path=model_path, pieces=Pieces(model_path))
    return _state["pieces"]


def _map(model_path: str, begin: bool, end: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _open(model_path)
        head = np.array([pieces.library.bos_id()] * begin, "<u4").tobytes()
        tail = np.array([pieces.library.eos_id()] * end, "<u4").tobytes()
        for batch in (x for b in batches for x in slices(b, "text")):
            ids = [head + pieces.encode(t) + tail for t in batch.column("text").to_pylist()]
            decoded = [pieces.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["id", "n_tokens", "ids", "decoded"]
            )

    return run


def piece_ids(news: DataFrame, model_path: str, begin: bool = True, end: bool = True, id_col: str = "id") -> DataFrame:
    """Piece ids of every whole article as the library of the model file (merging kind, ``.model``) gives them, and their text.

    news: ``id``, ``title``, ``summary``; more columns are ignored. Returns one row per input row: ``id``, ``n_tokens``
    (all ids), ``ids`` (little-endian unsigned 32-bit integers, as token files hold them; with the ids of begin and end
    unless switched off) and ``decoded`` (the text that the ids stand for).

    A text is cut where no piece reaches across. For each stretch an automaton of all pieces gives those that end at a
    place, the pair test picks the one that is the last piece of that prefix, and the ids are recovered backwards through
    the table; time grows with the length. Workers remember short stretches and pair tests within fixed bounds. Nothing is
    shuffled or broadcast; ``model_path`` must exist on every executor.

    Null title and summary count as empty (begin and end only, text empty). Rows with null or repeated ids are encoded
    like others. No rows give no rows.
    """
    texts = news.select(F.col(id_col).alias("id"), article_text(news).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(_map(model_path, begin, end), f"id {kind}, n_tokens long, ids binary, decoded string")
