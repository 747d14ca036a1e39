"""Harmonic packing of token sequences into fixed windows (operator 5)."""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from stationmine.llm.tables import claim, slices, text_only

SCHEMA = (
    "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
_ARROW = pa.schema(
    [(n, pa.binary() if n == "ids" else pa.int64()) for n in (x.split()[0] for x in SCHEMA.split(", "))]
)
#: White space other than single spaces and line ends; looked for one by one, which is faster than letter by letter.
_BREAKS = ("  ", "\n\n", " \n", "\n ", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"))


class Letters(dict):
    """For ``str.translate``: a letter as a byte-level vocabulary spells it; a space for what is no letter to ``split``."""

    def __init__(self, split):
        self.split = split

    def __missing__(self, code: int) -> str:
        found = self.split("a" + chr(code))
        self[code] = found[0][0][1:] if len(found) == 1 else " "
        return self[code]


class WordIds(dict):
    """Ids of texts by the ``tokenizers`` library, looked up by word.

    A byte-level vocabulary joins one space to the word behind it, and no token spans the border
    before such a space. So a text whose white space is only single spaces and line ends is a row
    of independent words, and each distinct word is tokenised once per worker. Any other text goes
    to the library whole. The table is emptied when it holds LIMIT words.

    Most words are letters, with signs behind them or not. The library tokenises both apart, so
    letters go straight to its model, without what it does around that for every text.
    """

    LIMIT = 1_200_000
    SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        made = json.loads(self.library.to_str())
        before = made["pre_tokenizer"]
        self.by_word = before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
        self.line_end = self._ids(["\n"])[0]
        # a token that the library cuts out first must not lie within letters and signs behind them
        added = [t["content"].rstrip(self.SIGNS) for t in made["added_tokens"]]
        self.by_letters = self.by_word and not made["normalizer"] and not any(not t or t.isalpha() for t in added)
        self.model = self.library.model
        self.letters = Letters(self.library.pre_tokenizer.pre_tokenize_str)

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _plain(self, text: str) -> bool:
        return (
            self.by_word
            and not text[0].isspace()
            and not text[-1].isspace()
            and not any(map(text.__contains__, _BREAKS))
        )

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes] = [b""] * len(texts)
        whole = []
        get, skip = self.__getitem__, len(self.line_end)
        for i, text in enumerate(texts):
            if text and self._plain(text):
                # a unit is a word led by a space (left out here) or by a line end; the first is led by a line end of ours
                units = ("\n" + text.replace("\n", " \n")).split(" ")
                out[i] = b"".join(map(get, units))[skip:]
            elif text:
                whole.append(i)
        for i, ids in zip(whole, self._ids([texts[i] for i in whole])):
            out[i] = ids
        return out

    def __missing__(self, unit: str) -> bytes:
        ids = self._word(unit) if self.by_letters else None
        if ids is None:
            ids = self._ids([unit if unit[0] == "\n" else " " + unit])[0]
        if len(self) >= self.LIMIT:
            self.clear()
        self[unit] = ids
        return ids

    def _word(self, unit: str) -> bytes | None:
        """Ids of a unit of letters, with signs behind them or not; None for others."""
        word = unit.rstrip(self.SIGNS)
        led = unit[0] == "\n"
        spelt = word[led:].translate(self.letters)
        if not spelt or " " in spelt:
            return None
        ids = self.get(word)
        if ids is None:
            found = self.model.tokenize(spelt if led else "\u0120" + spelt)
            ids = array("I", [t.id for t in found]).tobytes()
            if led:
                ids = self.line_end + ids
        if len(word) < len(unit):
            ids += self["\n" + unit[len(word) :]][len(self.line_end) :]
        return ids


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


@lru_cache(maxsize=4)
def cuts(capacity: int, tolerance: int) -> tuple[tuple[int, ...], ...]:
    """How to cut a rest of r tokens, r = 0 … capacity - 1, into pieces, longest first.

    A piece of length p is in class k = capacity // p and costs 1 / k of a sequence. The fewest
    pieces (three at most) that lose no more than ``tolerance`` tokens together; else the best three.
    """
    r = np.arange(1, capacity)
    loss = np.full((3, capacity), np.inf)
    loss[0, 1:] = capacity / (capacity // r) - r
    first = np.zeros((3, capacity), int)
    for more in (1, 2):
        for n in range(2, capacity):
            total = loss[0, 1:n] + loss[more - 1, n - 1 : 0 : -1]
            first[more, n] = 1 + int(total.argmin())
            loss[more, n] = total[first[more, n] - 1]

    def pieces(n: int) -> tuple[int, ...]:
        if n == 0:
            return ()
        fit = [m for m in range(3) if loss[m, n] <= tolerance]
        m, out = fit[0] if fit else int(loss[:, n].argmin()), []
        while m:
            out.append(int(first[m, n]))
            n, m = n - out[-1], m - 1
        return tuple(sorted([*out, n], reverse=True))

    return tuple(pieces(n) for n in range(capacity))


class Bins:
    """Open sequences of one worker, one for each class of lengths."""

    def __init__(self, capacity: int, base: int):
        self.capacity, self.base, self.made = capacity, base, 0
        self.open: dict[int, list[tuple]] = defaultdict(list)
        self.rows: list[tuple] = []

    def add(self, piece: tuple) -> None:
        """piece: doc_id, start, ids, doc_tokens."""
        k = self.capacity // (len(piece[2]) // 4)
        held = self.open[k]
        held.append(piece)
        if len(held) == k:
            self._close(self.open.pop(k))

    def _close(self, pieces: list[tuple]) -> None:
        number, at = self.base + self.made, 0
        self.made += 1
        for doc_id, start, ids, tokens in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, ids, zlib.crc32(ids), tokens, number, at))
            at += n

    def finish(self) -> None:
        """What no class could fill goes together, longest first, into the first sequence with room."""
        rest = sorted((p for held in self.open.values() for p in held), key=lambda p: -len(p[2]))
        room: list[int] = []
        bins: list[list[tuple]] = []
        for p in rest:
            n = len(p[2]) // 4
            at = next((i for i, free in enumerate(room) if free >= n), None)
            if at is None:
                room.append(self.capacity)
                bins.append([])
                at = -1
            room[at] -= n
            bins[at].append(p)
        for held in bins:
            self._close(held)
        self.open.clear()

    def drain(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows)) or [[]] * len(_ARROW)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, tolerance: int = 16
) -> DataFrame:
    """Cuts documents into pieces and deals them into sequences of at most ``capacity`` tokens.

    A document is its ids and ``end_id``. All full stretches of ``capacity`` tokens are sequences of
    their own. The rest of a document is cut so that its pieces lie just below the top of their
    reciprocal class (capacity / (k + 1), capacity / k], and each class closes a sequence after
    exactly k pieces. A worker holds at most one open sequence per class, about 2 * sqrt(capacity)
    of them, and needs nothing from other workers; what is open when its rows end is packed
    first-fit, so a worker leaves few sequences partly filled.

    ``ids`` holds a piece's ids as little-endian unsigned 32-bit numbers. Sequence ids are the
    partition's number shifted by 40 bits plus a count.

    Null text is an empty text: one piece that holds the end id. Null or repeated doc_ids are
    documents of their own. Only ``doc_id`` and ``text`` are read. No rows: no rows.
    """
    if capacity < 2:
        raise ValueError("capacity must be 2 at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(capacity, TaskContext.get().partitionId() << 40)
        plan = cuts(capacity, tolerance)
        end = np.array([end_id], "<u4").tobytes()
        claim("ids", word_ids.cache_clear)
        encoder = word_ids(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(texts)):
                    ids += end
                    tokens = len(ids) // 4
                    full, rest = divmod(tokens, capacity)
                    start = 0
                    for n in (*[capacity] * full, *plan[rest]):
                        bins.add((doc_id, start, ids[4 * start : 4 * (start + n)], tokens))
                        start += n
                yield bins.drain()
        bins.finish()
        yield bins.drain()

    return text_only(docs).mapInArrow(run, SCHEMA)
