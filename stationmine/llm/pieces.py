"""Encoding and decoding with merge-type sentencepiece vocabularies (operator 10)."""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stationmine.llm.tables import by_slice, claim, text_only

SCHEMA = "doc_id long, ids binary, n_tokens long, decoded string"
SPACE = "▁"
_CHUNK = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")


def agenda(symbols: list[str], rank: dict[str, int]) -> list[str]:
    """Merges adjacent symbols, best rank first and leftmost among equals, until none can merge.

    The agenda is a heap of (rank, position, merged text). An entry is stale when its left symbol
    is gone or either side has grown since.
    """
    parts: list[str | None] = list(symbols)
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    entries = []

    def offer(i: int, j: int) -> None:
        both = parts[i] + parts[j]
        found = rank.get(both)
        if found is not None:
            heapq.heappush(entries, (found, i, both))

    for i in range(n - 1):
        offer(i, i + 1)
    while entries:
        _, i, both = heapq.heappop(entries)
        if parts[i] is None or after[i] == n:
            continue
        j = after[i]
        if len(parts[i]) + len(parts[j]) != len(both):
            continue
        parts[i], parts[j] = both, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            offer(i, after[i])
        if before[i] >= 0:
            offer(before[i], i)
    return [p for p in parts if p is not None]


def short_agenda(symbols: list[str], rank: dict[str, int]) -> list[str]:
    """The same for few symbols: the agenda is a list of ranks by position, scanned for its least."""
    parts, none = list(symbols), len(rank)
    ranks = [rank.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while ranks:
        best = min(ranks)
        if best == none:
            break
        i = ranks.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del ranks[i]
        if i < len(ranks):
            ranks[i] = rank.get(parts[i] + parts[i + 1], none)
        if i:
            ranks[i - 1] = rank.get(parts[i - 1] + parts[i], none)
    return parts


class Pieces(dict):
    """word → ids. Merges stay within words, so each distinct word is merged once per worker.

    No piece of the vocabulary holds a space mark behind another character, nor a line end; both
    are checked when it is loaded. Words are therefore cut before space marks and around line ends.
    The table is emptied when it holds LIMIT words.
    """

    LIMIT = 600_000

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        usual = [
            i for i in range(lib.get_piece_size())
            if not (lib.is_unknown(i) or lib.is_control(i) or lib.is_unused(i) or lib.is_byte(i))
        ]
        self.id = {lib.id_to_piece(i): i for i in usual}
        scores = sorted({lib.get_score(i) for i in usual}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        self.rank = {lib.id_to_piece(i): place[lib.get_score(i)] for i in usual}
        self.byte = {lib.piece_to_id(f"<0x{b:02X}>"): b for b in range(256)}
        self.byte_id = {b: i for i, b in self.byte.items()}
        inner = any(SPACE in p.lstrip(SPACE) for p in self.id)
        unused = any(lib.is_unused(i) for i in range(lib.get_piece_size()))
        if inner or unused or any("\n" in p for p in self.id) or len(self.byte) != 256:
            raise ValueError(f"{path} is not a merge vocabulary with byte fallback and whole words")
        if lib.normalize(" a  ﬁ ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}ﬁ{SPACE}":
            raise ValueError(f"{path} changes texts before it cuts them")
        self.new: dict[str, tuple[bytes, bytes]] = {}
        self.mark, self.line = self.merged(SPACE), self.merged("\n")

    def __missing__(self, unit: str) -> bytes:
        """unit: a word without the space before it, or a line end and what follows it."""
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[unit] = self.noted(unit if unit[:1] == "\n" else SPACE + unit)
        return value

    def noted(self, chunk: str) -> bytes:
        """Ids of a chunk, noted by the text that has them behind some others in the library.

        The library puts a space mark before every text, and no merge crosses a line end.
        """
        ids = self.merged(chunk)
        if chunk[0] == "\n":
            self.new[chunk] = self.mark, ids
        elif chunk == SPACE:
            self.new["\n"] = ids, self.line
        elif chunk[0] == SPACE:
            self.new[chunk[1:]] = b"", ids
        else:
            self.new["\n" + chunk] = self.mark, self.line + ids
        return ids

    def merged(self, text: str) -> bytes:
        """Ids of a text whose spaces are space marks already."""
        ids: list[int] = []
        merge = short_agenda if len(text) <= 32 else agenda
        for p in merge(list(text), self.rank):
            found = self.id.get(p)
            ids += [found] if found is not None else [self.byte_id[b] for b in p.encode()]
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids without begin and end."""
        if not text:
            return b""
        spread = text.replace("\n", " \n")
        if "  " in spread or spread[0] == " " or spread[-1] == " " or SPACE in text:
            return b"".join(map(self.noted, _CHUNK.findall(SPACE + text.replace(" ", SPACE))))
        return b"".join(map(self.__getitem__, spread.split(" ")))

    def check(self) -> None:
        """Holds all that was merged since the last call against the library's own merges."""
        noted, self.new = self.new, {}
        for unit, ids in zip(noted, self.library.encode(list(noted), num_threads=1)):
            before, own = noted[unit]
            if before + self.get(unit, own) != np.array(ids, "<u4").tobytes():
                raise AssertionError(f"other ids than the library's for {unit!r}")


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, model: str, begin: bool = True, end: bool = True) -> DataFrame:
    """Encodes each whole text and decodes it again with the library.

    ``ids`` are little-endian unsigned 32-bit numbers. In each Arrow batch, the words met for the
    first time are checked against the library.

    Null text is an empty text. Null or repeated doc_ids are documents of their own. Only
    ``doc_id`` and ``text`` are read. No rows: no rows.
    """

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        claim("pieces", pieces.cache_clear)
        own = pieces(model)
        lib = own.library
        first = np.array([lib.bos_id()] * begin, "<u4").tobytes()
        last = np.array([lib.eos_id()] * end, "<u4").tobytes()
        ids = [first + own.encode(t or "") + last for t in part.column("text").to_pylist()]
        own.check()
        decoded = [lib.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()),
             pa.array(decoded, pa.string())],
            ["doc_id", "ids", "n_tokens", "decoded"],
        )

    return text_only(docs).mapInArrow(by_slice(work, "text"), SCHEMA)

