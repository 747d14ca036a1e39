"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in slices of about so many bytes, whatever the size of an Arrow batch.
SLICE_BYTES = 2 << 20


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces whose ``column`` holds about ``limit`` bytes; one row at least."""
    start, held = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if held and held + (n or 0) > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    if batch.num_rows > start:
        yield batch.slice(start)


def by_slice(work: Callable[[pa.RecordBatch], pa.RecordBatch], column: str):
    """A function for ``mapInArrow`` that runs ``work`` over slices of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                yield work(part)

    return run


_holder: list[tuple[str, Callable[[], None]]] = []


def claim(name: str, clear: Callable[[], None]) -> None:
    """Tells that this worker's tables of words now serve operator ``name``; the tables of the one before are emptied.

    Workers live on from stage to stage, so without this each would end up with the tables of all operators.
    """
    if _holder and _holder[0][0] != name:
        _holder.pop()[1]()
    if not _holder:
        _holder.append((name, clear))


class WordHashes(dict):
    """64-bit hash of a word; emptied when full, so a worker's memory stays bounded."""

    LIMIT = 600_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word) - (1 << 63)
        return value


_words = WordHashes()
_hash_of = _words.__getitem__


def word_hashes(words: list[bytes]) -> np.ndarray:
    claim("hashes", _words.clear)
    return np.fromiter(map(_hash_of, words), np.int64, len(words)).view(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit numbers (splitmix64; its constants are fixed values)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def binary_column(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary column whose row i holds the bytes of ``values[bounds[i]:bounds[i + 1]]``."""
    values = np.ascontiguousarray(values)
    offsets = (np.asarray(bounds, np.int64) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values.view(np.uint8))]
    )


def text_only(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` and named columns: other columns, clashing names too, never reach an operator."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more)
