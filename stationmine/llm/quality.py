"""Document quality from a linear-chain conditional random field over lines (operator 6)."""

from __future__ import annotations

import operator
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationmine.llm.tables import by_slice, claim, slices, text_only

#: Character classes: 0 other, then lower (and caseless letters), upper, digit, space, punctuation, symbol, "!".
CLASSES = 8
#: Own features of a line that its neighbours see too.
SHARED = slice(1, 11)
OWN = 14
FEATURES = OWN + 2 * 10 + 3


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind[0] == "L":
            table[code] = 2 if kind == "Lu" else 1
        elif kind[0] == "N":
            table[code] = 3
        elif c.isspace():
            table[code] = 4
        elif kind[0] in "PS":
            table[code] = 5 if c in ".,;:'\"-?()" else 6
    table[ord("!")] = 7
    return table


def lines_of(text: str | None) -> list[str]:
    """Lines that hold more than white space; one empty line if there are none."""
    return [x for x in (text or "").split("\n") if x and not x.isspace()] or [""]


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows of all lines, their lengths, and the number of lines of each text."""
    claim("lines", lambda: None)
    lines = [lines_of(t) for t in texts]
    counts = np.fromiter(map(len, lines), np.int64, len(lines))
    flat = [x for part in lines for x in part]
    n = len(flat)
    length = np.fromiter(map(len, flat), np.int64, n)
    kinds = _classes()[np.frombuffer(("\n".join(flat) + "\n").encode("utf-32-le"), "<u4")]
    starts = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
    words = [x.split() for x in flat]
    n_words = np.fromiter(map(len, words), np.int64, n)
    distinct = np.fromiter((len(set(w)) for w in words), np.int64, n)
    repeats = np.fromiter((sum(map(operator.eq, w, w[1:])) for w in words), np.int64, n)
    size, some = np.maximum(length, 1), np.maximum(n_words, 1)
    x = np.zeros((n, FEATURES), np.float32)
    x[:, 0] = np.log1p(length)
    for k in range(1, CLASSES):
        x[:, k] = np.add.reduceat(kinds == k, starts, dtype=np.int64) / size
    x[:, 4] = (np.add.reduceat(kinds == 4, starts, dtype=np.int64) - 1) / size  # without the joining line end
    x[:, 8] = distinct / some
    x[:, 9] = repeats / some
    x[:, 10] = n_words < 4
    x[:, 11] = np.log1p(n_words)
    x[:, 12] = (length - n_words) / some / 10
    x[:, 13] = np.fromiter((w[-1:] in ".?" and w != "" for w in flat), bool, n)
    owner = np.repeat(np.arange(len(texts)), counts)
    joined = owner[1:] == owner[:-1]
    x[1:, OWN : OWN + 10][joined] = x[:-1, SHARED][joined]
    x[:-1, OWN + 10 : OWN + 20][joined] = x[1:, SHARED][joined]
    x[1:, OWN + 20] = joined
    x[:-1, OWN + 21] = joined
    x[1:, OWN + 22] = joined & np.fromiter(map(operator.eq, flat, flat[1:]), bool, n - 1)
    return x, length, counts


def forward_backward(unary: np.ndarray, counts: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of state 1, expected transitions of each chain (n, 2, 2), log of each normaliser.

    unary: score of state 1 against state 0 for every line, chain after chain. All chains go
    forward together, longest first, so a step works on the chains that still have lines.
    """
    order = np.argsort(-counts, kind="stable")
    first = (np.cumsum(counts) - counts)[order]
    sizes = counts[order]
    steps = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(steps), side="left")  # chains with more than t lines
    score = np.zeros((len(unary), 2))
    score[:, 1] = unary
    alpha, beta = score.copy(), np.zeros_like(score)
    for t in range(1, steps):
        now = first[: alive[t]] + t
        before = alpha[now - 1]
        alpha[now] += np.logaddexp(before[:, :1] + between[0], before[:, 1:] + between[1])
    pairs = np.zeros((len(counts), 2, 2))
    last = first + sizes - 1
    total = np.logaddexp(alpha[last, 0], alpha[last, 1])
    for t in range(steps - 2, -1, -1):
        now = first[: alive[t + 1]] + t
        ahead = beta[now + 1] + score[now + 1]
        beta[now] = np.logaddexp(between[:, 0] + ahead[:, :1], between[:, 1] + ahead[:, 1:])
        joint = alpha[now][:, :, None] + between + ahead[:, None, :] - total[: len(now), None, None]
        pairs[: len(now)] += np.exp(joint)
    norm = np.empty(len(counts))
    norm[order] = total
    marginal = np.exp(alpha[:, 1] + beta[:, 1] - np.repeat(norm, counts))
    out = np.empty_like(pairs)
    out[order] = pairs
    return np.clip(marginal, 0, 1), out, norm


@dataclass(frozen=True)
class LineField:
    """Weights over standardised features; ``between``: scores of neighbouring states."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    between: np.ndarray

    def score(self, texts: list[str | None]) -> np.ndarray:
        x, length, counts = features(texts)
        good, _, _ = forward_backward((x - self.mean) / self.scale @ self.weights + self.bias, counts, self.between)
        starts = np.cumsum(counts) - counts
        weight = length + 1.0
        return np.clip(np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts), 0, 1)


def learn(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = 150, ridge: float = 1.0) -> LineField:
    """Maximum likelihood with a ridge, by Adam over the whole sample; every line carries its document's label."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale < 1e-6, 1, scale)
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    y = np.repeat(labels, counts).astype(float)
    weights, between = np.zeros(z.shape[1]), np.zeros((2, 2))
    seen = np.zeros((2, 2))
    for state in (0, 1):
        seen[state, state] = np.maximum(counts[labels == state] - 1, 0).sum()
    moments = [np.zeros(z.shape[1] + 4), np.zeros(z.shape[1] + 4)]
    for t in range(1, rounds + 1):
        good, pairs, _ = forward_backward(z @ weights, counts, between)
        slope = np.r_[z.T @ (y - good) - ridge * weights, (seen - pairs.sum(axis=0) - ridge * between).ravel()]
        slope /= len(counts)
        moments[0] = 0.9 * moments[0] + 0.1 * slope
        moments[1] = 0.99 * moments[1] + 0.01 * slope**2
        step = 0.1 * moments[0] / (1 - 0.9**t) / (np.sqrt(moments[1] / (1 - 0.99**t)) + 1e-8)
        weights, between = weights + step[:-4], between + step[-4:].reshape(2, 2)
    return LineField(mean, scale, weights[:-1], float(weights[-1]), between)


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = 4000, train_lines: int = 256) -> LineField:
    """Learns from at most ``train_docs`` labelled documents.

    labels: doc_id, quality (0 or 1; other rows are passed over). The sample is what comes first by a
    hash of the id. Documents of more than ``train_lines`` lines are left out of the sample, so what the driver
    gets is bounded by train_docs * train_lines feature rows. Without labelled
    documents every score is 0.5.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
        .filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(train_docs)
    )

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        texts, marks = part.column("text").to_pylist(), part.column("quality").to_pylist()
        rows = [(m, *features([t])) for t, m in zip(texts, marks) if (t or "").count("\n") < train_lines]
        return pa.RecordBatch.from_pydict(
            {"quality": pa.array([r[0] for r in rows], pa.int32()), "x": pa.array([r[1].tobytes() for r in rows], pa.binary())}
        )

    # at most train_docs narrow rows are broadcast
    sample = text_only(docs).join(F.broadcast(chosen), "doc_id").select("text", "quality")
    rows = sample.mapInArrow(by_slice(work, "text"), "quality int, x binary").collect()
    if not rows:
        zero = np.zeros(FEATURES)
        return LineField(zero, zero + 1, zero, 0.0, np.zeros((2, 2)))
    rows.sort(key=lambda r: (r["quality"], bytes(r["x"])))  # same sums whatever task ends first
    parts = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in rows]
    marks = np.array([r["quality"] for r in rows])
    return learn(np.concatenate(parts).astype(float), np.array([len(p) for p in parts]), marks)


def score(docs: DataFrame, field: LineField) -> DataFrame:
    """doc_id, score: the line marginals of being good, weighted by line length.

    Each line of the whole text is labelled with its neighbours in view. Null and empty texts
    and texts of white space are one empty line. Null or repeated doc_ids are documents of their own. Only
    ``doc_id`` and ``text`` are read. No rows: no rows.
    """

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        found = field.score(part.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    return text_only(docs).mapInArrow(by_slice(work, "text"), "doc_id long, score double")


def keep(docs: DataFrame, field: LineField, at_least: float) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose score is ``at_least`` or more. Nothing is shuffled.

    A field that learned from no document rejects none.
    """
    if not np.any(field.weights):
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(field.score(part.column("text").to_pylist()) >= at_least))

    return docs.mapInArrow(run, docs.schema)
