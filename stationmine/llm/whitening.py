"""PCA whitening of vectors by a bidiagonal qd solver (operator 12).

The covariance is never formed. Centred rows are reduced to one triangle R by blockwise QR: each task
folds its blocks into a triangle, and triangles are folded FAN_IN at a time until one is left. What follows works on R alone, whose size is the vectors'
length: Householder reflections from both sides make it bidiagonal, dqds finds the squares of its
singular values to high relative accuracy, and twisted factorisations give their right vectors. Scaled by the
standard deviations, these are the whitening directions.

Components are integers (``grid``), so sums and deviations are exact and the same however rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationmine.llm.tables import binary_column
from stationmine.scale import cut

#: Rows reduced at once, and triangles folded into one at once.
BLOCK = 4096
FAN_IN = 16
_EPS = np.finfo(float).eps
#: Neighbouring squares closer than this share of themselves are a cluster: their vectors are made orthogonal explicitly.
CLOSE = 1e-3


# --- the triangle's singular values and vectors -------------------------------------------


def triangle(rows: np.ndarray) -> np.ndarray:
    """The R of a QR factorisation, with as many rows as columns."""
    d = rows.shape[1]
    r = np.linalg.qr(rows, mode="r")
    return r if len(r) == d else np.vstack([r, np.zeros((d - len(r), d))])


def _reflection(x: np.ndarray) -> tuple[np.ndarray, float]:
    """v and beta, so that (1 - beta v v') x is beyond its first entry zero."""
    v = x.copy()
    size = np.abs(x).max(initial=0.0)
    if size == 0 or not np.any(x[1:]):
        return v, 0.0
    v /= size
    v[0] += np.copysign(np.sqrt(v @ v), v[0])
    return v, 2.0 / (v @ v)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal a and superdiagonal b of U' R W, and the orthogonal W."""
    r = r.copy()
    d = len(r)
    w = np.eye(d)
    for k in range(d):
        v, beta = _reflection(r[k:, k])
        if beta:
            r[k:, k:] -= np.outer(beta * v, v @ r[k:, k:])
        if k + 2 < d:
            v, beta = _reflection(r[k, k + 1 :])
            if beta:
                r[k:, k + 1 :] -= np.outer(r[k:, k + 1 :] @ v, beta * v)
                w[:, k + 1 :] -= np.outer(w[:, k + 1 :] @ v, beta * v)
    return r.diagonal().copy(), r.diagonal(1).copy(), w


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float]:
    """One differential qd step with a shift, and the least pivot it met; negative if the shift was too large."""
    new_q, new_e = [], []
    d = q[0] - shift
    least = d
    for k in range(len(e)):
        s = d + e[k]
        ratio = q[k + 1] / s if s else 0.0
        new_q.append(s)
        new_e.append(e[k] * ratio)
        d = d * ratio - shift
        least = min(least, d)
        if least < 0 and shift:
            return q, e, least
    new_q.append(d)
    return new_q, new_e, least


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the bidiagonal (a, b), falling.

    The list is worked on from its end: shifts below the least value keep all entries positive, which
    keeps relative accuracy, and the last value is split off once the entry before it is negligible. Where
    an inner entry has become negligible the list is parted.
    """
    found: list[float] = []
    parts = [([float(x) ** 2 for x in a], [float(x) ** 2 for x in b], 0.0)]
    while parts:
        q, e, base = parts.pop()
        shift, turned = 0.0, False
        while True:
            n = len(q)
            if n == 1:
                found.append(base + q[0])
                break
            if e[-1] <= _EPS * _EPS * (base + q[-1]) or e[-1] == 0:
                found.append(base + q.pop())
                e.pop()
                shift = 0.0
                continue
            # an entry is negligible beside its neighbours or beside what has been shifted away
            at = next((i for i in range(n - 1) if e[i] <= _EPS * _EPS * (base + min(q[i], q[i + 1]))), None)
            if at is not None:
                parts.append((q[: at + 1], e[:at], base))
                q, e, shift = q[at + 1 :], e[at + 1 :], 0.0
                continue
            if not turned and q[-1] > 4 * q[0]:  # small values belong to the end
                q, e, turned = q[::-1], e[::-1], True
                continue
            while True:
                new_q, new_e, least = _step(q, e, shift)
                if least >= 0:
                    break
                shift = shift / 4 if shift > _EPS * base else 0.0
            q, e, base = new_q, new_e, base + shift
            # the least pivot bounds the least value from above; Gershgorin at the end gives a fair guess from below
            tail = q[-1] - np.sqrt(q[-1] * e[-1]) if e[-1] < q[-1] else 0.0
            shift = max(0.0, min(0.99 * max(least, 0.0), tail))
    return np.array(sorted(found, reverse=True))


class Twisted:
    """Twisted factorisation N D N' of B'B - x, for the bidiagonal B = (a, b): where to twist, and solutions."""

    def __init__(self, a: np.ndarray, b: np.ndarray, x: float):
        n = len(a)
        q, e = a * a, b * b
        self.off = a[:-1] * b
        tiny = np.finfo(float).tiny / _EPS
        floor = tiny + _EPS * _EPS * max(x, 0.0)
        guard = self.guard = lambda v: v if abs(v) > floor else floor
        s, p = np.empty(n), np.empty(n)
        self.down, self.up = np.empty(n), np.empty(n)
        s[0] = -x
        for k in range(n - 1):
            self.down[k] = guard(q[k] + s[k])
            s[k + 1] = e[k] * (s[k] / self.down[k]) - x
        p[n - 1] = q[n - 1] - x
        for k in range(n - 2, -1, -1):
            self.up[k + 1] = guard(e[k] + p[k + 1])
            p[k] = q[k] * (p[k + 1] / self.up[k + 1]) - x
        self.gamma = s + p + x
        self.at = int(np.argmin(np.abs(self.gamma)))

    def vector(self) -> np.ndarray:
        """Nearly the null vector: the solution for the unit vector at the twist."""
        return self._spread(np.zeros(len(self.gamma)), 1.0)

    def solve(self, y: np.ndarray) -> np.ndarray:
        """(B'B - x)⁻¹ y up to a factor."""
        n, k = len(y), self.at
        y = y.astype(float).copy()
        for i in range(k):
            y[i + 1] -= self.off[i] / self.down[i] * y[i]
        for i in range(n - 1, k, -1):
            y[i - 1] -= self.off[i - 1] / self.up[i] * y[i]
        middle = self.guard(self.gamma[k])
        pivots = np.concatenate([self.down[:k], [middle], self.up[k + 1 :]])
        z = y * (np.abs(pivots).min() / pivots)
        return self._spread(z, z[k])

    def _spread(self, z: np.ndarray, middle: float) -> np.ndarray:
        z[self.at] = middle
        for i in range(self.at - 1, -1, -1):
            z[i] -= self.off[i] / self.down[i] * z[i + 1]
        for i in range(self.at + 1, len(z)):
            z[i] -= self.off[i - 1] / self.up[i] * z[i - 1]
        return z / np.sqrt(z @ z)


def right_vectors(a: np.ndarray, b: np.ndarray, squares: np.ndarray, k: int) -> np.ndarray:
    """Columns: right singular vectors of (a, b) for the k largest squares, orthonormal.

    Vectors of well separated values come from twisted factorisations as they are. Within a cluster they are
    made orthogonal to those before them; one that nearly vanishes by that is replaced by inverse iteration from elsewhere.
    """
    draw = np.random.default_rng(0)
    out = np.zeros((len(a), k))
    first = 0
    for j in range(k):
        if j and squares[j - 1] - squares[j] > CLOSE * squares[j - 1]:
            first = j
        before = out[:, first:j]
        if len(a) == 1:
            out[0, 0] = 1.0
            continue
        form = Twisted(a, b, squares[j])
        z = form.vector()
        for attempt in range(8):
            left = z - before @ (before.T @ z)
            left -= before @ (before.T @ left)
            size = np.sqrt(left @ left)
            if size > 0.5:
                break
            # nothing new in z: look elsewhere, and let the factorisation turn it to this value
            start = left / size if attempt % 2 and size > _EPS else draw.standard_normal(len(a))
            start -= before @ (before.T @ start)
            z = form.solve(start / np.sqrt(start @ start)) if attempt < 6 else start / np.sqrt(start @ start)
        out[:, j] = left / size
    return out


def directions(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest squared singular values of the triangle, falling, and their right vectors as columns.

    Values that are rounding errors of the largest one are left out.
    """
    scale = np.abs(r).max(initial=0.0)
    if scale == 0:
        return np.zeros(0), np.zeros((len(r), 0))
    a, b, w = bidiagonal(r / scale)
    squares = dqds(a, b)
    k = int(np.sum(squares[:k] > (len(r) * _EPS) ** 2 * squares[0]))
    return squares[:k] * scale * scale, w @ right_vectors(a, b, squares, k)


# --- rows on Spark --------------------------------------------------------------------------


def usable(vector: Column) -> Column:
    """Not null and not empty, no entry null or non-finite."""
    x = vector.cast("array<double>")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.coalesce((F.size(x) > 0) & F.forall(x, finite), F.lit(False))


def grid(vector: Column) -> Column:
    """Entries as whole 64ths, moved up by a million."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(c * 64) + F.lit(1_000_000).cast("long"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(rows: DataFrame, column: str, schema: str, each, width: int) -> list:
    """Sums over all rows of what ``each`` makes of a block: one row per task, then summed per place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = each(_matrix(batch.slice(lo, BLOCK).column(column), width))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()])], ["part"])

    placed = rows.select(column).mapInArrow(run, f"part {schema}").select(F.posexplode("part").alias("i", "v"))
    return [r[1] for r in sorted(placed.groupBy("i").agg(F.sum("v")).collect())]


def _folded(rows: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """One triangle for all centred rows. Tasks hand on one triangle each; FAN_IN of them at a time become one."""
    d = len(sums)

    def fold(blocks: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        r = None
        for block in blocks:
            r = triangle(block if r is None else np.vstack([r, block]))
        if r is not None:
            yield pa.RecordBatch.from_arrays([binary_column(r.ravel(), np.array([0, r.size]))], ["r"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fold(
            _centred(_matrix(batch.slice(lo, BLOCK).column("x"), d), n, sums)
            for batch in batches
            for lo in range(0, batch.num_rows, BLOCK)
        )

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fold(
            np.frombuffer(r, np.float64).reshape(d, d) for batch in batches for r in batch.column("r").to_pylist()
        )

    found = cut(rows.select("x").mapInArrow(first, "r binary"))
    while (left := found.count()) > 1:
        groups = -(-left // FAN_IN)
        # dealt in turn, so no task holds many more than FAN_IN
        found = cut(found.repartition(groups).mapInArrow(more, "r binary"))
    return np.frombuffer(found.first()["r"], np.float64).reshape(d, d)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n, from exact integers, rounded once."""
    return (n * x - sums) / n


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per vector and component.

    Entries become whole 64ths (``grid``). ``n`` vectors are fitted on, all that are returned; ``deviation`` is the sum over
    dimensions of (n x - S)², exact; ``whitened`` the centred vector along a component, by its standard deviation;
    ``explained`` the component's share of the variance; ``identity_error`` the largest absolute entry, over all
    rows, of the covariance of ``whitened`` less the identity.

    Vectors that are null, empty or hold a null or non-finite entry take no part. Components without variance (fewer
    different vectors than dimensions, say) are not returned, so equal vectors alone give no rows. Vectors of
    different lengths, and sums or deviations beyond 64 bits, raise an error. Repeated and null vec_ids are answered
    row by row. Only ``vec_id`` and ``embedding`` are read. No rows: no rows.
    """
    rows = vectors.filter(usable(F.col("embedding"))).select(F.col("vec_id").cast("long"), grid(F.col("embedding")).alias("x"))
    rows = cut(rows)
    spark = vectors.sparkSession
    largest = F.max(F.array_max(F.transform("x", F.abs)))
    n, least, most, largest = rows.agg(F.count(F.lit(1)), F.min(F.size("x")), F.max(F.size("x")), largest).first()
    if n == 0:
        return spark.createDataFrame([], _OUT)
    if least != most:
        raise ValueError(f"vectors of different lengths: {least} to {most} entries")
    d = most
    if n * largest >= 2**62:
        raise OverflowError("sums of entries need more than 64 bits")
    sums = np.array(_sums(rows, "x", "array<long>", lambda x: x.sum(axis=0), d), np.int64)
    r = _folded(rows, n, sums)
    squares, basis = directions(r, min(components, d))
    if not len(squares):
        return spark.createDataFrame([], _OUT)
    k = len(squares)
    scaled = basis * np.sqrt(n / squares)

    def products(x: np.ndarray) -> np.ndarray:
        w = _centred(x, n, sums) @ scaled
        return np.vstack([w.sum(axis=0), w.T @ w])

    found = np.array(_sums(rows, "x", "array<double>", products, d)).reshape(k + 1, k) / n
    error = float(np.abs(found[1:] - np.outer(found[0], found[0]) - np.eye(k)).max())
    explained = squares / (r * r).sum()  # all squares together are n times the trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                x = _matrix(part.column("x"), d)
                size = len(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(pa.array(np.repeat(np.arange(size), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                        pa.array(np.full(size * k, n, np.int64)),
                        pa.array(np.repeat(_deviation(x, n, sums), k)),
                        pa.array((_centred(x, n, sums) @ scaled).ravel()),
                        pa.array(np.tile(explained, size)),
                        pa.array(np.full(size * k, error)),
                    ],
                    [c.split()[0] for c in _OUT.split(", ")],
                )

    return rows.mapInArrow(run, _OUT)


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Sum over dimensions of (n x - S)², exact."""
    apart = n * x - sums
    if int(np.abs(apart).max(initial=0)) ** 2 * x.shape[1] >= 2**63:
        exact = [sum(int(v) ** 2 for v in row) for row in apart]
        if max(exact) >= 2**63:
            raise OverflowError("a deviation needs more than 64 bits")
        return np.array(exact, np.int64)
    return (apart * apart).sum(axis=1)
