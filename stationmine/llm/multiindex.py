"""Nearest neighbours with an inverted multi-index (operator 2).

Vectors are cut into halves. Each half is quantised on its own, so two codebooks of K centroids make
K * K cells. A query takes pairs of centroids in order of their summed squared distances with a heap
until the cells passed hold enough vectors, and the vectors of these cells are ranked by their own distances.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationmine.llm.ranges import matrix, usable
from stationmine.llm.tables import binary_column, mix
from stationmine.scale import cut

#: Vectors a cell should have on average, and the most centroids of a half.
PER_CELL = 64
CENTROIDS = 256
#: Vectors that are compared with all others to learn how far queries have to go.
PROBES = 64
#: Rows of a block of entries, and queries that meet it at once.
BLOCK = 1024
#: Queries whose neighbours a task holds before it passes them on.
HELD = 100_000


@dataclass(frozen=True)
class Codebooks:
    """Centroids of the first and second half, and how many vectors each pair of them holds."""

    first: np.ndarray
    second: np.ndarray
    sizes: np.ndarray

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Cell of each vector: number of the pair of nearest centroids."""
        i, j = (_squared(h, c).argmin(axis=1) for h, c in zip(_halves(x), (self.first, self.second)))
        return i * len(self.second) + j

    def route(self, query: np.ndarray, enough: int) -> list[int]:
        """Cells in order of summed distance until they hold ``enough`` vectors (empty ones are passed over)."""
        left, right = (_squared(h[None], c)[0] for h, c in zip(_halves(query), (self.first, self.second)))
        rows, columns = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
        left, right = left[rows], right[columns]
        heap, out, held = [(left[0] + right[0], 0, 0)], [], 0
        while heap and held < enough:
            _, i, j = heapq.heappop(heap)
            n = self.sizes[rows[i], columns[j]]
            if n:
                out.append(int(rows[i] * len(self.second) + columns[j]))
                held += n
            # each pair has one parent, so none is met twice: rows go down from the first column only
            if j + 1 < len(right):
                heapq.heappush(heap, (left[i] + right[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(left):
                heapq.heappush(heap, (left[i + 1] + right[0], i + 1, 0))
        return out


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    middle = (x.shape[-1] + 1) // 2
    return x[..., :middle], x[..., middle:]


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=-1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=-1)


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    centroids = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(rounds):
        own = _squared(x, centroids).argmin(axis=1)
        n = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, d], k) for d in range(x.shape[1])], axis=1) if x.shape[1] else centroids
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def _entries(vectors: DataFrame) -> DataFrame:
    return vectors.select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")
    ).filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())


def _place(rows: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, cell and the vector's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("embedding"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(books.assign(x).astype(np.int64)),
                 binary_column(x.ravel(), np.arange(len(x) + 1) * x.shape[1])],
                ["vec_id", "cell", "vector"],
            )

    return rows.mapInArrow(run, "vec_id long, cell long, vector binary")


def build(vectors: DataFrame, sample: int = 20_000, seed: int = 5) -> tuple[Codebooks, DataFrame]:
    """Codebooks, and every entry with its cell (written to the shared folder).

    The codebooks are learned from ``sample`` vectors, the first by a hash of the id; every usable vector is indexed.
    The number of centroids grows with the square root of the table, up to CENTROIDS.
    """
    rows = _entries(vectors)
    n = rows.count()
    k = int(np.clip(round((n / PER_CELL) ** 0.5), 1, CENTROIDS))
    chosen = rows.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(sample).select("embedding")
    x = chosen.toArrow().column("embedding").combine_chunks()
    if not len(x):
        zero = np.zeros((1, 0))
        return Codebooks(zero, zero, np.zeros((1, 1), int)), cut(rows.selectExpr("vec_id", "0L AS cell", "CAST(NULL AS binary) AS vector"))
    first, second = (_kmeans(np.ascontiguousarray(h), min(k, len(h)), seed) for h in _halves(matrix(x)))
    books = Codebooks(first, second, np.zeros((len(first), len(second)), int))
    placed = cut(_place(rows, books))
    sizes = np.zeros(len(first) * len(second), int)
    for r in placed.groupBy("cell").count().collect():  # CENTROIDS squared rows at most
        sizes[r["cell"]] = r["count"]
    return Codebooks(first, second, sizes.reshape(len(first), len(second))), placed


def _parted(rows: DataFrame, id_: str, sizes: np.ndarray) -> DataFrame:
    """``rows`` with the part of its cell a row is dealt to: one part for every BLOCK rows the cell holds."""
    parts = np.maximum(1, -(-sizes.ravel() // BLOCK)).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cell = (batch.column(c).to_numpy() for c in (id_, "cell"))
            part = mix(ids.view(np.uint64)) % parts[cell]
            yield batch.append_column("part", pa.array(part.astype(np.int64)))

    return rows.mapInArrow(run, f"{', '.join(f'{n} {t}' for n, t in rows.dtypes)}, part long")


def _blocks(rows: DataFrame, names: list[str], parts: int) -> DataFrame:
    """Rows (cell, part, id, vector) as blocks of at most BLOCK rows of one cell: cell, ids, vectors."""
    id_ = names[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def close(cell: int) -> pa.RecordBatch:
            rows = held.pop(cell)
            return pa.RecordBatch.from_arrays(
                [pa.array([cell]), pa.array([np.array([r[0] for r in rows], np.int64).tobytes()], pa.binary()),
                 pa.array([b"".join(r[1] for r in rows)], pa.binary())],
                ["cell", *names],
            )

        for batch in batches:
            for cell, i, vector in zip(*(batch.column(c).to_pylist() for c in ("cell", id_, "vector"))):
                rows = held.setdefault(cell, [])
                rows.append((i, vector))
                if len(rows) == BLOCK:
                    yield close(cell)
        for cell in list(held):
            yield close(cell)

    return rows.repartition(parts, "cell", "part").mapInArrow(run, f"cell long, {names[0]} binary, {names[1]} binary")


class Nearest:
    """The k nearest of the blocks a task has seen, for each query: exact distances, ties to smaller ids."""

    def __init__(self, k: int):
        self.k = k
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, asked: np.ndarray, queries: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        rough = _squared(queries, x)
        limits = np.array([self._limit(int(q)) for q in asked])
        slack = 1e-9 * (np.abs(rough).max(axis=1) + (queries * queries).sum(axis=1))
        for i in np.flatnonzero(rough.min(axis=1) <= limits**2 + slack):
            near = np.flatnonzero((rough[i] <= limits[i] ** 2 + slack[i]) & (ids != asked[i]))
            if len(near) > self.k:
                last = np.partition(rough[i, near], self.k - 1)[self.k - 1]
                near = near[rough[i, near] <= last + slack[i]]
            gap = x[near] - queries[i]
            new = np.sqrt((gap * gap).sum(axis=1))
            own, distance = self.found.get(int(asked[i]), (ids[:0], new[:0]))
            own, distance = np.concatenate([own, ids[near]]), np.concatenate([distance, new])
            best = np.lexsort((own, distance))[: self.k]
            self.found[int(asked[i])] = own[best], distance[best]

    def _limit(self, query: int) -> float:
        held = self.found.get(query)
        return float(held[1][-1]) if held and len(held[1]) == self.k else np.inf

    def drain(self) -> pa.RecordBatch:
        found, self.found = self.found, {}
        n = [len(ids) for ids, _ in found.values()]
        query = np.repeat(np.array([*found], np.int64), n)
        both = [np.concatenate(c) if found else np.zeros(0) for c in zip(*found.values())] or [np.zeros(0), np.zeros(0)]
        return pa.RecordBatch.from_arrays(
            [pa.array(query), pa.array(both[0].astype(np.int64)), pa.array(both[1].astype(np.float64))],
            ["query_id", "vec_id", "score"],
        )


def needed_share(books: Codebooks, entries: DataFrame, k: int, recall: float) -> float:
    """Share of all vectors that a query has to pass to meet ``recall`` of its k nearest.

    PROBES vectors, the first by a hash of the id, are compared with every entry; of their true
    neighbours it is seen how many vectors lie in the cells that come no later.
    """
    rows = entries.orderBy(F.xxhash64(F.lit(11), "vec_id"), "vec_id").limit(PROBES).collect()
    ids = np.array([r["vec_id"] for r in rows], np.int64)
    probes = np.array([np.frombuffer(r["vector"], np.float64) for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, cell = batch.column("vec_id").to_numpy(), batch.column("cell").to_numpy()
            x = np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.float64).reshape(len(own), -1)
            d = _squared(probes, x)
            d[ids[:, None] == own] = np.inf
            some = np.argsort(d, axis=1)[:, :k]
            probe = np.repeat(np.arange(len(ids)), some.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(probe), pa.array(cell[some.ravel()]), pa.array(d[probe, some.ravel()])], ["probe", "cell", "d"]
            )

    order = Window.partitionBy("probe").orderBy("d", "cell")
    near = (
        entries.mapInArrow(run, "probe long, cell long, d double")
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).collect()
    )
    sizes, passed = books.sizes.ravel(), []
    for i, probe in enumerate(probes):
        cells = books.route(probe, int(sizes.sum()))
        upto = dict(zip(cells, np.cumsum(sizes[cells])))
        passed += [upto[r["cell"]] for r in near if r["probe"] == i]
    return float(np.quantile(passed, recall)) / max(1, sizes.sum()) if passed else 1.0


def search(
    vectors: DataFrame, is_query: Column, k: int = 10, recall: float = 0.95, least: int = 4096, sample: int = 20_000
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest vectors found for each query, by Euclidean distance.

    How many vectors a query passes follows from ``recall``, as measured on a few queries (needed_share), and
    is ``least`` at least; tables of up to ``least`` vectors are therefore searched in full. Clustered vectors
    need small shares; vectors without structure need more than half of the table, and no index changes
    that. Scores are exact, ties go to smaller ids. Vectors that
    are null, zero or hold null or non-finite components, and rows with null ids, take no part. All
    vectors have one length. Rows that repeat an id are one vector to a query with that id. Only ``vec_id`` and
    ``embedding`` are read. No rows: no rows.
    """
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    books, entries = build(vectors, sample)
    total = int(books.sizes.sum())
    enough = least if total <= least else max(least, int(np.ceil(needed_share(books, entries, k, recall) * total)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for query_id, vector in zip(batch.column("vec_id").to_pylist(), batch.column("vector").to_pylist()):
                cells = books.route(np.frombuffer(vector, np.float64), enough)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([query_id] * len(cells), pa.int64()), pa.array(cells, pa.int64()),
                     pa.array([vector] * len(cells), pa.binary())],
                    ["query_id", "cell", "vector"],
                )

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Nearest(k)
        for batch in batches:
            for row in batch.select(["vec_ids", "vectors", "query_id", "queries"]).to_pylist():
                ids, asked = (np.frombuffer(row[c], np.int64) for c in ("vec_ids", "query_id"))
                x = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1)
                best.add(asked, np.frombuffer(row["queries"], np.float64).reshape(len(asked), -1), ids, x)
                if len(best.found) > HELD:
                    yield best.drain()
        yield best.drain()

    questions = entries.filter(is_query).dropDuplicates(["vec_id"]).mapInArrow(route, "query_id long, cell long, vector binary")
    asked = _blocks(questions.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(4))), ["query_id", "queries"], parts)
    held = _blocks(_parted(entries, "vec_id", books.sizes).withColumnRenamed("vec_id", "vec_ids"), ["vec_ids", "vectors"], parts)
    found = held.hint("merge").join(asked.hint("merge"), "cell").mapInArrow(
        rerank, "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
