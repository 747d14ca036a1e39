"""Nearest neighbours and range joins against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationmine.llm import multiindex, ranges

SCHEMA = "vec_id long, embedding array<float>, label int"


def clustered(seed, n=600, size=8, noise=0.12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, size))
    x = centres[rng.integers(0, 40, n)] + rng.normal(size=(n, size)) * noise
    x[50:80] = x[50]
    x[90] = x[91] * 3
    return x.astype(np.float32)


def odd():
    nan, inf = float("nan"), float("inf")
    return [[0.0] * 8, None, [nan] * 8, [1.0, None] * 4, [inf] + [1.0] * 7, [-0.0] * 8]


def frame(spark, x, extra=(), parts=4):
    rows = [(i * 5, [float(v) for v in row], 1) for i, row in enumerate(x)]
    rows += [(100_000 + i, v, 1) for i, v in enumerate(extra)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return df.selectExpr("*", "7L AS cell", "8 AS rank", "9 AS kept")


def linked(x, cosine):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= cosine
    np.fill_diagonal(near, False)
    least = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min(least[i], least[near[i]].min(initial=i)) for i in range(len(x))])
        if (new == least).all():
            break
        least = new
    return [(i * 5, int(near[i].sum()), int(least[i]) * 5, bool(least[i] == i)) for i in range(len(x))]


@pytest.mark.parametrize("per_pivot,block", [(4096, 2048), (40, 16)])
def test_range_join_same_as_all_pairs(spark, monkeypatch, per_pivot, block):
    monkeypatch.setattr(ranges, "PER_PIVOT", per_pivot)
    monkeypatch.setattr(ranges, "BLOCK", block)
    x = clustered(1)
    got = sorted(tuple(r) for r in ranges.near_duplicates(frame(spark, x, odd()), 0.95).collect())
    alone = [(100_000 + i, 0, 100_000 + i, True) for i in range(len(odd()))]
    assert got == linked(x, 0.95) + alone


def test_range_join_chains_copies_and_lengths(spark):
    angle = np.linspace(0, 3, 60)
    x = np.stack([np.cos(angle), np.sin(angle)], axis=1)
    rows = [(i, [float(v) for v in p], 0) for i, p in enumerate(x)] + [(i + 500, [1.0, 0.0, 0.0], 0) for i in range(300)]
    rows += [(900, [1e300, 0.0], 0), (None, [1.0, 0.0], 0), (7, [float(v) for v in x[7]], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = [tuple(r) for r in ranges.near_duplicates(df, 0.95).collect()]
    by = {r[0]: r for r in got}
    assert len(got) == len(rows) and {by[i][2] for i in range(60)} == {0}
    assert by[500] == (500, 299, 500, True) and by[799] == (799, 299, 500, False)
    assert by[900][2] == 0 and by[None][1] == 0


def test_range_join_in_groups_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(ranges, "PER_PIVOT", 40)
    monkeypatch.setattr(ranges, "BLOCK", 16)
    monkeypatch.setattr(ranges, "GROUP_BYTES", 16 * 8 * 4 * 5)
    monkeypatch.setattr(ranges, "TASK_BYTES", 16 * 8 * 4 * 3)
    x = clustered(7, 300)
    assert sorted(tuple(r) for r in ranges.near_duplicates(frame(spark, x), 0.95).collect()) == linked(x, 0.95)


def test_range_join_writes_no_vector_twice(spark, monkeypatch):
    written = []

    def kept(df, cut=ranges.cut):
        written.append(cut(df))
        return written[-1]

    monkeypatch.setattr(ranges, "cut", kept)
    monkeypatch.setattr(ranges, "PER_PIVOT", 40)
    x = np.random.default_rng(8).normal(size=(500, 24)).astype(np.float32)
    assert ranges.near_duplicates(frame(spark, x), 0.95).filter("n_links = 0").count() == 500
    blocks = [df for df in written if "vectors" in df.columns]
    assert blocks and sum(r[0] for df in blocks for r in df.selectExpr("length(ids)").collect()) == 500 * 16


def test_range_join_where_vectors_share_a_fingerprint(spark, monkeypatch):
    monkeypatch.setattr(ranges, "fingerprint", lambda v: F.size(v).cast("long"))
    x = clustered(9, 200)
    assert sorted(tuple(r) for r in ranges.near_duplicates(frame(spark, x), 0.95).collect()) == linked(x, 0.95)


def test_range_join_signed_zeros_are_equal(spark):
    rows = [(1, [0.0, 1.0], 0), (2, [-0.0, 1.0], 0), (3, [1.0, -0.0], 0)]
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
        got = sorted(tuple(r) for r in ranges.near_duplicates(df, 0.95).collect())
        assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_range_join_without_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ranges.near_duplicates(none, 0.95).count() == 0
    assert ranges.near_duplicates(frame(spark, clustered(1)[:0], odd()), 0.95).filter("kept").count() == len(odd())


def nearest(x, i, k):
    d = np.sqrt(((x.astype(float) - x[i].astype(float)) ** 2).sum(axis=1))
    d[i] = np.inf
    order = np.lexsort((np.arange(len(x)), d))[: min(k, len(x) - 1)]
    return [(i * 5, r + 1, int(j) * 5, float(d[j])) for r, j in enumerate(order)]


def test_search_of_a_small_table_is_exact(spark):
    x = clustered(2)
    got = multiindex.search(frame(spark, x, odd()), F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    want = [r for i in range(0, len(x), 20) for r in nearest(x, i, 10)]
    assert [tuple(r)[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r["score"] for r in got], [r[3] for r in want], rtol=1e-12, atol=0)


def test_search_reaches_its_recall(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "BLOCK", 64)
    rng = np.random.default_rng(4)
    x = np.concatenate([clustered(3, 1500), rng.normal(size=(1500, 8)).astype(np.float32)])
    got = multiindex.search(frame(spark, x), F.col("vec_id") % 100 == 0, least=50).collect()
    want = {(r[0], r[2]) for i in range(0, len(x), 20) for r in nearest(x, i, 10)}
    assert len({(r["query_id"], r["vec_id"]) for r in got} & want) / len(want) >= 0.9


def test_search_of_few_and_no_vectors(spark):
    x = clustered(5)[:4]
    got = multiindex.search(frame(spark, x), F.col("vec_id") == 0).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3]
    assert multiindex.search(frame(spark, x[:1]), F.col("vec_id") == 0).count() == 0
    assert multiindex.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).count() == 0


def test_cells_come_in_order_of_summed_distance():
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(9, 4)), rng.normal(size=(7, 4))
    books = multiindex.Codebooks(a, b, np.ones((9, 7), int))
    q = rng.normal(size=8)
    order = books.route(q, 63)
    total = (((a - q[:4]) ** 2).sum(1)[:, None] + ((b - q[4:]) ** 2).sum(1)).ravel()
    assert sorted(order) == list(range(63)) and (np.diff(total[order]) >= -1e-9).all()


def test_vectors_of_several_lengths_are_named():
    import pyarrow as pa

    from stationmine.llm import ranges

    with pytest.raises(ValueError, match="several lengths"):
        ranges.matrix(pa.array([[1.0] * 3, [1.0] * 5, [1.0] * 4]))
    assert ranges.matrix(pa.array([[1.0, 2.0], [3.0, 4.0]])).tolist() == [[1, 2], [3, 4]]
