"""The Merkle manifest against a plain tree."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from stationmine.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def joined(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def _leaf(row, text):
    return joined(map(_field, (row[0], row[1], row[2], row[3], text)))


def _tree(leaves):
    """Root, and for each leaf the joined digests before and after it, level by level."""
    paths = [[] for _ in leaves]
    nodes = [(d, [i]) for i, d in enumerate(leaves)]
    while len(nodes) > 1:
        above = []
        for k in range(0, len(nodes), 3):
            run = nodes[k : k + 3]
            for j, (_, members) in enumerate(run):
                for m in members:
                    paths[m].append(("".join(d for d, _ in run[:j]), "".join(d for d, _ in run[j + 1 :])))
            above.append((joined(d for d, _ in run), [m for _, members in run for m in members]))
        nodes = above
    return nodes[0][0], paths


def plain(rows):
    """What the manifest of rows (doc_id, source, lang, n_chars, text) holds."""
    if not rows:
        return []
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        own = [(r[0] is not None, r[0] or 0, _leaf(r, r[4]), r) for r in rows if r[1] == s]
        own.sort(key=lambda x: x[:3])
        trees.append((own, *_tree([x[2] for x in own])))
    root, above = _tree([subroot for _, subroot, _ in trees])
    out = []
    for (own, subroot, paths), more in zip(trees, above):
        for (_, _, leaf, r), path in zip(own, paths):
            changed = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            folded = _leaf(r, r[4].replace("\n", "")) if changed else leaf
            for left, right in path + more:
                folded = joined([left, folded, right])
            proof = joined(a + b for a, b in path + more)
            out.append((r[0], leaf, subroot, root, proof, folded, folded == root))
    return out


def rows_of(n, seed):
    draw = random.Random(seed)
    return [
        (i, draw.choice(["a", "a", "b", None, "é", ""]), draw.choice(["en", None]), draw.choice([None, i]),
         draw.choice(["x\ny", "", None, "ü z", "line\n", "no end"]))
        for i in range(n)
    ]


def check(spark, rows):
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(3))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows), key=key)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 30, 82, 200])
def test_one_source(spark, n):
    check(spark, [(i * 5 - 7, "s", "en", i, f"t{i}\n") for i in range(n)])


def test_sources_nulls_and_tampering(spark):
    check(spark, rows_of(400, 1))


def test_many_sources_and_a_tree_over_them(spark):
    check(spark, [(i, f"s{i % 90}", "en", 1, "a\nb") for i in range(100)])


def test_one_source_with_most_rows_over_several_bands(spark):
    check(spark, [(i, "hot" if i % 5 else f"s{i % 11}", "en", 1, "a\nb" if i % 3 else "c") for i in range(2500)])


def test_repeated_and_null_ids(spark):
    rows = [(1, "s", "en", 1, "a\n"), (1, "s", "en", 1, "a\n"), (1, "s", "en", 1, "b"), (None, "s", None, None, None), (None, None, None, None, "x\n")]
    check(spark, rows * 3)


def test_long_text_and_foreign_columns(spark):
    rows = [(i, "s", "en", 3, "long \n" * 100_000 * i) for i in range(3)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS leaf", "1 AS rank", "'y' AS tree", "2 AS root")
    assert sorted(map(tuple, merkle.manifest(frame).collect())) == sorted(plain(rows))


def test_no_rows(spark):
    got = merkle.manifest(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert got.count() == 0


def test_nodes_are_labelled_with_nested_intervals(spark):
    rows = spark.range(1000).selectExpr("'t' AS tree", "id AS rank", "1000L AS size", "sha2(CAST(id AS STRING), 256) AS digest", "id AS kept")
    bands = merkle.Forest(rows).bands
    nodes = [b.select(F.explode(F.flatten("levels")).alias("n")).select("n.lo", "n.hi").collect() for b in bands]
    spans = {(r.lo, r.hi) for band in nodes for r in band}
    assert (0, 999) in spans and all((i, i) in spans for i in range(1000))
    assert all(b < c or d < a or (a <= c and d <= b) or (c <= a and b <= d) for a, b in spans for c, d in list(spans)[:40])
