"""Near-duplicate documents by a chosen-path set similarity join (operator 7).

Documents are sets of word shingles. Each set has a sketch of minwise tokens. A tree starts with all
documents at its root; every node picks one of the sketch's coordinates, by a second chance in four another one,
and sends a document to the child named by the minwise token it has there, so two documents of
similarity s stay together with probability s per pick, and the picks (1.25 on average, 1 / 0.8) balance that. Nodes that have
become small are compared exhaustively, others branch again. Independent trees repeat this until
the chance to miss a pair at the threshold is small (see ``TREES``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationmine.llm.graph import components, forest
from stationmine.llm.tables import binary_column, by_slice, mix, text_only, word_hashes
from stationmine.scale import cut, join_small

SKETCH = 64
#: A pair at similarity 0.8 stays together in one tree with probability 0.73 at depth 2, 0.64 at 3, 0.52
#: at 5 and 0.48 at 6, so twelve trees miss it with probability 1.5e-7, 5e-6, 1.4e-4 and 4e-4.
TREES = 12
#: Nodes of so many documents at most are compared exhaustively.
NODE = 500
#: At this depth every node is compared, whatever its size.
DEPTH = 6
#: A task compares about so many documents at once; larger nodes are compared as pairs of blocks of half of that.
TASK = 16_384
#: Documents with more candidates than this in a node are crowded: their pairs are not listed.
GROUP = 2
#: Crowded documents of one cluster are compared in blocks of so many.
BLOCK = 512
#: Edges a task gathers before it thins them.
_HELD = 1 << 20
#: Shingles that a block's matrix holds at once.
_WIDTH = 8192
#: Two-bit sketches of a pair at 0.8 agree in 54.4 of 64 places, give or take 2.9; 42 is 4.3 deviations below.
AGREE = 42

_MULTIPLIERS = mix(np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles, A-Z lower-cased.

    Words are what bytes.split() leaves: runs without space, tab, line feed, vertical tab, form feed
    and carriage return. Fewer words than k are one shingle.
    """
    h = word_hashes((text or "").encode().lower().split())
    if not len(h):
        return h
    k = min(k, len(h))
    n = len(h) - k + 1
    found = mix(h[:n])
    for j in range(1, k):
        found = mix(found + h[j : j + n])
    return np.unique(found)


def minwise(found: np.ndarray) -> np.ndarray:
    """The least image of the set under each of SKETCH hash functions."""
    least = np.full(SKETCH, np.uint64(2**64 - 1))
    for i in range(0, len(found), 1024):
        np.minimum(least, (found[i : i + 1024, None] * _MULTIPLIERS).min(axis=0), out=least)
    return least


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (set size), fp0 and fp1 (the set's fingerprint), bits (two bits a coordinate), sketch."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, k) for t in part.column("text").to_pylist()]
        full = np.array([minwise(s) for s in sets]).reshape(-1, SKETCH)
        mixed = mix(full)
        weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
        bits = [((mixed >> np.uint64(b) & np.uint64(1)) * weights).sum(axis=1, dtype=np.uint64) for b in (0, 1)]
        prints = [np.array([mix(s ^ np.uint64(salt)).sum(dtype=np.uint64) for s in sets], np.uint64) for salt in (0, 0x5BD1E995)]
        signed = lambda x: pa.array(x.astype(np.uint64).view(np.int64))
        bounds = np.arange(len(sets) + 1) * SKETCH
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *map(signed, prints), *map(signed, bits),
             binary_column((mixed >> np.uint64(32)).astype(np.uint32).ravel(), bounds)],
            ["doc_id", "n", "fp0", "fp1", "bits0", "bits1", "sketch"],
        )

    schema = "doc_id long, n long, fp0 long, fp1 long, bits0 long, bits1 long, sketch binary"
    return text_only(docs).mapInArrow(by_slice(work, "text"), schema)


def _children(node: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of each (node, document), and which row each comes from."""
    rows = np.arange(len(node))
    pick = mix(node + np.uint64(1))
    twice = np.flatnonzero(pick & np.uint64(3) == 0)
    rows = np.concatenate([rows, twice])
    place = np.concatenate([pick >> np.uint64(8), pick[twice] >> np.uint64(32)]) % np.uint64(SKETCH)
    token = sketch[rows, place.astype(np.int64)].astype(np.uint64)
    return mix(node[rows] ^ mix((place << np.uint64(32)) + token + np.uint64(1))), rows


def _rows(rep, node, bits0, bits1) -> pa.RecordBatch:
    arrays = [pa.array(x.view(np.int64)) for x in (node, rep, bits0, bits1)]
    return pa.RecordBatch.from_arrays(arrays, ["node", "rep", "bits0", "bits1"])


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False).view(np.uint64) for n in names]


def _sketch(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, SKETCH)


_NODE_ROW = "node long, rep long, bits0 long, bits1 long"


def _first_nodes(reps: DataFrame, trees: int, depth: int, seed: int) -> DataFrame:
    """Each document in its nodes at ``depth`` of every tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, b0, b1 = _columns(batch, "rep", "bits0", "bits1")
            sketch = _sketch(batch)
            for tree in range(trees):
                root = mix(np.array([(seed << 32) + tree + 1], np.uint64))
                node, row = np.repeat(root, len(rep)), np.arange(len(rep))
                for _ in range(depth):
                    node, parent = _children(node, sketch[row])
                    row = row[parent]
                yield _rows(rep[row], node, b0[row], b1[row])

    return reps.mapInArrow(run, _NODE_ROW)


def _next_nodes(open_rows: DataFrame, reps: DataFrame) -> DataFrame:
    """One more pick for the documents of nodes that are still large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, rep, b0, b1 = _columns(batch, "node", "rep", "bits0", "bits1")
            child, row = _children(node, _sketch(batch))
            yield _rows(rep[row], child, b0[row], b1[row])

    return open_rows.select("node", "rep").join(reps, "rep").mapInArrow(run, _NODE_ROW)


def _candidates(bits0: np.ndarray, bits1: np.ndarray, some: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) whose sketches agree enough, tile by tile; i from all rows, j from ``some``."""
    for lo in range(0, len(some), 512):
        j = some[lo : lo + 512]
        for at in range(0, len(bits0), 4096):
            own0, own1 = bits0[at : at + 4096], bits1[at : at + 4096]
            differ = np.bitwise_count((bits0[j, None] ^ own0) | (bits1[j, None] ^ own1))
            x, y = np.nonzero(differ <= SKETCH - AGREE)
            if len(x):
                yield y + at, j[x]


def _compare(rep: np.ndarray, bits0: np.ndarray, bits1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of one node, and edges that connect its crowded documents as far as they are candidates.

    Crowded documents have more than GROUP candidates. All pairs with someone who is not crowded are listed;
    of the others only a forest is, one edge per document.
    """
    n = len(rep)
    degree = np.zeros(n, np.int64)
    for i, _ in _candidates(bits0, bits1, np.arange(n)):
        degree += np.bincount(i, minlength=n)
    crowded = degree > GROUP + 1  # everyone is a candidate of oneself
    pairs = [np.zeros((0, 2), np.uint64)]
    for i, j in _candidates(bits0, bits1, np.flatnonzero(~crowded & (degree > 1))):
        once = (rep[i] < rep[j]) | crowded[i]
        pairs.append(np.c_[np.minimum(rep[i[once]], rep[j[once]]), np.maximum(rep[i[once]], rep[j[once]])])
    where = np.flatnonzero(crowded)
    edges = [np.zeros((0, 2), np.uint64)]
    for lo in range(0, len(where), 512):
        own = where[lo : lo + 512]
        for i, j in _candidates(bits0[where], bits1[where], np.arange(lo, lo + len(own))):
            order = np.lexsort((j, i))
            edges.append(forest(i[order], j[order] - lo, rep[where], rep[own]))
    return np.concatenate(pairs), _thinned(np.concatenate(edges))


def _thinned(edges: np.ndarray) -> np.ndarray:
    """At most two edges per document that connect what ``edges`` connect."""
    if not len(edges):
        return edges
    ids, at = np.unique(edges, return_inverse=True)
    a, b = at.reshape(-1, 2).T
    order = np.lexsort((b, a))
    found = forest(a[order], b[order], ids, ids)
    return found[found[:, 0] != found[:, 1]]


_FOUND = "kind int, a long, b long"
_PAIR, _EDGE, _OPEN = 0, 1, 2


def _found(kind: int, rows: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(np.ascontiguousarray(rows[:, c]).view(np.int64)) for c in range(2)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), kind, np.int32)), *columns], ["kind", "a", "b"])


def _runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of whole runs of the first name, and the bounds of those runs; rows come sorted by it."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = _columns(batch, *names)
        if held and columns[0][0] == held[0][0][0] and columns[0][-1] == held[0][0][0]:
            held.append(columns)
            continue
        joined = [np.concatenate([h[c] for h in held] + [columns[c]]) for c in range(len(names))]
        bounds = np.flatnonzero(np.concatenate([[True], joined[0][1:] != joined[0][:-1]]))
        last = int(bounds[-1])
        if last:
            yield [c[:last] for c in joined], bounds
        held = [[c[last:] for c in joined]]
    if held:
        joined = [np.concatenate([h[c] for h in held]) for c in range(len(names))]
        yield joined, np.array([0, len(joined[0])])


def _visit(nodes: DataFrame, branch: bool) -> DataFrame:
    """Compares small nodes (all nodes, unless ``branch``) and names the others, one row each. A task's edges are thinned together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, held = [np.zeros((0, 2), np.uint64)], 0
        for (node, rep, b0, b1), bounds in _runs(batches, ("node", "rep", "bits0", "bits1")):
            sizes = np.diff(bounds)
            large = bounds[:-1][sizes > NODE] if branch else bounds[:0]
            if len(large):
                yield _found(_OPEN, np.c_[node[large], node[large]])
            pairs = [np.zeros((0, 2), np.uint64)]
            for lo, n in zip(bounds[:-1][sizes > 1], sizes[sizes > 1]):
                if branch and n > NODE:
                    continue
                at = slice(lo, lo + n)
                listed, connecting = _compare(rep[at], b0[at], b1[at])
                pairs.append(listed)
                edges.append(connecting)
                held += len(connecting)
                if held > _HELD:
                    edges = [_thinned(np.concatenate(edges))]
                    held = len(edges[0])
            both = np.unique(np.concatenate(pairs), axis=0)
            yield _found(_PAIR, both[both[:, 0] != both[:, 1]])
        yield _found(_EDGE, _thinned(np.concatenate(edges)))

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return nodes.repartition(parts, "node").sortWithinPartitions("node").mapInArrow(run, _FOUND)


def _blocks(nodes: DataFrame) -> DataFrame:
    """Nodes of more than TASK documents as one node for each pair of their blocks; other nodes stay.

    Every two documents of a node meet in some pair of blocks, so the node is still compared in full, by
    many tasks. What is crowded is judged, and connected, within each pair of blocks. ``nodes`` is read several times.
    """
    sizes = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > TASK)
    large = cut(sizes.select("node", F.ceil(2 * F.col("size") / TASK).cast("int").alias("blocks")))
    if large.isEmpty():
        return nodes
    own = F.pmod(F.xxhash64("rep", "node"), F.col("blocks")).cast("int")
    dealt = join_small(nodes, large, ["node"], "left").withColumn("own", own)
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("own"))
    pair = F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))
    parted = dealt.filter("blocks IS NOT NULL").withColumn("other", F.explode(others)).withColumn("node", pair)
    return dealt.filter("blocks IS NULL").select(nodes.columns).union(parted.select(nodes.columns))


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """The sets (doc_id, members) of some documents, built again from their texts."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_set(t, k) for t in part.column("text").to_pylist()]
        bounds = np.cumsum([0, *map(len, found)])
        values = np.concatenate(found) if found else np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays([part.column("doc_id"), binary_column(values, bounds)], ["doc_id", "members"])

    chosen = join_small(text_only(docs), cut(ids), ["doc_id"], "left_semi")
    return cut(chosen.mapInArrow(by_slice(run, "text"), "doc_id long, members binary").dropDuplicates(["doc_id"]))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
            keep = []
            for x, y in zip(left, right):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                short, long = sorted((len(x), len(y)))
                keep.append(100 * short >= percent * long and _share(x, y, percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("left"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("right"))
    # hints keep the sets from being broadcast; hot keys are split by adaptive execution
    both = pairs.hint("merge").join(right.hint("merge"), "b").join(left.hint("merge"), "a")
    return both.select("a", "b", "left", "right").mapInArrow(alike, "a long, b long")


def _share(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    same = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * same >= percent * (len(x) + len(y) - same)


def _linked(sets: list[np.ndarray], first: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of linked pairs, i among the ``first`` sets, j among the others (or all, if there are none).

    Sizes of intersections are products of 0/1 matrices over the shingles that more than one set has.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    rest = first if first < len(sets) else 0
    same = np.zeros((first, len(sets) - rest), np.float64)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, _WIDTH):
        at = slice(*np.searchsorted(column, (lo, lo + _WIDTH)))
        dense = np.zeros((len(sets), _WIDTH), np.float32)
        dense[owner[at], column[at] - lo] = 1
        same += dense[:first] @ dense[rest:].T
    i, j = np.nonzero(100 * same >= percent * (sizes[:first, None] + sizes[rest:] - same))
    return i, j + rest


def _within(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Connecting edges of all linked pairs within each cluster of crowded documents.

    A cluster is what candidate edges connect. Its documents are dealt to blocks of about BLOCK, and each
    pair of blocks is one group of rows, so no task holds more than two blocks, whatever a cluster's size.
    """
    named = cut(components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")))
    blocks = named.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("n")).cast("int")
    dealt = (
        named.join(blocks, "cluster").withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select("doc_id", F.xxhash64("cluster", F.least("own", "other"), F.greatest("own", "other")).alias("pair"),
                "cluster", (F.col("own") > F.col("other")).cast("long").alias("second"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("pair", "cluster", "second", "doc_id", "members"))):
                if held and held[0][:2] != row[:2]:
                    yield links(held)
                    held = []
                held.append(row)
        if held:
            yield links(held)

    def links(rows: list[tuple]) -> pa.RecordBatch:
        ids = np.array([r[3] for r in rows], np.int64)
        first = sum(r[2] == 0 for r in rows)
        if not first:
            return _found(_PAIR, np.zeros((0, 2), np.uint64)).select(["a", "b"])
        i, j = _linked([np.frombuffer(r[4], np.uint64) for r in rows], first, percent)
        apart = i != j
        found = forest(i[apart], j[apart], ids, ids) if apart.any() else np.zeros((0, 2), np.int64)
        return _found(_PAIR, found[found[:, 0] != found[:, 1]]).select(["a", "b"])

    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = dealt.hint("merge").join(sets.hint("merge"), "doc_id")
    return full.repartition(n, "pair").sortWithinPartitions("pair", "cluster", "second").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, trees: int = TREES, seed: int = 1) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id of its component), kept, one row per document.

    Documents whose sets of k-word shingles have a similarity of ``percent`` / 100 or more are linked; links
    are confirmed on the full sets. Equal sets are found by fingerprint and go on as one document, so
    groups of copies cost one row. Every node and every group is worked on in full.

    Texts that are null or without words have no shingles and are linked with nothing. Null doc_ids
    are linked with nothing, have no component and are kept. Rows with one doc_id are each answered. Only
    ``doc_id`` and ``text`` are read. No rows: no rows.
    """
    drawn = cut(sketches(docs, k))
    some = drawn.filter("n > 0 AND doc_id IS NOT NULL")
    same = cut(some.groupBy("fp0", "fp1", "n").agg(F.min("doc_id").alias("rep")))
    first = some.join(same.select("rep"), F.col("doc_id") == F.col("rep"), "left_semi")
    reps = cut(first.select(F.col("doc_id").alias("rep"), "bits0", "bits1", "sketch").dropDuplicates(["rep"]))

    small = reps.count() <= NODE  # the root itself is a small node: one tree compares everything
    depth = 0 if small else 2
    nodes = _first_nodes(reps, 1 if small else trees, depth, seed)
    visited = [cut(_visit(nodes, not small))]
    while not small and depth < DEPTH:
        still = cut(visited[-1].filter(F.col("kind") == _OPEN).select(F.col("a").alias("node")))
        if still.isEmpty():
            break
        depth += 1
        nodes = cut(_next_nodes(join_small(nodes, still, ["node"], "left_semi"), reps))
        visited.append(cut(_visit(nodes, True) if depth < DEPTH else _visit(_blocks(nodes), False)))
    found = visited[0]
    for more in visited[1:]:
        found = found.union(more)

    pairs = cut(found.filter(F.col("kind") == _PAIR).select("a", "b").distinct())
    edges = cut(found.filter(F.col("kind") == _EDGE).select("a", "b").distinct())
    both = pairs.union(edges)
    sets = _sets(docs, both.select(F.col("a").alias("doc_id")).union(both.select("b")).distinct(), k)
    links = _confirmed(pairs, sets, percent)
    if not edges.isEmpty():
        links = links.union(_within(edges, sets, percent))
    parts = components(links).withColumnRenamed("node", "rep")
    named = same.join(parts, "rep", "left").select(
        "fp0", "fp1", "n", F.coalesce("component", "rep").alias("component_id")
    )
    out = drawn.select("doc_id", F.col("n").alias("n_shingles"), "fp0", "fp1", "n").join(
        named, ["fp0", "fp1", "n"], "left"
    )
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept")
    )
