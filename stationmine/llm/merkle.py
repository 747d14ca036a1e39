"""Merkle manifest of a dataset by nested-interval labels (operator 13).

Every row is a leaf. The leaves of a source, in order of doc_id, have ranks 0, 1, 2 … in its tree, and
every node is labelled with the interval of leaf ranks it covers: [r, r] for a leaf, and the hull of its
children's intervals for an inner node. So an ancestor of a node is whatever covers its interval, and its siblings
are the children that lie in its parent's interval but outside its own.

Levels go by bands of BAND. A bucket is a node whose level is a multiple of BAND together with the
nodes of the BAND levels below it, 27 units at its bottom, so all work on a bucket is bounded. Bands are built from the leaves up, and what
each bucket's root covers becomes a unit of the next band. Paths go from the root down: a bucket takes
the path of the unit that covers its interval, and each of its units puts its own siblings in front. The sources' roots are the leaves of one more tree.

Only ids and digests are shuffled: rows to their rank, and leaves to their bucket. A source that
holds most rows is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationmine.scale import cut, global_rank, join_small

#: Children of a node, and levels of a band.
RUN, BAND = 3, 3
#: Units of a bucket.
WIDTH = RUN**BAND


def digest(text: Column) -> Column:
    """Lowercase hex sha256 of the text in UTF-8."""
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the value led by its length in bytes, so that no two rows read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column, names: list[str]) -> Column:
    """Digest of a row's columns, with ``text`` in place of the column of that name."""
    return digest(F.concat(*[field(text if n == "text" else F.col(n)) for n in names]))


def tampered_text() -> Column:
    """``text`` without line feeds where 2 divides the crc32 of the decimal doc_id; else null as a sign of no change."""
    odd = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) != 0
    return F.when(~F.coalesce(odd, F.lit(True)), F.translate("text", "\n", ""))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree, leaf and altered: one row per document, without its text.

    ``tree`` orders as the source does, null first. ``altered`` is the leaf of the tampered text.
    """
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    rows = docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"),
        F.col("n_chars").cast("long"), F.col("text").cast("string"),
    )
    changed = tampered_text()
    return rows.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("1"), "source"), F.lit("0")).alias("tree"),
        leaf(F.col("text"), names).alias("leaf"),
        F.when(changed.isNotNull() & (changed != F.col("text")), leaf(changed, names)).alias("altered"),
    )


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their ``rank`` in their tree from 0, and ``size``, the number of leaves there.

    All rows are ranked in one order by ranges, then each tree's first rank is taken off.
    """
    placed = cut(global_rank(rows, [F.asc_nulls_first(c) for c in ["tree", *order]]))
    trees = cut(placed.groupBy("tree").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("size")))
    return join_small(placed, trees, ["tree"]).withColumn("rank", F.col("rank") - F.col("first")).drop("first")


def _next_level(nodes: Column) -> Column:
    """Parents of neighbouring nodes, RUN by RUN: interval from the first to the last child, digest of all."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / RUN).cast("int"))

    def parent(i: Column) -> Column:
        run = F.slice(nodes, i * RUN + 1, F.lit(RUN))
        return F.struct(
            F.element_at(run, 1)["lo"].alias("lo"),
            F.element_at(run, -1)["hi"].alias("hi"),
            digest(F.array_join(F.transform(run, lambda n: n["digest"]), "")).alias("digest"),
        )

    return F.transform(runs, parent)


def _band(units: DataFrame, band: int) -> DataFrame:
    """Buckets (tree, lo, hi, size, node, kept, levels) of one band from its units (tree, lo, hi, size, digest, kept).

    ``levels`` holds the nodes of each level from the units up to the bucket's root. A tree of no more than WIDTH
    units ends in this band, at the first level of one node.
    """
    step = WIDTH**band
    units = units.withColumn("bucket", F.floor(F.col("lo") / (step * WIDTH)))
    gathered = units.groupBy("tree", "bucket").agg(
        F.first("size").alias("size"),
        F.array_sort(F.collect_list(F.struct("lo", "hi", "digest", "kept"))).alias("units"),
    )
    count = F.ceil(F.col("size") / step)
    up = F.when(count <= 1, 0)
    for level in range(1, BAND):
        up = up.when(count <= RUN**level, level)
    rounds = F.filter(F.array(*[F.lit(i) for i in range(1, BAND + 1)]), lambda i: i <= F.col("up"))
    base = F.array(F.transform("units", lambda u: F.struct(u["lo"].alias("lo"), u["hi"].alias("hi"), u["digest"].alias("digest"))))
    levels = F.aggregate(rounds, base, lambda held, _: F.concat(held, F.array(_next_level(F.element_at(held, -1)))))
    built = gathered.withColumn("up", up.otherwise(BAND)).withColumn("levels", levels)
    top = F.element_at(F.element_at("levels", -1), 1)
    kept = F.transform("units", lambda u: u["kept"])
    return cut(built.select("tree", "size", top.alias("top"), kept.alias("kept"), "levels")).select(
        "tree", "top.lo", "top.hi", "size", F.col("top.digest").alias("node"), "kept", "levels"
    )


def _inside(n: Column, outer: Column) -> Column:
    return (n["lo"] >= outer["lo"]) & (n["hi"] <= outer["hi"])


def _siblings(unit: Column, levels: Column) -> Column:
    """For each level of a bucket the digests before and after the one that covers ``unit``, within its parent's interval."""

    def at(level: Column, i: Column) -> Column:
        above = F.filter(F.element_at(levels, i + 2), lambda n: _inside(unit, n))
        parent = F.element_at(above, 1)
        children = F.filter(level, lambda n: _inside(n, parent))
        left = F.filter(children, lambda n: n["hi"] < unit["lo"])
        right = F.filter(children, lambda n: n["lo"] > unit["hi"])
        text = lambda nodes: F.array_join(F.transform(nodes, lambda n: n["digest"]), "")
        return F.struct(text(left).alias("left"), text(right).alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), at)


class Forest:
    """The trees over rows (tree, rank, size, digest, kept): built up once, then asked for paths.

    ``kept`` is any column that a leaf takes along to its path.
    """

    def __init__(self, rows: DataFrame):
        units = rows.select("tree", F.col("rank").alias("lo"), F.col("rank").alias("hi"), "size", "digest", "kept")
        largest = units.agg(F.max("size")).first()[0] or 0
        self.bands: list[DataFrame] = []
        while True:
            self.bands.append(_band(units, len(self.bands)))
            if largest <= WIDTH ** len(self.bands):
                break
            done = F.lit(WIDTH ** len(self.bands))
            units = self.bands[-1].filter(F.col("size") > done).select(
                "tree", "lo", "hi", "size", F.col("node").alias("digest"), F.lit(None).cast("int").alias("kept")
            )

    def roots(self) -> DataFrame:
        """tree, digest: the root of every tree."""
        out = None
        for band, buckets in enumerate(self.bands):
            ends = buckets.filter(F.col("size") <= WIDTH ** (band + 1)).select("tree", F.col("node").alias("digest"))
            out = ends if out is None else out.union(ends)
        return out

    def paths(self, above: DataFrame | None = None) -> DataFrame:
        """tree, kept, digest, path and the columns of ``above``: one row per leaf.

        ``path`` holds a pair (left, right) of joined sibling digests per level, from the leaf up. ``above``
        (tree, path and more) says how each tree's path goes on; else it ends at the tree's root.
        """
        if above is None:
            empty = F.array().cast("array<struct<left:string,right:string>>")
            above = self.roots().select("tree", empty.alias("path"))
        more = [c for c in above.columns if c not in ("tree", "path")]
        upper = None
        for band in reversed(range(len(self.bands))):
            buckets = self.bands[band]
            ends = join_small(buckets.filter(F.col("size") <= WIDTH ** (band + 1)), above, ["tree"])
            if upper is not None:
                # an ancestor of a bucket is the unit above that covers its interval; both lie in the same stretch of ranks
                step = WIDTH ** (band + 1)
                lower = buckets.filter(F.col("size") > step).withColumn("stretch", F.floor(F.col("lo") / step)).alias("l")
                cover = upper.withColumn("stretch", F.floor(F.col("lo") / step)).alias("u")
                holds = (F.col("l.tree") == F.col("u.tree")) & (F.col("l.stretch") == F.col("u.stretch"))
                holds &= (F.col("u.lo") <= F.col("l.lo")) & (F.col("l.hi") <= F.col("u.hi"))
                found = lower.join(cover, holds).select("l.*", *[F.col(f"u.{c}") for c in ("path", *more)]).drop("stretch")
                ends = ends.unionByName(found)
            spread = ends.select(
                "tree", "path", "levels", "kept", *more, F.posexplode(F.element_at("levels", 1)).alias("i", "unit")
            )
            steps = F.concat(_siblings(F.col("unit"), F.col("levels")), "path")
            if band:
                upper = cut(spread.select("tree", "unit.lo", "unit.hi", steps.alias("path"), *more))
            else:
                own = F.element_at("kept", F.col("i") + 1).alias("kept")
                return spread.select("tree", own, "unit.digest", steps.alias("path"), *more)


def fold(start: Column, path: Column) -> Column:
    """The root that ``start`` leads to along a path."""
    return F.aggregate(path, start, lambda held, s: digest(F.concat(s["left"], held, s["right"])))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row per document.

    Leaves of a source ascend by doc_id (null first; rows with one doc_id by leaf), sources ascend bytewise, null first.
    Every RUN consecutive nodes become one, the last run may be shorter, until one node is left; a lone leaf is its source's root itself.
    ``proof_sha256`` digests all siblings on the way to the root, left to right, level by level; ``folded_root`` is
    computed from the tampered row (see ``tampered_text``; rows without doc_id or text are not tampered) and these siblings,
    and ``verified`` tells whether it is the root. Null, empty and long values are told apart by ``field``.
    Only doc_id, source, lang, n_chars and text are read. No rows: no rows.
    """
    rows = cut(leaves(docs))  # ranges are sampled first: texts are read and hashed once
    placed = ranked(rows, ["doc_id", "leaf"])
    keep = F.struct("doc_id", "altered")
    trees = Forest(placed.select("tree", "rank", "size", F.col("leaf").alias("digest"), keep.alias("kept")))
    tops = trees.roots().select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("digest").alias("leaf"))
    tops = ranked(tops, ["source"])
    top = Forest(tops.select("tree", "rank", "size", F.col("leaf").alias("digest"), F.col("source").alias("kept")))
    root = top.roots().select("tree", F.col("digest").alias("root"))
    above = join_small(top.paths(), root, ["tree"]).select(
        F.col("kept").alias("tree"), F.col("digest").alias("subroot"), "root", "path"
    )
    found = trees.paths(cut(above))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    out = found.select(
        "kept.doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        digest(siblings).alias("proof_sha256"),
        fold(F.coalesce("kept.altered", "digest"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
