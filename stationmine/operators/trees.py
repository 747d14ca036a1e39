"""Many classification trees grown at once, level by level, from histograms.

One model per station means thousands of small trees. They are rows of one table, told apart by key columns (station,
and if wanted tree of a forest, fold, grid point), and each level of all of them is one aggregation over (keys, node, feature,
bin). Rows carry the node they lie in; nodes are numbered as in a heap, from 1. So the number of jobs is the depth of the
deepest tree, whatever the number of models, and no model passes the driver.

Features are whole numbers (``cells``). A split sends rows with x[feature] <= bin to the left.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationmine.scale import cut, fits, join_small

#: Chances that a row drawn with replacement occurs at most 0, 1, … 5 times (Poisson of mean one). Fixed values.
AT_MOST = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)
_RATE = 1 << 20
#: What all nodes of a tree share (its limits and the number of features), and what a row knows of its node.
_TREE, _NODE = ["depth", "least", "entropy", "size"], ["node", "n", "p"]


class Model(NamedTuple):
    """``splits``: keys, node, feature, bin; ``leaves``: keys, node, n, p (rows, and positive ones)."""

    splits: DataFrame
    leaves: DataFrame
    keys: list[str]
    depth: int


def cells(features: Column, width: float = 1.0, top: int = 63) -> Column:
    """Bins of equal width from zero; what lies beyond the last one belongs to it."""
    return F.transform(features, lambda v: F.greatest(F.lit(0), F.least(F.lit(top), F.floor(v / width).cast("int"))))


def chance(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(_RATE)) / F.lit(float(_RATE))


def drawn(rows: DataFrame, trees: int, row: list[str]) -> DataFrame:
    """Rows once per tree with ``w``, how often each is drawn there. Depends on the ``row`` columns and the tree."""
    u = chance(F.col("tree"), *[F.col(c) for c in row])
    times = sum((u >= t).cast("int") for t in AT_MOST)
    many = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    return many.withColumn("w", F.when(F.col("w") > 0, times).otherwise(0))


def _impurity(n: Column, p: Column) -> Column:
    """Gini impurity, or entropy, of n rows with p positive ones, times n."""
    q = n - p
    part = lambda a: F.when(a > 0, -a * F.log2(a / n)).otherwise(0.0)
    return F.when(n == 0, 0.0).otherwise(F.when(F.col("entropy"), part(p) + part(q)).otherwise(F.lit(2.0) * p * q / n))


def _may_split(n: Column, p: Column, level: int) -> Column:
    """Whether a split can lower a node's impurity and leave enough rows on each side."""
    return (p > 0) & (p < n) & (n >= 2 * F.col("least")) & (F.col("depth") > level)


def _tried(keys: list[str], node: Column, subset: int | None) -> Column:
    """The ``subset`` features tried in a node, chosen by a hash of keys and node; null: all."""
    if subset is None:
        return F.lit(None).cast("array<int>")
    every = F.filter(F.sequence(F.lit(0), F.col("size")), lambda f: f < F.col("size"))
    luck = F.transform(every, lambda f: F.struct(F.xxhash64(*[F.col(k) for k in keys], node, f).alias("luck"), f.alias("f")))
    return F.transform(F.slice(F.array_sort(luck), 1, subset), lambda e: e["f"])


def best_splits(rows: DataFrame, keys: list[str], subset: int | None) -> DataFrame:
    """keys, limits, node, n, p, feature, bin, ln, lp: the split of each node that lowers impurity most, with the rows and the positive
    ones in the node and on the left; ties to the first feature, then bin. Features are those in ``tried`` if there is a ``subset``, else all.
    """
    node = [*keys, *_TREE, *_NODE]
    if subset is None:
        pairs = F.transform("x", lambda b, f: F.struct(f.alias("feature"), b.alias("bin")))
    else:
        pairs = F.transform("tried", lambda f: F.struct(f.alias("feature"), F.get("x", f).alias("bin")))
    entries = rows.select(*node, "y", "w", F.explode(pairs).alias("e")).select(*node, "y", "w", "e.*")
    cells_ = entries.groupBy(*node, "feature", "bin").agg(F.sum("w").alias("bn"), F.sum(F.col("w") * F.col("y")).alias("bp"))
    upto = Window.partitionBy(*node, "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = cells_.select(
        *node, "feature", "bin", F.sum("bn").over(upto).alias("ln"), F.sum("bp").over(upto).alias("lp")
    ).filter((F.col("ln") >= F.col("least")) & (F.col("n") - F.col("ln") >= F.col("least")))
    n, p, ln, lp = (F.col(c) for c in ("n", "p", "ln", "lp"))
    gain = F.round(_impurity(n, p) - _impurity(ln, lp) - _impurity(n - ln, p - lp), 9)
    order = F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "ln", "lp")
    best = sums.groupBy(*node).agg(F.max(order).alias("best")).filter("best.gain > 0")
    return best.select(*node, (-F.col("best.f")).alias("feature"), (-F.col("best.b")).alias("bin"), "best.ln", "best.lp")


def grow(rows: DataFrame, keys: list[str], subset: int | None = None) -> Model:
    """One tree per combination of ``keys``.

    ``rows`` hold the keys, x (array of bins, as many in all rows of a tree, none null), y (0 or 1), w (weight, a whole number; 0: the
    row does not count) and the tree's limits: depth, least (rows on each side of a split) and entropy (else Gini). Keys must not be
    null. A tree whose rows are alike is one leaf; keys without rows have no tree.

    A split tells how many rows, and positive ones, go to either side. So rows go on only to nodes that can be split again, and the
    features tried in a node are chosen once per node, not once per row.
    """
    state = cut(rows.filter("w > 0").select(*keys, "x", "y", "w", "depth", "least", "entropy"))
    sums = [F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("p"), F.max(F.size("x")).alias("size")]
    roots = cut(state.groupBy(*keys, "depth", "least", "entropy").agg(*sums).withColumn("node", F.lit(1).cast("long")))
    nodes, found = [roots.select(*keys, *_NODE)], []
    live = roots.filter(_may_split(F.col("n"), F.col("p"), 0))
    live = cut(live.select(*keys, "size", *_NODE, _tried(keys, F.col("node"), subset).alias("tried")))
    state = cut(join_small(state, live, keys, salts=1))
    while True:
        level = len(found) + 1
        node, n, p, ln, lp = (F.col(c) for c in (*_NODE, "ln", "lp"))
        sides = []
        for number, m, q in ((2 * node, ln, lp), (2 * node + 1, n - ln, p - lp)):
            tried, may = _tried(keys, number, subset), _may_split(m, q, level)
            sides.append(F.struct(number.alias("node"), m.alias("n"), q.alias("p"), may.alias("_live"), F.when(may, tried).alias("tried")))
        splits = cut(best_splits(state, keys, subset).select(*keys, "node", "feature", "bin", F.array(*sides).alias("_sides")))
        if splits.isEmpty():
            break
        found.append(splits.select(*keys, "node", "feature", "bin"))
        nodes.append(splits.select(*keys, F.explode("_sides").alias("_to")).select(*keys, *[f"_to.{c}" for c in _NODE]))
        open_ = splits.filter(F.exists("_sides", lambda to: to["_live"]))
        to = F.get("_sides", (F.get("x", "feature") > F.col("bin")).cast("int"))
        moved = join_small(state.drop("n", "p", "tried"), open_, [*keys, "node"], salts=1).withColumn("_to", to).filter("_to._live")
        state = cut(moved.select(*keys, "x", "y", "w", *_TREE, *[f"_to.{c}" for c in (*_NODE, "tried")]))
    every, all_nodes = splits.select(*keys, "node", "feature", "bin"), nodes[0]
    for more in found:
        every = every.union(more)
    for more in nodes[1:]:
        all_nodes = all_nodes.union(more)
    # most nodes are leaves: both sides may be long
    leaves = cut(all_nodes.join(every.hint("merge"), [*keys, "node"], "left_anti").select(*keys, "node", "n", "p"))
    return Model(every, leaves, keys, len(found))


def route(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with n and p of the leaf each lies in. Rows whose keys have no tree are left out.

    A tree travels as a map from node to split; its size is bounded by the rows it was grown from.
    """
    split = F.struct("node", F.struct("feature", "bin").alias("s"))
    maps = model.splits.groupBy(*model.keys).agg(F.map_from_entries(F.collect_list(split)).alias("_splits"))

    def step(node: Column, _: Column) -> Column:
        s = F.try_element_at("_splits", node)
        return F.when(s.isNull(), node).otherwise(2 * node + (F.get("x", s["feature"]) > s["bin"]).cast("int"))

    levels = F.sequence(F.lit(1), F.lit(max(1, model.depth)))
    # files tell little about the size of maps: they are broadcast if the splits in them are few
    maps = F.broadcast(maps) if fits(model.splits) else maps.hint("merge")
    placed = rows.join(maps, model.keys, "left").withColumn("node", F.aggregate(levels, F.lit(1).cast("long"), step))
    return join_small(placed, model.leaves, [*model.keys, "node"], salts=1).drop("_splits", "node")


def save(model: Model, path: str) -> None:
    """Both tables as Parquet; keys and depth are read off them again."""
    model.splits.write.parquet(path + "/splits")
    model.leaves.write.parquet(path + "/leaves")


def load(spark: SparkSession, path: str) -> Model:
    splits, leaves = spark.read.parquet(path + "/splits"), spark.read.parquet(path + "/leaves")
    deepest = splits.agg(F.max(F.length(F.bin("node")))).first()[0]
    return Model(splits, leaves, [c for c in leaves.columns if c not in ("node", "n", "p")], deepest or 0)


def vote(routed: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and ``positive``: whether the mean share of positive rows over the leaves of all trees exceeds a half."""
    return routed.groupBy(*by).agg((F.avg(F.col("p") / F.col("n")) > 0.5).alias("positive"))


def grid_points(rows: DataFrame, depths: list[int], leasts: list[int], entropies: list[bool]) -> DataFrame:
    """Rows once per combination, numbered as ``point``."""
    points = [(d, m, e) for d in depths for m in leasts for e in entropies]
    all_ = F.array(*[
        F.struct(F.lit(i).alias("point"), F.lit(d).alias("depth"), F.lit(m).alias("least"), F.lit(e).alias("entropy"))
        for i, (d, m, e) in enumerate(points)
    ])
    return rows.withColumn("_point", F.explode(all_)).select(*rows.columns, "_point.*")


def cross_validated(rows: DataFrame, keys: list[str], row: list[str], folds: int, counts: dict[str, Column]) -> DataFrame:
    """Counts tp, tn, fp, fn per keys and fold: each fold is held out once. ``counts`` maps names to columns over ``hit`` and ``y``.

    Folds are dealt by a hash of the ``row`` columns. All folds, points and stations grow side by side.
    """
    fold = F.pmod(F.xxhash64(F.lit(5), *[F.col(c) for c in row]), F.lit(folds)).cast("int")
    dealt = rows.withColumn("_own", fold).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    dealt = dealt.withColumn("w", F.when(F.col("_own") == F.col("fold"), 0).otherwise(F.col("w")))
    model = grow(dealt, [*keys, "fold"])
    held = route(dealt.filter("_own = fold"), model).withColumn("hit", 2 * F.col("p") > F.col("n"))
    return held.groupBy(*keys, "fold").agg(*[c.alias(n) for n, c in counts.items()])
