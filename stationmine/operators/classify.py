"""Rules as a classifier of the last slot of held-out sequences.

A sequence and a rule meet through atoms ``back|state|distance``, where ``back`` counts
slots before the one to predict.  A rule matches when all atoms of its antecedent are in
the sequence.  Atoms of antecedents are numbered, so a sequence and an antecedent are a few
longs each and containment is a bit test.  Each antecedent is keyed by its rarest atom only,
and a sequence is repeated for those of its atoms that are such a key, so a pair of sequence
and antecedent is looked at once at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationmine.functions.columns import pattern_key, ratio
from stationmine.operators.patterns import rank_rules
from stationmine.params import check_target
from stationmine.scale import cut, join_small, spread

ID = ["win", "center"]
#: Bits of a mask used; the sign is left alone.
WORD = 63


def target_rules(rules: DataFrame, target: str, conf: float = 0.0, sup: int = 0) -> DataFrame:
    """Rules whose last slot holds only target items of the centre, filtered by conf and sup."""
    check_target(target)
    last = F.element_at("sequence", -1)
    aims = F.forall(last, lambda i: i.contains("_0") & i.contains(target))
    return rules.filter(aims & (F.col("conf") >= conf) & (F.col("sup") >= sup))


def label_sequences(sequences: DataFrame, target: str, window_size: int = 3) -> DataFrame:
    """Full-length sequences with ``y_true``: the target if the centre shows it in the last slot."""
    check_target(target)
    hit = F.exists(F.element_at("sequence", -1), lambda i: i.rlike(f"{target}_T._0"))
    return sequences.filter(F.size("sequence") == window_size).withColumn(
        "y_true", F.when(hit, F.lit(target)).otherwise(F.lit("Normal"))
    )


def _atoms(body: Column, prefix: bool = False) -> Column:
    """Distinct atoms of the slots before the label; the time index is ignored."""

    def per_slot(slot, i):
        back = F.size(body) - i

        def per_item(item):
            parts = F.split(item, "_")
            if not prefix:
                return F.array(F.concat_ws("|", back, parts[0], parts[2]))
            ends = F.sequence(F.lit(1), F.length(parts[2]))
            return F.transform(
                ends, lambda n: F.concat_ws("|", back, parts[0], F.substring(parts[2], F.lit(1), n))
            )

        return F.flatten(F.transform(slot, per_item))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(body, per_slot))))


def _body(sequence: str = "sequence") -> Column:
    return F.slice(sequence, F.lit(1), F.size(sequence) - 1)


def _dictionary(antecedents: DataFrame) -> list[str]:
    """The distinct atoms of ``needed``: as many as frequent items times slots, whatever the number of rules or sequences."""
    return sorted(r["atom"] for r in antecedents.select(F.explode("needed").alias("atom")).distinct().collect())


def _words(known: list[str]) -> list[str]:
    return [f"m{w}" for w in range(-(-len(known) // WORD))]


def _masks(atoms: Column, known: list[str]) -> list[Column]:
    """Columns m0, m1, ...: bit i % WORD of word i // WORD stands for the i-th known atom; other atoms have no bit."""
    masks = []
    for w, name in enumerate(_words(known)):
        here = F.array(*[F.lit(a) for a in known[w * WORD : (w + 1) * WORD]])
        bits = F.filter(F.transform(atoms, lambda a: F.array_position(here, a)), lambda p: p > 0)  # noqa: B023
        bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), (p - 1).cast("int"))
        masks.append(F.aggregate(bits, F.lit(0).cast("long"), lambda m, p: m.bitwiseOR(bit(p))).alias(name))
    return masks


def _bits(among: list[int]) -> Column:
    """Those numbers ``among`` whose bit is set in the masks."""
    found = [F.array().cast("array<int>")]
    for w in sorted({i // WORD for i in among}):
        here = F.array(*[F.lit(i % WORD) for i in among if i // WORD == w])
        word = F.col(f"m{w}")
        is_set = lambda i: F.call_function("shiftright", word, i).bitwiseAND(F.lit(1).cast("long")) == 1  # noqa: B023, E731
        found.append(F.transform(F.filter(here, is_set), lambda i: i + F.lit(w * WORD)))  # noqa: B023
    return F.concat(*found)


def _with_pivot(antecedents: DataFrame, masked: DataFrame, known: list[str]) -> DataFrame:
    """Antecedents with ``pivot``, the atom that is in fewest sequences; those without atoms match nothing and go."""
    everything = list(range(len(known)))
    counts = masked.select(F.explode(_bits(everything)).alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()
    often = {r["i"]: r["n"] for r in counts}
    rarest = sorted(everything, key=lambda i: (often.get(i, 0), known[i]))
    bits = _bits(everything)
    place = F.array(*[F.lit(rarest.index(i)) for i in everything]) if known else F.array().cast("array<int>")
    first = F.array_min(F.transform(bits, lambda i: F.struct(F.get(place, i).alias("place"), i.alias("i"))))
    return antecedents.withColumn("pivot", first["i"]).filter(F.col("pivot").isNotNull())


def _meet(masked: DataFrame, antecedents: DataFrame, known: list[str], how: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Sequences joined with the antecedents they contain, over those of their atoms that are a pivot."""
    pivots = sorted(r["pivot"] for r in antecedents.select("pivot").distinct().collect())
    exploded = masked.withColumn("pivot", F.explode_outer(_bits(pivots)))
    needed = antecedents
    contained = F.lit(True)
    for m in _words(known):
        needed = needed.withColumnRenamed(m, f"needed_{m}")
        contained &= F.col(f"l.{m}").bitwiseAND(F.col(f"r.needed_{m}")) == F.col(f"r.needed_{m}")
    return join_small(exploded, needed, [*by, "pivot"], how, condition=contained)


def _votes(
    labelled: DataFrame, rules: DataFrame, weights: dict[str, Column], prefix: bool, by: tuple[str, ...], how: str
) -> DataFrame:
    """Sequences joined with distinct antecedents and their summed ``weights``.

    Rules that differ only in consequent or time index share an antecedent, and each
    of them is a vote, so votes are added up here.  ``prefix=True`` lets distance 1 of a rule also stand for 10 to 19.
    """
    voters = cut(rules.select(*by, _atoms(_body()).alias("needed"), *[w.alias(name) for name, w in weights.items()]))
    known = _dictionary(voters)
    # written once, since atoms are counted and then joined, and spread by sequence, since each is repeated
    masked = cut(spread(labelled.select(*by, *ID, "y_true", *_masks(_atoms(_body(), prefix), known)), *by, *ID))
    distinct = voters.select(*by, *weights, *_masks(F.col("needed"), known)).groupBy(*by, *_words(known)).agg(
        *[F.sum(name).alias(name) for name in weights]
    )
    return _meet(masked, cut(_with_pivot(distinct, masked, known)), known, how, by)


def rule_matches(labelled: DataFrame, rules: DataFrame, prefix: bool = False) -> DataFrame:
    """(win, center, votes): number of rules that match, for sequences with at least one."""
    met = _votes(labelled, rules, {"weight": F.lit(1)}, prefix, (), "inner")
    return met.groupBy(*ID).agg(F.sum("weight").alias("votes"))


def count_votes(
    labelled: DataFrame, rules: DataFrame, weights: dict[str, Column], prefix: bool = False, by: tuple[str, ...] = ()
) -> DataFrame:
    """Each sequence with the sum of each weight over the rules it matches, zero included. Sequences meet the rules of their own ``by``."""
    return (
        _votes(labelled, rules, weights, prefix, by, "left")
        .groupBy(*by, *ID, "y_true")
        .agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in weights])
    )


def predict(labelled: DataFrame, rules: DataFrame, target: str, k: int = 1, prefix: bool = False) -> DataFrame:
    """(win, center, y_pred, y_true): the target when at least ``k`` rules match."""
    votes = count_votes(labelled, rules, {"votes": F.lit(1)}, prefix)
    y_pred = F.when(F.col("votes") >= k, F.lit(target)).otherwise(F.lit("Normal"))
    return votes.select(*ID, y_pred.alias("y_pred"), "y_true")


def _cells(pred: Column, true: Column) -> dict[str, Column]:
    return {
        "tp": F.count_if(pred & true),
        "tn": F.count_if(~pred & ~true),
        "fp": F.count_if(pred & ~true),
        "fn": F.count_if(~pred & true),
    }


def confusion(predictions: DataFrame, target: str, by: tuple = ()) -> DataFrame:
    """Counts tp, tn, fp, fn, per ``by`` if given."""
    cells = _cells(F.col("y_pred") == target, F.col("y_true") == target)
    return predictions.groupBy(*by).agg(*[c.alias(n) for n, c in cells.items()])


def metrics(conf: DataFrame) -> DataFrame:
    """Add accuracy, precision, recall and f1; null where undefined."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    p, r = F.col("precision"), F.col("recall")
    return (
        conf.withColumn("accuracy", ratio(tp + tn, tp + tn + fp + fn))
        .withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn("f1", ratio(2 * p * r, p + r))
    )


def explain_matches(labelled: DataFrame, rules: DataFrame, k: int = 1) -> DataFrame:
    """For each sequence with ``k`` matches: the k-th matching rule by rank, and the slots it matched.

    Ranks alone are matched; rules and slots are joined to the one rank that is kept.
    """
    found = cut(labelled.select(*ID, "sequence"))
    ranked = cut(
        rank_rules(rules).select("key", "rank", (F.size("sequence") - 1).alias("length"), _atoms(_body()).alias("needed"))
    )
    known = _dictionary(ranked)
    masked = cut(spread(found.select(*ID, *_masks(_atoms(_body()), known)), *ID))
    keyed = cut(_with_pivot(ranked.select("rank", *_masks(F.col("needed"), known)), masked, known))
    order = F.row_number().over(Window.partitionBy(*ID).orderBy("rank"))
    kept = (
        _meet(masked, keyed, known, "inner").select(*ID, "rank")
        .withColumn("nth", order)
        .filter(F.col("nth") == k)
        .drop("nth")
    )
    body = _body()
    return join_small(kept, ranked.drop("needed"), ["rank"]).join(found, ID).select(
        *ID, "key", pattern_key(F.slice(body, -F.col("length"), F.col("length"))).alias("matched")
    )


def persistence_rule(spark: SparkSession, target: str) -> DataFrame:
    """The one-row baseline: the target at T0 predicts the target at T1."""
    check_target(target)
    return spark.range(1).select(
        F.array(F.array(F.lit(f"{target}_T0_0")), F.array(F.lit(f"{target}_T1_0"))).alias("sequence"),
        F.lit(f"{target}_T0_0-{target}_T1_0").alias("key"),
        F.lit(0.0).alias("conf"),
        F.lit(0).cast("long").alias("sup"),
    )


def evaluate_grid(
    labelled: DataFrame,
    rules: DataFrame,
    target: str,
    confs: list[float],
    ks: list[int],
    tags: dict | None = None,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """One metrics row per ``by``, confidence and match threshold, from one pass over the sequences.

    Votes of all confidence thresholds are summed side by side.  A threshold with no
    rules, or with fewer rules than ``k``, yields no row.
    """
    rules = target_rules(rules, target)
    names = {f"v{i}": c for i, c in enumerate(confs)}
    weights = {v: (F.col("conf") >= c).cast("int") for v, c in names.items()}
    votes = count_votes(labelled, rules, weights, by=by)
    true = F.col("y_true") == target
    rows = []
    for v, c in names.items():
        for k in ks:
            cells = _cells(F.col(v) >= k, true)
            rows.append(
                F.struct(
                    F.lit(float(c)).alias("confidence_threshold"),
                    F.lit(k).alias("match_threshold"),
                    *[x.alias(n) for n, x in cells.items()],
                )
            )
    spelled = lambda df: df.select(*by, F.explode("rows").alias("row")).select(*by, "row.*")
    grid = spelled(votes.groupBy(*by).agg(F.array(*rows).alias("rows")))
    counts = spelled(rules.groupBy(*by).agg(
        F.array(
            *[
                F.struct(F.lit(float(c)).alias("confidence_threshold"), F.sum(weights[v]).alias("n_rules"))
                for v, c in names.items()
            ]
        ).alias("rows")
    ))
    scored = metrics(grid.join(counts, [*by, "confidence_threshold"])).filter(
        (F.col("n_rules") > 0) & (F.col("n_rules") >= F.col("match_threshold"))
    )
    for name, value in (tags or {}).items():
        scored = scored.withColumn(name, F.lit(value))
    return scored
