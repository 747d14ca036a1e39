"""Patterns and rules against enumeration on small random sequences."""

import math
import random
from itertools import combinations

import numpy as np
import pytest

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from stationmine.operators import mining
from stationmine.operators import patterns as pt
from stationmine.sources.readers import read_rules_text
from stationmine.sources.sinks import rules_to_line, write_rules_text
from tests.conftest import tuples


def random_sequences(seed, n=60):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        seq = []
        for t in range(3):
            pool = [f"{s}_T{t}_{d}" for s in ("Full", "AlmostFull") for d in (0, 1, 2)]
            items = [i for i in pool if rng.random() < 0.4]
            if items:
                seq.append(items)
        if seq:
            out.append(seq)
    return out


def enumerate_patterns(seqs, support, max_items):
    """A label names its slot, so a pattern is a set of labels."""
    need = math.ceil(support * len(seqs))
    counts = {}
    for seq in seqs:
        items = [(k, i) for k, slot in enumerate(seq) for i in sorted(slot)]
        for n in range(1, max_items + 1):
            for combo in combinations(items, n):
                slots = {}
                for k, i in combo:
                    slots.setdefault(k, []).append(i)
                key = "-".join(",".join(sorted(v)) for _, v in sorted(slots.items()))
                counts[key] = counts.get(key, 0) + 1
    return {k: c for k, c in counts.items() if c >= need}


@pytest.fixture(scope="module")
def mined(spark):
    seqs = random_sequences(5)
    df = spark.createDataFrame([(s,) for s in seqs], "sequence array<array<string>>")
    return seqs, pt.frequent_patterns(df, 0.1, 3)


def held(seq, pattern):
    """Whether the pattern's slots lie in slots of the sequence, in order."""
    at = 0
    for slot in pattern:
        while at < len(seq) and not set(slot) <= set(seq[at]):
            at += 1
        if at == len(seq):
            return False
        at += 1
    return True


def grow_plainly(seqs, need, max_items):
    """Patterns over items that may recur in several slots, by growing and counting each one apart."""
    items = sorted({i for s in seqs for slot in s for i in slot})
    level, out = [((i,),) for i in items], {}
    for _ in range(max_items):
        counts = {p: sum(held(s, p) for s in seqs) for p in level}
        level = [p for p, c in counts.items() if c >= need]
        out |= {p: counts[p] for p in level}
        level = [p + ((i,),) for p in level for i in items] + [p[:-1] + (p[-1] + (i,),) for p in level for i in items if i > p[-1][-1]]
    return out


@pytest.mark.parametrize("seed,block", [(1, 256), (2, 2)])
def test_items_that_recur_in_later_slots(spark, monkeypatch, seed, block):
    monkeypatch.setattr(mining, "BLOCK", block)
    monkeypatch.setattr(mining, "BLOCKS", 3)
    monkeypatch.setattr(mining, "CHUNK_BYTES", 100)
    rng = random.Random(seed)
    seqs = [[[i for i in "abcd" if rng.random() < 0.4] for _ in range(rng.randrange(5))] for _ in range(90)]
    seqs += seqs[:7] * 40 + [[["a", "a"], ["b"]]] * 3
    df = spark.createDataFrame([(s,) for s in seqs] + [(None,)], "sequence array<array<string>>")
    got = {tuple(map(tuple, r["sequence"])): r["freq"] for r in mining.mine(df, 0.2, 4).collect()}
    assert got == grow_plainly(seqs, math.ceil(0.2 * len(seqs)), 4)


def test_sets_are_mined_side_by_side(spark):
    groups = {k: random_sequences(k, 40 + 20 * k) for k in (1, 2, 3)}
    df = spark.createDataFrame([(k, s) for k, seqs in groups.items() for s in seqs], "tag int, sequence array<array<string>>")
    found = pt.named(mining.mine(df, 0.15, 3, F.col("tag"))).collect()
    for k, seqs in groups.items():
        assert {r["key"]: r["freq"] for r in found if r["tag"] == k} == enumerate_patterns(seqs, 0.15, 3)


def test_nothing_to_mine(spark):
    empty = spark.createDataFrame([], "sequence array<array<string>>")
    assert mining.mine(empty, 0.1).count() == 0
    rare = spark.createDataFrame([([[str(i)]],) for i in range(20)] + [([],)], "sequence array<array<string>>")
    assert mining.mine(rare, 0.5).count() == 0


def test_patterns_stay_off_the_driver(spark, monkeypatch):
    """Only totals and frequent items are collected."""
    df = spark.createDataFrame([(s,) for s in random_sequences(4)], "sequence array<array<string>>")
    seen, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda d: seen.append(d.columns) or collect(d))
    mining.mine(df, 0.1, 4)
    assert seen == [["key", "n"], ["key", "item", "n"]]


def is_focal(key):
    return any(i.endswith("_T0_0") for slot in key.split("-") for i in slot.split(","))


def plain_rules(found):
    focal = {k: v for k, v in found.items() if is_focal(k)}
    return {k: (v / focal[k.rpartition("-")[0]], v) for k, v in focal.items() if "-" in k}


def test_patterns_match_enumeration(mined):
    seqs, patterns = mined
    assert dict(tuples(patterns, "key", "freq")) == enumerate_patterns(seqs, 0.1, 3)


def test_rules_and_confidence(mined):
    seqs, patterns = mined
    got = {r.key: (r.conf, r.sup) for r in pt.rules(patterns).collect()}
    assert got == plain_rules(enumerate_patterns(seqs, 0.1, 3))
    assert all(0 < c <= 1 for c, _ in got.values())


@pytest.mark.parametrize("by,order", [("conf", (0, 1)), ("sup", (1, 0))])
def test_ranking(mined, by, order):
    seqs, patterns = mined
    want = plain_rules(enumerate_patterns(seqs, 0.1, 3))
    want = sorted(want, key=lambda k: (-want[k][order[0]], -want[k][order[1]], k))
    got = pt.rank_rules(pt.rules(patterns), by).orderBy("rank").collect()
    assert [r.key for r in got] == want
    assert [r["rank"] for r in got] == list(range(1, len(want) + 1))


def test_statistics(mined):
    seqs, patterns = mined
    rules = plain_rules(enumerate_patterns(seqs, 0.1, 3))
    items = {k: len(k.replace("-", ",").split(",")) for k in rules}
    total = sum(s for _, s in rules.values())
    row = pt.pattern_stats(patterns).first()
    assert (row.n_patterns, row.min_items, row.max_items) == (len(rules), min(items.values()), max(items.values()))
    assert row.mean_items == pytest.approx(sum(items[k] * s for k, (_, s) in rules.items()) / total)
    assert row.mean_slots == pytest.approx(sum(len(k.split("-")) * s for k, (_, s) in rules.items()) / total)
    assert row.n_repeated == 0


def test_selections(mined):
    seqs, patterns = mined
    rules = pt.rules(patterns)
    keys = set(plain_rules(enumerate_patterns(seqs, 0.1, 3)))
    flat = {k: k.replace("-", ",").split(",") for k in keys}
    mixed = {k for k, i in flat.items() if any(x[0] == "F" for x in i) and any(x[0] == "A" for x in i)}
    assert {r.key for r in pt.mixed_state(rules, "Full-AlmostFull").collect()} == mixed

    def reaches(k, least):
        return "T0_0" in k.split("-")[0] and any(
            len(s.split(",")) >= least and any(not i.endswith("_0") for i in s.split(",")) for s in k.split("-")[1:]
        )

    assert {r.key for r in pt.influence(rules).collect()} == {k for k in keys if reaches(k, 2)}
    assert {r.key for r in pt.influence(rules, single=True).collect()} == {k for k in keys if reaches(k, 1)}


def test_histogram_and_curve(mined):
    seqs, patterns = mined
    rules = pt.rules(patterns)
    confs = [c for c, _ in plain_rules(enumerate_patterns(seqs, 0.1, 3)).values()]
    hist = dict(tuples(pt.conf_hist(rules, whole=True), "bucket", "n_rules"))
    assert hist == {b: sum(min(int(c * 10), 9) == b for c in confs) for b in range(10)}
    hist = [n for _, n in tuples(pt.conf_hist(rules), "bucket", "n_rules")]
    assert hist == np.histogram([round(c, 2) for c in confs], 10)[0].tolist()
    assert sum(n for _, n in tuples(pt.conf_hist(rules.limit(1)), "bucket", "n_rules")) == 1
    assert pt.conf_hist(rules.limit(0)).count() == 0
    curve = tuples(pt.conf_curve(rules, 0.5), "threshold", "n_rules")
    assert curve == [(t, sum(c >= t for c in confs)) for t in (0.5, 0.6, 0.7, 0.8, 0.9)]


def test_support_sweep(spark):
    seqs = random_sequences(8, 40)
    df = spark.createDataFrame([(s,) for s in seqs], "sequence array<array<string>>")
    got = tuples(pt.support_sweep(df, [0.2, 0.3, 0.99], 2), "support", "n_patterns")
    assert got == [(s, len(enumerate_patterns(seqs, s, 2))) for s in (0.2, 0.3, 0.99)]


def test_repeated_items_are_counted(spark):
    rows = [([["A_T0_0", "A_T0_0"], ["B_T1_0"]], 4), ([["A_T0_0"], ["B_T1_0"]], 5)]
    df = spark.createDataFrame(rows, "sequence array<array<string>>, freq long")
    assert pt.pattern_stats(df).first().n_repeated == 1


def test_rule_text_round_trip(spark, mined, tmp_path):
    _, patterns = mined
    rules = pt.rules(patterns)
    path = str(tmp_path / "rules")
    write_rules_text(rules, path)
    assert tuples(read_rules_text(spark, path), "key", "sequence", "conf", "sup") == tuples(
        rules, "key", "sequence", "conf", "sup"
    )
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines[:2] == ["Pattern, Confidence-Frequence", f"Total number of input patterns: {rules.count()}"]
    order = [r.line for r in rules_to_line(pt.rank_rules(rules)).collect()]
    assert sorted(lines[2:]) == sorted(order)
    confs = [float(x.split("['")[-1].split(" - ")[0]) for x in lines[2:]]
    assert confs == sorted(confs, reverse=True)


def test_rule_line_shape(spark):
    df = spark.createDataFrame(
        [([["A_T0_0"], ["B_T1_0", "C_T1_0"]], "k", 0.5, 12)],
        "sequence array<array<string>>, key string, conf double, sup long",
    )
    assert rules_to_line(df).first().line == "[[[['A_T0_0'], ['B_T1_0,C_T1_0']]], ['0.5 - 12']]"


def test_small_confidences_are_read(spark, tmp_path):
    path = tmp_path / "r.txt"
    path.write_text("Pattern, Confidence-Frequence\nTotal\n[[[['A_T0_0'], ['B_T1_0']]], ['1e-05 - 12']]\n")
    assert tuples(read_rules_text(spark, str(path)), "conf", "sup") == [(1e-05, 12)]


def test_mining_leaves_the_session_fit_for_forests(spark):
    """Spark's forests serialize their session with the model, which fails once it has observed anything."""
    session = spark.newSession()
    seqs = session.createDataFrame([([["a"], ["b"]],), ([["a"], ["b"]],)], "sequence array<array<string>>")
    assert mining.mine(seqs, 0.5).count() == 3
    rows = session.createDataFrame([(float(i), float(i > 3)) for i in range(8)], "v double, label double")
    rows = rows.select(array_to_vector(F.array("v")).alias("features"), "label")
    model = RandomForestClassifier(numTrees=2, seed=1).fit(rows)
    assert len(model.transform(rows).select("prediction").collect()) == 8
