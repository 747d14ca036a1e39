"""Rule scoring against nested loops."""

import random

import pytest

from stationmine.operators import classify as cl
from tests.conftest import tuples

TARGET = "AlmostFull"


def label(rng, t):
    return f"{rng.choice(['AlmostFull', 'Normal', 'Increase'])}_T{t}_{rng.choice([0, 1, 2, 12])}"


def random_case(seed, n_seq=80, n_rules=40):
    rng = random.Random(seed)
    seqs = []
    for i in range(n_seq):
        size = rng.choice([1, 2, 3, 3, 3])
        seqs.append((i, i % 7, [sorted({label(rng, t) for _ in range(rng.randint(1, 4))}) for t in range(size)]))
    rules, keys = [], set()
    while len(rules) < n_rules:
        body = [sorted({label(rng, t) for _ in range(rng.randint(1, 2))}) for t in range(rng.choice([1, 1, 2, 3]))]
        seq = body + [[f"{TARGET}_T{len(body)}_0"]]
        key = "-".join(",".join(s) for s in seq)
        if key not in keys:
            keys.add(key)
            rules.append((seq, key, round(rng.random(), 3), rng.randint(1, 50)))
    return seqs, rules


def frames(spark, seqs, rules):
    return (
        cl.label_sequences(
            spark.createDataFrame(seqs, "win long, center long, sequence array<array<string>>"), TARGET
        ),
        spark.createDataFrame(rules, "sequence array<array<string>>, key string, conf double, sup long"),
    )


def parts(item):
    state, _, dist = item.split("_")
    return state, dist


def matches(seq, rule, prefix=False):
    body, need = seq[:-1], rule[:-1]
    if len(need) > len(body):
        return False

    def has(slot, item):
        state, dist = parts(item)
        return any(s == state and (d.startswith(dist) if prefix else d == dist) for s, d in map(parts, slot))

    return all(has(slot, i) for slot, items in zip(body[len(body) - len(need):], need) for i in items)


@pytest.mark.parametrize("seed,prefix", [(1, False), (2, False), (3, True)])
def test_votes_match_nested_loops(spark, seed, prefix):
    seqs, rules = random_case(seed)
    labelled, rule_df = frames(spark, seqs, rules)
    want = {
        (w, c): n
        for w, c, s in seqs
        if len(s) == 3 and (n := sum(matches(s, r[0], prefix) for r in rules))
    }
    got = {(w, c): v for w, c, v in tuples(cl.rule_matches(labelled, rule_df, prefix), "win", "center", "votes")}
    assert got == want and want


def test_masks_of_several_words(spark, monkeypatch):
    monkeypatch.setattr(cl, "WORD", 5)
    seqs, rules = random_case(7)
    labelled, rule_df = frames(spark, seqs, rules)
    want = {(w, c): n for w, c, s in seqs if len(s) == 3 and (n := sum(matches(s, r[0]) for r in rules))}
    got = {(w, c): v for w, c, v in tuples(cl.rule_matches(labelled, rule_df), "win", "center", "votes")}
    assert got == want and want


def test_no_text_is_exchanged_for_votes(spark):
    labelled, rule_df = frames(spark, *random_case(8))
    plan = cl.rule_matches(labelled, rule_df)._jdf.queryExecution().executedPlan().toString()
    assert "array" not in plan[: plan.index("BroadcastExchange")].split("Scan")[-1] and "ReadSchema: struct<win:bigint,center:bigint,m0:bigint>" in plan


@pytest.mark.parametrize("k", [1, 3])
def test_predictions_and_log(spark, k):
    seqs, rules = random_case(4)
    labelled, rule_df = frames(spark, seqs, rules)
    best = sorted(rules, key=lambda r: (-r[2], -r[3], r[1]))
    preds, log = [], []
    for w, c, s in seqs:
        if len(s) != 3:
            continue
        hits = [r for r in best if matches(s, r[0])]
        true = TARGET if any(i.startswith(TARGET) and i.endswith("_0") for i in s[-1]) else "Normal"
        preds.append((w, c, TARGET if len(hits) >= k else "Normal", true))
        if len(hits) >= k:
            rule = hits[k - 1]
            n = len(rule[0]) - 1
            log.append((w, c, rule[1], "-".join(",".join(x) for x in s[:-1][2 - n:])))
    pred_df = cl.predict(labelled, rule_df, TARGET, k)
    assert tuples(pred_df, "win", "center", "y_pred", "y_true") == sorted(preds)
    assert tuples(cl.explain_matches(labelled, rule_df, k), "win", "center", "key", "matched") == sorted(log)
    row = cl.metrics(cl.confusion(pred_df, TARGET)).first()
    tp = sum(p == t == TARGET for *_, p, t in preds)
    fp = sum(p == TARGET != t for *_, p, t in preds)
    fn = sum(t == TARGET != p for *_, p, t in preds)
    assert (row.tp, row.fp, row.fn, row.tn) == (tp, fp, fn, len(preds) - tp - fp - fn)
    assert row.precision == pytest.approx(tp / (tp + fp)) and row.recall == pytest.approx(tp / (tp + fn))


def test_rules_that_differ_in_time_only_are_two_votes(spark):
    seqs = [(0, 0, [["AlmostFull_T0_0"], ["Normal_T1_1"], ["Normal_T2_0"]])]
    rules = [
        ([["Normal_T0_1"], ["AlmostFull_T1_0"]], "a", 0.5, 1),
        ([["Normal_T1_1"], ["AlmostFull_T2_0"]], "b", 0.5, 1),
    ]
    assert tuples(cl.rule_matches(*frames(spark, seqs, rules)), "votes") == [(2,)]


def test_grid_equals_single_runs(spark):
    seqs, rules = random_case(6)
    labelled, rule_df = frames(spark, seqs, rules)
    grid = cl.evaluate_grid(labelled, rule_df, TARGET, [0.2, 0.6, 0.99], [1, 3], {"extraction": "x"}).collect()
    assert {r.extraction for r in grid} == {"x"}
    seen = set()
    for r in grid:
        chosen = cl.target_rules(rule_df, TARGET, r.confidence_threshold)
        single = cl.confusion(cl.predict(labelled, chosen, TARGET, r.match_threshold), TARGET).first()
        assert (r.tp, r.tn, r.fp, r.fn) == (single.tp, single.tn, single.fp, single.fn)
        seen.add((r.confidence_threshold, r.match_threshold))
    for c in (0.2, 0.6, 0.99):
        n = sum(x[2] >= c for x in rules)
        assert {(c, k) for k in (1, 3) if n >= k} == {x for x in seen if x[0] == c}


def test_no_rules_and_one_class(spark):
    seqs = [(0, 0, [["Normal_T0_0"], ["Normal_T1_0"], ["Normal_T2_0"]])]
    labelled, rule_df = frames(spark, seqs, random_case(1)[1])
    none = cl.target_rules(rule_df, TARGET, conf=2.0)
    row = cl.metrics(cl.confusion(cl.predict(labelled, none, TARGET), TARGET)).first()
    assert (row.tp, row.tn, row.fp, row.fn, row.accuracy) == (0, 1, 0, 0, 1.0)
    assert row.precision is None and row.recall is None and row.f1 is None
    assert cl.evaluate_grid(labelled, none, TARGET, [0.5], [1]).isEmpty()


def test_persistence_baseline(spark):
    seqs = [
        (0, 0, [["Normal_T0_0"], ["AlmostFull_T1_0"], ["AlmostFull_T2_0"]]),
        (1, 0, [["AlmostFull_T0_0"], ["AlmostFull_T1_1"], ["AlmostFull_T2_0"]]),
    ]
    labelled, _ = frames(spark, seqs, random_case(1)[1])
    got = cl.predict(labelled, cl.persistence_rule(spark, TARGET), TARGET)
    assert tuples(got, "win", "y_pred") == [(0, TARGET), (1, "Normal")]


def test_target_rules(spark):
    rules = [
        ([["A_T0_0"], ["AlmostFull_T1_0"]], "a", 0.5, 1),
        ([["A_T0_0"], ["AlmostFull_T1_1"]], "b", 0.9, 1),
        ([["A_T0_0"], ["AlmostFull_T1_0", "Full_T1_0"]], "c", 0.9, 1),
        ([["A_T0_0"], ["AlmostFull_T1_0"]], "d", 0.9, 9),
    ]
    df = spark.createDataFrame(rules, "sequence array<array<string>>, key string, conf double, sup long")
    assert tuples(cl.target_rules(df, TARGET), "key") == [("a",), ("d",)]
    assert tuples(cl.target_rules(df, TARGET, 0.6, 5), "key") == [("d",)]
    with pytest.raises(ValueError):
        cl.target_rules(df, "Full")


def test_configurations_are_scored_one_by_one(spark):
    from stationmine.operators import grid
    from stationmine.plans import queries as q
    from stationmine.sources.fixture import Fixture

    fx = Fixture(spark, "/root/testdata/sf0.001")
    edges = q.small_edges(fx)
    configs = [q.TRAIN, q.TRAIN.but(neighborhood="indegree")]
    got = grid.evaluate_configs(
        q.split_status(fx, "train"), q.split_status(fx, "test"), fx.station, configs, TARGET, 0.1, [0.2], [1], edges, 2
    ).collect()
    assert {(r.extraction, r.neighborhood) for r in got} == {("Full-AlmostFull_wrapped", n) for n in ("Dist", "3")}
    assert all(r.tp + r.tn + r.fp + r.fn == got[0].tp + got[0].tn + got[0].fp + got[0].fn for r in got)
