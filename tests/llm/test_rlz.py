"""Relative Lempel-Ziv factors against plain loops over windows."""

import random
import re

import numpy as np
import pytest

from stationmine.llm import rlz


def plain(rows, window):
    """(doc_id, kept words, n_removed) by looking every window up in all documents."""
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for a in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[a : a + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            if i is not None and first[tuple(w[a : a + window])] < i:
                gone[a : a + window] = [True] * window
        out.append((i, [x for x, g in zip(w, gone) if not g], sum(gone)))
    return sorted(out, key=str)


def answered(frame):
    return sorted(((r["doc_id"], (r["text"] or "").split(), r["n_removed"]) for r in frame.collect()), key=str)


def passages(seed, letters, n=60):
    rng = random.Random(seed)
    base = [rng.choice(letters) for _ in range(400)]
    rows = []
    for i in range(n):
        a = rng.randrange(300)
        b = a + rng.randrange(100)
        w = [rng.choice(letters) for _ in range(rng.randrange(30))] + base[a:b]
        w += [rng.choice(letters) for _ in range(rng.randrange(30))] + base[max(0, b - 40) : b + 30]
        rows.append((i if i % 11 else None, rng.choice([" ", "\n", ""]) + rng.choice([" ", "\t\n"]).join(w)))
    return [*rows, (3, None), (100, ""), (101, " "), (5, rows[5][1]), (-7, rows[8][1])]


@pytest.mark.parametrize("seed,letters,window", [(1, "abc", 8), (2, "abcdefg", 13), (3, "abcdefghijkl", 20), (4, "ab", 31)])
def test_same_as_plain_loops(spark, docs, seed, letters, window):
    rows = passages(seed, letters)
    assert answered(rlz.deduplicate(docs(rows, 5), window)) == plain(rows, window)


def test_batches_of_one_document(spark, docs, monkeypatch):
    """What one batch would find among its own documents is then found in the blocks."""
    rows = passages(9, "abcdef")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        assert answered(rlz.deduplicate(docs(rows, 7), 12)) == plain(rows, 12)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_factors_name_their_reference(spark, docs):
    body = [f"w{i}" for i in range(80)]
    rows = [(1, " ".join(body)), (2, "x y " + " ".join(body[10:75]) + " z"), (3, " ".join(body[:30]))]
    got = [tuple(r) for r in rlz.factors(docs(rows), 50).collect()]
    spans = {(d, s + k, r, q + k) for d, s, n, r, q in got for k in range(n)}
    assert {x[0] for x in spans} == {2} and {x[2] for x in spans} == {1}
    assert {x[1] for x in spans} == set(range(2, 67)) and all(q - s == 8 for _, s, _, q in spans)


@pytest.mark.parametrize("seed", range(6))
def test_longest_matches_against_plain_loops(seed):
    rng = random.Random(seed)
    texts = [[rng.choice("abc"[: 2 + seed % 2]) for _ in range(rng.randrange(1, 25))] for _ in range(12)]
    ids = sorted(rng.choice(range(8)) for _ in texts)
    flat = [(i, k, j) for k, (i, t) in enumerate(zip(ids, texts)) for j in range(len(t))]
    name = np.array([ord(texts[k][j]) for _, k, j in flat])
    upto = np.cumsum([len(t) for t in texts])[[k for _, k, _ in flat]]
    length, ref = rlz._longest(name, np.array([i for i, _, _ in flat]), upto)

    def common(x, y):
        n = 0
        while x + n < upto[x] and y + n < upto[y] and name[x + n] == name[y + n]:
            n += 1
        return n

    for x, (i, _, _) in enumerate(flat):
        most = max((common(x, y) for y, (j, _, _) in enumerate(flat) if j < i), default=0)
        assert length[x] == most
        if most:
            assert common(x, ref[x]) >= most
            assert flat[ref[x]][0] == min(j for y, (j, _, _) in enumerate(flat) if j < i and common(x, y) >= most)


def test_the_longest_reference_wins_and_borders_are_looked_up(spark, docs):
    """Document 1 holds the first half, document 2 the whole: one factor. Another goes on from 2 in 3, with windows across."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        body = [f"w{i}" for i in range(400)]
        rows = [(1, " ".join(body[:200])), (2, " ".join(["a", *body[:300]])), (3, " ".join(body[240:])), (9, " ".join(body))]
        got = sorted(tuple(r) for r in rlz.factors(docs(rows, 4), 50).filter("doc_id = 9").collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    covered = {s + k for _, s, n, _, _ in got for k in range(n)}
    assert covered == set(range(400)) and all(n >= 50 for _, _, n, _, _ in got)
    one = [tuple(r) for r in rlz.factors(docs(rows, 1), 50).filter("doc_id = 9").collect()]
    assert sorted(one) == [(9, 0, 300, 2, 1), (9, 251, 149, 3, 11)]


def test_a_long_passage_is_one_factor(spark, docs):
    """Also where it crosses many blocks."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        body = [f"w{i}" for i in range(3000)]
        rows = [(1, " ".join(body)), (7, " ".join(["x", *body[100:2900], "y"]))]
        assert [tuple(r) for r in rlz.factors(docs(rows, 2), 50).collect()] == [(7, 1, 2800, 1, 100)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_phrase_in_every_document(spark, docs):
    phrase = [f"p{i}" for i in range(30)]
    rows = [(i, " ".join([*(f"a{i}.{k}" for k in range(40)), *phrase, *(f"b{i}.{k}" for k in range(40))])) for i in range(200)]
    assert {r["n_removed"] for r in rlz.deduplicate(docs(rows, 5), 50).collect()} == {0}
    assert {r["n_removed"] for r in rlz.deduplicate(docs(rows, 5), 30).filter("doc_id > 0").collect()} == {30}


def test_long_text_and_repeats_within_a_document(spark, docs):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, long), (2, "again " + long), (4, "same " * 300)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in rlz.deduplicate(docs(rows), 50).collect()}
    assert got == {1: (60_000, 0), 2: (60_001, 60_000), 4: (300, 0)}


def test_other_columns_and_white_space_stay(spark, docs):
    body = " ".join(f"w{i}" for i in range(50))
    rows = [(1, body), (2, f"  keep\n\nthis {body}\nand\tthat ")]
    got = {r["doc_id"]: r for r in rlz.deduplicate(docs(rows), 50, ["source", "kept"]).collect()}
    assert got[2]["text"] == "  keep\n\nthis and\tthat " and (got[2]["source"], got[2]["kept"]) == ("s", "x")
    assert got[1]["text"] == body


def test_no_rows(spark, docs):
    assert rlz.deduplicate(docs([]), 50).count() == 0
    with pytest.raises(ValueError):
        rlz.factors(docs([]), 7)
