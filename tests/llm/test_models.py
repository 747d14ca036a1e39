"""Language profiles and the line field: held-out accuracy, plain versions of their cores, odd rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationmine.llm import language, quality
from stationmine.llm.tables import read

ROOT = "/root/testdata/sf0.01"


def plain_profile(text, size, seed):
    """Bind and bundle one letter triple after the other."""
    flat, last = [0], 0
    for c in text:
        code = ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 0
        if code or last:
            flat.append(code)
        last = code
    if flat[-1]:
        flat.append(0)
    v = lambda c: language._vector(c, size, seed).astype(float)
    out = np.zeros(size)
    for a, b, c in zip(flat, flat[1:], flat[2:]):
        if b:
            out += np.roll(v(a), 2) * np.roll(v(b), 1) * v(c)
    n = np.linalg.norm(out)
    return out / n if n else out


def test_profiles_are_bound_and_bundled_triples():
    texts = ["Hello, world", "", "  \n", "a", "ÄÖ ß 1x", "日本語 abc", "x" * 50]
    got, some = language.profiles(texts, 256, 3)
    for row, t in zip(got, texts):
        assert np.allclose(row, plain_profile(t, 256, 3), atol=1e-5)
    assert some.tolist() == [True, False, False, True, True, True, True]


def test_held_out_languages(spark):
    docs = read(spark, ROOT, "documents")
    out = language.held_out(F.col("doc_id"), 5, 0)
    model = language.fit(docs, ~out)
    assert model.names == ("de", "en", "es", "fr")
    got = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(out)
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 150 and right > 0.97


def test_odd_rows_of_languages(spark, docs):
    rows = [(1, "the cat"), (1, "the cat"), (2, None), (3, "12 !!"), (None, "the"), (4, ""), (5, "the " * 50_000)]
    model = language.fit(docs(rows), F.col("doc_id") == 1)
    got = sorted((tuple(r) for r in language.predict(docs(rows), model).collect()), key=str)
    assert [(r[0], r[1]) for r in got] == [(1, "en"), (1, "en"), (2, "und"), (3, "und"), (4, "und"), (5, "en"), (None, "en")]
    assert all(0 <= r[2] <= 1 for r in got)
    kept = language.keep(docs(rows), model, 0.0)
    assert kept.count() == 4 and kept.columns == docs(rows).columns
    empty = language.fit(docs([]), F.lit(True))
    assert {r["lang_pred"] for r in language.predict(docs(rows), empty).collect()} == {"und"}
    assert language.predict(docs([]), model).count() == 0 and language.keep(docs(rows), empty, 0.5).count() == 7


def test_forward_backward_same_as_all_labelings():
    rng = np.random.default_rng(1)
    counts = np.array([3, 1, 5, 2])
    unary, between = rng.normal(size=counts.sum()), rng.normal(size=(2, 2))
    good, pairs, norm = quality.forward_backward(unary, counts, between)
    at = 0
    for c, n in enumerate(counts):
        weights, marginal, joint = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            s = sum(unary[at + t] * y[t] for t in range(n)) + sum(between[a, b] for a, b in zip(y, y[1:]))
            weights += np.exp(s)
            marginal += np.exp(s) * np.array(y)
            for a, b in zip(y, y[1:]):
                joint[a, b] += np.exp(s)
        assert np.allclose(good[at : at + n], marginal / weights) and np.isclose(norm[c], np.log(weights))
        assert np.allclose(pairs[c], joint / weights)
        at += n


def test_lines_see_their_neighbours():
    x, length, counts = quality.features(["one two\n\nTHREE!! FOUR!!\nTHREE!! FOUR!!", None, "x"])
    assert counts.tolist() == [3, 1, 1] and length.tolist() == [7, 14, 14, 0, 1]
    own, before, after = x[:, quality.SHARED], x[:, quality.OWN : quality.OWN + 10], x[:, quality.OWN + 10 : quality.OWN + 20]
    assert (before[1] == own[0]).all() and (after[0] == own[1]).all() and not before[0].any() and not after[2].any()
    assert x[2, -1] == 1 and x[1, -1] == 0 and not before[3:].any()


def test_held_out_quality(spark):
    docs, labels = read(spark, "/root/testdata/sf0.1", "documents"), read(spark, "/root/testdata/sf0.1", "labels")
    out = language.held_out(F.col("doc_id"), 4, 2)
    field = quality.fit(docs, labels.filter(~out), train_docs=1500)
    rows = quality.score(docs, field).join(labels, "doc_id").filter(out).select("score", "quality").toPandas()
    good, bad = (rows.score[rows.quality == q].to_numpy() for q in (1, 0))
    assert (good[:, None] > bad).mean() > 0.98 and (good >= 0.7).mean() > 0.97


def test_odd_rows_of_quality(spark, docs):
    rows = [(1, "A plain line of words."), (2, "$$$ ### !!!"), (None, "x"), (3, None), (3, ""), (4, " \n "), (5, "w " * 100_000)]
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, None), (None, 1), (9, 0), (3, 7)], "doc_id long, quality int")
    field = quality.fit(docs(rows), labels)
    got = quality.score(docs(rows), field).collect()
    assert len(got) == 7 and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[1] > by[2]
    assert quality.keep(docs(rows), field, 0.0).count() == 7 and quality.score(docs([]), field).count() == 0
    plain = quality.fit(docs(rows), labels.limit(0))
    assert {r["score"] for r in quality.score(docs(rows), plain).collect()} == {0.5}


def test_too_many_languages_are_an_error(spark, docs):
    with pytest.raises(ValueError):
        language.fit(docs([(1, "a")]), F.lit(True), max_languages=0)
