"""The registered queries against SQL or plain versions, and the pipeline stage by stage."""

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from stationmine.llm import language, oracle, quality, queries
from stationmine.llm.tables import read
from tests.llm.test_neardup import plain as plain_near
from tests.llm.test_rlz import plain as plain_passages

ROOT = "/root/testdata/sf0.001"
OWN, SQL = queries.queries(), oracle.oracle_sql()
COLUMNS = {
    "op1_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op2_inverted_multi_index": "query_id rank vec_id score",
    "op3_relative_lempel_ziv": "doc_id n_words n_removed kept_sha256",
    "op4_hyperdimensional_language": "doc_id held_out lang_pred score",
    "op5_harmonic_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op6_line_field_quality": "doc_id held_out score predicted",
    "op7_chosen_path_near_duplicates": "doc_id n_shingles component_id kept",
    "op8_metric_range_join": "vec_id n_links component_id kept",
    "op9_layout_text": "page_id text",
    "op11_link_graph_filter": "page_id host path rule verdict trust distrust",
    "op12_bidiagonal_whitening": "vec_id component n deviation whitened explained identity_error",
    "op13_merkle_manifest": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op10_sentencepiece": "doc_id n_tokens ids_sha256 decoded_sha256",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def ids(spark):
    return sorted(r[0] for r in read(spark, ROOT, "documents").select("doc_id").collect())


def test_every_operator_has_a_query():
    assert set(OWN) == set(COLUMNS) and set(OWN) | {"pipeline"} <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("key", sorted(SQL))
def test_same_as_sql(spark, duck, key):
    df = OWN[key](spark, ROOT)
    rel = duck.sql(SQL[key])
    order = [rel.columns.index(c) for c in df.columns]
    assert len(order) == len(rel.columns)
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in order) for r in rel.fetchall())


@pytest.mark.parametrize("key", sorted(COLUMNS))
def test_columns(spark, key):
    assert OWN[key](spark, ROOT).columns == COLUMNS[key].split()


def test_nearest_neighbours(spark):
    rows = read(spark, ROOT, "embeddings").collect()
    own = np.array([r["vec_id"] for r in rows])
    x = np.array([r["embedding"] for r in rows], float)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in OWN["op2_inverted_multi_index"](spark, ROOT).collect()}
    for i in np.flatnonzero(own % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        for rank, j in enumerate(np.lexsort((own, d))[:10], 1):
            found, score = got.pop((own[i], rank))
            assert found == own[j] and abs(score - d[j]) < 1e-12
    assert not got


def test_folds_and_ranges(spark, ids):
    for key, folds, fold in (("op4_hyperdimensional_language", 5, 0), ("op6_line_field_quality", 4, 2)):
        rows = OWN[key](spark, ROOT).collect()
        assert sorted(r["doc_id"] for r in rows) == ids
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == fold) for r in rows)
        assert all(0 <= r["score"] <= 1 for r in rows)


def test_every_page_and_document_is_answered(spark, ids):
    for key in ("op5_harmonic_packing", "op10_sentencepiece"):
        assert sorted({r["doc_id"] for r in OWN[key](spark, ROOT).select("doc_id").collect()}) == ids
    pages = read(spark, ROOT, "pages")
    assert OWN["op9_layout_text"](spark, ROOT).filter("length(text) > 0").count() == pages.count()


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = read(spark, ROOT, "documents"), []
    for name, stage in pipeline.STAGES:
        new = pipeline.cut(stage(spark, docs, ROOT))
        out.append((name, docs, new))
        docs = new
    return {name: (before, after) for name, before, after in out}


def pairs(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_stages_keep_the_columns_of_documents(spark, stages):
    want = read(spark, ROOT, "documents").dtypes
    assert all(after.dtypes == want for name, (_, after) in stages.items() if name != "packing")
    assert len(pipeline.STAGES) == 5 and pipeline.ORACLE_SQL is None


def test_quality_stage_goes_by_score(spark, stages):
    before, after = stages["quality"]
    labels = read(spark, ROOT, "labels").filter(~language.held_out(F.col("doc_id"), 4, 2))
    want = quality.score(before, quality.fit(before, labels)).filter(F.col("score") >= 0.7)
    assert sorted(r[0] for r in want.select("doc_id").collect()) == [i for i, _ in pairs(after)]
    assert 0 < after.count() < before.count()


def test_language_stage_drops_what_has_no_letters(spark, docs):
    rows = [(i, "The cat sat on the mat and " * 3) for i in range(10)] + [(10, "12 34 --"), (11, None)]
    assert [i for i, _ in pairs(pipeline.known_language(spark, docs(rows), ROOT))] == list(range(10))


def test_language_stage_drops_unlearned_scripts(spark, docs):
    rng, before = np.random.default_rng(5), read(spark, ROOT, "documents")
    known = [(i, r["text"]) for i, r in enumerate(before.filter(language.held_out(F.col("doc_id"), 5, 0)).collect())]
    scripts = [(0x430, 0x450), (0x3B1, 0x3CA), (0x4E00, 0x5E00), (0x627, 0x64B), (0x5D0, 0x5EB), (0x10D0, 0x10F1)]
    made = []
    for low, high in scripts:
        for _ in range(25):
            made.append(" ".join("".join(map(chr, rng.integers(low, high, rng.integers(2, 9)))) for _ in range(300)))
    learned = before.filter(~language.held_out(F.col("doc_id"), 5, 0)).select("doc_id", "text", "lang")
    unseen = 1 << 40  # ids of rows not learned from: lang is null
    rows = spark.createDataFrame([(unseen + i, t, None) for i, t in known + [(1000 + i, t) for i, t in enumerate(made)]], learned.schema)
    kept = [r[0] - unseen for r in pipeline.known_language(spark, learned.union(rows), ROOT).select("doc_id").collect()]
    assert sorted(i for i in kept if 0 <= i < 1000) == [i for i, t in known if any(map(str.isalpha, t or ""))]
    assert sum(i >= 1000 for i in kept) <= 3


def test_near_duplicate_stage_keeps_one_of_each(stages):
    before, after = stages["near duplicates"]
    assert [i for i, _ in pairs(after)] == sorted(r[0] for r in plain_near(pairs(before), 5, 80) if r[3])


def test_near_duplicate_stage_keeps_one_of_repeated_rows(spark, docs):
    rows = [(1, "a b c"), (1, "a b c"), (2, "x"), (None, "y"), (3, "a b c")]
    assert sorted((r[0] or 0) for r in pipeline.no_near_duplicates(spark, docs(rows), ROOT).select("doc_id").collect()) == [0, 1, 2]


def test_passage_stage(stages):
    before, after = stages["repeated passages"]
    want = [(i, w) for i, w, _ in plain_passages(pairs(before), 50) if w]
    assert [(i, t.split()) for i, t in pairs(after)] == sorted(want)
    assert after.filter("n_chars <> length(text)").count() == 0


def test_passage_stage_keeps_texts_without_words(spark, docs):
    rows = docs([(1, None), (2, ""), (3, " \n"), (4, "w " * 60), (5, "w " * 60)])
    kept = pipeline.no_repeated_passages(spark, rows, ROOT)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4]


def test_quality_stage_without_labels_rejects_nothing(spark, docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = docs([(1, "a"), (2, None)])
    assert pipeline.good_quality(spark, rows, str(tmp_path)).count() == 2


def test_packing_stage_holds_every_token(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    before, after = stages["packing"]
    got = after.toPandas().sort_values(["doc_id", "start"]).groupby("doc_id").ids.agg(b"".join).to_dict()
    for i, text in pairs(before):
        assert got.pop(i) == np.array(library.encode(text, add_special_tokens=False).ids + [0], "<u4").tobytes()
    assert not got
