"""From raw documents to packed sequences: each stage applies one operator to all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationmine.llm import language, neardup, packing, quality, rlz
from stationmine.llm.queries import QUALITY, tokenizer_file
from stationmine.llm.tables import read
from stationmine.scale import cut, fits

#: Of texts unrelated to every language, the share that passes the language stage by chance.
CHANCE = 0.002
#: Texts of fewer different letter groups (about four words) are too short to tell from chance; they stay.
FEW = 20
#: Words of a shingle, percent of similarity, words of a repeated passage.
SHINGLE, PERCENT, PASSAGE = 5, 80, 50


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores at QUALITY or more. Learns from the labels outside fold 2 of 4."""
    labels = read(spark, sf_dir, "labels").filter(~language.held_out(F.col("doc_id"), 4, 2))
    return quality.keep(docs, quality.fit(docs, labels), QUALITY)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have letters and are nearer to some language than chance, or too short to tell. Learns from ``lang`` outside fold 0 of 5."""
    train = ~language.held_out(F.col("doc_id"), 5, 0) & F.col("doc_id").isNotNull()
    model = language.fit(docs, train)
    return language.keep(docs, model, model.noise(CHANCE), FEW)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is not among ``ids``. These are broadcast if they are few, so that texts stay where they are."""
    ids = cut(ids)
    return docs.join(F.broadcast(ids) if fits(ids) else ids, "doc_id", "left_anti")


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least doc_id; of rows with one doc_id, one."""
    found = neardup.near_duplicates(docs, SHINGLE, PERCENT)
    kept = without(docs, found.filter("NOT kept").select("doc_id").distinct())
    again = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if again.isEmpty():
        return kept
    again = cut(again)
    return without(kept, again).union(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(kept.columns))


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of PASSAGE words that an earlier document holds; texts that lose every word go, those that had none stay."""
    # other columns travel under names that clash with none of the operator's
    others = {f"_other{i}": c for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}
    rows = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for n, c in others.items()])
    left = rlz.deduplicate(rows, PASSAGE, list(others)).filter("n_words > n_removed OR n_removed = 0")
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    own |= {c: F.col(n) for n, c in others.items()}
    return left.select(*[own[c].alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids, dealt into sequences of 1024."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near duplicates", no_near_duplicates),
    ("repeated passages", no_repeated_passages),
    ("packing", packed),
]

#: Tokenising, learned weights and the join's trees have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
