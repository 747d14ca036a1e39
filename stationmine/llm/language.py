"""Language identification with hyperdimensional profiles (operator 4).

Every letter has a random vector of +1 and -1. Three neighbouring letters are bound to one vector by
multiplying them, the first permuted (rotated) twice and the second once. A text's profile bundles (adds)
its bound vectors, a language's prototype the profiles of its texts, and texts go to the language
whose prototype has the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationmine.llm.tables import by_slice, claim, slices, text_only

UNKNOWN = "und"
_BOUND_AT_ONCE = 8192


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """code point → code point of the lower-case letter; 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        letter = chr(code)
        if letter.isalpha():
            small = letter.lower()
            table[code] = ord(small) if len(small) == 1 else code
    return table


@lru_cache(maxsize=20_000)
def _vector(code: int, size: int, seed: int) -> np.ndarray:
    return (np.random.default_rng((seed, code)).integers(0, 2, size) * 2 - 1).astype(np.int8)


def profiles(texts: list[str], size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit profile of each text, and whether it has letters at all."""
    found, groups = bundled(texts, size, seed)
    return found, groups > 0


def bundled(texts: list[str], size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit profile of each text, and how many different bound vectors it bundles.

    Stretches of other characters count as one border, which is a letter of its own; each bound
    vector has a letter in its middle.
    """
    claim("letters", lambda: None)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    codes = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le"), "<u4")
    letters = _letters()[codes]
    owner = np.repeat(np.arange(len(texts)), lengths)
    kept = letters != 0
    kept[1:] |= letters[:-1] != 0
    letters, owner = letters[kept], owner[kept]
    if len(letters) and letters[0] != 0:
        letters, owner = np.concatenate([[0], letters]), np.concatenate([[0], owner])
    out = np.zeros((len(texts), size), np.float32)
    middle = np.flatnonzero(letters[1:-1] != 0) + 1 if len(letters) > 2 else np.zeros(0, np.int64)
    if not len(middle):
        return out, np.zeros(len(texts), np.int64)
    seen = np.zeros(0x110000, bool)
    seen[letters] = True
    own = np.flatnonzero(seen)
    place = np.zeros(0x110000, np.int64)
    place[own] = np.arange(n := len(own))
    at = place[letters]
    keys = owner[middle] * n**3 + (at[middle - 1] * n + at[middle]) * n + at[middle + 1]
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.append(first, len(keys))).astype(np.float32)
    doc, gram = np.divmod(keys[first], n**3)
    grams, column = np.unique(gram, return_inverse=True)
    base = np.stack([_vector(int(c), size, seed) for c in own])
    once, twice = np.roll(base, 1, axis=1), np.roll(base, 2, axis=1)
    for lo in range(0, len(grams), _BOUND_AT_ONCE):
        part = grams[lo : lo + _BOUND_AT_ONCE]
        bound = twice[part // (n * n)] * once[part // n % n] * base[part % n]
        mine = (column >= lo) & (column < lo + len(part))
        dense = np.zeros((len(texts), len(part)), np.float32)
        dense[doc[mine], column[mine] - lo] = counts[mine]
        out += dense @ bound.astype(np.float32)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms == 0, 1, norms), np.bincount(doc, minlength=len(texts))


@dataclass(frozen=True)
class LanguageModel:
    """names: sorted; prototypes: one unit row for each."""

    names: tuple[str, ...]
    prototypes: np.ndarray
    size: int
    seed: int

    def noise(self, chance: float) -> float:
        """The score that a text unrelated to every language reaches with probability ``chance``.

        The cosine of unrelated profiles is about normal, with a deviation of 1 / sqrt(size); a score is the
        best of one for each language.
        """
        return NormalDist().inv_cdf(1 - chance / max(1, len(self.names))) / self.size**0.5

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        return self.judge(texts)[:2]

    def judge(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, score and number of different letter groups of each text."""
        found, groups = bundled([t or "" for t in texts], self.size, self.seed)
        some = groups > 0
        names, scores = np.full(len(some), UNKNOWN, object), np.zeros(len(some))
        if self.names:
            cosines = found @ self.prototypes.T
            names[some] = np.array(self.names, object)[cosines.argmax(axis=1)][some]
            scores[some] = np.clip(cosines.max(axis=1), 0, 1)[some]
        return names, scores, groups


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id's text falls into the fold. A null id never does."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(
    docs: DataFrame, train: Column, size: int = 1024, seed: int = 7, per_language: int = 5000, max_languages: int = 1000
) -> LanguageModel:
    """Prototypes from rows where ``train`` holds and ``lang`` is not null.

    Of each language about ``per_language`` documents are taken, by a hash of the id, so the fit does
    not grow with the corpus; languages with fewer give all. Profiles are summed in Spark; only
    one vector per language reaches the driver. More than ``max_languages`` labels are an error.
    """
    rows = docs.filter(train & F.col("lang").isNotNull()).select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")
    )
    sizes = rows.groupBy("lang").count().limit(max_languages + 1).collect()
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not sizes:
        return LanguageModel((), np.zeros((0, size), np.float32), size, seed)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, per_language / r["count"]))])
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                found, _ = profiles([t or "" for t in part.column("text").to_pylist()], size, seed)
                langs = np.array(part.column("lang").to_pylist(), object)
                for lang in set(langs):
                    sums[lang] = sums.get(lang, 0) + found[langs == lang].sum(axis=0, dtype=np.float64)
        yield pa.RecordBatch.from_pydict(
            {"lang": pa.array(sums, pa.string()), "sums": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))}
        )

    summed = (
        chosen.mapInArrow(bundle, "lang string, sums array<double>")
        .select("lang", F.posexplode("sums").alias("at", "x"))
        .groupBy("lang", "at")
        .agg(F.sum("x").alias("x"))
        .groupBy("lang")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("x"))
        .collect()
    )
    found = {r["lang"]: np.array(r["x"]) for r in summed}
    found = {k: v / np.linalg.norm(v) for k, v in sorted(found.items()) if np.any(v)}
    rows_ = np.stack([*found.values()]) if found else np.zeros((0, size))
    return LanguageModel(tuple(found), rows_.astype(np.float32), size, seed)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score (the cosine, 0 at least), one row per document.

    Looks at whole texts and at nothing else. Null texts, texts without letters and models without
    languages give ``und`` with score 0. Ties go to the name that sorts first. Null or repeated
    doc_ids are documents of their own. No rows: no rows.
    """

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = model.predict(part.column("text").to_pylist())
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
            ["doc_id", "lang_pred", "score"],
        )

    return text_only(docs).mapInArrow(by_slice(work, "text"), "doc_id long, lang_pred string, score double")


def keep(docs: DataFrame, model: LanguageModel, at_least: float, few: int = 0) -> DataFrame:
    """Rows of ``docs``, with all their columns, that have a language, with a score of ``at_least`` or more.

    Texts with letters but fewer than ``few`` different letter groups are kept at any score: they are too short to
    tell. Nothing is shuffled. A model without languages rejects nothing.
    """
    if not model.names:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                names, scores, groups = model.judge(part.column("text").to_pylist())
                yield part.filter(pa.array((names != UNKNOWN) & ((scores >= at_least) | (groups < few)), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
