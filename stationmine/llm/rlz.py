"""Substring deduplication by relative Lempel-Ziv factors (operator 3).

A document is parsed into factors: stretches of words that occur in the same order in a reference, here
any document with a smaller id. Only factors of at least ``window`` words count; they are the
document's duplicate spans.

References are indexed in blocks. A window (``window`` consecutive words) belongs to the block
named by the least phrase of eight words in it, which depends on its words alone, so equal windows of
any documents meet in one block, and a document is parsed against every block that can hold a
factor of it. The index of a block is the suffix order of its texts (see ``_longest``). A parse starts at the first
window that the reference holds and takes the longest stretch from there that any smaller document goes on
with. Where a factor ends, the window across its border is looked up: if the reference holds it, the next factor starts there,
else at the next window it holds. ``factors`` joins what block borders cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationmine.llm.tables import binary_column, by_slice, mix, slices, text_only, word_hashes

PHRASE = 8
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_PARSED = "block long, doc_id long, start long, windows binary, length long, ref_doc_id long, ref_start long, spans binary"
FACTOR = "doc_id long, start long, length long, ref_doc_id long, ref_start long"
SPANS = "doc_id long, spans binary"


def _joined(left: np.ndarray, right: np.ndarray, shift: int) -> np.ndarray:
    """Hash of the stretch that starts in ``left`` and goes on ``shift`` words later in ``right``."""
    n = max(0, len(right) - shift)
    return mix(left[:n]) + right[shift : shift + n]


def _stretches(h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all stretches of eight words and of ``length`` words (8 at least)."""
    power, size, out, phrase = h, 1, None, h
    while size <= length:
        if size == PHRASE:
            phrase = power
        if length & size:
            out = power if out is None else _joined(power, out, size)
        power = _joined(power, power, size)
        size *= 2
    return mix(phrase), mix(out)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _nearest_less(doc: np.ndarray) -> np.ndarray:
    """For every place the nearest one before it that has a smaller document, else -1."""
    doc = np.append(doc, np.iinfo(np.int64).min)  # place -1 is smaller than any
    at = np.arange(-1, len(doc) - 2)
    todo = np.flatnonzero(doc[at] >= doc[:-1])
    while len(todo):
        at[todo] = at[at[todo]]
        todo = todo[doc[at[todo]] >= doc[todo]]
    return at


def _longest(name: np.ndarray, doc: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every window the most windows from it on that a smaller document has too, and the first document's place of these.

    ``upto`` is where the stretch ends that a window lies in. Stretches are ranked by doubling their length,
    which puts all suffixes in order. The longest match of a suffix lies next to it in that order, before or behind,
    among the suffixes of smaller documents.
    """
    n = len(name)
    at = np.arange(n)
    ranks = [np.unique(name, return_inverse=True)[1].astype(np.int64)]
    size, most = 1, int((upto - at).max())
    while size < most and ranks[-1].max() < n - 1:
        last, after = ranks[-1], np.zeros(n, np.int64)
        more = np.flatnonzero(at + size < upto)
        after[more] = last[more + size] + 1
        ranks.append(np.unique(last * (n + 1) + after, return_inverse=True)[1].astype(np.int64))
        size *= 2

    def shared(other: np.ndarray) -> np.ndarray:
        """How many windows two suffixes share."""
        mine = np.flatnonzero(other >= 0)
        x, y = at[mine], other[mine]
        for k in range(len(ranks) - 1, -1, -1):
            same = np.flatnonzero((x < upto[mine]) & (y < upto[other[mine]]))
            same = same[ranks[k][x[same]] == ranks[k][y[same]]]
            step = np.minimum(1 << k, upto[mine[same]] - x[same])
            x[same] += step
            y[same] += step
        out = np.zeros(n, np.int64)
        out[mine] = x - at[mine]
        return out

    order = np.lexsort((doc, ranks[-1]))
    before, behind = _nearest_less(doc[order]), n - 1 - _nearest_less(doc[order[::-1]])[::-1]
    ends = np.append(order, -1)  # places -1 and n: none
    sides = np.empty((2, n), np.int64)
    sides[0, order], sides[1, order] = ends[before], ends[behind]
    first, second = shared(sides[0]), shared(sides[1])
    length, ref = np.maximum(first, second), np.where(first >= second, sides[0], sides[1])
    todo = np.flatnonzero(length > 0)
    todo = todo[length[ref[todo]] >= length[todo]]
    while len(todo):  # a smaller document goes on as long
        ref[todo] = ref[ref[todo]]
        todo = todo[length[ref[todo]] >= length[todo]]
    return length, ref


def _factors(early: np.ndarray, block: np.ndarray, doc: np.ndarray, place: np.ndarray, window: int) -> list[np.ndarray]:
    """Greedy factors of windows, which come by block, document and place; ``early``: the first row with the same window."""
    known = doc[early] < doc
    hit = np.zeros(len(doc), bool)
    hit[early[known]] = True
    some = np.flatnonzero(hit[early])
    early, block, doc, place, known = early[some], block[some], doc[some], place[some], known[some]
    if not len(some):
        return [doc, place, place, doc, place]
    goes_on = (block[1:] == block[:-1]) & (doc[1:] == doc[:-1]) & (place[1:] == place[:-1] + 1)
    ends = np.append(np.flatnonzero(~goes_on) + 1, len(doc))
    upto = np.repeat(ends, np.diff(np.append(0, ends)))
    length, ref = _longest(early, doc, upto)
    follows = np.append(False, goes_on & known[:-1]) & known
    at = np.flatnonzero(known & ~follows)
    starts = [at]
    while len(at):  # every stretch of known windows takes its next factor
        at = at + length[at]
        at = at[at < len(doc)]
        at = at[follows[at]]
        starts.append(at)
    at = np.sort(np.concatenate(starts))
    return [doc[at], place[at], length[at] + window - 1, doc[ref[at]], place[ref[at]]]


def _merged(parts: list[np.ndarray]) -> tuple[np.ndarray, pa.Array]:
    """Documents of factors, and for each the stretches (start, length) its factors cover together, as one binary value."""
    by = np.lexsort(parts[1::-1])
    doc, start, length = (p[by] for p in parts[:3])
    heads = np.append(False, doc[1:] != doc[:-1])[: len(doc)]
    shift = np.cumsum(heads) << 40  # the furthest end so far, within each document
    end = np.maximum.accumulate(start + length + shift) - shift
    fresh = np.ones(len(doc), bool)
    fresh[1:] = heads[1:] | (start[1:] > end[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(doc))[: len(first)] - 1
    stretches = np.c_[start[first], end[last] - start[first]]
    owner = doc[first]
    heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else first
    return owner[heads], binary_column(stretches.ravel().astype(np.int64), 2 * np.append(heads, len(owner)))


def _earliest(name: np.ndarray) -> np.ndarray:
    """For every row the first row with the same name."""
    order = np.argsort(name, kind="stable")
    sorted_ = name[order]
    heads = np.ones(len(name), bool)
    heads[1:] = sorted_[1:] != sorted_[:-1]
    out = np.empty(len(name), np.int64)
    out[order] = order[np.flatnonzero(heads)][np.cumsum(heads) - 1]
    return out


def _batch(block, doc, start, windows, length, ref, ref_start, spans=None) -> pa.RecordBatch:
    signed = lambda x: pa.array(np.asarray(x).astype(np.int64, copy=False))
    return pa.RecordBatch.from_arrays(
        [signed(block), signed(doc), signed(start), windows, signed(length), signed(ref), signed(ref_start),
         pa.nulls(len(doc), pa.binary()) if spans is None else spans],
        [x.split()[0] for x in _PARSED.split(", ")],
    )


def _parse(batch: pa.RecordBatch, window: int, merge: bool) -> Iterator[pa.RecordBatch]:
    """Windows of some documents by block, and the factors these documents have among themselves (``merge``: one row per document).

    A window that an earlier document of the batch holds is a factor's already; it is not sent on, so a
    passage in very many documents goes to its block once per batch.
    """
    rows = sorted(
        ((i, t) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) if i is not None and t),
        key=lambda x: x[0],
    )
    hashes = [word_hashes(t.encode().split()) for _, t in rows]
    ids = np.array([i for i, _ in rows], np.int64)
    ids, hashes = ids[[len(h) >= window for h in hashes]], [h for h in hashes if len(h) >= window]
    if not hashes:
        return
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    begins = np.cumsum(sizes) - sizes
    phrase, name = _stretches(np.concatenate(hashes), window)
    least = _least(phrase, window - PHRASE + 1)
    # windows that lie within a document
    per_doc = sizes - window + 1
    doc = np.repeat(ids, per_doc)
    place = np.arange(per_doc.sum()) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    at = np.repeat(begins, per_doc) + place
    name, least = name[at], least[at]
    early = _earliest(name)
    known = doc[early] < doc
    parts = _factors(early, np.zeros(len(doc), np.int64), doc, place, window)
    if merge:
        own, spans = _merged(parts)
        none = np.zeros(len(own), np.int64)
        yield _batch(mix(own.view(np.uint64)).view(np.int64), own, none, pa.nulls(len(own), pa.binary()), none, none, none, spans)
    else:
        where = mix(parts[0].view(np.uint64) + parts[1].astype(np.uint64)).view(np.int64)  # spreads finished factors
        yield _batch(where, parts[0], parts[1], pa.nulls(len(where), pa.binary()), *parts[2:])
    sent = np.flatnonzero(~known)
    if not len(sent):
        return
    goes_on = (doc[sent[1:]] == doc[sent[:-1]]) & (place[sent[1:]] == place[sent[:-1]] + 1)
    goes_on &= least[sent[1:]] == least[sent[:-1]]
    first = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    bounds = np.append(first, len(sent))
    zero = np.zeros(len(first), np.int64)
    head = sent[first]
    yield _batch(
        least[head].view(np.int64), doc[head], place[head], binary_column(name[sent], bounds), zero, zero, zero
    )


def _against_blocks(batches: Iterator[pa.RecordBatch], window: int, merge: bool) -> Iterator[pa.RecordBatch]:
    """Parses what each block's documents hold of it against its index; rows come sorted by block, document, place."""
    names = [c.split()[0] for c in (SPANS if merge else FACTOR).split(", ")]
    held: list[pa.RecordBatch] = []

    def work(rows: pa.Table) -> pa.RecordBatch:
        block = rows.column("block").to_numpy()
        alone = np.concatenate([[True], block[1:] != block[:-1]]) & np.concatenate([block[1:] != block[:-1], [True]])
        rows = rows.filter(pa.array(~alone))
        block, doc, start = (rows.column(c).to_numpy() for c in ("block", "doc_id", "start"))
        packed = rows.column("windows").to_pylist()
        sizes = np.fromiter((len(w) // 8 for w in packed), np.int64, len(packed))
        own = np.frombuffer(b"".join(packed), np.uint64)
        block, doc, first = (np.repeat(x, sizes) for x in (block, doc, np.cumsum(sizes) - sizes))
        place = np.repeat(start, sizes) + np.arange(len(own)) - first
        parts = _factors(_earliest(own + mix(block.view(np.uint64))), block, doc, place, window)
        if merge:
            own, spans = _merged(parts)
            return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), spans], names)
        return pa.RecordBatch.from_arrays([pa.array(p.astype(np.int64)) for p in parts], names)

    for batch in batches:
        done = batch.column("windows").is_valid()
        yield batch.filter(pc.invert(done)).select(names)
        batch = batch.filter(done)
        if not batch.num_rows:
            continue
        block = batch.column("block").to_numpy()
        turn = np.flatnonzero(block != block[-1])
        cut_at = int(turn[-1]) + 1 if len(turn) else 0
        if not cut_at and (not held or held[-1].column("block")[-1].as_py() == block[0]):
            held.append(batch)
            continue
        # what ends within this batch, or ended with the last one
        yield work(pa.Table.from_batches([*held, batch.slice(0, cut_at)]))
        held = [batch.slice(cut_at)]
    if held:
        yield work(pa.Table.from_batches(held))


def factors(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, start, length (in words), ref_doc_id, ref_start: all factors of ``window`` words or more.

    Together they cover exactly the words of windows that also start in a document with a smaller id. Factors that go on in
    the same reference across the border of a block are one.
    """
    end = F.col("start") + F.col("length")
    line = Window.partitionBy("doc_id", "ref_doc_id", F.col("ref_start") - F.col("start")).orderBy("start", "length")
    before = F.max(end).over(line.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start") <= before, 0).otherwise(1)
    return (
        _found(docs, window, False)
        .withColumn("fresh", fresh)
        .withColumn("line", F.col("ref_start") - F.col("start"))
        .withColumn("part", F.sum("fresh").over(line))
        .groupBy("doc_id", "ref_doc_id", "line", "part")
        .agg(F.min("start").alias("start"), F.max(end).alias("end"), F.min("ref_start").alias("ref_start"))
        .select("doc_id", "start", (F.col("end") - F.col("start")).alias("length"), "ref_doc_id", "ref_start")
    )


def _found(docs: DataFrame, window: int, merge: bool) -> DataFrame:
    """All factors; or, merged, the stretches they cover: rows (doc_id, spans), one per document and batch that finds some."""
    if window < PHRASE:
        raise ValueError(f"window must be {PHRASE} words at least")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                yield from _parse(part, window, merge)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        text_only(docs)
        .mapInArrow(parse, _PARSED)
        .repartition(parts, "block")
        .sortWithinPartitions("block", "doc_id", "start")
        .mapInArrow(lambda batches: _against_blocks(batches, window, merge), SPANS if merge else FACTOR)
    )


def without(text: str, spans: list[tuple[int, int]]) -> tuple[str, int, int]:
    """Text without the words of the spans (start, length), number of words, number of words removed.

    What stands between kept words stays as it is; a removed word takes the white space behind it along.
    """
    data = text.encode()
    if not spans:
        return text, len(data.split()), 0
    begins = np.fromiter((m.start() for m in _WORD.finditer(data)), np.int64)
    n = len(begins)
    change = np.zeros(n + 1, np.int64)
    for start, length in spans:
        change[start] += 1
        change[start + length] -= 1
    gone = np.cumsum(change[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))
    at = np.append(begins, len(data))
    kept = [data[at[a] : at[b]] for a, b in zip(edges[::2], edges[1::2])]
    return (data[: at[0]] + b"".join(kept)).decode(), n, int(gone.sum())


def _stretches_of(found: list[bytes] | None) -> list[tuple[int, int]]:
    return np.frombuffer(b"".join(found or ()), np.int64).reshape(-1, 2).tolist()


def deduplicate(docs: DataFrame, window: int = 50, others: Sequence[str] = ()) -> DataFrame:
    """doc_id, text (what is left), n_words, n_removed and the columns ``others``, one row per document.

    Words are runs without space, tab, line feed, vertical tab, form feed and carriage return. Windows
    are judged on the input. Repeats within one document stay. Null texts stay null and have no words. Rows with null
    doc_ids are neither references nor changed. Rows that share a doc_id do not refer to each other, and all of
    their spans are taken from each. Other columns are passed on or left out, never read. No rows: no rows.
    """
    spans = _found(docs, window, True).groupBy("doc_id").agg(F.collect_list("spans").alias("spans"))

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, found in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
            out.append((None, 0, 0) if text is None else without(text, _stretches_of(found)))
        texts, words, removed = zip(*out) if out else ((), (), ())
        own = [pa.array(texts, pa.string()), pa.array(words, pa.int64()), pa.array(removed, pa.int64())]
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), *own, *(part.column(c) for c in others)],
            ["doc_id", "text", "n_words", "n_removed", *others],
        )

    rows = text_only(docs, *others)
    kinds = "".join(f", `{n}` {kind}" for n, kind in rows.dtypes[2:])
    schema = "doc_id long, text string, n_words long, n_removed long" + kinds
    return rows.join(spans, "doc_id", "left").mapInArrow(by_slice(work, "text"), schema)
