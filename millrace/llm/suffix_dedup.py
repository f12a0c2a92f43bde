"""Remove every byte that a string of ``length`` bytes covers which also starts earlier, by prefix-free parsing.

Parse: the least rolling hash among the ``trigger``-byte grams of a window of ``length`` bytes is its trigger; it depends on the
window's bytes alone. Windows with one trigger follow each other and make a phrase, which runs from the first of them to the end of the
last, so neighbouring phrases overlap and every window lies in one phrase. Two equal windows stand at the same offset from equal
triggers, so suffixes cut at ``length`` bytes are ordered within the phrases that share a trigger, and equal phrases make equal runs.

Corpus order: suffixes are ordered by (trigger, phrase, document, start). Of equal phrases all but the first are repeats, known from
the parse alone; within a block of documents this happens before anything is shuffled. Only where different phrases share a trigger
the suffix array of those dictionary phrases is built (by prefix doubling, cut at ``length`` bytes); the places of its equal suffixes in the
parse follow in corpus order (document, start), and the first stays. A trigger with very many different phrases is dealt suffix by suffix,
each under a key of its own. Phrases are compared by two independent 64-bit hashes, suffixes byte by byte.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import BASE, BASE2, in_slices, materialise, mix64, prefix_sums
from millrace.shipping import ship

LENGTH = 100
TRIGGER = 40
SEGMENT = 1 << 20


def phrases(data: np.ndarray, length: int = LENGTH, trigger: int = TRIGGER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The parse of one text: (trigger hash, phrase hash, first start, last start) of each phrase, in order."""
    out = []
    n, span = len(data), length - trigger + 1
    for base in range(0, max(1, n - length + 1), SEGMENT):
        part = data[base : base + SEGMENT + length - 1]
        if len(part) < length:
            break
        sums, inverse = prefix_sums(part, BASE)
        m = len(part) - trigger + 1
        gram = mix64((sums[trigger:] - sums[:m]) * inverse[:m])
        key = (gram >> np.uint64(21) << np.uint64(21)) | np.arange(m, dtype=np.uint64)
        least, width = key, 1
        while width * 2 <= span:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        head = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        last = np.concatenate((head[1:], [len(least)])) - 1
        at = (least[head] & np.uint64((1 << 21) - 1)).astype(np.int64)
        sums2, inverse2 = prefix_sums(part, BASE2)
        whole = mix64((sums2[last + length] - sums2[head]) * inverse2[head] + mix64((at - head).astype(np.uint64) << np.uint64(8) | (last - head).astype(np.uint64)))
        out.append((gram[at], whole, head + base, last + base))
    if not out:
        z = np.empty(0, dtype=np.uint64)
        return z, z, z.astype(np.int64), z.astype(np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


_BLOCK_BYTES = 24 << 20
_NULL_ID = (1 << 63) - 1


def _runs(doc: np.ndarray, v: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Merge the intervals of each (doc, v) where they overlap or touch."""
    if not len(doc):
        return doc, v, start, end
    order = np.lexsort((start, v, doc))
    doc, v, start, end = doc[order], v[order], start[order], end[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (v[1:] != v[:-1])))
    group = np.cumsum(new) - 1
    # the furthest end so far, within each document: ends lifted by the document's number stay in order across documents
    lift = group.astype(np.int64) << np.int64(40)
    far = np.maximum.accumulate(end + lift) - lift
    cut = new.copy()
    cut[1:] |= start[1:] > far[:-1]
    at = np.flatnonzero(cut)
    stop = np.concatenate((at[1:], [len(doc)])) - 1
    return doc[at], v[at], start[at], far[stop]


_PARSED = "kind byte, a long, h long, doc long, v long, place long"


def _batch(kind: int, a, h, doc, v, place) -> pa.RecordBatch:
    n = len(doc)
    fill = lambda x: x if isinstance(x, np.ndarray) else np.full(n, x, dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, dtype=np.int8)), *(pa.array(fill(x).view(np.int64)) for x in (a, h, doc, v, place))], names=["kind", "a", "h", "doc", "v", "place"])


def _removed(doc: np.ndarray, v: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0: a removed run; its start stands in h and its end in place, and a spreads the rows."""
    doc, v, start, end = _runs(doc, v, start, end)
    if len(doc):
        yield _batch(0, mix64(doc.view(np.uint64)), start, doc, v, end)


def _parse(length: int, trigger: int):
    """(doc, text) to rows of kind 0 (repeats within a block of documents) and of kind 1 (first phrases of the block)."""

    def block(rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        parts = []
        for doc, raw in rows:
            a, h, first, last = phrases(np.frombuffer(raw, dtype=np.uint8), length, trigger)
            parts.append((a, h, np.full(len(a), doc, dtype=np.int64), np.full(len(a), zlib.crc32(raw), dtype=np.int64), first, last))
        a, h, doc, v, first, last = (np.concatenate(x) for x in zip(*parts))
        if not len(a):
            return
        order = np.lexsort((first, doc, a, h))
        a, h, doc, v, first, last = (x[order] for x in (a, h, doc, v, first, last))
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (a[1:] != a[:-1])))
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (doc != doc[lead]) | (first != first[lead])
        yield from _removed(doc[later], v[later], first[later], last[later] + length)
        keep = np.flatnonzero(~later)
        keep = keep[np.lexsort((first[keep], doc[keep]))]
        yield _batch(1, a[keep], h[keep], doc[keep], v[keep], first[keep] << np.int64(8) | (last - first)[keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, load = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = (text or "").encode("utf-8", "replace")
                rows.append((doc, raw))
                load += len(raw)
                if load > _BLOCK_BYTES:
                    yield from block(rows)
                    rows, load = [], 0
        if rows:
            yield from block(rows)

    return run


def _order(length: int):
    """Rows sorted by (a, h, doc, place): repeats become kind 0; first phrases whose trigger has others become kind 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a0 = h0 = None
        lead0 = (0, 0)
        many0, held = False, None
        for batch in batches:
            kind = batch.column(0).to_numpy()
            cols = [batch.column(k).to_numpy() for k in range(1, 6)]
            if (kind == 0).any():
                done = kind == 0
                yield _batch(0, *(c[done] for c in cols))
                cols = [c[~done] for c in cols]
            a, h, doc, v, place = cols
            if not len(a):
                continue
            first = place >> np.int64(8)
            goes_on = a0 is not None and a[0] == a0
            new_a = np.concatenate(([not goes_on], a[1:] != a[:-1]))
            new_h = new_a.copy()
            new_h[1:] |= h[1:] != h[:-1]
            new_h[0] = not (goes_on and h[0] == h0)
            run_of = np.cumsum(new_h)  # 0: the phrase that goes on from the batch before
            at = np.flatnonzero(new_h)
            lead_doc = np.concatenate(([lead0[0]], doc[at]))[run_of]
            lead_first = np.concatenate(([lead0[1]], first[at]))[run_of]
            later = (doc != lead_doc) | (first != lead_first)
            yield from _removed(doc[later], v[later], first[later], (first + (place & 255) + length)[later])
            group = np.cumsum(new_a)  # 0: the trigger that goes on
            kinds = np.bincount(group, weights=new_h, minlength=group[-1] + 1)
            if goes_on:
                kinds[0] += 2 if many0 else 1
            elif held is not None:
                held = None
            open_ = ~later & (kinds[group] > 1)
            if goes_on and not many0 and kinds[0] > 1 and held is not None:
                yield _batch(2, *held)
            if open_.any():
                yield _batch(2, a[open_], h[open_], doc[open_], v[open_], place[open_])
            last = group[-1]
            if kinds[last] > 1:
                held = None
            else:
                mine = (group == last) & ~later
                own = [c[mine] for c in (a, h, doc, v, place)]
                held = [np.concatenate(x) for x in zip(held, own)] if goes_on and last == 0 and held is not None else own
            a0, h0, lead0, many0 = a[-1], h[-1], (lead_doc[-1], lead_first[-1]), kinds[last] > 1

    return run


def _contents(length: int, most_phrases: int):
    """(doc, v, text, phrases of it) to rows (key, doc, v, start, bytes): a phrase under its trigger, or, of a trigger with too many
    phrases, each of its suffixes under its own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, docs, vs, starts, pieces = [], [], [], [], []
            for doc, v, text, wanted in zip(*(batch.column(k).to_pylist() for k in range(4))):
                raw = (text or "").encode("utf-8", "replace")
                for w in wanted:
                    start, size = w["place"] >> 8, w["place"] & 255
                    data = raw[start : start + size + length]
                    if w["n"] <= most_phrases:
                        rows = [(w["a"], start, data)]
                    else:
                        rows = [(int.from_bytes(hashlib.blake2b(data[k : k + length], digest_size=8).digest(), "big", signed=True), start + k, data[k : k + length]) for k in range(size + 1)]
                    for key, s, d in rows:
                        keys.append(key)
                        docs.append(doc)
                        vs.append(v)
                        starts.append(s)
                        pieces.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(docs, pa.int64()), pa.array(vs, pa.int64()), pa.array(starts, pa.int64()), pa.array(pieces, pa.binary())], names=["key", "doc", "v", "start", "bytes"])

    return run


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """The place of each suffix among all suffixes of ``data`` in the order of their first ``length`` bytes: equal places are equal strings.
    Suffixes shorter than that get a place without meaning. By prefix doubling: ranks of w bytes give those of 2 w."""
    n, width = len(data), 1 << min(3, length.bit_length() - 1)
    padded = np.concatenate((data, np.zeros(length, dtype=np.uint8)))
    key = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        key <<= np.uint64(8)
        key |= padded[k : n + k]
    while True:
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
        if width == length:
            return rank
        step = min(width, length - width)
        key = rank * np.int64(n)
        key[: max(0, n - step)] += rank[step:]
        width += step


def _suffixes(length: int):
    """Phrases sorted by key: the suffix array of the phrases of some keys; all but the first of equal suffixes are repeats. Equal strings of
    ``length`` bytes have one trigger and so one key, which is never cut."""

    def solve(keys: list, docs: list, vs: list, starts: list, pieces: list) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(p) for p in pieces])
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        windows = sizes - length + 1
        of = np.repeat(np.arange(len(sizes)), windows)
        k = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = np.repeat(np.cumsum(sizes) - sizes, windows) + k
        rank = suffix_ranks(data, length)[at]
        some = np.flatnonzero(np.bincount(rank)[rank] > 1)
        if not len(some):
            return
        rank, of, k = rank[some], of[some], k[some]
        doc, v, start = np.array(docs, dtype=np.int64)[of], np.array(vs, dtype=np.int64)[of], np.array(starts, dtype=np.int64)[of] + k
        order = np.lexsort((start, doc, rank))
        rank, doc, v, start = rank[order], doc[order], v[order], start[order]
        new = np.concatenate(([True], rank[1:] != rank[:-1]))
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (doc != doc[lead]) | (start != start[lead])
        yield from _removed(doc[later], v[later], start[later], start[later] + length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = [[], [], [], [], []]
        load = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if load > 1 << 19 and row[0] != rows[0][-1]:
                    yield from solve(*rows)
                    rows, load = [[], [], [], [], []], 0
                for column, x in zip(rows, row):
                    column.append(x)
                load += len(row[4])
        if rows[0]:
            yield from solve(*rows)

    return run


def removed_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, trigger: int = TRIGGER, most_phrases: int = 10_000) -> DataFrame:
    """(doc, v, runs): the removed byte runs [s, e) of the documents that have any; v is the CRC-32 of the text, which tells rows of one id apart."""
    ship(docs.sparkSession)
    keyed = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(_NULL_ID)).alias("doc"), docs[text_col].cast("string").alias("text"))
    parsed = keyed.mapInArrow(in_slices(_parse(length, trigger)), _PARSED)
    ordered = materialise(parsed.repartition("a").sortWithinPartitions("a", "h", "doc", "place").mapInArrow(in_slices(_order(length), 1 << 16), _PARSED), "ordered")
    open_ = ordered.filter("kind = 2").select("a", "doc", "v", "place")
    counts = open_.groupBy("a").agg(F.count("*").alias("n"))
    wanted = open_.join(counts, "a").groupBy("doc", "v").agg(F.collect_list(F.struct("a", "place", "n")).alias("wanted"))
    texts = keyed.withColumn("v", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    contents = wanted.join(texts, ["doc", "v"]).select("doc", "v", "text", "wanted").mapInArrow(in_slices(_contents(length, most_phrases)), "key long, doc long, v long, start long, bytes binary")
    sorted_ = contents.repartition("key").sortWithinPartitions("key").mapInArrow(in_slices(_suffixes(length), 1 << 13), _PARSED)
    runs = ordered.filter("kind = 0").unionByName(sorted_).select("doc", "v", F.struct(F.col("h").alias("s"), F.col("place").alias("e")).alias("run"))
    return runs.groupBy("doc", "v").agg(F.collect_list("run").alias("runs"))


def _cut(raw: bytes, runs: list | None) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal runs removed)."""
    if not runs:
        return raw, 0, 0
    kept, at, gone, spans = [], 0, 0, 0
    end = -1
    for s, e in sorted((r["s"], r["e"]) for r in runs):
        if s > end:
            spans += 1
            kept.append(raw[at:s])
            gone += e - s
            at = end = e
        elif e > end:
            gone += e - end
            at = end = e
    kept.append(raw[at:])
    return b"".join(kept), gone, spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows with n_bytes, n_removed, n_spans, kept (the bytes left, joined) and kept_text (those bytes without the parts of characters
    that lost some) appended; columns of these names are replaced.

    A null text counts as empty and keeps nothing; texts shorter than ``length`` bytes stay whole. Rows that share an id are one document:
    what they have at the same start isn't earlier in either. A null id comes after all others. Nothing crosses documents.
    """
    names = ("n_bytes", "n_removed", "n_spans", "kept", "kept_text")
    docs = docs.drop(*names)
    runs = removed_runs(docs, id_col, text_col, **options)
    own = docs.columns
    plain = docs.toDF(*(f"in_{k}" for k in range(len(own))))
    i, t = f"in_{own.index(id_col)}", f"in_{own.index(text_col)}"
    plain = plain.withColumns({"doc": F.coalesce(F.col(i).cast("long"), F.lit(_NULL_ID)), "v": F.crc32(F.coalesce(F.col(t).cast("string"), F.lit("")).cast("binary"))})
    joined = plain.join(runs, ["doc", "v"], "left").select(*plain.columns[: len(own)], "runs")
    at = own.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [(x or "").encode("utf-8", "replace") for x in batch.column(at).cast(pa.string()).to_pylist()]
            cut = [_cut(raw, r) for raw, r in zip(raws, batch.column(len(own)).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array([len(x) for x in raws], pa.int64()), pa.array([x[1] for x in cut], pa.int64()), pa.array([x[2] for x in cut], pa.int64()), pa.array([x[0] for x in cut], pa.binary()), pa.array([x[0].decode(errors="ignore") for x in cut], pa.string())], names=[*own, *names])

    fields = [T.StructField(n, k) for n, k in zip(names, (T.LongType(), T.LongType(), T.LongType(), T.BinaryType(), T.StringType()))]
    return joined.mapInArrow(in_slices(run), T.StructType([*docs.schema.fields, *fields]))
