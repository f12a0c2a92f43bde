"""Language identification by the nearest of several clustered centroids a language.

A text becomes a vector of hashed byte n-grams (two and three bytes of its lower-cased text, all but letters as one blank), weighted
by (1 + log tf) * idf and scaled to length 1. Document frequencies are counted over all learning rows. Centroids come from spherical
k-means within each language over all its learning rows, which starts from the clusters of some of them (``sample_per_language``, by a
hash of the id). A text gets the language of the centroid of highest cosine. Cosines grow with the number of different n-grams a text
has, so each language has a floor for every power of two of that number, from all learning texts and their beginnings held against
centroids without the text itself; a text below its floor is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex as re
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import in_slices, share_bound
from millrace.shipping import ship

BUCKETS = 1 << 14
LETTER = re.compile(r"\p{L}")
_BLANKED = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_BLOCK = 1 << 20
_SHORT = 2048
_LEVELS = BUCKETS.bit_length()
#: Sums of vectors are of whole steps, so that they don't depend on the order of tasks.
_STEP, _CELL, _COSINES = 1 << 20, 1 << 12, 1 << 14


def has_letter(text: str | None) -> bool:
    return text is not None and LETTER.search(text) is not None


def _plain(text: str) -> bytes:
    """The lower-cased text, all but letters as one blank, between blanks."""
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_BLANKED).split()) + b" "


def _terms(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the n-grams of two and of three bytes, in order."""
    x = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    two = ((x[:-1] << 8 | x[1:]) * np.uint32(2654435761)) >> np.uint32(18)
    return two, ((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2246822519) ^ np.uint32(0x5BD1E995)) >> np.uint32(18)


def term_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the whole text's n-grams and how often they occur, block by block so that memory doesn't follow its length."""
    raw = _plain(text)
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, len(raw) - 1, _BLOCK):
        for terms in _terms(raw[at : at + _BLOCK + 2]):
            counts += np.bincount(terms[:_BLOCK], minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found]


def beginnings_counts(text: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(buckets, counts, where each beginning's start) of the ``beginnings``: of short ones together, of a long one alone."""
    parts, whole, own = [], None, _terms(_plain(text[: _SHORT + 1]))
    for head in beginnings(text):
        if len(head) > _SHORT:
            at, counts = term_counts(head)
            yield at, counts, np.zeros(1, dtype=np.int64)
            continue
        if whole is None:
            whole = _plain(text[: _SHORT + 1])
        raw = _plain(head)
        two, three = (own[0][: len(raw) - 1], own[1][: len(raw) - 2]) if whole.startswith(raw) else _terms(raw)
        parts += [two | np.uint32(len(parts) // 2 << _LEVELS - 1), three | np.uint32(len(parts) // 2 << _LEVELS - 1)]
    if parts:
        keys = np.sort(np.concatenate(parts))
        new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        counts, keys = np.diff(np.append(new, len(keys))), keys[new]
        head = keys >> np.uint32(_LEVELS - 1)
        yield keys & np.uint32(BUCKETS - 1), counts, np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1])))


def beginnings(text: str) -> Iterator[str]:
    """The text and its first 2, 4, 8, ... characters, cut after whole words where one ends there, that have a letter."""
    size = 2
    while size < len(text):
        head = text[:size].rsplit(None, 1)
        if head and has_letter(head[0]):
            yield head[0]
        size *= 2
    yield text


def level(terms: int) -> int:
    """The power of two in the number of a text's different n-grams."""
    return max(1, int(terms)).bit_length() - 1


def weights(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the text's vector that aren't zero, and their values."""
    at, counts = term_counts(text)
    v = (1 + np.log(counts.astype(np.float32))) * idf[at]
    norm = float(np.sqrt(v @ v))
    return at, v / np.float32(norm) if norm > 0 else v


def vector(text: str, idf: np.ndarray) -> np.ndarray:
    at, v = weights(text, idf)
    out = np.zeros(BUCKETS, dtype=np.float32)
    out[at] = v
    return out


@dataclass
class LanguageModel:
    """Rows of ``centroids`` have length 1; ``languages`` and ``least`` (by level, the lowest cosine that isn't rejected) go row by row."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    least: np.ndarray

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """(language, cosine, rejected) of each text; a text without a letter is ``und``, 0 and rejected."""
        names, scores, rejected = [], [], []
        for start in range(0, len(texts), 64):
            block = texts[start : start + 64]
            there = [has_letter(t) for t in block]
            if not self.languages:
                names += ["und"] * len(block)
                scores += [0.0] * len(block)
                rejected += [True] * len(block)
                continue
            x = np.stack([vector(t, self.idf) if ok else np.zeros(BUCKETS, dtype=np.float32) for t, ok in zip(block, there)])
            cosine = x @ self.centroids.T
            best = cosine.argmax(axis=1)
            for k, ok in enumerate(there):
                c = float(min(1.0, max(0.0, cosine[k, best[k]]))) if ok else 0.0
                names.append(self.languages[best[k]] if ok else "und")
                scores.append(c)
                rejected.append(not ok or c < self.least[best[k], level(np.count_nonzero(x[k]))])
        return names, scores, rejected


def _clustered(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from seeds chosen farthest first; no random choices."""
    seeds = [int((x @ x.mean(axis=0)).argmax())]
    while len(seeds) < min(k, len(x)):
        far = (x @ x[seeds].T).max(axis=1)
        seeds.append(int(far.argmin()))
    c = x[seeds].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (near == j).any():
                m = x[near == j].mean(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-9)
    return c


def _summed(rows: DataFrame, clustered: dict[str, np.ndarray], idf: np.ndarray) -> dict[str, np.ndarray]:
    """The sums of the vectors of all rows (t, l), each at the nearest centroid of its language."""
    given = rows.sparkSession.sparkContext.broadcast({name: c.T.copy() for name, c in clustered.items()})
    first = dict(zip(clustered, np.cumsum([0, *(len(c) for c in clustered.values())])))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, sums = zstandard.ZstdCompressor(level=1), {}
        for b in batches:
            for t, l in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if has_letter(t):
                    at, v = weights(t, idf)
                    k = int(first[l]) + int((v @ given.value[l][at]).argmax())
                    if k not in sums:
                        sums[k] = np.zeros(BUCKETS, dtype=np.int64)
                    sums[k][at] += np.round(v * np.float32(_STEP)).astype(np.int64)
        for k, found in sums.items():
            parts = found.reshape(-1, _CELL)
            keys = k * len(parts) + np.arange(len(parts))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([pack.compress(p.tobytes()) for p in parts], pa.binary())], names=["k", "v"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by k: their sums."""
        unpack, last, total = zstandard.ZstdDecompressor(), None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["k", "v"])
        for k, v in (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            if k != last and last is not None:
                yield done()
            part = np.frombuffer(unpack.decompress(v), dtype=np.int64)
            last, total = k, total + part if k == last else part
        if last is not None:
            yield done()

    cells = rows.select("t", "l").mapInArrow(in_slices(add), "k long, v binary")
    out = np.zeros((sum(len(c) for c in clustered.values()), BUCKETS // _CELL, _CELL))
    for r in cells.repartition("k").sortWithinPartitions("k").mapInArrow(in_slices(together), "k long, v binary").collect():
        out[divmod(r.k, BUCKETS // _CELL)] = np.frombuffer(r.v, dtype=np.int64) / _STEP
    given.unpersist()
    out = out.reshape(-1, BUCKETS).astype(np.float32)
    return {name: out[first[name] : first[name] + len(c)] for name, c in clustered.items()}


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", clusters: int = 4, sample_per_language: int = 1200, slack: float = 0.5, rounds: int = 1) -> LanguageModel:
    """Learn from the rows where ``learn`` holds, the language isn't null and the text has a letter.

    ``sample_per_language`` bounds the rows whose clusters a language's centroids start from; each of ``rounds`` passes (one at least) deals
    all its learning rows to the nearest centroid and takes their mean. Document frequencies and floors cover all learning rows. ``slack``: a text is rejected below this share of the lowest cosine (its 0.5 % quantile) that the language's texts of as many
    different n-grams, or more, show in learning; texts of more n-grams than any of them are held to the last floor. A language of one
    learning row has no floor. Without learning rows the model knows no language and every text is ``und``.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.filter(learn & docs[lang_col].isNotNull() & docs[text_col].isNotNull()).select(docs[id_col].cast("string").alias("i"), docs[text_col].cast("string").alias("t"), docs[lang_col].cast("string").alias("l"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total, langs = np.zeros(BUCKETS, dtype=np.int64), 0, {}
        for b in batches:
            for t, l in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if has_letter(t):
                    found[term_counts(t)[0]] += 1
                    total += 1
                    langs[l] = langs.get(l, 0) + 1
        if total:
            at = np.flatnonzero(found)
            keys = [*(f"g{k}" for k in at), *(f"l{k}" for k in langs)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([*found[at].tolist(), *langs.values()], pa.int64())], names=["k", "n"])

    counted = rows.select("t", "l").mapInArrow(in_slices(frequencies), "k string, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    sizes = {r.k[1:]: r.n for r in counted if r.k[0] == "l"}
    total = sum(sizes.values())
    df = np.zeros(BUCKETS)
    for r in counted:
        if r.k[0] == "g":
            df[int(r.k[1:])] = r.n
    idf = np.log((1 + total) / (1 + df)).astype(np.float32) + np.float32(0.1)
    if not total:
        return LanguageModel(idf, np.zeros((0, BUCKETS), dtype=np.float32), [], np.zeros((0, _LEVELS)))
    bound = share_bound(0.0)
    for name, n in sizes.items():
        bound = F.when(F.col("l") == name, share_bound(sample_per_language / n)).otherwise(bound)
    picked = rows.filter(F.xxhash64("i", F.lit("centroids")) <= bound).select("t", "l")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [(l, vector(t, idf)) for t, l in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if has_letter(t)]
            at = [np.flatnonzero(v) for _, v in keep]
            yield pa.RecordBatch.from_arrays([pa.array([l for l, _ in keep], pa.string()), pa.array([a.astype(np.uint16).tobytes() for a in at], pa.binary()), pa.array([v[a].astype(np.float16).tobytes() for (_, v), a in zip(keep, at)], pa.binary())], names=["l", "at", "v"])

    sample = sorted(picked.mapInArrow(in_slices(vectors), "l string, at binary, v binary").collect())
    clustered = {}
    for name in sorted(sizes):
        own = [r for r in sample if r.l == name]
        x = np.zeros((len(own), BUCKETS), dtype=np.float32)
        for k, r in enumerate(own):
            x[k, np.frombuffer(r.at, dtype=np.uint16)] = np.frombuffer(r.v, dtype=np.float16)
        clustered[name] = _clustered(x, clusters).astype(np.float32) if own else np.zeros((1, BUCKETS), dtype=np.float32)
    del sample
    for _ in range(rounds):
        starts, sums = clustered, _summed(rows, clustered, idf)
        clustered = {name: np.stack([m / np.float32(np.linalg.norm(m)) if m.any() else c for c, m in zip(starts[name], sums[name])]) for name in starts}
    given = spark.sparkContext.broadcast({name: (starts[name].T.copy(), clustered[name].T.copy(), sums[name].T.copy(), np.square(sums[name]).sum(axis=1)) for name in starts})

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(language, level, cosine in steps, number) of the texts and their beginnings, with the text itself taken out of its centroid."""
        found: dict[tuple, int] = {}
        mine = np.zeros(BUCKETS, dtype=np.float32)
        for b in batches:
            for t, l in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not has_letter(t):
                    continue
                first, last, summed, squares = given.value[l]
                at, v = weights(t, idf)
                j = int((v @ first[at]).argmax())
                size = float(np.sqrt(max(0.0, squares[j] - 2 * float(v @ summed[at, j]) + float(v @ v))))
                if size <= 1e-2 and not np.delete(last, j, axis=1).any():
                    continue
                mine[at] = v
                for some, counts, starts in beginnings_counts(t):
                    x = (1 + np.log(counts.astype(np.float32))) * idf[some]
                    norms = np.sqrt(np.add.reduceat(x * x, starts))
                    cosine = np.add.reduceat(last[some] * x[:, None], starts)
                    cosine[:, j] = np.add.reduceat(x * (summed[some, j] - mine[some]), starts) / size if size > 1e-2 else 0
                    top = cosine.max(axis=1) / np.maximum(norms, 1e-9)
                    for n, c in zip(np.diff(np.append(starts, len(some))).tolist(), (top * _COSINES).astype(np.int64).tolist()):
                        key = (l, level(n), c)
                        found[key] = found.get(key, 0) + 1
                mine[at] = 0
        yield pa.RecordBatch.from_arrays([*(pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int32()))), pa.array(list(found.values()), pa.int64())], names=["l", "level", "step", "n"])

    steps = rows.select("t", "l").mapInArrow(in_slices(cosines), "l string, level int, step int, n long").groupBy("l", "level", "step").agg(F.sum("n").alias("n"))
    upto, every = Window.partitionBy("l", "level").orderBy("step"), Window.partitionBy("l", "level")
    lowest = steps.select("l", "level", "step", F.sum("n").over(upto).alias("upto"), F.sum("n").over(every).alias("every")).filter(F.col("upto") > 0.005 * (F.col("every") - 1)).groupBy("l", "level").agg((F.min("step") / _COSINES).alias("low")).collect()
    given.unpersist()
    groups, names = clustered, [name for name in clustered for _ in clustered[name]]
    centroids = [c for name in clustered for c in clustered[name]]
    floors = {name: np.full(_LEVELS, np.inf) for name in groups}
    for r in lowest:
        floors[r.l][r.level] = slack * r.low
    for floor in floors.values():
        seen = np.flatnonzero(np.isfinite(floor))
        floor[seen[-1] + 1 if len(seen) else 0 :] = floor[seen[-1]] if len(seen) else 0.0
        floor[:] = np.minimum.accumulate(floor[::-1])[::-1]
    return LanguageModel(idf, np.stack(centroids).astype(np.float32), names, np.stack([floors[n] for n in names]))


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows with lang_pred, lang_score and lang_rejected appended (columns of these names are replaced); one pass, no shuffle."""
    ship(docs.sparkSession)
    docs = docs.drop("lang_pred", "lang_score", "lang_rejected")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, s, r = model.judge(b.column(at).cast(pa.string()).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.string()), pa.array(s, pa.float64()), pa.array(r, pa.bool_())], names=[*b.schema.names, "lang_pred", "lang_score", "lang_rejected"])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_rejected", T.BooleanType())])
    return docs.mapInArrow(in_slices(run), schema)
