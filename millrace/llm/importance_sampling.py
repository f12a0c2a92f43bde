"""A quality classifier by importance resampling: two generative models of hashed byte n-grams, one of target texts and one of all texts,
give each document a log importance weight, and Gumbel top-k draws documents by weight without replacement.

Target rows are a bounded sample of those labelled good (``target_rows``, by a hash of the id); the raw model counts every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import in_slices, materialise, share_of
from millrace.shipping import ship

BUCKETS = 1 << 14
_BLOCK = 1 << 20


def ngram_counts(text: str | None) -> np.ndarray:
    """Occurrences of the hashed runs of two and three bytes of the whole text."""
    raw = (text or "").encode("utf-8", "replace")
    out = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, max(0, len(raw) - 1), _BLOCK):
        x = np.frombuffer(raw[at : at + _BLOCK + 2], dtype=np.uint8).astype(np.uint32)
        out += np.bincount((((x[:-1] << 8 | x[1:]) * np.uint32(2654435761)) >> np.uint32(18))[:_BLOCK], minlength=BUCKETS)
        if len(x) > 2:
            out += np.bincount((((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2246822519) ^ np.uint32(0x5BD1E995)) >> np.uint32(18))[:_BLOCK], minlength=BUCKETS)
    return out


def log_ratios(docs: DataFrame, target: DataFrame, id_col: str, text_col: str, target_rows: int = 20_000) -> np.ndarray:
    """log p(n-gram | target) - log p(n-gram | all) of each bucket; ``target`` has the ids of good documents in doc_id."""
    ship(docs.sparkSession)
    ids = target.select(F.col("doc_id").alias("_good")).filter("_good is not null").distinct()
    total = ids.count()
    if total > target_rows:
        ids = ids.filter(share_of(target_rows / total, "_good"))  # about target_rows at most
    marked = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("t")).join(F.broadcast(ids), F.col("_id") == F.col("_good"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, good = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            for g, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = ngram_counts(t)
                every += n
                if g:
                    good += n
        at = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(every[at]), pa.array(good[at])], names=["b", "n", "g"])

    found = marked.select(F.col("_good").isNotNull().alias("g"), "t").mapInArrow(in_slices(run), "b long, n long, g long").groupBy("b").agg(F.sum("n").alias("n"), F.sum("g").alias("g")).collect()
    every, good = np.full(BUCKETS, 0.5), np.full(BUCKETS, 0.5)
    for r in found:
        every[r.b] += r.n
        good[r.b] += r.g
    if good.sum() <= BUCKETS * 0.5:
        return np.zeros(BUCKETS)  # no target text: all alike
    return np.log(good / good.sum()) - np.log(every / every.sum())


def weigh(docs: DataFrame, ratios: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_grams, log_weight (summed) and mean_weight (a n-gram) of every row; a text without n-grams has a null mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, w = [], []
            for t in b.column(1).to_pylist():  # one text's counts at a time
                c = ngram_counts(t)
                n.append(int(c.sum()))
                w.append(float(c @ ratios))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(w, pa.float64()), pa.array([x / k if k else None for x, k in zip(w, n)], pa.float64())], names=["doc_id", "n_grams", "log_weight", "mean_weight"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("t")).mapInArrow(in_slices(run), f"doc_id {dict(docs.dtypes)[id_col]}, n_grams long, log_weight double, mean_weight double")


def cut_for_top(keys: DataFrame, k: int, small: int = 4096) -> float | None:
    """The k-th largest of the column ``key``, by histograms that each look into one bin of the one before; null where k is 0."""
    if k <= 0:
        return None
    rows, bins = keys.filter("key is not null"), 4096
    while True:
        low, high, n = rows.agg(F.min("key"), F.max("key"), F.count("*")).first()
        if n <= small or low == high:
            found = sorted((r.key for r in rows.orderBy(F.col("key").desc()).limit(min(k, small)).collect()), reverse=True) if low != high else [high]
            return found[min(k, len(found)) - 1] if found else None
        number = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit((high - low) / bins)), F.lit(bins - 1)).cast("int")
        counts = {r.b: r.n for r in rows.groupBy(number.alias("b")).agg(F.count("*").alias("n")).collect()}
        for b in sorted(counts, reverse=True):
            if k <= counts[b]:
                rows = rows.filter(number == b)
                break
            k -= counts[b]
        else:
            return low


def sample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = 0.85, seed: str = "gumbel", **options) -> DataFrame:
    """doc_id, n_grams, log_weight, mean_weight, key and selected of every row.

    ``key`` is log_weight, the log of p(text | target) / p(text | all), plus Gumbel noise from a seeded hash of the id (of a null id: of the
    row's place), so reruns agree; exactly round(``keep`` * rows) rows with the largest keys are selected, fewer only where fewer have a
    key: texts without n-grams (null, empty, one byte) have a null key and aren't selected. Of equal keys at the cut those of the
    lowest place in the table are selected; an empty table gives an empty one; without target text all weights are 0.
    """
    ratios = log_ratios(docs, target, id_col, text_col, **options)
    weighed = weigh(docs, ratios, id_col, text_col).withColumn("_place", F.monotonically_increasing_id())
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("_place").cast("string")))
    uniform = (F.pmod(F.xxhash64(name, F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    rows = materialise(weighed.withColumn("key", F.when(F.col("n_grams") > 0, F.col("log_weight") - F.log(-F.log(uniform)))), "weights")
    k = round(keep * rows.count())
    cut = cut_for_top(rows, k)
    if cut is None:
        return rows.withColumn("selected", F.lit(False)).drop("_place")
    above, ties = rows.agg(F.coalesce(F.sum((F.col("key") > cut).cast("long")), F.lit(0)), F.coalesce(F.sum((F.col("key") == cut).cast("long")), F.lit(0))).first()
    chosen = F.col("key") >= F.lit(cut)
    if above + ties > k:
        places = rows.filter(F.col("key") == cut).select((-F.col("_place")).alias("key"))
        chosen = (F.col("key") > F.lit(cut)) | (F.col("key") == F.lit(cut)) & (-F.col("_place") >= F.lit(cut_for_top(places, k - above)))
    return rows.withColumn("selected", F.coalesce(chosen, F.lit(False))).drop("_place")
