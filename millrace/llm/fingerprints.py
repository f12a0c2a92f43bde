"""Bottom-k sketches of word shingles; DataFrame operations only.

A fingerprint is the sorted array of the k smallest distinct 64-bit hashes of a text's shingles of five words (the whole sequence as
one where there are fewer words). Sketches of parts merge into the sketch of the whole, and estimate resemblance, containment and the
number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialise

SHINGLE = 5
K = 128
_BREAK = r"[\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, not wherever the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sketch(text: Column, k: int = K, n: int = SHINGLE) -> Column:
    """array<bigint>; a null text counts as empty, a text without words has an empty sketch."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), _BREAK, -1), lambda w: w != "")

    def shingles(h: Column) -> Column:
        whole = F.array(F.aggregate(h, F.lit(42).cast("long"), lambda a, x: F.xxhash64(a, x)))
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - F.lit(n - 1), F.lit(1))), lambda i: F.xxhash64(*(F.get(h, i + F.lit(j - 1)) for j in range(n))))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < n, whole).otherwise(F.slice(F.sort_array(F.array_distinct(runs)), 1, k))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), shingles)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated intersection over union, 0 to 1: the share of the merged sketch that both have. Two empty sets are alike."""
    both = _let(merge(a, b, k), lambda m: F.size(F.array_intersect(m, F.array_intersect(a, b))) / F.greatest(F.size(m), F.lit(1)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both.cast("double"))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    top = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / F.greatest(top, F.lit(1e-18)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    j = resemblance(a, b, k)
    union = distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * union / F.greatest(distinct_shingles(a, k), F.lit(1.0))))


def merged_sketch(rows: DataFrame, group: list[str], sketch_col: str, k: int = K) -> DataFrame:
    """The sketch of each group's rows together. A salt keeps at most k hashes of each part of a hot group before the parts meet."""
    one = rows.select(*group, F.pmod(F.xxhash64(F.col(sketch_col).cast("string")), F.lit(64)).alias("_salt"), F.explode(sketch_col).alias("_h")).distinct()
    ranked = one.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_salt").orderBy("_h"))).filter(F.col("_r") <= k)
    return ranked.groupBy(*group).agg(F.slice(F.sort_array(F.collect_set("_h")), 1, k).alias(sketch_col))


def text_form(a: Column) -> Column:
    """16 hexadecimal digits a hash, in order."""
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def edited(text: Column, following: Column) -> Column:
    """The text whose last quarter (rounded down) of code points gives way to as many first ones of the following text, or all."""
    n = F.char_length(text)
    cut = F.floor(n / F.lit(4)).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the value, by nested comparisons as deep as the logarithm of their number."""
    def part(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value >= F.lit(bounds[mid]), part(mid + 1, high)).otherwise(part(low, mid))

    return part(0, len(bounds))


def _dealt(rows: DataFrame, rows_a_bucket: int, most_ranges: int) -> DataFrame:
    """``rows`` with ``_range`` and ``_bucket``, both ascending with the id (nulls first), equal ids together.

    Ranges lie between quantiles of the ids and are at most ``most_ranges``, as they are part of an expression; each is cut into equal steps of
    the id, whose number follows the table, so buckets stay near ``rows_a_bucket`` rows at any size where ids are spread evenly inside a range.
    """
    n = rows.count()
    ranges = max(1, min(most_ranges, n // rows_a_bucket))
    steps = max(1, n // (rows_a_bucket * ranges))
    quantiles = F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 50_000) if ranges > 1 else F.lit(None)
    found = rows.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), quantiles.alias("cuts")).first()
    if found.low is None:
        return rows.withColumns({"_range": F.lit(0), "_bucket": F.lit(0).cast("long")})
    cuts = sorted({c for c in found.cuts or [] if c > found.low})
    edges = [found.low, *cuts, found.high + 1]
    at = _bucket(F.col("doc_id"), cuts)
    low, width = (F.get(F.array(*(F.lit(float(x)) for x in xs)), at) for xs in (edges[:-1], [b - a for a, b in zip(edges, edges[1:])]))
    step = F.least(F.lit(steps - 1), F.floor((F.col("doc_id").cast("double") - low) / width * F.lit(steps))).cast("long") if steps > 1 else F.lit(0).cast("long")
    known = F.col("doc_id").isNotNull()
    rows = rows.withColumn("_range", F.when(known, at + F.lit(1)).otherwise(F.lit(0)))
    return rows.withColumn("_bucket", F.when(known, F.col("_range").cast("long") * F.lit(steps) + step).otherwise(F.lit(0).cast("long")))


def _with_heads(rows: DataFrame) -> DataFrame:
    """``rows`` and, marked by ``_halo``, the first row of each bucket once more in the bucket before it (that of the first in the last)."""
    one = rows.groupBy("_range", "_bucket").agg(F.min("doc_id").alias("_first"))
    ends = one.groupBy("_range").agg(F.max("_bucket").alias("_end"))  # a row a range, so few
    all_ends = Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(F.col("_range").alias("_r"), F.coalesce(F.lag("_end").over(Window.partitionBy().orderBy("_range")), F.last("_end").over(all_ends)).alias("_end"))
    before = F.lag("_bucket").over(Window.partitionBy("_range").orderBy("_bucket"))
    one = one.withColumn("_before", before).join(ends, F.col("_range") == F.col("_r")).select(F.col("_bucket").alias("_b"), "_first", F.coalesce("_before", "_end").alias("_to"))
    one = materialise(one, "heads")  # a written table has a known size, so that texts are only shuffled for this join where it is too large to broadcast
    heads = rows.join(one, (F.col("_bucket") == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("_first")))
    heads = heads.groupBy("_bucket", "_to").agg(F.min(F.struct("doc_id", "text")).alias("m"))
    heads = heads.select("m.doc_id", "m.text", F.col("_to").alias("_bucket"), F.lit(True).alias("_halo"))
    return rows.select("doc_id", "text", "_bucket", F.lit(False).alias("_halo")).unionByName(heads)


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, rows_a_bucket: int = 4000, most_ranges: int = 1024) -> DataFrame:
    """Fingerprints of every text, of its edited text and their likeness, and the likeness to the next document's.

    The next document has the next id in ascending order (nulls first, equal ids by text; after the last comes the first). Ids are cut
    into buckets (see ``_dealt``); each also gets the first row of the next one, so no task orders more than a bucket, but for rows of one
    id or of none, which stay together. Only quantiles of the ids reach the driver. A null text is empty; one document alone is its own
    next; an empty table gives an empty one.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    rows = _with_heads(_dealt(rows, rows_a_bucket, most_ranges))
    run = Window.partitionBy("_bucket").orderBy("_halo", F.col("doc_id").asc_nulls_first(), "text")
    rows = rows.withColumn("_next", F.lead("text").over(run))
    rows = rows.withColumn("_edited", edited(F.col("text"), F.coalesce("_next", F.lit(""))))
    rows = rows.withColumns({"_own": sketch(F.col("text"), k), "_changed": F.when(~F.col("_halo"), sketch(F.col("_edited"), k))})
    rows = rows.withColumn("_after", F.lead("_own").over(run)).filter(~F.col("_halo"))
    return rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), text_form(F.col("_own")).alias("fingerprint"), text_form(F.col("_changed")).alias("edited_fingerprint"),
        resemblance(F.col("_own"), F.col("_changed"), k).alias("near_edited"), resemblance(F.col("_own"), F.col("_after"), k).alias("near_next"),
    )
