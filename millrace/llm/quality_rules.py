"""A ledger of quality rules: each rule is measured once a document, its failure is one bit, and policies read the bits.

``measure`` makes the ledger: measurements and the bit mask of failed rules. A policy names the rules that count; its verdict is
``mask & policy = 0``, so a new policy version needs no second look at the texts. ``ablation`` tells, for each rule of a policy, how
many documents it fails alone and together with others, by bitwise aggregation of the masks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import in_slices, shingle_hashes, word_bounds, word_hashes
from millrace.shipping import ship

WINDOW = 8
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_START = np.ones(256, dtype=bool)
_START[128:192] = False  # bytes that continue a code point

#: Rules in the order of their bits: (name, SQL condition of failure over the measurements). Bits never change their meaning.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("few_letters", "100 * n_alpha_words < 60 * n_words"),
    ("capitals", "2 * n_upper_words > n_words"),
]
#: Policy versions: the rules that count in each.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "short_words", "long_words", "symbols", "duplicate_lines", "few_letters", "capitals"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_alpha_words", "n_upper_words")


def bits(rules: tuple[str, ...]) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(r) for r in rules)


def measurements(text: str) -> tuple[int, ...]:
    """The values of MEASURES for one whole text."""
    raw = text.encode("utf-8", "replace")
    data = np.frombuffer(raw, dtype=np.uint8)
    start, end = word_bounds(data)
    n = len(start)
    symbols = int(_SYMBOL[data].sum())
    if not n:
        return 0, 0, symbols, 0, 0, 0, 0, 0
    edges = np.stack((start, end), axis=1).ravel()[: 2 * n - 1]  # the last word runs to the end, behind which there is only white space

    def in_words(marks: np.ndarray) -> np.ndarray:
        return np.add.reduceat(marks[: end[-1]], edges, dtype=np.int64)[::2]

    chars = int(in_words(_START[data]).sum())
    big = in_words((data >= 65) & (data <= 90))
    small = in_words((data >= 128) | (data >= 97) & (data <= 122))
    alpha, upper = int((big + small > 0).sum()), int(((big > 1) & (small == 0)).sum())
    repeated = 0
    if n >= WINDOW:
        h = shingle_hashes(word_hashes(raw), WINDOW)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        if same.any():
            twice = np.zeros(len(h), dtype=bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            cover = np.zeros(n + 1, dtype=np.int64)
            at = np.flatnonzero(twice)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + WINDOW, -1)
            repeated = int((np.cumsum(cover[:n]) > 0).sum())
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return n, chars, symbols, len(lines) - len(set(lines)), len(lines), repeated, alpha, upper


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger: doc_id, MEASURES and ``mask``, one row an input row, from one pass without a shuffle.

    A null text has no words and fails ``few_words``; repeated rows are measured each; other columns are not looked at.
    """
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([measurements(t or "") for t in b.column(1).to_pylist()], dtype=np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(found[:, k]) for k in range(len(MEASURES)))], names=["doc_id", *MEASURES])

    out = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("t")).mapInArrow(in_slices(run), f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    mask = F.lit(0)
    for k, (_, condition) in enumerate(RULES):
        mask = mask.bitwiseOR(F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)))
    return out.withColumn("mask", mask)


def apply_policy(ledger: DataFrame, policy: str) -> DataFrame:
    """The ledger with ``kept``: whether no rule of the policy failed."""
    return ledger.withColumn("kept", F.col("mask").bitwiseAND(F.lit(bits(POLICIES[policy]))) == 0)


def ablation(ledger: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents it fails, documents that only it fails, documents kept without it. One pass."""
    mine = bits(POLICIES[policy])
    m = F.col("mask").bitwiseAND(F.lit(mine))
    names = POLICIES[policy]
    sums = ledger.agg(F.count("*").alias("n"), F.sum((m == 0).cast("long")).alias("kept"), *(F.sum((m.bitwiseAND(F.lit(bits((r,)))) != 0).cast("long")).alias(f"f_{r}") for r in names), *(F.sum((m == bits((r,))).cast("long")).alias(f"o_{r}") for r in names))
    rows = F.array(*(F.struct(F.lit(r).alias("rule"), F.coalesce(F.col(f"f_{r}"), F.lit(0)).alias("failed"), F.coalesce(F.col(f"o_{r}"), F.lit(0)).alias("failed_alone"), (F.coalesce(F.col("kept"), F.lit(0)) + F.coalesce(F.col(f"o_{r}"), F.lit(0))).alias("kept_without")) for r in names))
    return sums.select(F.inline(rows))
