"""Connected components of a distributed table of links, by contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, materialise


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (least node, other node) that join what the links (a, b) join: one for each node but the least of each component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        p, q = label[x], label[y]
        open_ = p != q
        x, y, p, q = x[open_], y[open_], p[open_], q[open_]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label = label[label]
    other = label != np.arange(len(nodes))
    return nodes[label[other]], nodes[other]


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, label): for every node of the links (a, b), the least node it reaches. Links with a null end are left out, and so is a
    node that only links with itself.

    Each round gives every node the least of itself and its neighbours (then that node's own such label), rewrites the links to those
    labels and drops loops and repeats, so the table shrinks from round to round; a hot node's links are combined before they are shuffled.
    The rounds' labels are then followed one after another. Tables stay in the shared folder; only whether links are left reaches the driver.
    """
    ends = links.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    ends = materialise(ends.distinct(), "links")
    rounds: list[DataFrame] = []
    while ends.limit(1).count():
        if len(rounds) == most_rounds:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        near = ends.union(ends.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label"))
        near = materialise(near, "near")
        step = near.alias("n").join(near.select(F.col("node").alias("via"), F.col("label").alias("beyond")), F.col("n.label") == F.col("via")).select("node", F.least("label", "beyond").alias("label"))
        step = materialise(step, "step")
        discard(near)
        left, right = step.select(F.col("node").alias("a"), F.col("label").alias("x")), step.select(F.col("node").alias("b"), F.col("label").alias("y"))
        fewer = ends.join(left, "a").join(right, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        fewer = materialise(fewer, "links")
        discard(ends)
        rounds.append(step)
        ends = fewer
    if not rounds:
        return ends.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = rounds[0]
    for step in rounds[1:]:
        after = step.select(F.col("node").alias("via"), F.col("label").alias("beyond"))
        labels = labels.join(after, labels.label == after.via, "left").select("node", F.coalesce("beyond", "label").alias("label"))
    if len(rounds) > 1:
        labels = materialise(labels, "labels")
        for step in rounds:
            discard(step)
    discard(ends)
    return labels
