"""Judge URLs by host and path rules and, where no rule fits, by gradient-boosted trees; DataFrame operations only.

The rules label the URLs they fit. Trees of depth 2 are boosted on lexical features of those: length, depth, digit ratio, character
entropy, parameters, parts of the host, and the smoothed share of blocked URLs under the host's suffix. Features are cut into bins at
quantiles; each level of each tree is one aggregation of gradients by (leaf, feature, bin), so the driver sees only that bounded
histogram, and the model is a Column expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialise, share_of

#: Fixed rules: (verdict, host and path). A rule fits the host and its subdomains if the path starts with the rule's path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NUMERIC = ("f_length", "f_depth", "f_digits", "f_entropy", "f_parameters", "f_labels", "f_host", "f_suffix")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end; else both empty."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + F.lit(3), F.char_length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, the first of equally long ones; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    n = F.char_length(text).cast("double")
    share = lambda c: (F.char_length(text) - F.char_length(F.replace(text, c, F.lit("")))) / n
    return F.when(n > 0, F.aggregate(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))).otherwise(F.lit(0.0))


def with_features(rows: DataFrame) -> DataFrame:
    """Lexical features of (url, host, path); a null url has those of an empty one."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    digits = F.char_length(F.regexp_replace(url, r"[^0-9]", ""))
    return rows.select(
        "*", F.regexp_extract("host", r"([^.]*)$", 1).alias("suffix"), F.char_length(url).cast("double").alias("f_length"), F.regexp_count("path", F.lit("/+[^/]")).cast("double").alias("f_depth"),
        (digits / F.greatest(F.char_length(url), F.lit(1))).cast("double").alias("f_digits"), _entropy(url).alias("f_entropy"), F.when(query == "", F.lit(0.0)).otherwise(F.size(F.split(query, "&")).cast("double")).alias("f_parameters"),
        F.size(F.split("host", r"\.")).cast("double").alias("f_labels"), F.char_length("host").cast("double").alias("f_host"),
    )


def _bin(value: Column, cuts: list[float]) -> Column:
    out = F.lit(len(cuts))
    for k in range(len(cuts) - 1, -1, -1):
        out = F.when(value <= F.lit(cuts[k]), F.lit(k)).otherwise(out)
    return out


class BoostedTrees:
    """Trees of depth 2 over binned features; ``margin`` is the log odds of the positive class as a Column of the bin columns."""

    def __init__(self, prior: float):
        self.prior, self.trees = prior, []

    @staticmethod
    def _value(tree: dict) -> Column:
        if "value" in tree:
            return F.lit(float(tree["value"]))
        return F.when(F.col(f"b_{tree['feature']}") <= F.lit(tree["bin"]), BoostedTrees._value(tree["low"])).otherwise(BoostedTrees._value(tree["high"]))

    def margin(self) -> Column:
        out = F.lit(float(self.prior))
        for t in self.trees:
            out = out + self._value(t)
        return out

    def fit(self, cells: DataFrame, features: tuple[str, ...], rounds: int, rate: float, ridge: float = 1.0) -> BoostedTrees:
        """``cells``: bin columns, n rows and n_pos positive ones of each combination."""
        for _ in range(rounds):
            p = F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin()))
            scored = cells.withColumn("g", F.col("n") * p - F.col("n_pos")).withColumn("h", F.col("n") * p * (F.lit(1.0) - p))
            top = self._split(scored, F.lit(0), features, ridge).get(0)
            if top is None:
                break
            feature, cut = top["feature"], top["bin"]
            leaf = F.when(F.col(f"b_{feature}") <= F.lit(cut), F.lit(0)).otherwise(F.lit(1))
            below = self._split(scored, leaf, features, ridge)
            sides = []
            for k, (g, h) in enumerate((top["left"], top["right"])):
                if (s := below.get(k)) is None:
                    sides.append({"value": -rate * g / (h + ridge)})
                else:
                    sides.append({"feature": s["feature"], "bin": s["bin"], "low": {"value": -rate * s["left"][0] / (s["left"][1] + ridge)}, "high": {"value": -rate * s["right"][0] / (s["right"][1] + ridge)}})
            self.trees.append({"feature": feature, "bin": cut, "low": sides[0], "high": sides[1]})
        return self

    @staticmethod
    def _split(scored: DataFrame, leaf: Column, features: tuple[str, ...], ridge: float) -> dict[int, dict]:
        """The best split of each leaf, from one aggregation by (leaf, feature, bin)."""
        pairs = F.array(*(F.struct(F.lit(f).alias("f"), F.col(f"b_{f}").alias("b")) for f in features))
        rows = scored.select(leaf.alias("leaf"), "g", "h", F.explode(pairs).alias("x")).groupBy("leaf", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        best: dict[int, dict] = {}
        for node in sorted({r.leaf for r in rows}):
            for f in features:
                own = sorted((r.b, r.g, r.h) for r in rows if r.leaf == node and r.f == f)
                total_g, total_h = math.fsum(r[1] for r in own), math.fsum(r[2] for r in own)
                g = h = 0.0
                for b, dg, dh in own[:-1]:
                    g, h = g + dg, h + dh
                    gain = g * g / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - total_g**2 / (total_h + ridge)
                    if gain > 1e-6 and (node not in best or gain > best[node]["gain"] * (1 + 1e-9)):
                        best[node] = {"gain": gain, "feature": f, "bin": b, "left": (g, h), "right": (total_g - g, total_h - h)}
        return best


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, rounds: int = 10, rate: float = 0.4, bins: int = 16, sample_rows: int = 400_000) -> DataFrame:
    """page_id, host, path, rule, verdict and block_score of every row.

    ``sample_rows`` bounds about how many labelled URLs the trees are fitted on (by a hash of the URL); quantiles and suffix shares
    come from the same rows. Without labelled URLs of both kinds, what no rule fits is allowed if the labelled ones are, or if there
    are none. A null URL has empty host and path; repeated rows are judged alike.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url")).withColumns({"host": host, "path": path})
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "rule_verdict": verdict})
    labelled = rows.filter("rule is not null").select("url", "host", "path", (F.col("rule_verdict") == "block").cast("int").alias("y"))
    total, blocked = labelled.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if 0 < blocked < total:
        share = min(1.0, sample_rows / total)
        sample = labelled.filter(share_of(share, "url")) if share < 1 else labelled
        sample = materialise(with_features(sample), "urls")
        base = blocked / total
        suffixes = sample.groupBy("suffix").agg(((F.sum("y") + F.lit(20 * base)) / (F.count("*") + F.lit(20))).alias("f_suffix"))
        known = lambda df: df.join(suffixes, "suffix", "left").fillna(base, ["f_suffix"])
        sample = known(sample)
        at = [k / bins for k in range(1, bins)]
        cuts = sample.agg(*(F.percentile_approx(f, at, 10_000).alias(f) for f in NUMERIC)).first()
        binned = lambda df: df.withColumns({f"b_{f}": _bin(F.col(f), sorted(set(cuts[f] or []))) for f in NUMERIC})
        cells = binned(sample).groupBy(*(f"b_{f}" for f in NUMERIC)).agg(F.count("*").alias("n"), F.sum("y").alias("n_pos"))
        cells = materialise(cells, "cells")
        model = BoostedTrees(math.log(base / (1 - base))).fit(cells, NUMERIC, rounds, rate)
        rows = binned(known(with_features(rows)))
        score = F.lit(1.0) / (F.lit(1.0) + F.exp(-model.margin()))
    else:
        score = F.lit(1.0 if total and blocked == total else 0.0)
    rows = rows.withColumn("block_score", score)
    return rows.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.when(F.col("block_score") > 0.5, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "block_score")
