"""Mix sources to target weights by Sainte-Laguë apportionment of equal blocks of words; DataFrame operations only.

Targets: the sources, by code point with null last, weigh 1, 2, 3, 1, ...; they share all words by weight, none gets more than
``most`` times its own words, and what a capped source leaves is shared among the others by weight (a level of water: the sources
are sorted by cap over weight, and the first that the level of those not before it leaves uncapped fixes the level).

Quotas: the mix has as many blocks as all words fill, rounded. They are apportioned twice by Sainte-Laguë: among the sources with the
targets as votes, and a source's among its shards with their words as votes. A part's k-th block is claimed by the quotient
votes / (2k - 1), and the highest quotients win, equal ones in the order of the parts. Shards hold about ``shard_words`` words each and
are dealt by a seeded hash of the id.

Selection: a shard's documents stand in a seeded order, their words form one sequence of blocks, and the quota takes that sequence
as often as it fits and then its first blocks. So hot sources are many shards, and no task sees more than one shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialise

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, cycle: int = 3, most: int = 3) -> DataFrame:
    """(number, source, source_size, target) from rows (source, size): one row a source, few and small, numbered in their order."""
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    src = src.withColumn("number", F.row_number().over(by_name))
    src = src.withColumn("weight", F.lit(1) + F.pmod(F.col("number") - 1, F.lit(cycle)))
    cap = F.lit(most) * F.col("source_size")
    by_cap = Window.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum(cap).over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    src = src.withColumn("level", (F.sum("source_size").over(everything) - before).cast("double") / left)
    level = F.max(F.when(F.col("level") * F.col("weight") <= cap, F.col("level"))).over(everything)
    return src.select("number", "source", "source_size", F.least(cap.cast("double"), level * F.col("weight")).alias("target"))


def apportion(parts: DataFrame, part: str, votes: str, seats: str, among: tuple[str, ...] = ()) -> DataFrame:
    """(among, part, won): the ``seats`` of each group ``among`` dealt to its parts by the highest quotients votes / (2k - 1), equal ones by
    ``part``. Parts without votes are left out.

    Rounding votes / d gives a part the seats whose quotients are at least 1 / (2d). Of n parts, d = all votes / (seats - n / 2) can't give
    too many seats in all, and all votes / (seats + n / 2) can't give too few; so only quotients between the two, about two a part, are ranked.
    """
    v, everything = F.col(votes).cast("double"), Window.partitionBy(*among)
    rows = parts.filter(v > 0).withColumns({"_all": F.sum(v).over(everything), "_n": F.count(F.lit(1)).over(everything)})
    slack = F.col("_n") / F.lit(2.0) + F.lit(1.0)  # one more than needed, for roundings of doubles
    at = lambda n: F.greatest(F.lit(0), F.floor(v * n / F.col("_all") + F.lit(0.5)).cast("long"))
    rows = rows.withColumns({"_low": at(F.col(seats) - slack), "_high": at(F.col(seats) + slack)})
    rows = rows.withColumn("_wins", F.col(seats) - F.sum("_low").over(everything) + F.col("_n"))
    rows = rows.select(*among, part, v.alias("_v"), "_low", "_wins", F.explode(F.sequence("_low", "_high")).alias("_k"))
    quotient = F.when(F.col("_k") > F.col("_low"), F.col("_v") / (F.lit(2) * F.col("_k") - F.lit(1))).otherwise(F.lit(float("inf")))
    rows = rows.withColumn("_place", F.row_number().over(everything.orderBy(quotient.desc(), part)))
    return rows.filter(F.col("_place") <= F.col("_wins")).groupBy(*among, part).agg(F.max("_k").alias("won"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = (), seed: str = "mix", block_words: int = 8, shard_words: int = 1 << 20, cycle: int = 3, most: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken and the columns ``carry`` of every row.

    A null text has no words, so nothing is taken; a null source is one source, the last; a null id is dealt by an empty text;
    repeated rows take each their own share; an empty table gives an empty one.
    """
    ids, own = F.col("_doc").cast("string"), [F.col(f"_c{k}").alias(c) for k, c in enumerate(carry)]
    sized = docs.select(docs[id_col].alias("_doc"), docs[source_col].alias("source"), words(docs[text_col]).alias("size"), *(docs[c].alias(f"_c{k}") for k, c in enumerate(carry)))
    goal = targets(sized.select("source", "size"), cycle, most)
    goal = goal.withColumn("_blocks", F.floor((F.sum("source_size").over(Window.partitionBy()) + F.lit(block_words // 2)) / F.lit(block_words)))
    # written tables have a known size, so that rows with texts are only shuffled for joins with tables too large to broadcast
    goal = materialise(goal.join(apportion(goal, "number", "target", "_blocks"), "number", "left").drop("_blocks"), "sources")
    rows = sized.alias("d").join(goal.alias("t"), F.expr("d.source <=> t.source")).select("d.*", "number", "source_size", "target", "won")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ids, F.lit(""))).cast("binary"))
    rows = rows.withColumn("_order", order)
    hashed = F.conv(F.substring("_order", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("_shard", F.pmod(hashed, F.lit(1) + F.floor(F.col("source_size") / F.lit(shard_words)).cast("long")))
    shards = rows.groupBy("number", "_shard").agg(F.sum("size").alias("_words"), F.first("won").alias("_blocks"))
    shards = materialise(shards, "shards")
    won = apportion(shards, "_shard", "_words", "_blocks", ("number",))
    quota = F.least(F.coalesce(F.col("won"), F.lit(0)) * F.lit(block_words), F.lit(most) * F.col("_words"))
    shards = materialise(shards.join(won, ["number", "_shard"], "left").select("number", "_shard", "_words", quota.alias("_quota")), "quotas")
    rows = rows.drop("won").join(shards, ["number", "_shard"])
    stream = Window.partitionBy("number", "_shard").orderBy("_order", F.col("_doc").asc_nulls_first(), "size")
    rows = rows.withColumn("_before", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    times = F.when(F.col("_words") > 0, F.expr("_quota div _words")).otherwise(F.lit(0))
    rest = F.col("_quota") - times * F.col("_words") - F.col("_before")
    taken = times * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return rows.select(F.col("_doc").alias("doc_id"), "size", "source_size", "target", taken.cast("long").alias("taken"), *own)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    split = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1)
    return F.array_join(F.slice(split, F.lit(1), n), "")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself, with the columns of ``docs``: a document appears as often as its words are taken whole, and a part taken
    is its first words, cut after the last of them; what isn't taken goes. ``n_chars``, where there, follows the text."""
    columns = docs.columns
    plain = docs.toDF(*(f"in_{k}" for k in range(len(columns))))
    name = {c: f"in_{k}" for k, c in enumerate(columns)}
    marked = mix(plain, name["doc_id"], name["text"], name["source"], carry=tuple(plain.columns), **options)
    full = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(F.lit(0)).cast("int")
    part = F.when(F.col("size") > 0, F.expr("taken % size")).otherwise(F.lit(0)).cast("int")
    copies = F.concat(F.array_repeat(F.lit(-1), full), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    out = marked.withColumn("_copy", F.explode(copies))
    whole, text = F.col("_copy") < 0, F.col(name["text"])
    changed = {"text": F.when(whole, text).otherwise(first_words(text, F.col("_copy")))}
    out = out.withColumn("_text", changed["text"])
    final = {"text": F.col("_text")}
    if "n_chars" in columns:
        final["n_chars"] = F.when(whole, F.col(name["n_chars"])).otherwise(F.char_length("_text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*(final.get(c, F.col(name[c])).alias(c) for c in columns))
