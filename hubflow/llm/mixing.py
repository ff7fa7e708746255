"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length in words. A source whose
target exceeds its size is taken whole as often as it fits; for the remaining
budget an equal share of every length is taken, and what that leaves is filled
by a bounded-knapsack dynamic program over the lengths still available. Which
documents of a length are taken is decided by a seeded hash: the smallest.

Targets: the sizes of all sources together are shared by weight; no target
exceeds ``max_repeats`` times its source's size, and the excess is shared again
among the others until none is above.

Only counts by length travel to the program, never documents. The number of
documents of one length is unbounded (a group of copies), so their cut is found
by counting hash ranges first and ranking only inside the range of the cut.

Defined cases: null text has size 0; null is a source of its own, the last;
empty documents are never taken; no document at all gives no rows; of a very
long text only the number of words matters. Rows equal in id, source and text
draw alike; where the cut falls on such rows, as many of them are taken as are
still wanted, numbered by input partition (of rows that differ in other columns,
which ones depends on the partitions). Columns besides the named ones are passed
on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged, table, words

#: Weights of the sources in code-point order, repeated.
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SEED = 97
#: Largest budget in words that the dynamic program solves; more is first
#: brought below it by taking long documents.
PROGRAM_WORDS = 1 << 16


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, so that their words come as
    near to ``budget`` as the program can, and never above it."""
    total = int((lengths.astype(object) * counts).sum()) if len(lengths) else 0
    if budget <= 0 or total == 0:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.astype(np.int64)
    taken = np.array([int(n) * budget // total for n in counts], np.int64)
    left = budget - int((lengths.astype(object) * taken).sum())
    for i in np.argsort(-lengths):
        if left <= PROGRAM_WORDS:
            break
        more = min(int(counts[i] - taken[i]), left // int(lengths[i])) if lengths[i] else 0
        taken[i] += more
        left -= more * int(lengths[i])
    room = min(left, PROGRAM_WORDS)
    # bounded knapsack: how[s] is the item that first reached the sum s
    reached = np.zeros(room + 1, bool)
    reached[0] = True
    how = np.full(room + 1, -1, np.int64)
    items: list[tuple[int, int]] = []
    for i in np.argsort(lengths):
        length, spare = int(lengths[i]), int(counts[i] - taken[i])
        if length == 0 or length > room:
            continue
        spare, k = min(spare, room // length), 1
        while spare > 0 and not reached[room]:
            k = min(k, spare)
            w = k * length
            new = reached[: room + 1 - w] & ~reached[w:]
            how[w:][new] = len(items)
            reached[w:] |= new
            items.append((int(i), k))
            spare, k = spare - k, 2 * k
        if reached[room]:
            break
    s = int(np.flatnonzero(reached)[-1])
    while s:
        i, k = items[how[s]]
        taken[i] += k
        s -= k * int(lengths[i])
    return taken


def targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``sizes`` (source, source_size), one row per source, with ``target``.

    With caps taken in the order of cap by weight, the targets are
    ``min(cap, weight * level)`` at the level where they sum to all sizes."""
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size") * max_repeats)
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))
    )
    rows = rows.withColumn("level", level.cast("double")).withColumn("at", F.row_number().over(by_cap))
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("at", "level"))
    rows = rows.withColumn("level", F.min(fits).over(every)["level"])
    return rows.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target"))


def _key(source: Column) -> Column:
    """A source as a key that equals itself, null included."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def plan_mix(sized: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``sized`` (source, size, h) to one row per source and size: ``k`` (the
    source's key), ``size``, ``source_size``, ``target``, ``repeats`` (taken
    whole so often), ``cut`` (once more if h is below that; null: none), ``equal``
    (documents whose h is the cut) and ``ties`` (how many of these are taken)."""
    hist = staged(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    per_source = targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, max_repeats)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    per_source = per_source.withColumn("repeats", whole).withColumn(
        "budget", F.round(F.col("target") - F.col("repeats") * F.col("source_size")).cast("long")
    )
    lengths = hist.withColumn("k", _key(F.col("source"))).join(per_source.withColumn("k", _key(F.col("source"))).drop("source"), "k")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ignore_index=True)
        rows["extra"] = fit_budget(rows["size"].to_numpy(), rows["n"].to_numpy(), int(rows["budget"][0]))
        return rows

    columns = ["k", "size", "n", "source_size", "target", "repeats"]
    schema = "k string, size long, n long, source_size long, target double, repeats long, budget long, extra long"
    plan = staged(lengths.select(*columns, "budget").groupBy("k").applyInPandas(fit, schema).drop("budget"))

    # the cut of each length: the hash of its extra-th document
    some = plan.where("extra > 0 and extra < n").select("k", "size", "n", "extra")
    ranges = F.ceil(F.sqrt("n"))  # as many ranges as documents in a range
    part = F.least(F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * ranges), ranges - 1).cast("long")
    drawn = sized.select(_key(F.col("source")).alias("k"), "size", "h").join(some, ["k", "size"])
    # equal draws, a third of all rows perhaps, are one row with a count from here on
    drawn = staged(drawn.groupBy("k", "size", "extra", part.alias("part"), "h").agg(F.count("*").alias("equal")))
    counts = drawn.groupBy("k", "size", "part", "extra").agg(F.sum("equal").alias("m"))
    upto = F.sum("m").over(Window.partitionBy("k", "size").orderBy("part"))
    at_cut = counts.withColumn("upto", upto).where("upto >= extra and upto - m < extra")
    at_cut = staged(at_cut.select("k", "size", "part", (F.col("extra") - F.col("upto") + F.col("m")).alias("rank")))
    ranked = drawn.join(at_cut, ["k", "size", "part"]).withColumn("r", F.sum("equal").over(Window.partitionBy("k", "size", "part").orderBy("h")))
    cuts = ranked.where("r >= rank and r - equal < rank").select(
        "k", "size", F.col("h").alias("cut"), "equal", (F.col("rank") - F.col("r") + F.col("equal")).alias("ties")
    )
    all_of_it = F.when((F.col("extra") >= F.col("n")) & (F.col("n") > 0), F.lit(2**63 - 1))
    return staged(
        plan.join(cuts, ["k", "size"], "left").select(
            "k", "size", "source_size", "target", "repeats", F.coalesce("cut", all_of_it).alias("cut"), "equal", "ties"
        )
    )


def sizes_and_draws(docs: DataFrame, key: str, text: str, source: str, seed: int) -> list[Column]:
    t = F.col(text)
    draw = F.xxhash64(F.lit(seed), F.col(key), F.crc32(t))
    return [F.col(source).alias("source"), F.size(words(t)).cast("long").alias("size"), draw.alias("h")]


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (source, size, h, ...) joined with their plan and ``copies``: how
    often a row is taken."""
    rows = rows.withColumn("k", _key(F.col("source"))).withColumn("salt", F.spark_partition_id())
    joined = rows.join(plan, ["k", "size"])
    tied = F.coalesce((F.col("h") == F.col("cut")) & (F.col("ties") < F.col("equal")), F.lit(False))

    def copies(once_more: Column) -> Column:
        more = F.coalesce(once_more, F.lit(False)).cast("long")
        return F.when(F.col("size") > 0, F.col("repeats") + more).otherwise(F.lit(0)).cast("long")

    if plan.where("ties < equal").isEmpty():
        return joined.withColumn("copies", copies(F.col("h") <= F.col("cut"))).drop("salt")
    # number the rows at the cut: by input partition, then within it, so that
    # no task holds more of them than an input partition does
    at_cut = staged(joined.where(tied))
    by_salt = at_cut.groupBy("k", "size", "salt").agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy("k", "size").orderBy("salt"))
    before = by_salt.select("k", "size", "salt", (upto - F.col("m")).alias("before"))
    within = F.row_number().over(Window.partitionBy("k", "size", "salt").orderBy("h"))
    numbered = at_cut.withColumn("nth", within).join(before, ["k", "size", "salt"])
    chosen = numbered.withColumn("copies", copies(F.col("before") + F.col("nth") <= F.col("ties"))).drop("nth", "before", "salt")
    others = joined.where(~tied).withColumn("copies", copies(F.col("h") <= F.col("cut"))).drop("salt")
    return others.unionByName(chosen)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """The mixture: the rows of ``docs`` that are taken, repeats as repeated rows."""
    draws = sizes_and_draws(docs, key, text, source, seed)
    plan = plan_mix(staged(docs.select(*draws)))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *draws)
    taken = with_copies(rows, plan)
    return taken.where("copies > 0").select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op6_mix(spark, sf_dir: str) -> DataFrame:
    """What the mixture takes of every document."""
    docs = table(spark, sf_dir, "documents")
    sized = staged(docs.select("doc_id", *sizes_and_draws(docs, "doc_id", "text", "source", SEED)))
    rows = with_copies(sized, plan_mix(sized))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
