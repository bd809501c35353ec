"""Problem 7: a mix of sources in which each has its target share of the tokens, by subset-sum budget fitting.

Documents are counted by exact token length. The total is the largest that every present source can serve within its
repeats (or the one asked for). A source's budget is met by whole passes over all its documents and, for the rest, by
a count per length: an even part of every length first, then a bounded-knapsack table over what remains, which finds
the largest sum that still fits, token for token. Within a length, documents are drawn by a seeded hash.

What leaves the rows is one count per (source, length); the fitting runs once a source, in its own task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.operators.ranking import rank_within

#: Largest rest that the knapsack table covers; more is filled by whole documents before.
TABLE_TOKENS = 1 << 14


def source_name(source: Column) -> Column:
    """A source's name without case, white space at the ends and kind of hyphen; empty is null."""
    name = F.regexp_replace(F.lower(F.trim(source)), r"[-\s]+", "_")
    return F.when(name != "", name)


def fit(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take (0..counts) so that their tokens come closest to budget from below.

    An even share of every length first; where the rest can't be met exactly, half that share, then none of it, is
    taken instead, so that budgets within TABLE_TOKENS are always met as well as any choice can. Lengths must be
    positive and different.
    """
    held = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= held:
        return list(counts)
    best, missing = [0] * len(lengths), max(budget, 0)
    for part in (1.0, 0.5, 0.0):
        if missing <= 0:
            break
        take = _fit_rest(lengths, counts, [min(c, int(c * budget / held * part)) for c in counts], budget)
        open_ = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
        if open_ < missing:
            best, missing = take, open_
    return best


def _fit_rest(lengths: list[int], counts: list[int], take: list[int], budget: int) -> list[int]:
    """Add to take: the longest documents that fit until at most TABLE_TOKENS are open, then the exact bounded knapsack.

    Bit v of reach[k] says that the sum v can be made from the first k bundles (1, 2, 4, ... documents of a length).
    """
    rest = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for once in (True, False):  # one more of each length, then as many as needed
        for i in order:
            if rest <= TABLE_TOKENS:
                break
            n = min(counts[i] - take[i], 1 if once else (rest - TABLE_TOKENS // 2) // lengths[i], rest // lengths[i])
            if n > 0:
                take[i] += n
                rest -= n * lengths[i]
    mask = (1 << (rest + 1)) - 1
    bundles: list[tuple[int, int]] = []
    reach = [1]
    for i in order:
        free, n = min(counts[i] - take[i], rest // lengths[i]), 1
        while free > 0 and not reach[-1] >> rest & 1:
            n_here = min(n, free)
            bundles.append((i, n_here))
            reach.append((reach[-1] | reach[-1] << (n_here * lengths[i])) & mask)
            free, n = free - n_here, n * 2
    value = reach[-1].bit_length() - 1
    for (i, n), before in zip(reversed(bundles), reversed(reach[:-1]), strict=True):
        if not before >> value & 1:
            take[i] += n
            value -= n * lengths[i]
    return take


def plan_counts(frame: pd.DataFrame) -> pd.DataFrame:
    """applyInPandas over one source: passes over all its documents and how many of each length to take once more."""
    budget, lengths, counts = int(frame["budget"].iloc[0]), frame["tokens"].tolist(), frame["documents"].tolist()
    total = int(np.dot(frame["tokens"].astype("int64"), frame["documents"].astype("int64")))
    repeats = int(frame["max_repeats"].iloc[0])
    passes = min(budget // total, repeats)
    extra = fit(lengths, counts, budget - passes * total) if passes < repeats else [0] * len(lengths)
    return pd.DataFrame({"source": frame["source"], "tokens": lengths, "passes": passes, "extra": extra})


def mix(items: DataFrame, key: str, source: str, size: str, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, rows_per_part: int = 1_000_000) -> DataFrame:
    """(source, key, tokens, uses): every document in the mix and how often it is used.

    targets: source, target_share, max_repeats; one row a source. Shares of sources that have no token are given to
    the others in proportion. total_tokens None: the most that all sources together allow; a larger total is cut to
    what each source can give. Documents of a source without target, without source, or of size 0 or null are in no
    mix. Equal keys are documents of their own. Empty tables give an empty mix.
    """
    goal = targets.where("target_share > 0 and max_repeats > 0").groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").cast("int").alias("max_repeats")).where("source is not null")
    rows = items.select(source_name(F.col(source)).alias("source"), F.col(key).alias("_key"), F.col(size).cast("int").alias("tokens")).where("tokens > 0 and source is not null")
    # One row a target; whether that is small enough to broadcast is left to the optimiser's sizes.
    counts = rows.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("documents")).join(goal, "source")
    held = counts.groupBy("source").agg(F.sum(F.col("tokens").cast("long") * F.col("documents")).alias("held"), F.first("target_share").alias("share"), F.first("max_repeats").alias("repeats"))
    every = Window.partitionBy(F.lit(1))  # one row a source
    shares = held.withColumn("share", F.col("share") / F.sum("share").over(every))
    most = F.min(F.col("held") * F.col("repeats") / F.col("share")).over(every)
    whole = most if total_tokens is None else F.lit(float(total_tokens))
    budgets = shares.select("source", F.least(F.floor(whole * F.col("share") + F.lit(1e-6)), F.col("held") * F.col("repeats")).cast("long").alias("budget"))
    plan = counts.join(budgets, "source").groupBy("source").applyInPandas(plan_counts, "source string, tokens int, passes int, extra long")
    seeded = F.xxhash64(F.lit(seed), "_key")
    wanted = rows.join(goal.select("source"), "source", "left_semi")
    ranked = rank_within(wanted, ["source", "tokens"], [seeded, F.col("_key")], "_rank", rows_per_part, seeded)
    used = ranked.join(plan, ["source", "tokens"]).withColumn("uses", F.col("passes") + (F.col("_rank") < F.col("extra")).cast("int"))
    return used.where("uses > 0").select("source", F.col("_key").alias(key), "tokens", "uses")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: its share, the share among present sources, what was reached, documents, tokens, most uses."""
    goal = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share"), F.col("max_repeats"))
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens").cast("long") * F.col("uses")).alias("tokens"), F.max("uses").alias("most_uses"))
    every = Window.partitionBy(F.lit(1))
    there = goal.join(got, "source", "left").na.fill(0, ["documents", "tokens", "most_uses"])
    present = F.when(F.col("tokens") > 0, F.col("target_share")).otherwise(0.0)
    return there.select("source", "target_share", (present / F.sum(present).over(every)).alias("present_share"), (F.col("tokens") / F.sum("tokens").over(every)).alias("reached_share"), "documents", "tokens", "most_uses", "max_repeats")
