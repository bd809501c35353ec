"""Problem 6: items packed whole into containers of fixed capacity, by bulk-synchronous best fit.

Sizes are whole tokens, so the sorted list of items and the sorted list of gaps have at most `capacity` different
values each, however many rows there are. Both are kept as runs of equal size. A round is one sweep over the item runs
from the largest: each takes its successor among the gap runs (the smallest gap that holds it); where more items want
a gap run than it has gaps, the lower ranks win and the others go on to the next gap run; gaps made in a round are
open from the next round on. A round that places nothing opens new containers. What a sweep decides is a short table
of rank ranges; documents find their container by their rank among documents of their size, in one range lookup.

The rows are read once to count sizes, once to number them; the sweeps see counts only and run one task a capacity.
That task is bounded by the capacity, not by the rows: a placement either uses a run of gaps up, which leaves one run
in its stead, or serves the last item of a size, so there are never more runs of gaps than sizes and openings. It is
so, and not a join of document rows with gap rows in every round, since a container takes one document a round then,
and a container of capacity c needs as many rounds, each with a range sort of all rows, as it has documents.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.operators.ranking import rank_within


def best_fit(sizes: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Place counts of items by size. Returns (size, first rank, end rank, first container, place).

    Items of one size are told apart by rank 0..count-1; a row says that the ranks go one by one into neighbouring
    containers, each at offset `place`. Containers are numbered from 0 without holes.
    """
    if any(s < 1 or s > capacity for s in sizes):
        raise ValueError("sizes must lie in 1..capacity")
    left = dict(sizes)
    done = dict.fromkeys(sizes, 0)
    out: list[tuple[int, int, int, int, int]] = []
    order = sorted((s for s in sizes if sizes[s]), reverse=True)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first container, end container), ascending
    opened = 0

    def place(size: int, runs: list[tuple[int, int]], want: int, gap: int, made: list[tuple[int, int, int]]) -> int:
        """Put up to `want` items of a size into the gap runs; what is left of the runs stays."""
        got = 0
        while runs and got < want:
            first, end = runs.pop(0)
            n = min(end - first, want - got)
            out.append((size, done[size], done[size] + n, first, capacity - gap))
            done[size] += n
            got += n
            if gap > size:
                made.append((gap - size, first, first + n))
            if first + n < end:
                runs.insert(0, (first + n, end))
        return got

    while order:
        made: list[tuple[int, int, int]] = []
        sorted_gaps = sorted(g for g, r in gaps.items() if r)
        placed = 0
        for size in order:
            k = bisect_left(sorted_gaps, size)
            while left[size] and k < len(sorted_gaps):
                gap = sorted_gaps[k]
                got = place(size, gaps[gap], left[size], gap, made)
                left[size] -= got
                placed += got
                if not gaps[gap]:
                    del sorted_gaps[k]
                else:
                    k += 1
        if not placed:  # new containers: for each item over half a capacity, else for the tokens left
            big = [s for s in order if 2 * s > capacity]
            new = sum(left[s] for s in big) if big else max(1, -(-sum(s * left[s] for s in order) // capacity))
            insort(gaps.setdefault(capacity, []), (opened, opened + new))
            opened += new
        for gap, first, end in sorted(made):
            runs = gaps.setdefault(gap, [])
            at = bisect_left(runs, (first, end))
            if at and runs[at - 1][1] == first:  # neighbours with one gap are one run again
                runs[at - 1] = (runs[at - 1][0], end)
            else:
                runs.insert(at, (first, end))
        order = [s for s in order if left[s]]
    return _without_empty(out, gaps.get(capacity, []))


def _without_empty(rows: list[tuple[int, int, int, int, int]], empty: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Renumber containers so that those nothing was put in vanish."""
    if not empty:
        return rows
    empty = sorted(empty)
    ends = [e for _, e in empty]
    gone = np.cumsum([0, *[e - s for s, e in empty]]).tolist()
    return [(s, a, b, c - gone[bisect_left(ends, c + 1)], o) for s, a, b, c, o in rows]


def _sweep(frame: pd.DataFrame) -> pd.DataFrame:
    capacity = int(frame["capacity_tokens"].iloc[0])
    rows = best_fit(dict(zip(frame["size"].tolist(), frame["items"].tolist(), strict=True)), capacity)
    out = pd.DataFrame(rows, columns=["size", "first_rank", "end_rank", "first_container", "place"])
    out.insert(0, "capacity_tokens", capacity)
    return out


_PLACED = "capacity_tokens int, size int, first_rank long, end_rank long, first_container long, place int"


def pack(items: DataFrame, key: str, size: str, capacities: list[int], rows_per_part: int = 1_000_000) -> DataFrame:
    """(capacity_tokens, key, piece_no, tokens, first_token, container, place): where every item lies, for each capacity.

    An item is cut only if it exceeds the capacity: into full containers and one remainder. container is numbered from
    0 per capacity, place is the offset of the item in it. Items of size 0 or null take no space: they come out with a
    null container. Equal keys are separate items; a null key is an item like others.
    """
    if not capacities or min(capacities) < 1:
        raise ValueError("capacities must be positive")
    kinds = F.explode(F.array(*[F.lit(int(c)) for c in sorted(set(capacities))])).alias("capacity_tokens")
    sized = items.select(F.col(key).alias("_key"), F.coalesce(F.col(size).cast("int"), F.lit(0)).alias("_size"))
    empty = sized.where("_size < 1").select(kinds, "_key", F.lit(1).alias("piece_no"), F.lit(0).alias("tokens"), F.lit(0).alias("first_token"), F.lit(None).cast("long").alias("container"), F.lit(None).cast("int").alias("place"))
    cut = F.posexplode(F.sequence(F.lit(0), F.col("_size") - 1, F.col("capacity_tokens"))).alias("_no", "first_token")
    pieces = sized.where("_size > 0").select("_key", "_size", kinds).select("_key", "capacity_tokens", "_size", cut)
    pieces = pieces.select("capacity_tokens", "_key", (F.col("_no") + 1).alias("piece_no"), F.least(F.col("capacity_tokens"), F.col("_size") - F.col("first_token")).alias("tokens"), "first_token")
    counts = pieces.groupBy("capacity_tokens", F.col("tokens").alias("size")).agg(F.count(F.lit(1)).alias("items"))
    placed = counts.groupBy("capacity_tokens").applyInPandas(_sweep, _PLACED)
    ranked = rank_within(pieces, ["capacity_tokens", "tokens"], [F.col("_key"), F.col("piece_no"), F.col("first_token")], "_rank", rows_per_part, F.xxhash64("_key", "piece_no"), few_groups=True)  # at most `capacity` sizes a capacity
    found = _lookup(ranked, placed)
    return found.unionByName(empty).withColumnRenamed("_key", key)


def _lookup(ranked: DataFrame, placed: DataFrame) -> DataFrame:
    """Join each rank to the range that holds it, by blocks of 256 ranks: an equi-join with a small residual, however many ranges a size has."""
    blocks = F.explode(F.sequence(F.shiftright("first_rank", 8), F.shiftright(F.col("end_rank") - 1, 8))).alias("_block")
    ranges = placed.select("*", blocks).select(F.col("capacity_tokens").alias("_c"), F.col("size").alias("_s"), F.col("_block").alias("_b"), "first_rank", "end_rank", "first_container", "place")
    inside = (F.col("capacity_tokens") == F.col("_c")) & (F.col("tokens") == F.col("_s")) & (F.shiftright("_rank", 8) == F.col("_b")) & (F.col("_rank") >= F.col("first_rank")) & (F.col("_rank") < F.col("end_rank"))
    joined = ranked.join(ranges, inside, "inner")
    return joined.select("capacity_tokens", "_key", "piece_no", "tokens", "first_token", (F.col("first_container") + F.col("_rank") - F.col("first_rank")).alias("container"), "place")


def fill(packed: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens in them, the least number of containers any packing needs, and the share filled."""
    used = packed.where("container is not null").groupBy("capacity_tokens").agg((F.max("container") + 1).alias("containers"), F.sum("tokens").cast("long").alias("tokens"), F.count(F.lit(1)).alias("items"))
    least = F.ceil(F.col("tokens") / F.col("capacity_tokens")).cast("long")
    return used.select("capacity_tokens", "containers", "items", "tokens", least.alias("least_containers"), F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("filled"))
