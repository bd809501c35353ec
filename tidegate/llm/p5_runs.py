"""Problem 5: runs of identical or near-identical consecutive events, by adjacent agglomeration.

Per entity a linked list of runs and a priority queue of neighbouring pairs: the most similar pair is merged first,
its neighbours' similarities are renewed, until no pair meets the similarity and gap limits. Two runs are similar
only if they hold the same label; with a score column the similarity is 1 - spread / scale, where spread is the
distance between the extreme scores of both runs together (complete linkage), without one it is 1.

Sequences of any length: the list is built per block of 65,536 positions, and what touches a block's edge is
agglomerated again per sequence. Positions are 32-bit, so a sequence has at most 32,768 blocks with two edge runs
each and the second stage is bounded. For labels alone this equals one list over the whole sequence; with scores it
is the same inside a block, and across a block's edge the edge runs merge as they stand.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 16
BATCH_ROWS = 50_000

#: Other words for a label.
SYNONYMS = {"uncertain": "controversial"}


_UNKNOWN, _INF = -(2**63), float("inf")


def normal_label(label: Column) -> Column:
    """A label without case and surrounding white space, synonyms united; empty is null."""
    bare = F.lower(F.regexp_replace(label, r"^[\s\u00a0\u3000\u200b\ufeff]+|[\s\u00a0\u3000\u200b\ufeff]+$", ""))
    for word, meaning in SYNONYMS.items():
        bare = F.when(bare == word, meaning).otherwise(bare)
    return F.when(bare != "", bare)


def agglomerate(labels: list[int], first: list[int], last: list[int], count: list[int], begin: list[int], end: list[int], low: list[float] | None, high: list[float] | None, scale: float, least: float, max_gap: float) -> list[int]:
    """Merge neighbouring runs in place. Returns the heads of the runs that remain.

    labels: < 0 is no label, in no run. begin and end: microseconds, or the least integer where unknown. A pair is
    linked while its similarity is at least `least` and the time between the runs at most max_gap.
    """
    n = len(labels)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    stamp = [0] * n
    alive = bytearray(b"\x01") * n
    unknown = _UNKNOWN

    def similarity(a: int, b: int) -> float:
        if labels[a] != labels[b] or labels[a] < 0:
            return -1.0
        if max_gap != _INF and end[a] != unknown and begin[b] != unknown and begin[b] - end[a] > max_gap:
            return -1.0
        if low is None:
            return 1.0
        return 1.0 - (max(high[a], high[b]) - min(low[a], low[b])) / scale

    queue = []
    for a in range(n - 1):
        if labels[a] == labels[a + 1] and (s := similarity(a, a + 1)) >= least:
            queue.append((-s, a, 0, 0))
    heapq.heapify(queue)
    pop, push = heapq.heappop, heapq.heappush
    while queue:
        _, a, seen_a, seen_b = pop(queue)
        if not alive[a] or stamp[a] != seen_a:
            continue
        b = after[a]
        if b >= n or stamp[b] != seen_b:
            continue
        last[a], count[a] = last[b], count[a] + count[b]
        if begin[a] == unknown or unknown != begin[b] < begin[a]:
            begin[a] = begin[b]
        if end[b] > end[a]:
            end[a] = end[b]
        if low is not None:
            low[a], high[a] = min(low[a], low[b]), max(high[a], high[b])
        alive[b] = 0
        after[a] = c = after[b]
        if c < n:
            before[c] = a
        stamp[a] += 1
        if c < n and (s := similarity(a, c)) >= least:
            push(queue, (-s, a, stamp[a], stamp[c]))
        if low is not None or max_gap != _INF:  # else a merge changes nothing for the run before
            if (p := before[a]) >= 0 and (s := similarity(p, a)) >= least:
                push(queue, (-s, p, stamp[p], stamp[a]))
        elif (p := before[a]) >= 0 and labels[p] == labels[a]:
            push(queue, (-1.0, p, stamp[p], stamp[a]))
    return [a for a in range(n) if alive[a]]


def _stage(group: list[str], has_score: bool, scale: float, least: float, max_gap: float, min_events: int, passed: int | None):
    """mapInArrow function over rows sorted by group and position; every group is agglomerated as a whole.

    passed: value of the last group column that marks rows to agglomerate; others are passed on. None: all rows are
    single events, of which a repeated position counts once (the first), and runs that touch no edge and are shorter
    than min_events are left out.
    """

    def agglomerated(table: pa.Table) -> pa.Table:
        n = table.num_rows
        column = {c: table.column(c).combine_chunks() for c in table.column_names}
        change = np.ones(n, bool)
        change[1:] = False
        for g in group:
            ids = column[g] if not pa.types.is_string(column[g].type) else column[g].dictionary_encode().indices
            ids = np.asarray(ids)
            change[1:] |= ids[1:] != ids[:-1]
        if passed is not None:  # between a block's first and last run lie others
            change |= np.asarray(column["_edge"]) == 2
        if passed is None:  # a position delivered again
            first = np.asarray(column["_first"])
            kept = change.copy()
            kept[1:] |= first[1:] != first[:-1]
            if not kept.all():
                where = pa.array(np.flatnonzero(kept))
                column = {c: v.take(where) for c, v in column.items()}
                change, n = change[kept], int(kept.sum())
        label = np.asarray(column["_label"].dictionary_encode().indices.fill_null(-1))
        begin, end = (np.asarray(column[c].fill_null(_UNKNOWN)) for c in ("_begin", "_end"))
        first, last, count = (np.asarray(column[c]) for c in ("_first", "_last", "_count"))
        low = high = None
        if has_score:
            low, high = (np.asarray(column[c].fill_null(np.nan)) for c in ("_low", "_high"))
        cuts = [*np.flatnonzero(change).tolist(), n]
        heads: list[int] = []
        outs: list[list] = [[] for _ in range(7)]
        edge: list[int] = []
        for i, j in zip(cuts, cuts[1:]):
            part = [x[i:j].tolist() if x is not None else None for x in (label, first, last, count, begin, end, low, high)]
            kept_here = agglomerate(*part, scale, least, max_gap)
            top = len(kept_here) - 1
            for k, a in enumerate(kept_here):
                at_edge = k in (0, top)
                if passed is None and not at_edge and (part[3][a] < min_events or min_events > 1 and part[0][a] < 0):
                    continue
                heads.append(i + a)
                edge.append(at_edge + (at_edge and k > 1))
                for o, p in zip(outs, part[1:]):
                    if p is not None:
                        o.append(p[a])
        at = pa.array(heads, pa.int64())
        time = lambda v: pa.array(np.array(v, np.int64), pa.int64(), mask=np.array(v, np.int64) == _UNKNOWN)
        scores = lambda v: pa.array(v if has_score else [None] * len(heads), pa.float64())
        data = {k: column[k].take(at) for k in group}
        data |= {"_label": column["_label"].take(at), "_first": pa.array(outs[0], pa.int32()), "_last": pa.array(outs[1], pa.int32()), "_count": pa.array(outs[2], pa.int64())}
        data |= {"_begin": time(outs[3]), "_end": time(outs[4]), "_low": scores(outs[5]), "_high": scores(outs[6])}
        return pa.table(data | ({"_edge": pa.array(edge, pa.int32())} if passed is None else {}))

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if passed is not None:
            open_ = pc.equal(table.column(group[-1]), passed)
            yield from table.filter(pc.invert(open_)).drop_columns(["_edge"]).to_batches()
            table = table.filter(open_)
        if table.num_rows:
            yield from agglomerated(table).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches are joined until a group ends, so none is cut."""
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < BATCH_ROWS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            same = np.ones(table.num_rows, bool)
            for g in group:
                c = table.column(g)
                same &= np.asarray(pc.equal(c, c[-1]))
            start = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1
            if start:
                yield from work(table.slice(0, start))
                table = table.slice(start)
            held, rows = table.to_batches(), table.num_rows
        if held:
            yield from work(pa.Table.from_batches(held))

    return run


def runs(events: DataFrame, keys: list[str], position: str, label: str, at: str, newest_by: str | None = None, score: str | None = None, scale: float = 1.0, least: float = 1.0, max_gap_s: float | None = None, min_events: int = 1) -> DataFrame:
    """One row per run of each sequence: keys, label, first_position, last_position, events, duration_ms.

    events: keys name the sequence, position (INT) orders it. A position delivered again counts once, with the
    delivery of the highest newest_by (ties: the later time, then the greater label). Positions that are missing don't
    break a run. A null label breaks a run; its rows come out as runs of a null label, or not at all with
    min_events > 1. Rows with a null key or position belong to no sequence. A null time counts in the run but not in
    its duration (null if no time is known). A null score meets no limit, so it ends a run if score is given.
    An empty table gives no run. One shuffle of narrow rows by (sequence, block), one of runs.
    """
    if scale <= 0 or max_gap_s is not None and max_gap_s < 0 or min_events < 1:
        raise ValueError("scale must be positive, max_gap_s not negative, min_events at least 1")
    named = {k: f"_key{i}" for i, k in enumerate(keys)}
    ids = list(named.values())
    for k in (*keys, position):
        events = events.where(F.col(k).isNotNull())
    when = F.unix_micros(F.col(at).cast("timestamp"))
    value = (F.col(score) if score else F.lit(None)).cast("double")
    rows = events.select(*[F.col(k).cast("string").alias(c) for k, c in named.items()], F.shiftright(F.col(position).cast("int"), BLOCK_BITS).alias("_block"), F.col(label).alias("_label"), F.col(position).cast("int").alias("_first"), (F.col(newest_by) if newest_by else F.lit(0)).cast("long").alias("_newest"), when.alias("_begin"), value.alias("_low"))
    gap = float("inf") if max_gap_s is None else max_gap_s * 1e6
    options = (score is not None, scale, least, gap, min_events)
    fields = ", ".join([*[f"{c} string" for c in ids], "_block int", "_label string, _first int, _last int, _count long, _begin long, _end long, _low double, _high double"])
    newest = [F.desc("_newest"), F.desc("_begin"), F.desc("_label"), F.desc("_low")]
    # The columns that only repeat another are added behind the shuffle.
    single = rows.repartition(*ids, "_block").sortWithinPartitions(*ids, "_block", "_first", *newest).select(*ids, "_block", "_label", "_first", F.col("_first").alias("_last"), F.lit(1).cast("long").alias("_count"), "_begin", F.col("_begin").alias("_end"), "_low", F.col("_low").alias("_high"))
    merged = single.mapInArrow(_stage([*ids, "_block"], *options, None), fields + ", _edge int")
    # Of a sequence, at most two runs per block can go on in another block; they meet in group -1.
    placed = merged.withColumn("_block", F.when(F.col("_edge") > 0, -1).otherwise(F.col("_block")))
    joined = placed.repartition(*ids, "_block").sortWithinPartitions(*ids, "_block", "_first").mapInArrow(_stage([*ids, "_block"], *options, -1), fields)
    whole = joined.where(F.col("_count") >= min_events)
    if min_events > 1:
        whole = whole.where(F.col("_label").isNotNull())
    return whole.select(*[F.col(c).alias(k) for k, c in named.items()], F.col("_label").alias("label"), F.col("_first").alias("first_position"), F.col("_last").alias("last_position"), F.col("_count").alias("events"), ((F.col("_end") - F.col("_begin")) / 1000.0).alias("duration_ms"))
