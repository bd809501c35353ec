"""Live replay with Structured Streaming: token decisions come in, stops go out as soon as a rule fires.

State per (run_id, trace_id): where the current buffer began, where the last stop was, and for each rule its running
count, run length and the last k flags. It is a few numbers, whatever the length of a response. Tokens must come in
order within a sequence; a token with a lower index than the last is a repeated delivery and is ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegate.operators.replay import CHUNKS, POLICIES, Rule

OUTPUT = "run_id string, trace_id string, mode string, rule int, signal_token int, released_tokens int"
STATE = "last int, start int, fired array<boolean>, counts array<int>, runs array<int>, inside array<int>, recent array<array<int>>"


def live_signals(decisions: DataFrame, rules: list[Rule], mode: str = "token", timeout_ms: int | None = None, max_sentence: int = 128) -> DataFrame:
    """(run_id, trace_id, mode, rule, signal_token, released_tokens), once per rule that fires.

    decisions: run_id, trace_id, token_index, label, evaluated, terminal (a sentence ends at the token) and, if there is
    one, closes (the response ends at the token: its state is dropped). All buffers have a live form; sentences are cut
    every max_sentence tokens, and a full buffer has released nothing when a rule fires. A sequence without tokens for timeout_ms is forgotten (None: never; with a timeout Spark runs batches without data too).
    """
    if mode not in ("token", "sentence", "full_buffered", *CHUNKS):
        raise ValueError(f"mode {mode} has no live form")
    if any(r.threshold is not None for r in rules):
        raise ValueError("live rules read labels; apply thresholds to the stream before")

    has_end = "closes" in decisions.columns

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = len(rules)
        last, start, fired, counts, runs, inside, recent = state.get if state.exists else (0, 0, [False] * n, [0] * n, [0] * n, [0] * n, [[] for _ in rules])
        fired, counts, runs, inside, recent = list(fired), list(counts), list(runs), list(inside), [list(r) for r in recent]
        rows = []
        frames = [b for b in batches]
        for t in pd.concat(frames).sort_values("token_index").itertuples() if frames else ():
            i = int(t.token_index)
            if i <= last:
                continue
            if mode in CHUNKS and (i - 1) // CHUNKS[mode] * CHUNKS[mode] > start or mode == "token":
                start = i - 1 if mode == "token" else (i - 1) // CHUNKS[mode] * CHUNKS[mode]
                inside = [0] * n
            if mode == "sentence" and i - start > max_sentence:
                start, inside = start + (i - start - 1) // max_sentence * max_sentence, [0] * n
            for k, r in enumerate(rules):
                flag = bool(t.evaluated) and t.label in POLICIES[r.policy]
                runs[k] = (runs[k] if i == last + 1 else 0) + 1 if flag else 0
                if not flag:
                    continue
                counts[k] += 1
                inside[k] += 1
                recent[k] = [*recent[k], i][-r.trigger_count :]
                hit = {"cumulative": counts[k], "consecutive": runs[k], "buffer": inside[k], "window": len(recent[k]) if i - recent[k][0] < (r.trigger_window or 0) else 0}[r.trigger_mode] >= r.trigger_count
                if hit and not fired[k]:
                    fired[k] = True
                    rows.append((*key, mode, k, i, start))
            last = i
            if mode == "sentence" and bool(t.terminal):
                start, inside = i, [0] * n
        if has_end and any(b["closes"].fillna(False).any() for b in frames):
            state.remove()
        else:
            state.update((last, start, fired, counts, runs, inside, recent))
        if timeout_ms is not None and state.exists:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(rows, columns=["run_id", "trace_id", "mode", "rule", "signal_token", "released_tokens"])

    return decisions.groupBy("run_id", "trace_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
