"""Guards as pluggable scorers: what is asked where, per-trace errors, tokenisation checks.

A guard is an object with `tokenize(text) -> list of end characters` and `score(query, text, ends, at) -> list of
(label, unsafe_score)` for the asked tokens `at` (1-based). It is pickled to the workers; a model is loaded in
`open()`, once a task. No weights come with the library; the guards here are deterministic.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions.text import STOPS, char_slice
from tidegate.operators.replay import KEYS

_WORD = re.compile(r"\S+\s*|^\s+")
REGISTRY: dict[str, Callable[..., object]] = {}


def register(name: str) -> Callable:
    """Make a guard known by name, for configurations."""

    def keep(make: Callable) -> Callable:
        REGISTRY[name] = make
        return make

    return keep


def build(name: str, **settings: object) -> object:
    if name not in REGISTRY:
        raise ValueError(f"unknown guard {name}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](**settings)


@register("marker")
@dataclass(frozen=True)
class MarkerGuard:
    """Flags a token that holds one of some marker words. Asked at every token, or at the ends of intervals if checkpoints is set."""

    markers: tuple[str, ...]
    checkpoint_scoring: bool = False
    threshold: float = 0.5

    def open(self) -> MarkerGuard:
        return self

    def tokenize(self, text: str) -> list[int]:
        return [m.end() for m in _WORD.finditer(text)]

    def score(self, query: str | None, text: str, ends: list[int], at: list[int]) -> list[tuple[str, float]]:
        out = []
        for i in at:
            start = 0 if self.checkpoint_scoring or i == 1 else ends[i - 2]
            word = text[start : ends[i - 1]].lower()
            score = 0.9 if any(m in word for m in self.markers) else 0.1
            out.append(("unsafe" if score >= self.threshold else "safe", score))
        return out


@register("scripted")
@dataclass(frozen=True)
class ScriptedGuard:
    """Says what a script says, for tests: labels by token."""

    labels: tuple[str, ...]
    fail_on: str | None = None

    def open(self) -> ScriptedGuard:
        return self

    def tokenize(self, text: str) -> list[int]:
        return list(range(1, len(text) + 1))

    def score(self, query: str | None, text: str, ends: list[int], at: list[int]) -> list[tuple[str, float]]:
        if self.fail_on is not None and self.fail_on in text:
            raise RuntimeError(f"scripted failure on {self.fail_on}")
        return [(self.labels[(i - 1) % len(self.labels)], 0.0) for i in at]


SCORED = "trace_id string, token_index int, end_character int, risk_label string, unsafe_score double, evaluated boolean, error string"


def score_traces(traces: DataFrame, guard: object, asked: Callable[[list[int], str], list[int]] | None = None, done: DataFrame | None = None) -> DataFrame:
    """Token decisions of a guard on every trace. A trace that fails gives one row with the error and no token.

    asked: which tokens the guard is asked at (all by default); the others are safe and not evaluated. done: traces
    that are scored already (trace_id); they are left out, so a run can go on where it stopped. Null responses have no
    token. Ends that fall or pass the text are an error of the trace.
    """
    todo = traces.select("trace_id", "query", "response").where("response is not null")
    if done is not None:
        todo = todo.join(done.select("trace_id"), "trace_id", "left_anti")
    names = [c.split()[0] for c in SCORED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = guard.open()
        for batch in batches:
            rows = []
            for trace, query, text in zip(batch["trace_id"], batch["query"], batch["response"], strict=True):
                try:
                    ends = opened.tokenize(text)
                    if any(b < a for a, b in zip([0, *ends], ends)) or ends and ends[-1] != len(text):
                        raise ValueError("tokens don't cover the response")
                    at = list(range(1, len(ends) + 1)) if asked is None else asked(ends, text)
                    said = dict(zip(at, opened.score(query, text, ends, at), strict=True))
                    rows += [(trace, i, e, *said.get(i, ("safe", None)), i in said, None) for i, e in enumerate(ends, 1)]
                except Exception as e:  # a trace's failure is data
                    rows.append((trace, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=names)

    return todo.mapInPandas(run, SCORED)


def sentence_asks(ends: list[int], text: str) -> list[int]:
    """Where a prefix guard is asked: tokens whose own text holds a stop, and the last one."""
    return [i for i, (a, b) in enumerate(zip([0, *ends], ends), 1) if i == len(ends) or re.search(f"[{STOPS}]", text[a:b])]


def prefix_guard_checks(tokens: DataFrame, traces: DataFrame) -> DataFrame:
    """Per sequence: tokens whose own text holds a sentence stop, or that are the last; the same rule as sentence_asks, as a plan.

    A response is joined to the tokens of its trace after they are reduced to spans.
    """
    w = Window.partitionBy(*KEYS).orderBy("token_index")
    spans = tokens.withColumn("_from", F.coalesce(F.lag("end_character").over(w), F.lit(0))).withColumn("_last", F.max("token_index").over(Window.partitionBy(*KEYS)))
    own = char_slice(F.col("response"), F.col("_from"), F.col("end_character"))
    asked = F.regexp_like(own, F.lit(f"[{STOPS}]")) | (F.col("token_index") == F.col("_last"))
    joined = spans.select(*KEYS, "token_index", "_from", "end_character", "_last").join(traces.select("trace_id", "response"), "trace_id")
    return joined.groupBy(*KEYS).agg(F.count_if(asked).alias("checks"), F.count(F.lit(1)).alias("tokens"))
