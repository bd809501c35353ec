"""Tokens and operations that a guard spends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.operators.replay import KEYS, intervals

#: Floating point operations per parameter and token. Fixed value.
FLOPS = 2


def streaming_cost(results: DataFrame, query_tokens: DataFrame) -> DataFrame:
    """A guard that reads the stream once: the query and every token up to the stop. query_tokens: trace_id, query_tokens; a trace without is charged its tokens only."""
    read = F.coalesce("intervention_token", "released_tokens")
    return results.join(query_tokens, "trace_id", "left").select(*KEYS, "model_id", "mode", "policy", read.cast("long").alias("model_calls"), (F.coalesce("query_tokens", F.lit(0)) + read).cast("long").alias("tokens"), (F.coalesce("query_tokens", F.lit(0)) + read).cast("long").alias("tokens_cached"))


def prefix_cost(results: DataFrame, checks: DataFrame, query_check_tokens: DataFrame | None = None) -> DataFrame:
    """A guard that reads the prefix again at every check up to the stop.

    checks: run_id, trace_id, mode, token_index, head_tokens, tail_tokens, generated_tokens, one row per check the mode
    makes. tokens reads head and tail each time; tokens_cached reads the longest head once. A failed or unchecked
    sequence makes no call. query_check_tokens (trace_id, query_tokens) adds the check of the query.
    """
    stop = F.coalesce("intervention_token", "released_tokens")
    made = results.select(*KEYS, "mode", "policy", "rule", stop.alias("_stop")).join(checks, [*KEYS, "mode"]).where(F.col("token_index") <= F.col("_stop"))
    repeated = F.sum(F.col("tail_tokens") + F.col("generated_tokens"))
    spent = made.groupBy(*KEYS, "mode", "rule").agg(F.count(F.lit(1)).alias("_calls"), (F.sum("head_tokens") + repeated).alias("_tokens"), (F.max("head_tokens") + repeated).alias("_cached"))
    out = results.select(*KEYS, "model_id", "mode", "policy", "rule").join(spent, [*KEYS, "mode", "rule"], "left").na.fill(0, ["_calls", "_tokens", "_cached"])
    extra, calls = F.lit(0), F.lit(0)
    if query_check_tokens is not None:
        out, calls = out.join(query_check_tokens, "trace_id", "left"), F.lit(1)
        extra = F.coalesce("query_tokens", F.lit(0))
    return out.select(*KEYS, "model_id", "mode", "policy", (F.col("_calls") + calls).cast("long").alias("model_calls"), (F.col("_tokens") + extra).cast("long").alias("tokens"), (F.col("_cached") + extra).cast("long").alias("tokens_cached"))


def mode_checks(numbered: DataFrame, modes: tuple[str, ...], head: int, tail: int, generated: int, max_sentence: int = 128) -> DataFrame:
    """The checks each mode makes at delivered tokens: evaluated tokens at the end of an interval; the head is a fixed part plus the prefix."""
    at = numbered.where("evaluated").select(*KEYS, "token_index", F.inline(intervals(modes, max_sentence))).where("end = token_index")
    return at.select(*KEYS, "mode", "token_index", (F.lit(head) + F.col("token_index")).cast("long").alias("head_tokens"), F.lit(tail).cast("long").alias("tail_tokens"), F.lit(generated).cast("long").alias("generated_tokens"))


def summarise(cost: DataFrame, models: DataFrame) -> DataFrame:
    """Mean calls, tokens and 10^12 operations per model, mode and policy. models: model_id, parameters_millions, a short list."""
    scale = FLOPS * F.first("parameters_millions") * 1e6 / 1e12
    return cost.join(F.broadcast(models.select("model_id", "parameters_millions")), "model_id").groupBy("model_id", "mode", "policy").agg(*[F.avg(c).alias(c) for c in ("model_calls", "tokens", "tokens_cached")], (F.avg("tokens") * scale).alias("tflops"), (F.avg("tokens_cached") * scale).alias("tflops_cached"))
