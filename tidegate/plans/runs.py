"""Runs on disk: identity, resume, replay from saved decisions, reports.

A run directory holds token_decisions, prompt_decisions and intervention_results as Parquet, errors as CSV, and
metadata.json. Scoring and replay have identities of their own: a change of replay settings replays saved decisions
and scores nothing.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.operators import metrics as M
from tidegate.operators import replay as R
from tidegate.plans.scoring import build, score_traces, sentence_asks
from tidegate.sources import io

TABLES = ("token_decisions", "prompt_decisions", "intervention_results")
ERRORS = "run_id string, trace_id string, model_id string, error string"
REPLAY_SETTINGS = ("modes", "policies", "trigger_mode", "trigger_count", "trigger_window", "max_sentence")


def identity(settings: dict) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def scoring_identity(config: dict) -> str:
    """Hash of what the decisions depend on; replay settings are not part of it."""
    experiment = {k: v for k, v in config.get("experiment", {}).items() if k not in REPLAY_SETTINGS and k != "output_dir"}
    return identity({"dataset": config.get("dataset"), "model": config.get("model"), "experiment": experiment})


def rules_of(config: dict) -> list[R.Rule]:
    e = config.get("experiment", {})
    return [R.Rule(p, e.get("trigger_mode", "cumulative"), e.get("trigger_count", 1), e.get("trigger_window")) for p in e.get("policies", list(R.POLICIES))]


def same_model(saved: dict, model: dict) -> bool:
    """Whether saved decisions were made by the model a configuration describes: its guard, revision, threshold and settings, as far as it names them."""
    stated = saved.get("config", {}).get("model", {})
    return all(stated.get(k) == v for k, v in model.items() if v is not None) and stated.get("threshold") == model.get("threshold")


def prompt_decisions(traces: DataFrame, guard: object, failed: DataFrame) -> DataFrame:
    """(trace_id, query_ground_truth, risk_label, latency_ms, error) of every trace: what the guard says of the query if it judges queries (`score_query`), `not_evaluated` else; a failed trace has no label but its error."""
    ask = getattr(guard, "score_query", None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said = []
            for q in b["query"]:
                began = time.perf_counter()
                said.append((ask(q) if q is not None else "not_evaluated", 1000 * (time.perf_counter() - began)))
            yield pd.DataFrame({"trace_id": b["trace_id"], "risk_label": [x for x, _ in said], "latency_ms": [y for _, y in said]})

    rows = traces.select("trace_id", "query")
    judged = rows.mapInPandas(run, "trace_id string, risk_label string, latency_ms double") if ask else rows.select("trace_id", F.lit("not_evaluated").alias("risk_label"), F.lit(0.0).alias("latency_ms"))
    truth = traces.select("trace_id", (F.col("query_truth") if "query_truth" in traces.columns else F.lit(None).cast("string")).alias("query_ground_truth"))
    both = truth.join(judged, "trace_id").join(failed.select("trace_id", "error"), "trace_id", "left")
    return both.select("trace_id", "query_ground_truth", F.when(F.col("error").isNull(), F.col("risk_label")).alias("risk_label"), F.when(F.col("error").isNull(), F.col("latency_ms")).otherwise(0.0).alias("latency_ms"), "error")


def run_exists(directory: str, config: dict) -> bool:
    """Whether a finished run of the same scoring is there."""
    meta = Path(directory) / "metadata.json"
    return meta.exists() and json.loads(meta.read_text()).get("scoring_identity") == scoring_identity(config)


def run_or_load(spark: SparkSession, config: dict, traces: DataFrame, force: bool = False) -> dict[str, DataFrame]:
    """Score what isn't scored yet, replay, save and return the run's tables. A saved run of the same identity is loaded."""
    directory = config["experiment"]["output_dir"]
    if not force and run_exists(directory, config) and json.loads((Path(directory) / "metadata.json").read_text()).get("configuration") == identity(config):
        return load_run(spark, directory)
    Path(directory).mkdir(parents=True, exist_ok=True)
    run_id = scoring_identity(config)[:12]
    scored_at = f"{directory}/token_decisions"
    guard = build(config["model"]["guard"], **config["model"].get("settings", {}))
    if force or not run_exists(directory, config):
        asked = sentence_asks if getattr(guard, "checkpoint_scoring", False) else None
        begun = Path(directory, "scoring.json")
        resumed = not force and begun.exists() and json.loads(begun.read_text()) == scoring_identity(config) and Path(scored_at).exists()
        done = spark.read.parquet(scored_at).select("trace_id").distinct() if resumed else None
        begun.write_text(json.dumps(scoring_identity(config)))
        scored = score_traces(traces, guard, asked, done).withColumns({"run_id": F.lit(run_id), "latency_ms": F.lit(0.0), "confidence": F.lit(None).cast("double"), "controversial_score": F.lit(None).cast("double")})
        scored.write.mode("append" if resumed else "overwrite").parquet(scored_at)
    decisions = spark.read.parquet(scored_at)
    sequences = traces.select("trace_id").join(decisions.where("error is not null").select("trace_id", "error"), "trace_id", "left").select(F.lit(run_id).alias("run_id"), "trace_id", F.lit(config["model"]["guard"]).alias("model_id"), "error")
    tokens = decisions.where("error is null").select("run_id", "trace_id", "token_index", "end_character", "latency_ms", "unsafe_score", "controversial_score", "confidence", "evaluated", F.col("risk_label").alias("label"))
    e = config["experiment"]
    cap = e.get("max_sentence", 128)
    results = R.replay(R.numbered(tokens, sequences, traces, cap), sequences, traces, rules_of(config), tuple(e.get("modes", R.MODES)), cap)
    io.write_parquet(results, f"{directory}/intervention_results")
    io.write_parquet(prompt_decisions(traces, guard, sequences.where("error is not null")), f"{directory}/prompt_decisions")
    io.write_csv(sequences.where("error is not null"), f"{directory}/errors")
    io.write_json({"scoring_identity": scoring_identity(config), "configuration": identity(config), "run_id": run_id, "config": config}, f"{directory}/metadata.json")
    return load_run(spark, directory)


def load_run(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    missing = [t for t in (*TABLES, "errors", "metadata.json") if not (Path(directory) / t).exists()]
    if missing:
        raise FileNotFoundError(f"{directory} lacks {', '.join(missing)}")
    return {t: spark.read.parquet(f"{directory}/{t}") for t in TABLES} | {"errors": spark.read.schema(ERRORS).option("header", True).csv(f"{directory}/errors")}


def load_saved_runs(spark: SparkSession, config_directory: str, baseline: str | None = None) -> DataFrame:
    """Results of every configured run that is saved, tagged with its model; the baseline's configuration first, then by name."""
    out = None
    for config in io.configs(config_directory, baseline):
        directory = config["experiment"]["output_dir"]
        if run_exists(directory, config):
            tagged = load_run(spark, directory)["intervention_results"].withColumn("model", F.lit(config["name"]))
            out = tagged if out is None else out.unionByName(tagged)
    if out is None:
        raise FileNotFoundError(f"no saved run of {config_directory}")
    return out


def write_reports(results: DataFrame, directory: str) -> None:
    io.write_csv(M.response_metrics(results, True), f"{directory}/response_policy_metrics")
    io.write_csv(M.streaming_metrics(results), f"{directory}/streaming_metrics")
