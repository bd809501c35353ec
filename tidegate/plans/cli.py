"""Command line: python -m tidegate.plans.cli prepare|validate|run|reports|cost ..."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from tidegate.functions.text import whole_word_tokens
from tidegate.operators import cost, prepare
from tidegate.plans import runs
from tidegate.session import build_session
from tidegate.sources import io


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidegate")
    sub = p.add_subparsers(dest="what", required=True)
    for name, arguments in {"prepare": ["examples", "out"], "validate": ["source", "out"], "run": ["config", "traces"], "reports": ["run", "out"], "cost": ["run", "traces", "models", "out"]}.items():
        s = sub.add_parser(name)
        for a in arguments:
            s.add_argument(a)
        if name == "validate":
            s.add_argument("--rows", type=int)
        if name == "run":
            s.add_argument("--force", action="store_true")
            s.add_argument("--profile", default="full")
    return p


def main(arguments: list[str] | None = None) -> None:
    a = _parser().parse_args(arguments)
    spark = build_session()
    if a.what == "prepare":
        io.write_parquet(prepare.traces(spark.read.parquet(a.examples)), a.out)
        io.write_parquet(io.manifest(spark.read.parquet(a.examples), a.examples, "1"), f"{a.out}_manifest")
    elif a.what == "validate":
        io.write_csv(prepare.validate_source(spark.read.parquet(a.source), a.rows), a.out)
    elif a.what == "run":
        runs.run_or_load(spark, io.read_config(a.config), prepare.profile(spark.read.parquet(a.traces), a.profile), a.force)
    elif a.what == "reports":
        runs.write_reports(runs.load_run(spark, a.run)["intervention_results"], a.out)
    else:
        queries = spark.read.parquet(a.traces).select("trace_id", F.size(whole_word_tokens(F.col("query"))).alias("query_tokens"))
        spent = cost.streaming_cost(runs.load_run(spark, a.run)["intervention_results"], queries)
        io.write_csv(cost.summarise(spent, spark.read.parquet(a.models)), a.out)


if __name__ == "__main__":
    main()
