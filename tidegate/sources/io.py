"""Readers and writers: Parquet, CSV, JSON, nested trace files, configurations, manifests."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 2
SOURCE = "query string, response string, query_label string, response_label string, unsafe_start_index int, safe_prefix string"
DECISION = "trace_id string, token_index int, token_id int, end_character int, risk_label string, risk_categories array<string>, confidence double, latency_ms double, unsafe_score double, safe_score double, controversial_score double, evaluated boolean, raw_output string"
PROMPT = "trace_id string, query_ground_truth string, risk_label string, risk_categories array<string>, confidence double, latency_ms double, error string"
TRACE = f"trace_id string, prompt_decision struct<{PROMPT.replace(' ', ':').replace(',:', ',')}>, decisions array<struct<{DECISION.replace(' ', ':').replace(',:', ',')}>>, model_id string, model_revision string, tokenizer_id string, tokenizer_revision string, device string, total_latency_ms double, schema_version int"
#: Names of a source's columns as delivered, and ours. Fixed values.
DELIVERED = {"Query": "query", "Response": "response", "Query_Label": "query_label", "Response_Label": "response_label", "Unsafe_Start_Index": "unsafe_start_index", "Safe_Prefix": "safe_prefix"}


def read_parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_source_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of source rows under their delivered names."""
    schema = ", ".join(f"{k} {'int' if v == 'unsafe_start_index' else 'string'}" for k, v in DELIVERED.items())
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return raw.select(*[F.col(k).alias(v) for k, v in DELIVERED.items()])


def from_rows(spark: SparkSession, rows: object, schema: str) -> DataFrame:
    """A DataFrame as it is, a pandas frame or a list of rows with a schema."""
    if isinstance(rows, DataFrame):
        return rows
    if hasattr(rows, "to_pandas"):
        rows = rows.to_pandas()
    return spark.createDataFrame(rows, schema)


def write_parquet(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path) if partition_by else df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(value: object, path: str) -> None:
    """UTF-8 JSON; NaN is refused."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, ensure_ascii=False, allow_nan=False, indent=2) + "\n", encoding="utf-8")


def write_trace_files(traces: DataFrame, path: str) -> None:
    """Scored traces with nested decisions, JSON lines."""
    traces.withColumn("schema_version", F.lit(SCHEMA_VERSION)).write.mode("overwrite").json(path)


def read_trace_files(spark: SparkSession, path: str) -> DataFrame:
    """Scored traces. Fields of older files that are not in the schema are dropped; another schema version fails the query."""
    raw = spark.read.schema(TRACE).json(path)
    return raw.where(F.assert_true(F.col("schema_version") == SCHEMA_VERSION, F.lit(f"schema version {SCHEMA_VERSION} is needed")).isNull())


def token_rows(traces: DataFrame, run_id: str) -> DataFrame:
    """One row per token of nested traces."""
    return traces.select(F.inline("decisions")).withColumn("run_id", F.lit(run_id))


def file_hash(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def manifest(df: DataFrame, repository: str, revision: str) -> DataFrame:
    """Rows, label histograms of a prepared table, in one row."""
    count = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce(F.col(c), F.lit("null")), F.col("n")))))
    both = None
    for c in ("query_label", "response_label"):
        m = df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(count(c).alias(f"{c}s"), F.sum("n").alias("rows"))
        both = m if both is None else both.crossJoin(m.drop("rows"))  # one row each
    return both.select(F.lit(repository).alias("repository"), F.lit(revision).alias("revision"), "rows", "query_labels", "response_labels")


def read_config(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) | {"name": Path(path).stem}


def configs(directory: str, baseline: str | None = None) -> list[dict]:
    """All configurations of a directory, the baseline first, then by file name."""
    paths = sorted(Path(directory).glob("*.yaml"), key=lambda p: (p.stem != baseline, p.name))
    return [read_config(str(p)) for p in paths]
