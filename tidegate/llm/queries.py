"""Queries of the eight problems, over their whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import p1_pairs, p2_percentiles, p3_sentences, p4_pieces, p5_runs, p6_containers, p7_mix, p8_languages
from tidegate.llm.tokens import token_count
from tidegate.session import checkpointed, spread, table

LIMIT, OVERLAP = 200, 20
FRACTIONS = [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
METRICS = ["leakage_median", "leakage_p90", "detection_delay_median"]
ACCURACY = 0.01


def p1_pairs_all(spark: SparkSession, d: str) -> DataFrame:
    """Every triggered defect of every pair. Languages that share a script are told apart by the model of problem 8."""
    pairs = table(spark, d, "synthetic_singstreambench_sample")
    _, codes, model = _model(spark, d)
    scripts = {r["code"]: r["script"] for r in codes.where("script is not null").limit(1000).collect()}
    return p1_pairs.pairs(pairs, "pair_id", "query", "response", "ingested_at", model, scripts).select("pair_id", "defect", "first")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pairs_all(spark, d).where("first").select("pair_id", "defect")


def p1_by_label(spark: SparkSession, d: str) -> DataFrame:
    """How the defects spread over the stated response labels."""
    pairs = table(spark, d, "synthetic_singstreambench_sample")
    labels = p3_sentences.once_per_key(pairs, "pair_id", ["response_label"], "ingested_at").select("pair_id", p5_runs.normal_label(F.col("response_label")).alias("response_label"))
    return p1_pairs_all(spark, d).where("first").join(labels, "pair_id").groupBy("response_label", "defect").agg(F.count(F.lit(1)).alias("pairs"))


def _metric_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each (run_id, shard, mode, policy) once, by the latest delivery; deliveries are equal but for their time, so this adds up in part before the shuffle."""
    at = F.coalesce("ingested_at", F.lit(0).cast("timestamp"))
    keys = ["run_id", "shard", "mode", "policy", "model_id", "run_date"]
    return table(spark, d, "streaming_metrics").groupBy(*keys).agg(*[F.max_by(m, at).alias(m) for m in METRICS])


def _sketch_by_day(spark: SparkSession, d: str) -> DataFrame:
    return p2_percentiles.sketch(_metric_rows(spark, d), ["model_id", "mode", "policy", "run_date"], METRICS, ACCURACY, F.col("value") >= 0)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in ("value", "low", "high") else c for c in df.columns])


def p2_percentiles_by_group(spark: SparkSession, d: str) -> DataFrame:
    keys = ["model_id", "mode", "policy"]
    sketch = p2_percentiles.sketch(_metric_rows(spark, d), keys, METRICS, ACCURACY, F.col("value") >= 0)
    return _rounded(p2_percentiles.quantiles(sketch, keys, FRACTIONS, ACCURACY))


def p2_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Medians and p90 of every single day."""
    return _rounded(p2_percentiles.quantiles(_sketch_by_day(spark, d), ["model_id", "mode", "policy", "run_date"], [0.5, 0.9], ACCURACY))


def p2_merged_days(spark: SparkSession, d: str) -> DataFrame:
    """The same as over all rows, from the sketches of single days."""
    keys = ["model_id", "mode", "policy"]
    return _rounded(p2_percentiles.quantiles(p2_percentiles.merge(_sketch_by_day(spark, d), keys), keys, FRACTIONS, ACCURACY))


def _responses(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    return p3_sentences.once_per_key(table(spark, d, "benchmark_example"), "trace_id", columns, "ingested_at")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_sentences.sentences(_responses(spark, d, ["response"]), "trace_id", "response").select("trace_id", "end_character")


def p3_units(spark: SparkSession, d: str) -> DataFrame:
    """Units of response and safe_prefix with their text."""
    rows = _responses(spark, d, ["response", "safe_prefix"])
    texts = rows.select("trace_id", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in ("response", "safe_prefix")])).alias("_t")).select("trace_id", "_t.field", "_t.text")
    found = texts.where("text is not null").select("trace_id", "field", p3_sentences.sentence_texts("text").alias("_units"))
    return found.select("trace_id", "field", F.posexplode("_units").alias("_no", "_s")).select("trace_id", "field", (F.col("_no") + 1).alias("sentence_no"), F.col("_s.start").alias("start_character"), F.col("_s.end").alias("end_character"), "_s.unit")


def p4_cut(spark: SparkSession, d: str) -> DataFrame:
    return p4_pieces.pieces(_responses(spark, d, ["response"]), "trace_id", "response", LIMIT, OVERLAP)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pieces.cut_kinds(p4_cut(spark, d), "trace_id", LIMIT)


def _runs(spark: SparkSession, d: str, min_events: int, **options: object) -> DataFrame:
    tokens = table(spark, d, "response_token_decision").where("evaluated")
    tokens = tokens.select("run_id", "trace_id", "token_index", "scored_at", "ingest_batch", "unsafe_score", p5_runs.normal_label(F.col("risk_label")).alias("label"))
    return p5_runs.runs(tokens, ["run_id", "trace_id"], "token_index", "label", "scored_at", "ingest_batch", min_events=min_events, **options)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d, 2).select("run_id", "trace_id", F.col("first_position").alias("first_token_index"), F.col("last_position").alias("last_token_index"))


def p5_runs_all(spark: SparkSession, d: str) -> DataFrame:
    """Every run with its count and duration, runs of one event included."""
    return _runs(spark, d, 1).where("label is not null").select("run_id", "trace_id", "label", F.col("first_position").alias("first_token_index"), F.col("last_position").alias("last_token_index"), "events", F.round("duration_ms", 3).alias("duration_ms"))


def p5_near_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one label whose unsafe scores lie within 0.2 and whose events are at most ten seconds apart."""
    return _runs(spark, d, 2, score="unsafe_score", scale=1.0, least=0.8, max_gap_s=10.0).select("run_id", "trace_id", "label", F.col("first_position").alias("first_token_index"), F.col("last_position").alias("last_token_index"), "events", F.round("duration_ms", 3).alias("duration_ms"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their size in tokens. The count runs in the JVM; it is written once since it is read for the counts and for the ranks."""
    return checkpointed(table(spark, d, "documents").select("doc_id", "source", token_count(F.col("text")).alias("tokens")))


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    kinds = [(r["container_kind"], int(r["capacity_tokens"])) for r in table(spark, d, "container_size").collect()]  # three rows, fixed
    packed = p6_containers.pack(_sized(spark, d), "doc_id", "tokens", [c for _, c in kinds])
    names = spark.createDataFrame(kinds, "container_kind string, capacity_tokens int")
    return packed.join(F.broadcast(names), "capacity_tokens").select("container_kind", "capacity_tokens", "container", "place", "doc_id", "piece_no", "first_token", "tokens")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return p6_containers.fill(p6_packed(spark, d))


def p7_mixed(spark: SparkSession, d: str) -> DataFrame:
    return p7_mix.mix(_sized(spark, d), "doc_id", "source", "tokens", table(spark, d, "source_target"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return p7_mix.shares(p7_mixed(spark, d), table(spark, d, "source_target"))


def _model(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, p8_languages.LanguageModel]:
    documents, codes = spread(table(spark, d, "documents").select("doc_id", "text", "lang")), table(spark, d, "language_code")
    return documents, codes, p8_languages.fit_languages(documents, "doc_id", "text", "lang", codes)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    documents, codes, model = _model(spark, d)
    return p8_languages.wrong_labels(documents, "doc_id", "text", "lang", codes, model).select("doc_id", "start_char", "lang")


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every segment of every text with its language and confidence."""
    documents, _, model = _model(spark, d)
    return p8_languages.segments(documents, "doc_id", "text", model).select("doc_id", "segment_no", "segments", "start_char", "end_char", "lang", F.round("confidence", 4).alias("confidence"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found, "p1_pairs": p1_pairs_all, "p1_by_label": p1_by_label,
        "p2_percentiles": p2_percentiles_by_group, "p2_by_day": p2_by_day, "p2_merged_days": p2_merged_days,
        "p3_found": p3_found, "p3_units": p3_units,
        "p4_found": p4_found, "p4_pieces": p4_cut,
        "p5_found": p5_found, "p5_runs": p5_runs_all, "p5_near_runs": p5_near_runs,
        "p6_packed": p6_packed, "p6_fill": p6_fill,
        "p7_mixed": p7_mixed, "p7_shares": p7_shares,
        "p8_found": p8_found, "p8_segments": p8_segments,
    }
