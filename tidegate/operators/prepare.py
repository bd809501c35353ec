"""From delivered tables to clean ones: one row a trace, a scored sequence, a token decision; and the checks of a source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.text import char_slice, normal_label

SOURCE_COLUMNS = ["query", "response", "query_label", "response_label", "unsafe_start_index", "safe_prefix"]
LABELS = ("safe", "unsafe")


#: What a table of traces has to hold. Fixed values.
TRACE_COLUMNS = ("trace_id", "query", "response", "query_label", "response_label", "unsafe_start_character", "unsafe_start_token", "response_token_count")


def require_columns(df: DataFrame, names: tuple[str, ...] | list[str] = TRACE_COLUMNS) -> DataFrame:
    """df itself; missing columns are an error before anything runs."""
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def optional(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with those of the columns (name: type) it lacks, null."""
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items() if c not in df.columns})


def latest(df: DataFrame, keys: list[str], columns: list[Column | str], newest_by: Column) -> DataFrame:
    """The latest delivery per key; rows with a null key are left out. Partly aggregated before the shuffle; ties go to the greater row."""
    known = reduce(lambda a, k: a.where(F.col(k).isNotNull()), keys, df)
    return known.groupBy(*keys).agg(F.max(F.struct(newest_by.alias("_at"), *columns)).alias("_r")).select(*keys, "_r.*").drop("_at")


def traces(examples: DataFrame) -> DataFrame:
    """One row per trace with a truth. A missing label follows from the onset: behind the last character is safe; without either the truth is null."""
    at = F.coalesce("ingested_at", F.lit(0).cast("timestamp")) if "ingested_at" in examples.columns else F.lit(0)
    columns = ["query", "response", "query_label", "response_label", "unsafe_start_character", "unsafe_start_token", "response_token_count"]
    once = latest(require_columns(examples), ["trace_id"], columns, at)
    by_onset = F.when(F.col("unsafe_start_character") >= F.length("response"), "safe").when(F.col("unsafe_start_character").isNotNull(), "unsafe")
    truth = F.coalesce(normal_label(F.col("response_label")), by_onset)
    return once.withColumn("response_truth", truth).withColumn("query_truth", normal_label(F.col("query_label")))


def sequences(guard_traces: DataFrame) -> DataFrame:
    """One row per (run_id, trace_id) with model, error and the decision on the prompt."""
    at = F.coalesce("ingested_at", F.lit(0).cast("timestamp"))
    p = "prompt_decision"
    once = latest(guard_traces, ["run_id", "trace_id"], ["model_id", "error", "total_latency_ms", F.col(f"{p}.query_ground_truth").alias("query_ground_truth"), F.col(f"{p}.risk_label").alias("prompt_label"), F.col(f"{p}.confidence").alias("prompt_confidence")], at)
    return once.withColumn("prompt_label", normal_label(F.col("prompt_label"))).withColumn("query_ground_truth", normal_label(F.col("query_ground_truth")))


def token_decisions(tokens: DataFrame) -> DataFrame:
    """Each token of each sequence once, by the latest batch, with normal labels. Moved once, by (run_id, trace_id)."""
    columns = ["token_index", "end_character", "risk_label", "latency_ms", "unsafe_score", "controversial_score", "confidence", "evaluated", "ingest_batch"]
    placed = tokens.select("run_id", "trace_id", *columns).repartition("run_id", "trace_id")
    once = latest(placed, ["run_id", "trace_id", "token_index"], [c for c in columns if c not in ("token_index", "ingest_batch")], F.coalesce("ingest_batch", F.lit(0)))
    return once.withColumn("label", normal_label(F.col("risk_label"))).withColumn("evaluated", F.coalesce("evaluated", F.lit(False))).drop("risk_label")


def validate_source(df: DataFrame, expected_rows: int | None = None) -> DataFrame:
    """(check, passed, detail), one aggregation over the source. With columns missing only that check is reported. Null values fail the checks on values; an empty table passes them."""
    missing = sorted(set(SOURCE_COLUMNS) - set(df.columns))
    if missing:
        return df.sparkSession.createDataFrame([("required_columns", False, ", ".join(missing))], "check string, passed boolean, detail string")
    onset, response = F.col("unsafe_start_index"), F.col("response")
    integer = df.schema["unsafe_start_index"].dataType.typeName() in ("integer", "long", "short", "byte")
    all_of = lambda c: F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(True))
    in_range = all_of(onset.between(0, F.length(response)))
    prefix = F.coalesce(F.col("safe_prefix") == char_slice(response, F.lit(0), onset), F.lit(False))
    label_fits = (F.col("response_label") == "safe") & (onset == F.length(response)) | (F.col("response_label") == "unsafe") & (onset < F.length(response))
    m = df.agg(
        F.count(F.lit(1)).alias("n"), all_of(F.col("query_label").isin(*LABELS)).alias("ql"), all_of(F.col("response_label").isin(*LABELS)).alias("rl"),
        all_of((F.length("query") > 0) & (F.length(response) > 0)).alias("text"), all_of(onset.isNotNull() & F.lit(integer)).alias("onset"), in_range.alias("range"),
        F.count_if(prefix).alias("same"), F.count_if(~prefix).alias("other"), all_of(label_fits).alias("fits"),
    )
    usable = F.col("onset") & F.col("range")
    rows = [
        ("required_columns", F.lit(True), F.lit("")), ("row_count", F.lit(expected_rows is None) | (F.col("n") == F.lit(expected_rows or 0)), F.col("n").cast("string")),
        ("query_labels", F.col("ql"), F.lit("")), ("response_labels", F.col("rl"), F.lit("")), ("nonempty_text", F.col("text"), F.lit("")), ("onset_integer", F.col("onset"), F.lit("")), ("onset_range", usable, F.lit("")),
        ("safe_prefix_exact", usable & (F.col("other") == 0), F.when(usable, F.format_string("%d matching, %d mismatching", "same", "other")).otherwise("not evaluated: invalid onset")),
        ("label_onset_consistency", usable & F.col("fits"), F.lit("")), ("unicode_unchanged", F.lit(True), F.lit("")),
    ]
    return m.select(F.inline(F.array(*[F.struct(F.lit(c).alias("check"), p.alias("passed"), d.alias("detail")) for c, p, d in rows])))


def prefix_report(df: DataFrame) -> DataFrame:
    """How the stated prefixes agree with the responses: exact, missing, inexact, or no onset to compare."""
    exact = F.col("safe_prefix") == char_slice(F.col("response"), F.lit(0), F.col("onset"))
    kind = F.when(F.col("onset").isNull() | F.col("response").isNull(), "no onset").when(F.col("safe_prefix").isNull(), "missing").when(exact, "exact").otherwise("inexact")
    return df.groupBy(kind.alias("prefix")).agg(F.count(F.lit(1)).alias("rows"))


def onset_tokens(tokens: DataFrame, traces_: DataFrame) -> DataFrame:
    """(run_id, trace_id, onset_token): the first token that ends behind the onset character; tokens + 1 for a safe trace.

    A token the onset falls into counts as a whole. An onset behind the last token, or no onset, counts as tokens + 1.
    """
    onset = traces_.select("trace_id", "unsafe_start_character", "response_truth")
    hit = F.when((F.col("response_truth") == "unsafe") & (F.col("end_character") > F.col("unsafe_start_character")), F.col("token_index"))
    return tokens.join(onset, "trace_id").groupBy("run_id", "trace_id").agg(F.coalesce(F.min(hit), F.max("token_index") + 1).alias("onset_token"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def require_unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """df itself; the query fails when a key occurs twice. One shuffle by the keys."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*df.columns)).alias("_r"))
    checked = counted.where(F.assert_true(F.col("_n") == 1, F.lit(f"{what} must be unique by {', '.join(keys)}")).isNull())
    return checked.select("_r.*")


def profile(traces_: DataFrame, name: str, expected_rows: int | None = None) -> DataFrame:
    """full: all traces (expected_rows checked by the caller's choice). smoke2: the first safe trace and the first unsafe one whose onset is not the first character."""
    if name == "full":
        if expected_rows is not None and (n := traces_.count()) != expected_rows:
            raise ValueError(f"{expected_rows} traces expected, {n} found")
        return traces_
    if name != "smoke2":
        raise ValueError(f"unknown profile {name}")
    safe = traces_.where("response_truth = 'safe'").orderBy("trace_id").limit(1)
    unsafe = traces_.where("response_truth = 'unsafe' and unsafe_start_character > 0").orderBy("trace_id").limit(1)
    return safe.unionByName(unsafe)
