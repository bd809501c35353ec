"""Tables behind reports and figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions.stats import fisher_exact, ratio
from tidegate.functions.text import lstrip, word_count
from tidegate.operators.ranking import rank_within


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """How often each value occurs in each of several columns, side by side; 0 where it doesn't."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("string").alias("value")) for c in columns])))
    return long.groupBy("value").pivot("_c", columns).count().na.fill(0)


def crosstab(df: DataFrame, a: str, b: str, values_a: list[str], values_b: list[str]) -> DataFrame:
    """Counts of a x b over the full grid of values; others are left out."""
    grid = df.sparkSession.createDataFrame([(x, y) for x in values_a for y in values_b], f"{a} string, {b} string")
    counts = df.where(F.col(a).isin(values_a) & F.col(b).isin(values_b)).groupBy(a, b).agg(F.count(F.lit(1)).alias("rows"))
    return F.broadcast(grid).join(counts, [a, b], "left").na.fill(0, ["rows"])


def describe(df: DataFrame, columns: dict[str, Column], keys: list[str]) -> DataFrame:
    """count, mean, median, p90, p95 and max of several measures per group. Whole numbers, so exact percentiles hold distinct values only."""
    long = df.select(*keys, F.inline(F.array(*[F.struct(F.lit(k).alias("measure"), c.cast("double").alias("v")) for k, c in columns.items()])))
    return long.groupBy(*keys, "measure").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), *[F.percentile("v", p).alias(k) for k, p in (("median", 0.5), ("p90", 0.9), ("p95", 0.95))], F.max("v").alias("max"))


def text_measures() -> dict[str, Column]:
    return {"query_chars": F.length("query"), "response_chars": F.length("response"), "response_words": word_count(F.col("response")), "onset": F.col("unsafe_start_character")}


def histogram(df: DataFrame, value: Column, width: float, keys: list[str]) -> DataFrame:
    """Rows per bin of fixed width; null values are in no bin."""
    return df.where(value.isNotNull()).groupBy(*keys, (F.floor(value / width) * width).cast("double").alias("bin")).agg(F.count(F.lit(1)).alias("rows"))


def onset_groups(traces: DataFrame) -> DataFrame:
    unsafe = F.col("response_truth") == "unsafe"
    return traces.agg(F.count_if(unsafe & (F.col("unsafe_start_character") == 0)).alias("at_start"), F.count_if(unsafe & (F.col("unsafe_start_character") > 0)).alias("later"), F.count_if(unsafe).alias("unsafe"))


def flags_per_sequence(tokens: DataFrame, truth: DataFrame) -> DataFrame:
    """Per truth: sequences, those with one flag only, with one to three, and the mean of flags."""
    flags = tokens.groupBy("run_id", "trace_id").agg(F.count_if(F.col("evaluated") & (F.col("label") != "safe")).alias("flags"))
    return flags.join(truth, "trace_id").groupBy("response_truth").agg(F.count(F.lit(1)).alias("sequences"), F.count_if(F.col("flags") == 1).alias("single_flag"), F.count_if(F.col("flags").between(1, 3)).alias("one_to_three"), F.avg("flags").alias("flags_mean"))


def offset_categories(results: DataFrame, keys: list[str]) -> DataFrame:
    """Signals on unsafe responses before, at and after the onset, missed ones, and the median delay of late ones."""
    o = F.col("signal_offset_tokens")
    rows = results.where((F.col("response_truth") == "unsafe") & F.col("error").isNull())
    return rows.groupBy(*keys).agg(F.count_if(o < 0).alias("before"), F.count_if(o == 0).alias("exact"), F.count_if(o > 0).alias("after"), F.count_if(F.col("signal_token").isNull()).alias("missed"), F.percentile(F.when(o > 0, o), 0.5).alias("late_median"))


def false_alarm_timing(results: DataFrame, keys: list[str]) -> DataFrame:
    """When false blocks on safe responses signal."""
    rows = results.where((F.col("response_truth") == "safe") & F.col("blocked"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("false_blocks"), F.percentile("signal_token", 0.5).alias("signal_median"), F.count_if(F.col("signal_token") <= 8).alias("within_8"), F.count_if(F.col("signal_token") <= 32).alias("within_32"))


def list_start_errors(results: DataFrame, traces: DataFrame, keys: list[str]) -> DataFrame:
    """False block rate of safe responses that begin with `1.` and of others, with Fisher's exact p. Null where a group is empty."""
    starts = traces.select("trace_id", F.coalesce(F.startswith(lstrip(F.col("response")), F.lit("1.")), F.lit(False)).alias("_list"))
    rows = results.where((F.col("response_truth") == "safe") & F.col("error").isNull()).join(starts, "trace_id")
    c = rows.groupBy(*keys).agg(*[F.count_if(x).cast("int").alias(n) for n, x in (("list_blocked", F.col("_list") & F.col("blocked")), ("list_passed", F.col("_list") & ~F.col("blocked")), ("other_blocked", ~F.col("_list") & F.col("blocked")), ("other_passed", ~F.col("_list") & ~F.col("blocked")))])
    a, b, d, e = (F.col(x) for x in ("list_blocked", "list_passed", "other_blocked", "other_passed"))
    return c.withColumns({"list_rate": ratio(a, a + b), "other_rate": ratio(d, d + e), "p_value": fisher_exact(a, b, d, e)})


def first_and_last(tokens: DataFrame) -> DataFrame:
    """The first and the last evaluated decision of each sequence."""
    e = tokens.where("evaluated").groupBy("run_id", "trace_id").agg(F.min(F.struct("token_index", "label")).alias("_a"), F.max(F.struct("token_index", "label")).alias("_b"), F.count(F.lit(1)).alias("evaluated"))
    return e.select("run_id", "trace_id", "evaluated", F.col("_a.token_index").alias("first_token"), F.col("_a.label").alias("first_label"), F.col("_b.token_index").alias("last_token"), F.col("_b.label").alias("last_label"))


def error_overlap(results: DataFrame, unit: list[str], keys: list[str] | None = None) -> DataFrame:
    """How many rules (or guards) err on the same unit, by truth and keys, which are part of the unit."""
    wrong = F.col("blocked") != (F.col("response_truth") == "unsafe")
    per = results.where(F.col("error").isNull() & F.col("response_truth").isNotNull()).groupBy(*unit, "response_truth").agg(F.count_if(wrong).alias("wrong"), F.count(F.lit(1)).alias("rules"))
    return per.groupBy(*(keys or []), "response_truth", "rules", "wrong").agg(F.count(F.lit(1)).alias("sequences"))


def ensemble(results: DataFrame, unit: list[str], most: int, keys: list[str] | None = None) -> DataFrame:
    """False blocks and misses if at least m of the rules must block, for m = 1..most."""
    votes = results.where(F.col("error").isNull()).groupBy(*unit, "response_truth").agg(F.count_if("blocked").alias("_votes"))
    asked = votes.select("*", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("votes_needed"))
    blocked = F.col("_votes") >= F.col("votes_needed")
    return asked.groupBy(*(keys or []), "votes_needed").agg(F.count_if(blocked & (F.col("response_truth") == "safe")).alias("fp"), F.count_if(~blocked & (F.col("response_truth") == "unsafe")).alias("fn"))


def identity(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """SHA-256 of the sorted list of a group's ids. The list of one run, not of a whole table."""
    return df.groupBy(*keys).agg(F.sha2(F.array_join(F.sort_array(F.collect_set(F.col(column).cast("string"))), "\n"), 256).alias("identity"), F.countDistinct(column).alias("ids"))


def exemplars(results: DataFrame, keys: list[str]) -> DataFrame:
    """One sequence per kind and group: the earliest lead, the median late signal, the first miss, the first false block; ties by id."""
    ids = ["run_id", "trace_id"]
    rows = results.where(F.col("error").isNull())
    late = rows.where("detection_delay_tokens > 0")
    # The median's delay from counts per delay, then its place among the ids of that delay alone.
    counts = late.groupBy(*keys, "detection_delay_tokens").agg(F.count(F.lit(1)).alias("_here"))
    group = Window.partitionBy(*keys)
    upto = F.sum("_here").over(group.orderBy("detection_delay_tokens").rowsBetween(Window.unboundedPreceding, 0))
    middle = counts.withColumn("_upto", upto).withColumn("_half", F.floor(F.sum("_here").over(group) / 2)).where((F.col("_upto") > F.col("_half")) & (F.col("_upto") - F.col("_here") <= F.col("_half")))
    wanted = middle.select(*keys, "detection_delay_tokens", (F.col("_half") - (F.col("_upto") - F.col("_here"))).alias("_place"))
    ranked = rank_within(late.join(F.broadcast(wanted), [*keys, "detection_delay_tokens"]).select(*keys, *ids, "_place"), keys, [F.col(i) for i in ids], "_rank", salt=F.lit(0))
    out = ranked.where("_rank = _place").select(*keys, F.lit("median_late").alias("kind"), *ids)
    earliest = rows.where("early_lead_tokens > 0").groupBy(*keys).agg(F.min(F.struct((-F.col("early_lead_tokens")).alias("_l"), *ids)).alias("_r")).select(*keys, F.lit("earliest").alias("kind"), "_r.run_id", "_r.trace_id")
    firsts = rows.withColumn("kind", F.when((F.col("response_truth") == "unsafe") & ~F.col("blocked"), "miss").when((F.col("response_truth") == "safe") & F.col("blocked"), "false_block")).where("kind is not null")
    picked = firsts.groupBy(*keys, "kind").agg(F.min(F.struct(*ids)).alias("_r")).select(*keys, "kind", "_r.run_id", "_r.trace_id")
    return out.unionByName(earliest).unionByName(picked)


def timeline(results: DataFrame) -> DataFrame:
    """What a stopped stream showed, held back and never produced, in tokens."""
    stop = F.col("intervention_token")
    return results.select("run_id", "trace_id", "mode", "policy", F.col("released_tokens").alias("released"), F.greatest(F.lit(0), F.coalesce(stop - F.col("released_tokens"), F.lit(0))).alias("buffered"), F.greatest(F.lit(0), F.col("response_token_count") - F.coalesce(stop, F.col("released_tokens"))).alias("unseen"))


def _mirrored(flip: Column | None, columns: list[str], value: str) -> list[Column]:
    """The value with the other sign, and the bounds of its interval if there are any, which change places; only where flip is true."""
    turned = {value: -F.col(value)} | ({"ci_low": -F.col("ci_high"), "ci_high": -F.col("ci_low")} if {"ci_low", "ci_high"} <= set(columns) else {})
    return [(x if flip is None else F.when(flip, x).otherwise(F.col(c))).alias(c) for c, x in turned.items()]


def oriented(pairs: DataFrame, reference: str) -> DataFrame:
    """Paired rows turned so that the reference mode comes second, with their intervals; rows without it are left out."""
    flip = F.col("mode_a") == reference
    turned = _mirrored(flip, pairs.columns, "mean_difference")
    kept = [c for c in pairs.columns if c not in ("mode_a", "mode_b", "mean_difference", "ci_low", "ci_high")]
    return pairs.where((F.col("mode_a") == reference) | (F.col("mode_b") == reference)).select(F.when(flip, F.col("mode_b")).otherwise(F.col("mode_a")).alias("mode"), F.lit(reference).alias("reference"), *kept, *turned)


def antisymmetric(tests: DataFrame, a: str, b: str, value: str, keys: list[str] | None = None) -> DataFrame:
    """Every pair both ways round, the value with the other sign, its interval mirrored."""
    turned = _mirrored(None, tests.columns, value)
    columns = [value, *[c for c in ("ci_low", "ci_high") if len(turned) > 1]]
    return tests.select(*(keys or []), a, b, *columns).unionByName(tests.select(*(keys or []), F.col(b).alias(a), F.col(a).alias(b), *turned))
