"""Queries over the delivered tables, one or more for each operator. SQL that says the same is in catalog_sql.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegate.functions import text as T
from tidegate.functions.stats import fisher_exact
from tidegate.operators import analysis as A
from tidegate.operators import bootstrap as B
from tidegate.operators import cost as C
from tidegate.operators import metrics as M
from tidegate.operators import prepare as P
from tidegate.operators import replay as R
from tidegate.plans import scoring as G
from tidegate.session import checkpointed, table

BASE = [R.Rule("strict"), R.Rule("conservative")]
STOPS = [
    R.Rule("strict", "cumulative", 3), R.Rule("strict", "consecutive", 2), R.Rule("conservative", "window", 2, 5), R.Rule("strict", "buffer", 2),
    R.Rule("strict", "consecutive", 3), R.Rule("strict", "window", 3, 8),
]
SWEPT = [*[R.Rule("strict", "cumulative", k) for k in (1, 2, 4)], R.Rule("strict", "consecutive", 2), *[R.Rule("strict", "cumulative", k, threshold=t) for t in (0.5, 0.7) for k in (1, 2)], R.Rule("strict", "cumulative", 1, threshold=0.6, include_controversial=True)]
MAX_SENTENCE = 128
LIMITS = [0, 5, 20, 100]


def _traces(s: SparkSession, d: str) -> DataFrame:
    return P.traces(table(s, d, "benchmark_example"))


def _sequences(s: SparkSession, d: str) -> DataFrame:
    return P.sequences(table(s, d, "guard_trace"))


def _tokens(s: SparkSession, d: str) -> DataFrame:
    return P.token_decisions(table(s, d, "response_token_decision"))


def _numbered(s: SparkSession, d: str) -> DataFrame:
    return R.numbered(_tokens(s, d), _sequences(s, d), _traces(s, d), MAX_SENTENCE)


def _results(s: SparkSession, d: str, rules: list[R.Rule] | None = None, modes: tuple[str, ...] = R.MODES, with_text: bool = True) -> DataFrame:
    return R.replay(_numbered(s, d), _sequences(s, d), _traces(s, d), rules or BASE, modes, MAX_SENTENCE, with_text)


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def _source(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "synthetic_singstreambench_sample")


def v1_validate_source(s, d):
    return P.validate_source(_source(s, d), 210)


def v1_prefix_report(s, d):
    rows = table(s, d, "benchmark_example").select("response", "safe_prefix", F.col("unsafe_start_character").alias("onset"))
    return P.prefix_report(rows)


def v2_prepared(s, d):
    return _traces(s, d).select("trace_id", "query_truth", "response_truth", "unsafe_start_character", "unsafe_start_token", "response_token_count", F.length("response").alias("response_chars"))


def v3_onset_tokens(s, d):
    return P.onset_tokens(_tokens(s, d), _traces(s, d))


def v5_duplicates(s, d):
    return P.duplicates(table(s, d, "benchmark_example"), ["trace_id"])


def v6_smoke2(s, d):
    return P.profile(_traces(s, d), "smoke2").select("trace_id", "response_truth", "unsafe_start_character")


def v9_prompt_decisions(s, d):
    return M.evaluated_prompts(_sequences(s, d)).where(F.col("error").isNull()).select("run_id", "trace_id", "model_id", "prompt_label", "query_ground_truth")


def v12_relabelled(s, d):
    t = R.relabelled(_tokens(s, d), 0.6, True)
    return t.groupBy("label", "evaluated").agg(F.count(F.lit(1)).alias("tokens"))


def v14_restricted(s, d):
    r = R.restricted(_numbered(s, d), "chunk_8", MAX_SENTENCE, 8)
    return _round(r.where("label != 'safe'").select("run_id", "trace_id", "token_index", "label", "latency_sum"))


def v15_warmed_up(s, d):
    return R.warmed_up(_tokens(s, d), 16).groupBy("run_id", "trace_id").agg(F.count_if(F.col("evaluated") & F.col("label").isin("unsafe", "controversial")).alias("flags"))


def v16_labels(s, d):
    return table(s, d, "response_token_decision").groupBy(T.normal_label(F.col("risk_label")).alias("label")).agg(F.count(F.lit(1)).alias("rows"))


def v17_failed(s, d):
    return _results(s, d, with_text=False).where("error is not null").select("run_id", "trace_id", "mode", "policy", "error", "blocked", "released_tokens", "checks", "leakage_tokens")


def r1_checkpoints(s, d):
    return R.checkpoints(_numbered(s, d), R.MODES, MAX_SENTENCE).groupBy("mode").agg(F.count(F.lit(1)).alias("intervals"), F.sum("end").cast("long").alias("ends"), F.sum(F.col("end") - F.col("start")).cast("long").alias("tokens"))


def r5_checkpoint_tokens(s, d):
    return R.checkpoints(_numbered(s, d), R.MODES, MAX_SENTENCE).select("run_id", "trace_id", F.col("end").alias("token_index")).distinct()


def r6_signals(s, d):
    found = R.signals(_numbered(s, d), STOPS, R.MODES, MAX_SENTENCE)
    return found.select("run_id", "trace_id", "mode", "rule", "signal_token", F.col("start").alias("released_tokens"), F.col("end").alias("intervention_token"), F.col("number").alias("checks"))


RESULT = ["run_id", "trace_id", "model_id", "mode", "policy", "error", "response_truth", "blocked", "signal_token", "intervention_token", "released_tokens", "checks", "guard_time_ms", "safe_withheld_tokens", "leakage_tokens", "normalized_leakage", "signal_offset_tokens", "premature_block", "early_lead_tokens", "detection_delay_tokens", "post_signal_buffer_delay_tokens", "leakage_characters", "leakage_words"]


def r10_replay(s, d):
    return _round(_results(s, d).select(*RESULT), 4)


def r15_sweep(s, d):
    return _round(M.sweep(_results(s, d, SWEPT, R.MODES)))


def r16_sweep_default(s, d):
    swept = M.sweep(_results(s, d, [*SWEPT, R.Rule("conservative")]))
    default = (F.col("policy") == "strict") & F.col("threshold").isNull() & (F.col("trigger_count") == 1) & (F.col("trigger_mode") == "cumulative")
    return _round(swept.withColumn("is_default", default).select("mode", "rule", "policy", "fp", "fn", "is_default"))


WARMUPS = (0, 8, 16, 32, 64)


def r18_warmup_grid(s, d):
    """Block errors of restricted replay for every mode and warm-up length."""
    numbered, sequences, traces = checkpointed(_numbered(s, d)), _sequences(s, d), _traces(s, d)
    out = None
    for k in WARMUPS:
        for mode in R.MODES:
            r = R.replay(R.restricted(numbered, mode, MAX_SENTENCE, k), sequences, traces, BASE, (mode,), MAX_SENTENCE, False)
            m = M.response_metrics(r, True).select(F.lit(k).alias("warmup"), "mode", "policy", "tp", "fp", "tn", "fn")
            out = m if out is None else out.unionByName(m)
    return out


def a2_prompt_metrics(s, d):
    return _round(M.prompt_metrics(M.evaluated_prompts(_sequences(s, d), True), ["model_id"]))


def a3_response_metrics(s, d):
    return _round(M.response_metrics(_results(s, d, with_text=False)))


def a3_by_mode(s, d):
    return _round(M.response_metrics(_results(s, d, with_text=False), True, ["model_id"]))


def _leaking(s, d):
    """Results of harmful responses under both policies in every mode, kept, since sizes of groups are counted before they are drawn."""
    return checkpointed(M.harmful(_results(s, d)).select("run_id", "trace_id", "model_id", "mode", "policy", *M.INTERVALS))


def a5_bootstrap(s, d):
    return _round(B.bootstrap_all(_leaking(s, d), ["model_id", "mode", "policy"], M.INTERVALS, ["trace_id", "run_id"]))


def a5_counted(s, d):
    return _round(B.counted_all(M.harmful(_results(s, d)), ["mode", "policy"], M.INTERVALS))


def a5_portable(s, d):
    """For small groups: the mean leakage of a model in each mode, resampled over modes."""
    r = _results(s, d, [R.Rule("strict")], with_text=False).where("response_truth = 'unsafe' and error is null")
    per = r.groupBy("model_id", "mode").agg(F.round(F.avg("leakage_tokens"), 6).alias("leakage"))
    return _round(B.portable_ci(per, ["model_id"], "leakage", ["mode"], 50))


def a6_streaming_metrics(s, d):
    return _round(M.streaming_metrics(_results(s, d)))


def a6_by_model(s, d):
    return _round(M.streaming_metrics(_results(s, d), ["model_id"]))


NEEDED = ["run_id", "trace_id", "model_id", "mode", "rule", "policy", "error", "response_truth", "blocked", "signal_token", "premature_block", "released_tokens", "safe_withheld_tokens", "leakage_tokens", "normalized_leakage", "early_lead_tokens", "signal_offset_tokens", "detection_delay_tokens", "post_signal_buffer_delay_tokens", "checks", "guard_time_ms", "leakage_words", "leakage_characters"]


def a6_intervals(s, d):
    """The metrics with their bootstrap intervals; results are read for both, so they are kept."""
    return _round(M.with_intervals(checkpointed(_results(s, d).select(*NEEDED))))


def a6_intervals_by_model(s, d):
    return _round(M.with_intervals(checkpointed(_results(s, d).select(*NEEDED)), ["model_id"]))


def _mode_means(s, d):
    return B.paired_modes(_results(s, d, with_text=False)).groupBy("policy", "mode_a", "mode_b").agg(F.avg("difference").alias("mean_difference"), F.count(F.lit(1)).alias("pairs"))


def a7_paired_modes(s, d):
    return _round(_mode_means(s, d))


def _mode_intervals(s, d):
    return B.counted_pairs(B.paired_modes(_results(s, d, with_text=False)), ["policy", "mode_a", "mode_b"]).drop("mean_a", "mean_b", "p_value")


def a7_intervals(s, d):
    return _round(_mode_intervals(s, d))


def w13_intervals(s, d):
    return _round(A.oriented(_mode_intervals(s, d), "token"))


def w13_oriented(s, d):
    return _round(A.oriented(_mode_means(s, d), "token"))


def _policy_values(s, d, modes=("sentence",)):
    """Leaked tokens of each sequence under four rules, taken as four guards."""
    rules = [R.Rule("strict"), R.Rule("conservative"), R.Rule("strict", "consecutive", 2), R.Rule("strict", "window", 2, 5)]
    return _results(s, d, rules, modes, False).withColumn("guard", F.concat(F.lit("rule_"), F.col("rule").cast("string"))).withColumn("unit", F.concat_ws("/", "run_id", "trace_id"))


def a8_paired_rules(s, d):
    return _round(B.paired_models(_policy_values(s, d), "guard", "unit", "leakage_tokens").groupBy("model_a", "model_b").agg(F.avg("difference").alias("mean_difference"), F.count(F.lit(1)).alias("pairs")))


def _model_pairs(s, d):
    """Leaked tokens of every pair of models on the traces both scored, by mode and policy; a model's value on a trace is the mean over its runs."""
    r = _results(s, d, with_text=False).where("error is null and leakage_tokens is not null and model_id is not null")
    values = r.groupBy("mode", "policy", "trace_id", "model_id").agg(F.avg("leakage_tokens").alias("leakage"))
    return B.paired_models(values, "model_id", "trace_id", "leakage", ["mode", "policy"])


def a8_model_intervals(s, d):
    """Each pair of models on shared traces, in every mode and under every policy. The delivered tables share few traces between models."""
    return _round(B.counted_pairs(_model_pairs(s, d), ["mode", "policy", "model_a", "model_b"]).drop("p_value"))


def _rule_pairs(s, d):
    return B.paired_models(_policy_values(s, d, R.MODES), "guard", "unit", "leakage_tokens", ["mode"])


def a8_rule_intervals(s, d):
    return _round(B.counted_pairs(_rule_pairs(s, d), ["mode", "model_a", "model_b"]).drop("p_value"))


def a9_model_tests(s, d):
    """Tests of every pair of models on shared traces; Holm over the pairs of a mode and policy."""
    tests = B.counted_pairs(_model_pairs(s, d), ["mode", "policy", "model_a", "model_b"])
    return _round(B.holm(tests, "p_value", ["model_a", "model_b"], keys=["mode", "policy"]))


def w14_model_matrix(s, d):
    return _round(A.antisymmetric(B.counted_pairs(_model_pairs(s, d), ["mode", "policy", "model_a", "model_b"]), "model_a", "model_b", "mean_difference", ["mode", "policy"]))


def w14_intervals(s, d):
    return _round(A.antisymmetric(B.counted_pairs(_rule_pairs(s, d), ["mode", "model_a", "model_b"]), "model_a", "model_b", "mean_difference", ["mode"]))


def a9_pairwise_tests(s, d):
    """Tests of every pair of rules; Holm over the pairs of a mode."""
    tests = B.counted_pairs(_rule_pairs(s, d), ["mode", "model_a", "model_b"]).drop("mean_a", "mean_b").withColumnRenamed("pairs", "n")
    return _round(B.holm(tests, "p_value", ["model_a", "model_b"], keys=["mode"]))


def a10_holm(s, d):
    """Holm over the p-values of list-start tests, one a model and mode."""
    t = A.list_start_errors(_results(s, d, [R.Rule("strict")], with_text=False), _traces(s, d), ["model_id", "mode"])
    return _round(B.holm(t.select("model_id", "mode", "p_value"), "p_value", ["model_id", "mode"]))


def w14_matrix(s, d):
    return _round(A.antisymmetric(a8_paired_rules(s, d), "model_a", "model_b", "mean_difference"))


def a11_stopped_within(s, d):
    return _round(M.stopped_within(_results(s, d, BASE, ("sentence",)), LIMITS, "sentence", ["policy"]))


def _query_tokens(s, d):
    return _traces(s, d).select("trace_id", F.size(T.whole_word_tokens(F.col("query"))).alias("query_tokens"))


def a12_streaming_cost(s, d):
    return C.streaming_cost(_results(s, d, with_text=False), _query_tokens(s, d))


def a13_prefix_cost(s, d):
    checks = C.mode_checks(_numbered(s, d), R.MODES, 60, 12, 4, MAX_SENTENCE)
    return C.prefix_cost(_results(s, d, BASE, R.MODES, False), checks, _query_tokens(s, d))


def a14_cost_summary(s, d):
    return _round(C.summarise(a12_streaming_cost(s, d), table(s, d, "guard_model")))


def a16_sizes(s, d):
    return _traces(s, d).groupBy("query_truth", "response_truth").agg(F.count(F.lit(1)).alias("traces"))


def a17_value_counts(s, d):
    return A.value_counts(_traces(s, d), ["query_truth", "response_truth"])


def a18_crosstab(s, d):
    return A.crosstab(_traces(s, d), "query_truth", "response_truth", list(P.LABELS), list(P.LABELS))


def a19_describe(s, d):
    return _round(A.describe(_traces(s, d), A.text_measures(), ["response_truth"]))


def a20_histogram(s, d):
    return A.histogram(_results(s, d, BASE, ("sentence",), False), F.col("signal_offset_tokens"), 16.0, ["policy"])


def a21_onset_groups(s, d):
    return A.onset_groups(_traces(s, d))


def a22_flags(s, d):
    return _round(A.flags_per_sequence(_tokens(s, d), _traces(s, d).select("trace_id", "response_truth")))


def a23_offsets(s, d):
    return A.offset_categories(_results(s, d, with_text=False), ["model_id", "mode", "policy"])


def a24_trigger_counts(s, d):
    rules = [R.Rule("strict", "cumulative", k) for k in (1, 2, 3, 5, 8)]
    return _round(M.sweep(_results(s, d, rules, ("token",))).select("trigger_count", "fp", "fn", "leakage_words_mean", "detection_delay_median"))


def a25_threshold_grid(s, d):
    rules = [R.Rule("strict", "cumulative", k, threshold=t) for t in (0.4, 0.6, 0.8) for k in (1, 2, 4)]
    swept = M.sweep(_results(s, d, rules, ("token",)))
    return swept.groupBy("threshold").pivot("trigger_count", [1, 2, 4]).agg(F.first("fp")).select("threshold", *[F.col(str(k)).alias(f"fp_{k}") for k in (1, 2, 4)])


def a26_false_alarms(s, d):
    return A.false_alarm_timing(_results(s, d, with_text=False), ["mode", "policy"])


def a27_list_starts(s, d):
    return _round(A.list_start_errors(_results(s, d, with_text=False), _traces(s, d), ["mode", "policy"]))


def a28_fisher(s, d):
    """Fisher's exact test of truth against query truth, by revision."""
    t = _traces(s, d)
    c = t.agg(*[F.count_if((F.col("query_truth") == a) & (F.col("response_truth") == b)).cast("int").alias(f"{a}_{b}") for a in P.LABELS for b in P.LABELS])
    return _round(c.withColumn("p_value", fisher_exact(F.col("safe_safe"), F.col("safe_unsafe"), F.col("unsafe_safe"), F.col("unsafe_unsafe"))))


def a29_endpoints(s, d):
    return A.first_and_last(_tokens(s, d))


def _swept_by_model(s, d):
    return M.sweep(_results(s, d, SWEPT, with_text=True), ["model_id"])


def a30_matched_budget(s, d):
    """The best rule of each model and mode with no more false blocks than the model that blocks least by the default rule makes in that mode."""
    swept = _swept_by_model(s, d)
    budget = swept.where("rule = 0").groupBy("mode").agg(F.min("fp").alias("budget"))
    return _round(M.matched_budget(swept.join(budget, "mode"), F.col("budget"), ["model_id", "mode"]).select("model_id", "mode", "rule", "fp", "fn", "budget", "leakage_words_mean"))


def w2_frontier(s, d):
    swept = M.sweep(_results(s, d, SWEPT, R.MODES))
    return _round(M.frontier(swept, "false_positive_rate", "false_negative_rate", ["mode"]).select("mode", "rule", "false_positive_rate", "false_negative_rate"))


def _model_verdicts(s, d):
    """Whether each model blocks each trace: a model that scored it in several runs blocks it if most of them do."""
    r = _results(s, d, [R.Rule("strict")], with_text=False).where("error is null and model_id is not null and response_truth is not null")
    votes = r.groupBy("mode", "trace_id", "response_truth", "model_id").agg(F.count_if("blocked").alias("_yes"), F.count(F.lit(1)).alias("_all"))
    return votes.select("mode", "trace_id", "response_truth", F.col("model_id").alias("guard"), (2 * F.col("_yes") > F.col("_all")).alias("blocked"), F.lit(None).cast("string").alias("error"))


def a31_error_overlap(s, d):
    """How many models err on the same trace."""
    return A.error_overlap(_model_verdicts(s, d), ["mode", "trace_id"], ["mode"])


def a31_rules_overlap(s, d):
    return A.error_overlap(_policy_values(s, d), ["run_id", "trace_id"])


def a32_ensemble(s, d):
    """False blocks and misses if at least m models must block a trace that several scored."""
    return A.ensemble(_model_verdicts(s, d), ["mode", "trace_id"], 5, ["mode"])


def a32_rules_ensemble(s, d):
    return A.ensemble(_policy_values(s, d), ["run_id", "trace_id"], 4)


def a33_blocked_by_truth(s, d):
    """Share of blocked responses by truth."""
    r = _results(s, d, with_text=False).where("error is null")
    return _round(r.groupBy("model_id", "mode", "policy", "response_truth").agg(F.avg(F.col("blocked").cast("double")).alias("blocked_share"), F.count(F.lit(1)).alias("responses")))


def r19_restriction_check(s, d):
    """Replay restricted without warm-up against replay as delivered where a guard was asked at the ends of intervals only: rows that differ, by mode."""
    numbered, sequences, traces = checkpointed(_numbered(s, d)), _sequences(s, d), _traces(s, d)
    out = None
    for mode in ("token", "chunk_8", "chunk_16", "chunk_32", "full_buffered", "sentence"):
        once = R.restricted(numbered, mode, MAX_SENTENCE)
        a = R.replay(once, sequences, traces, BASE, (mode,), MAX_SENTENCE, False)
        b = R.replay(R.restricted(once, mode, MAX_SENTENCE, 0), sequences, traces, BASE, (mode,), MAX_SENTENCE, False)
        n = a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("different"))
        out = n if out is None else out.unionByName(n)
    return out


def j1_effects(s, d):
    """Block errors of each model, mode and policy beside those of the token mode of the same model and policy."""
    m = M.response_metrics(_results(s, d, with_text=False), True, ["model_id"]).select("model_id", "mode", "policy", "fp", "fn")
    token = m.where("mode = 'token'").select("model_id", "policy", F.col("fp").alias("token_fp"), F.col("fn").alias("token_fn"))
    return m.join(token, ["model_id", "policy"])


def j12_common_modes(s, d):
    """Modes that every run of a model has results in."""
    r = _results(s, d, with_text=False).where("error is null and model_id is not null")
    runs = r.groupBy("model_id").agg(F.countDistinct("run_id").alias("runs"))
    return r.groupBy("model_id", "mode").agg(F.countDistinct("run_id").alias("_n")).join(runs, "model_id").where("_n = runs").select("model_id", "mode", "runs")


def w5_sorted(s, d):
    """Labels counted in the order of traces: the first and last trace of each truth."""
    return _traces(s, d).where("response_truth is not null").groupBy("response_truth").agg(F.min("trace_id").alias("first_trace"), F.max("trace_id").alias("last_trace"), F.count(F.lit(1)).alias("traces"))


def a34_identity(s, d):
    return A.identity(_sequences(s, d), "trace_id", ["run_id"])


def w7_exemplars(s, d):
    return A.exemplars(_results(s, d, BASE, ("sentence",), False), ["policy"])


def w8_shortest(s, d):
    t = _traces(s, d).where("length(response) > 0")
    return t.select("trace_id", F.length("response").alias("chars")).orderBy("chars", "trace_id").limit(1)


def w11_pivot(s, d):
    m = M.response_metrics(_results(s, d, BASE, R.MODES, False), True, ["model_id"])
    return m.groupBy("model_id", "policy").pivot("mode", list(R.MODES)).agg(F.first("fp")).select("model_id", "policy", *[F.col(x).alias(f"fp_{x}") for x in R.MODES])


def w12_mode_order(s, d):
    return _round(M.response_metrics(_results(s, d, with_text=False), True).select("mode", "policy", M.mode_order(F.col("mode")).alias("place"), "fp", "fn"))


def w15_timeline(s, d):
    return A.timeline(_results(s, d, with_text=False))


def f5_verdicts(s, d):
    raw = table(s, d, "response_token_decision").where("raw_output is not null")
    return raw.groupBy(T.guard_verdict(F.col("raw_output")).alias("verdict"), T.normal_label(F.col("risk_label")).alias("label")).agg(F.count(F.lit(1)).alias("rows"))


def f11_softmax(s, d):
    scores = F.array("safe_score", "controversial_score", "unsafe_score")
    rows = table(s, d, "response_token_decision").where("safe_score is not null and controversial_score is not null and unsafe_score is not null")
    return _round(rows.select("run_id", "trace_id", "token_index", "ingest_batch", F.element_at(T.softmax(scores), 3).alias("unsafe_probability"), T.argmax(scores).alias("best")))


def f17_whole_words(s, d):
    t = _traces(s, d).where("response is not null").withColumn("_t", T.whole_word_tokens(F.col("response")))
    return t.select("trace_id", F.size("_t").alias("tokens"), (F.array_join("_t", "") == F.col("response")).alias("lossless"))


def j8_onset_word(s, d):
    """The word the onset falls into: a range condition on running lengths."""
    t = _traces(s, d).where("response_truth = 'unsafe' and length(response) > 0")
    words = t.select("trace_id", "unsafe_start_character", F.posexplode(T.whole_word_tokens(F.col("response"))).alias("no", "word"))
    end = F.sum(F.length("word")).over(Window.partitionBy("trace_id").orderBy("no"))
    placed = words.withColumn("end", end)
    return placed.where((F.col("unsafe_start_character") < F.col("end")) & (F.col("unsafe_start_character") >= F.col("end") - F.length("word"))).select("trace_id", (F.col("no") + 1).alias("word_no"))


def g6_prefix_checks(s, d):
    return G.prefix_guard_checks(_tokens(s, d), _traces(s, d))


def g10_scored(s, d):
    return _round(G.score_traces(_traces(s, d), G.MarkerGuard(("risk", "riesgo", "risque", "risco", "риск", "ризик"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = [n for n in globals() if n[0] in "vrawfjg" and n[1:2].isdigit()]
    return {n: globals()[n] for n in names}
