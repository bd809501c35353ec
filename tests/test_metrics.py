import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import sequences, tokens, traces
from tidegate import catalog
from tidegate.functions import text as T
from tidegate.functions.stats import fisher_exact, wilson
from tidegate.operators import analysis as A
from tidegate.operators import bootstrap as B
from tidegate.operators import cost as C
from tidegate.operators import metrics as M
from tidegate.operators import prepare as P
from tidegate.operators import replay as R
from tidegate.operators.ranking import rank_within


def test_wilson_and_fisher(spark):
    low, high = wilson(F.lit(7), F.lit(25))
    e = wilson(F.lit(0), F.lit(0))
    row = spark.range(1).select(low.alias("a"), high.alias("b"), e[0].alias("c"), fisher_exact(F.lit(3), F.lit(1), F.lit(1), F.lit(3)).alias("p")).first()
    assert row.a == pytest.approx(0.14283, abs=1e-4) and row.b == pytest.approx(0.47577, abs=1e-4) and row.c is None
    assert row.p == pytest.approx(34 / 70)


def test_bootstrap_is_fixed_and_ordered(spark):
    df = spark.createDataFrame([("g", i, float(i % 7)) for i in range(50)], "g string, i int, v double")
    a = B.bootstrap_ci(df, ["g"], "v", ["i"], resamples=500).first()
    b = B.bootstrap_ci(df.orderBy(F.desc("i")), ["g"], "v", ["i"], resamples=500).first()
    assert a == b
    values = np.array([i % 7 for i in range(50)], float)
    rng = np.random.default_rng(42)
    got = np.percentile([rng.choice(values, 50, replace=True).mean() for _ in range(500)], [2.5, 97.5])
    assert np.allclose([a.ci_low, a.ci_high], got)
    assert B.interval(np.array([])) == (None, None)
    c = B.counted(df, ["g"], "v", resamples=500).first()
    assert abs(c.ci_low - a.ci_low) < 0.2 and c.n == 50


def test_holm(spark):
    t = spark.createDataFrame([("x", 0.04), ("y", 0.004), ("z", 0.03), ("none", None)], "pair string, p double")
    got = {r.pair: r.significant for r in B.holm(t, "p", ["pair"]).collect()}
    assert got == {"x": False, "y": True, "z": False, "none": False}


def test_stopped_within(spark):
    rows = [("token", "unsafe", True, 1, None), ("token", "unsafe", True, 7, None), ("token", "unsafe", True, 60, None), ("token", "unsafe", False, 1, None), ("token", "safe", True, 1, None)]
    df = spark.createDataFrame(rows, "mode string, response_truth string, blocked boolean, leakage_words int, error string")
    got = {r.leaked_words: r.stopped_share for r in M.stopped_within(df, [2, 9, 70]).collect()}
    assert got == {2: 0.25, 9: 0.5, 70: 0.75}


def test_streaming_metrics_without_values(spark):
    tr, sq = traces(spark, [("t", "q", "ab", "safe", 2, 3, 2)]), sequences(spark)
    r = M.streaming_metrics(R.replay(R.numbered(tokens(spark, "SS"), sq, tr), sq, tr, [R.Rule()], ("token",))).first()
    assert r.leakage_mean is None and r.miss_rate is None and r.traces == 1 and r.safe_withheld_tokens_mean == 0


def test_costs(spark):
    tr, sq = traces(spark, [("t", "q", "x" * 12, "unsafe", 0, 1, 12)]), sequences(spark)
    q = spark.createDataFrame([("t", 7)], "trace_id string, query_tokens int")
    whole = R.replay(R.numbered(tokens(spark, "S" * 12), sq, tr), sq, tr, [R.Rule()], ("chunk_8",))
    r = C.streaming_cost(whole, q).first()
    assert (r.model_calls, r.tokens) == (12, 19)
    stopped = R.replay(R.numbered(tokens(spark, "SSSSU" + "S" * 7), sq, tr), sq, tr, [R.Rule()], ("chunk_8",))
    r = C.streaming_cost(stopped, q).first()
    assert (r.model_calls, r.tokens) == (8, 15)
    checks = spark.createDataFrame([("r", "t", "chunk_8", i, h, 3, 1) for i, h in ((8, 30), (12, 34))], "run_id string, trace_id string, mode string, token_index int, head_tokens long, tail_tokens long, generated_tokens long")
    r = C.prefix_cost(whole, checks, q).first()
    assert (r.model_calls, r.tokens, r.tokens_cached) == (3, 30 + 34 + 8 + 7, 34 + 8 + 7)
    r = C.prefix_cost(stopped, checks, q).first()
    assert (r.model_calls, r.tokens, r.tokens_cached) == (2, 30 + 4 + 7, 30 + 4 + 7)


def test_validation(spark):
    good = ("q", "Grüße ☂ da", "safe", "safe", 10, "Grüße ☂ da")
    bad = ("q", "Erst gut, dann nicht", "unsafe", "unsafe", 10, "Erst")
    schema = "query string, response string, query_label string, response_label string, unsafe_start_index int, safe_prefix string"
    r = {x["check"]: x for x in P.validate_source(spark.createDataFrame([good, bad], schema), 2).collect()}
    assert not r["safe_prefix_exact"].passed and r["safe_prefix_exact"].detail == "1 matching, 1 mismatching"
    assert r["row_count"].passed and r["label_onset_consistency"].passed
    none = P.validate_source(spark.createDataFrame([(None,) * 6], schema)).collect()
    assert not {x["check"]: x.passed for x in none}["onset_integer"]
    assert [x["check"] for x in P.validate_source(spark.range(1)).collect()] == ["required_columns"]
    assert all(x.passed for x in P.validate_source(spark.createDataFrame([], schema)).collect())


def test_duplicates_are_refused(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    with pytest.raises(Exception, match="must be unique"):
        P.require_unique(df, ["k"], "rows").collect()
    assert P.duplicates(df, ["k"]).first().rows == 2


def test_verdicts_and_text(spark):
    cases = {"<answer>Safe</answer> end": "safe", "<note>unsafe</note> <answer>controversial</answer>": "controversial", "UNCERTAIN\nsafe after all": "controversial", "it is safe.": "safe", "<answer>safe</answer><ANSWER>\nunsafe</ANSWER>": "unsafe", "\n\n": None, "no idea": None, "safe, maybe unsafe": None, "<reason>safe</reason>": None}
    df = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", T.guard_verdict(F.col("raw")).alias("v"))
    assert {r.raw: r.v for r in df.collect()} == cases
    one = spark.createDataFrame([("　a b c\n", " x​Uncertain ")], "t string, l string")
    r = one.select(T.word_count(F.col("t")).alias("w"), T.strip(F.col("t")).alias("s"), T.whole_word_tokens(F.col("t")).alias("k"), T.last_index_of(F.lit("abcab"), "ab").alias("i"), T.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))).alias("m")).first()
    assert r.w == 3 and r.s == "a b c" and "".join(r.k) == "　a b c\n" and r.i == 3 and r.m == 1


def test_ranks_split_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"k{i % 5}", i) for i in range(2000)] + [(None, 5000 + i) for i in range(7)]
    df = spark.createDataFrame(rows, "k string, i int")
    for few in (False, True):
        got = rank_within(df, ["k"], [F.col("i")], "n", 50, few_groups=few).collect()
        assert len(got) == len(rows)
        by = {}
        for r in got:
            by.setdefault(r.k, []).append(r.n)
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert rank_within(df.limit(0), ["k"], [F.col("i")], "n").count() == 0


def test_frontier_and_budget(spark):
    df = spark.createDataFrame([("m", 0, 0.1, 0.5, 1, 5, 2.0), ("m", 1, 0.2, 0.5, 2, 5, 1.0), ("m", 2, 0.3, 0.1, 3, 1, 3.0)], "mode string, rule int, x double, y double, fp int, fn int, leakage_words_mean double")
    assert {r.rule for r in M.frontier(df, "x", "y", ["mode"]).collect()} == {0, 2}
    assert M.matched_budget(df, 2, ["mode"]).first().rule == 1


def test_tables(spark):
    df = spark.createDataFrame([("safe", "safe"), ("safe", "unsafe"), (None, "unsafe")], "a string, b string")
    assert {(r.a, r.b): r.rows for r in A.crosstab(df, "a", "b", ["safe", "unsafe"], ["safe", "unsafe"]).collect()} == {("safe", "safe"): 1, ("safe", "unsafe"): 1, ("unsafe", "safe"): 0, ("unsafe", "unsafe"): 0}
    assert {r.value: (r.a, r.b) for r in A.value_counts(df, ["a", "b"]).collect()} == {"safe": (2, 1), "unsafe": (0, 2), None: (1, 0)}


def test_counted_statistics(spark):
    """Mean, median and p90 from counts: the estimates are those of the values, the intervals near those of the exact draws."""
    rows = [("g", i, float(i * i % 31)) for i in range(401)] + [("h", 0, 3.0), ("h", 1, None), ("none", 0, None)]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    got = {(r.g, r.statistic): r for r in B.counted_all(df, ["g"], {"v": ["mean", "median", "p90"]}, resamples=2000).collect()}
    values = np.array([i * i % 31 for i in range(401)], float)
    for s, of in (("mean", np.mean), ("median", np.median), ("p90", lambda x: np.percentile(x, 90))):
        r, exact = got["g", s], B.interval(values, s, resamples=2000)
        assert r.n == 401 and np.isclose(r.estimate, of(values)) and np.allclose([r.ci_low, r.ci_high], exact, atol=0.5 if s == "mean" else 1.5)
        assert (got["h", s].estimate, got["h", s].ci_low, got["h", s].ci_high) == (3, 3, 3)
    assert len(got) == 6


def test_streaming_intervals(spark):
    tr, sq = traces(spark, [(t, "q", "x" * 9, x, 0, 1, 9) for t, x in (("a", "unsafe"), ("b", "unsafe"), ("c", "safe"))]), sequences(spark, [("r", t, "m", None) for t in "abc"])
    tk = tokens(spark, "SSUSSSSSS", trace="a").unionByName(tokens(spark, "SSSSSSUSS", trace="b")).unionByName(tokens(spark, "SSSSSSSSS", trace="c"))
    results = R.replay(R.numbered(tk, sq, tr), sq, tr, [R.Rule()], ("token", "full_buffered"))
    got = {r["mode"]: r for r in M.with_intervals(results, ["model_id"], 500).collect()}
    r = got["token"]
    assert (r.leakage_mean, r.leakage_mean_ci_low, r.leakage_mean_ci_high) == (4, 2, 6) and (r.leakage_median_ci_low, r.leakage_p90_ci_high) == (2, 6)
    assert (r.delay_median_ci_low, r.delay_p90_ci_high) == (2, 6) and r.leakage_words_mean_ci_low == r.leakage_words_mean_ci_high == 1
    assert got["full_buffered"].leakage_mean_ci_high == 0
    none = M.with_intervals(results.where("response_truth = 'safe'"), None, 500).first()
    assert none.traces == 1 and none.leakage_mean_ci_low is None


def test_pairs_have_mirrored_intervals(spark):
    rows = [(m, f"t{i}", x, float(i % 3 + k)) for i in range(30) for m in ("a", "b") for k, x in enumerate(("u", "v"))] + [("a", "t30", "u", 9.0)]
    pairs = B.paired_models(spark.createDataFrame(rows, "mode string, unit string, model string, y double"), "model", "unit", "y", ["mode"])
    tests = B.counted_pairs(pairs.withColumn("difference", F.col("difference") + F.col("value_a")), ["mode", "model_a", "model_b"], resamples=500)
    r = tests.where("mode = 'a'").first()
    assert (r.pairs, r.mean_a, r.mean_b, r.mean_difference) == (30, 1, 2, 0) and r.ci_low < 0 < r.ci_high and r.p_value > 0.5
    there, back = (A.antisymmetric(tests, "model_a", "model_b", "mean_difference", ["mode"]).where(f"mode = 'a' and model_a = '{m}'").first() for m in "uv")
    assert (back.ci_low, back.ci_high) == (-there.ci_high, -there.ci_low)
    turned = spark.createDataFrame([("token", "x", 1.0, 0.5, 2.0), ("x", "y", 1.0, 0.5, 2.0)], "mode_a string, mode_b string, mean_difference double, ci_low double, ci_high double")
    assert [tuple(x) for x in A.oriented(turned, "token").select("mode", "mean_difference", "ci_low", "ci_high").collect()] == [("x", -1.0, -2.0, -0.5)]
    p = spark.createDataFrame([("a", "1", 0.03), ("b", "1", 0.03), ("b", "2", 0.04)], "mode string, pair string, p double")
    assert {(x["mode"], x.pair): x.significant for x in B.holm(p, "p", ["pair"], keys=["mode"]).collect()} == {("a", "1"): True, ("b", "1"): False, ("b", "2"): False}


def test_bootstrap_over_everything(spark):
    """Every mode, policy and metric has an interval, small groups the reference's draws, large ones those of counts; the catalog asks for all."""
    rows = [(m, p, i, float(i * i % 31 + k), None if i % 2 else float(i % 5)) for k, m in enumerate(("token", "sentence")) for p in ("strict", "conservative") for i in range(200 if m == "token" else 60)]
    df = spark.createDataFrame(rows, "mode string, policy string, i int, v double, w double")
    got = B.bootstrap_all(df, ["mode", "policy"], {"v": ["mean", "p90"], "w": ["median"]}, ["i"], resamples=300, exact=100).collect()
    assert len(got) == 12 and {(r["mode"], r.drawn) for r in got} == {("token", "counts"), ("sentence", "values")}
    r = next(x for x in got if (x["mode"], x.policy, x.statistic) == ("sentence", "strict", "p90"))
    assert np.allclose([r.ci_low, r.ci_high], B.interval(np.array([i * i % 31 + 1 for i in range(60)], float), "p90", resamples=300))
    assert {r.n for r in got if r.metric == "w"} == {100, 30}


def test_catalog_bootstraps_every_mode(spark):
    d = "/root/testdata/sf0.001"
    rows = catalog.a5_counted(spark, d).collect()
    assert {r["mode"] for r in rows} == set(R.MODES) and {r.policy for r in rows} == {"strict", "conservative"}
    assert {(r.metric, r.statistic) for r in rows} == {(m, s) for m, of in M.INTERVALS.items() for s in of}


def test_strict_output_and_labels(spark):
    rows = [(["safe", " UNSAFE\n"], ["0.1", "0.75"], ["x", "None"]), (["Controversial"], ["high"], ["a1"]), ([], ["0.5"], ["a1"]), (None, None, None), (["  "], [], []), (["risky"], ["0.5"], [""])]
    df = spark.createDataFrame(rows, "l array<string>, p array<string>, c array<string>").select(T.guard_output(F.col("l"), F.col("p"), F.col("c")).alias("o")).select("o.*")
    assert [tuple(r) for r in df.collect()] == [("unsafe", [], 0.75, None), ("controversial", ["a1"], None, None), (None, None, None, "empty level"), (None, None, None, "missing level"), (None, None, None, "blank level"), (None, None, None, "unknown level: risky")]
    labels = spark.createDataFrame([(" Uncertain",), (None,)], "l string")
    assert [r[0] for r in labels.select(T.strict_label(F.col("l"))).collect()] == ["controversial", None]
    with pytest.raises(Exception, match="unknown label"):
        spark.createDataFrame([("fine",)], "l string").select(T.strict_label(F.col("l"))).collect()
    assert spark.range(7, 8).select(T.padded(F.col("id"), 4, "run-")).first()[0] == "run-0007"


def test_columns_that_may_and_must_be_there(spark):
    tr, sq = traces(spark, [("t", "q", "ab", "unsafe", 0, 1, 2)]), sequences(spark)
    r = M.streaming_metrics(R.replay(R.numbered(tokens(spark, "SS"), sq, tr), sq, tr, [R.Rule()], ("token",), with_text=False)).first()
    assert r.leakage_words_mean is None and r.leakage_mean == 2
    with pytest.raises(ValueError, match="missing columns: query, query_label"):
        P.require_columns(tr.drop("query").withColumn("response_label", F.lit("x")))


def test_exemplars(spark):
    """The median late signal is row n // 2 of the late ones by delay and ids, found without ordering a whole group."""
    rows = [("p", "r", f"t{i:02d}", None, "unsafe", True, d, None) for i, d in enumerate([5, 1, 3, 3, 9, 3, 2])] + [("p", "r", "x", None, "unsafe", False, None, None), ("p", "r", "e", None, "unsafe", True, None, 4), ("p", "r", "f", None, "safe", True, None, None), ("q", "r", "g", "broken", "safe", True, 3, None)]
    df = spark.createDataFrame(rows, "policy string, run_id string, trace_id string, error string, response_truth string, blocked boolean, detection_delay_tokens int, early_lead_tokens int")
    assert {(r.policy, r.kind, r.trace_id) for r in A.exemplars(df, ["policy"]).collect()} == {("p", "median_late", "t03"), ("p", "earliest", "e"), ("p", "miss", "x"), ("p", "false_block", "f")}
