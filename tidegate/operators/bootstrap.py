"""Resampling intervals and paired comparisons.

The exact kernel draws with NumPy's PCG64, seed 42, from values in trace order; it needs a group's values in one task,
so it is for groups as large as a set of annotated traces. `counted` is the form for groups of any size: it draws from
the histogram of a group's values (whole tokens) with multinomial counts, so a task holds distinct values only.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interval(values: np.ndarray, statistic: str = "mean", seed: int = 42, resamples: int = 10_000) -> tuple[float | None, float | None]:
    """2.5 % and 97.5 % of a statistic (mean, median, p90) over resamples; none for no value. Draws go in blocks, the stream of random numbers is that of one draw."""
    if not len(values):
        return None, None
    of = {"mean": lambda v: v.mean(axis=1), "median": lambda v: np.median(v, axis=1), "p90": lambda v: np.percentile(v, 90, axis=1)}[statistic]
    rng = np.random.default_rng(seed)
    block = max(1, min(resamples, 4_000_000 // len(values)))
    got = np.concatenate([of(rng.choice(values, (min(block, resamples - k), len(values)), replace=True)) for k in range(0, resamples, block)])
    low, high = np.percentile(got, [2.5, 97.5])
    return float(low), float(high)


def bootstrap_ci(df: DataFrame, keys: list[str], value: str, order: list[str], statistic: str = "mean", seed: int = 42, resamples: int = 10_000) -> DataFrame:
    """(keys, n, estimate, ci_low, ci_high) of a statistic per group, values in the given order. Null and NaN values are left out; a group of none has null bounds."""
    kinds = [f"{k} {df.schema[k].dataType.simpleString()}" for k in keys]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        v = frame.sort_values([f"_o{i}" for i in range(len(order))])["_v"].dropna().to_numpy(float)
        low, high = interval(v, statistic, seed, resamples)
        est = None if not len(v) else float({"mean": np.mean, "median": np.median, "p90": lambda x: np.percentile(x, 90)}[statistic](v))
        return pd.DataFrame([[*frame[keys].iloc[0], len(v), est, low, high]], columns=[*keys, "n", "estimate", "ci_low", "ci_high"])

    rows = df.select(*keys, F.col(value).cast("double").alias("_v"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)])
    return rows.groupBy(*keys).applyInPandas(run, ", ".join([*kinds, "n long, estimate double, ci_low double, ci_high double"]))


def counted(df: DataFrame, keys: list[str], value: str, seed: int = 42, resamples: int = 10_000) -> DataFrame:
    """Bootstrap interval of a mean for groups of any size: counts per distinct value, then multinomial resamples of the counts."""
    kinds = [f"{k} {df.schema[k].dataType.simpleString()}" for k in keys]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_v")
        v, c = frame["_v"].to_numpy(float), frame["_c"].to_numpy(np.int64)
        n = int(c.sum())
        rng = np.random.default_rng(seed)
        got = np.array([rng.multinomial(n, c / n) @ v / n for _ in range(resamples)])
        low, high = np.percentile(got, [2.5, 97.5])
        return pd.DataFrame([[*frame[keys].iloc[0], n, float(v @ c / n), float(low), float(high)]], columns=[*keys, "n", "estimate", "ci_low", "ci_high"])

    histogram = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    return histogram.groupBy(*keys).applyInPandas(run, ", ".join([*kinds, "n long, estimate double, ci_low double, ci_high double"]))


def _resampled(v: np.ndarray, c: np.ndarray, statistics: list[str], seed: int, resamples: int) -> dict[str, np.ndarray]:
    """Each statistic (mean, median, p90) over multinomial resamples of counts c of ascending distinct values v. Draws go in blocks, all statistics see the same ones."""
    n = int(c.sum())
    rng = np.random.default_rng(seed)
    block = max(1, min(resamples, 2_000_000 // len(v)))
    got: dict[str, list[np.ndarray]] = {s: [] for s in statistics}
    for k in range(0, resamples, block):
        draws = rng.multinomial(n, c / n, min(block, resamples - k))
        upto = draws.cumsum(axis=1) if set(statistics) - {"mean"} else None
        for s in statistics:
            if s == "mean":
                got[s].append(draws @ v / n)
                continue
            at = {"median": 0.5, "p90": 0.9}[s] * (n - 1)
            low = int(at)
            x, y = (v[(upto <= rank).sum(axis=1)] for rank in (low, min(low + 1, n - 1)))
            got[s].append(x + (y - x) * (at - low))
    return {s: np.concatenate(x) for s, x in got.items()}


def counted_all(df: DataFrame, keys: list[str], metrics: dict[str, list[str]], seed: int = 42, resamples: int = 10_000) -> DataFrame:
    """(keys, metric, statistic, n, estimate, ci_low, ci_high) for groups of any size: statistics of each metric, from counts per distinct value. Null and NaN values are left out; a group of none has no row."""
    kinds = [f"{k} {df.schema[k].dataType.simpleString()}" for k in keys]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_v")
        v, c = frame["_v"].to_numpy(float), frame["_c"].to_numpy(np.int64)
        metric = frame["metric"].iloc[0]
        one = _resampled(v, c, metrics[metric], seed, resamples)
        upto, n = c.cumsum(), int(c.sum())
        rows = []
        for s, got in one.items():
            at = {"mean": 0.0, "median": 0.5, "p90": 0.9}[s] * (n - 1)
            x, y = (v[np.searchsorted(upto, rank, side="right")] for rank in (int(at), min(int(at) + 1, n - 1)))
            low, high = np.percentile(got, [2.5, 97.5])
            rows.append([*frame[keys].iloc[0], metric, s, n, float(v @ c / n) if s == "mean" else float(x + (y - x) * (at - int(at))), float(low), float(high)])
        return pd.DataFrame(rows, columns=[*keys, "metric", "statistic", "n", "estimate", "ci_low", "ci_high"])

    values = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("_v")) for m in metrics])).alias("_s")
    histogram = df.select(*keys, values).select(*keys, "_s.*").where("_v is not null and not isnan(_v)").groupBy(*keys, "metric", "_v").agg(F.count(F.lit(1)).alias("_c"))
    return histogram.groupBy(*keys, "metric").applyInPandas(run, ", ".join([*kinds, "metric string, statistic string, n long, estimate double, ci_low double, ci_high double"]))


def bootstrap_all(df: DataFrame, keys: list[str], metrics: dict[str, list[str]], order: list[str], seed: int = 42, resamples: int = 10_000, exact: int = 5_000) -> DataFrame:
    """(keys, metric, statistic, n, estimate, ci_low, ci_high, drawn): the exact kernel for groups of at most `exact` rows, by counts for larger ones; drawn says which. A metric of which a group has no value has no row."""
    sizes = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_size"))
    sized = df.join(sizes, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])).select(*df.columns, "_size")
    large = counted_all(sized.where(F.col("_size") > exact), keys, metrics, seed, resamples).withColumn("drawn", F.lit("counts"))
    kinds = [f"{k} {df.schema[k].dataType.simpleString()}" for k in keys]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([f"_o{i}" for i in range(len(order))])
        rows = []
        for m, statistics in metrics.items():
            v = frame[m].dropna().to_numpy(float)
            for s in statistics if len(v) else []:
                est = {"mean": np.mean, "median": np.median, "p90": lambda x: np.percentile(x, 90)}[s](v)
                rows.append([*frame[keys].iloc[0], m, s, len(v), float(est), *interval(v, s, seed, resamples), "values"])
        return pd.DataFrame(rows, columns=[*keys, "metric", "statistic", "n", "estimate", "ci_low", "ci_high", "drawn"])

    small = sized.where(F.col("_size") <= exact).select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics], *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)])
    return small.groupBy(*keys).applyInPandas(run, ", ".join([*kinds, "metric string, statistic string, n long, estimate double, ci_low double, ci_high double, drawn string"])).unionByName(large)


def counted_pairs(pairs: DataFrame, keys: list[str], seed: int = 42, resamples: int = 10_000) -> DataFrame:
    """(keys, pairs, mean_a, mean_b, mean_difference, ci_low, ci_high, p_value) of paired values for groups of any size, from counts per distinct difference; p is two-sided."""
    kinds = [f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_v")
        v, c = frame["_v"].to_numpy(float), frame["_c"].to_numpy(np.int64)
        n = int(c.sum())
        e = _resampled(v, c, ["mean"], seed, resamples)["mean"]
        low, high = np.percentile(e, [2.5, 97.5])
        p = min(1.0, 2 * min((e <= 0).mean(), (e >= 0).mean()))
        return pd.DataFrame([[*frame[keys].iloc[0], n, float(frame["_a"].sum() / n), float(frame["_b"].sum() / n), float(v @ c / n), float(low), float(high), float(p)]], columns=[*keys, "pairs", "mean_a", "mean_b", "mean_difference", "ci_low", "ci_high", "p_value"])

    histogram = pairs.groupBy(*keys, F.col("difference").alias("_v")).agg(F.count(F.lit(1)).alias("_c"), F.sum("value_a").alias("_a"), F.sum("value_b").alias("_b"))
    return histogram.groupBy(*keys).applyInPandas(run, ", ".join([*kinds, "pairs long, mean_a double, mean_b double, mean_difference double, ci_low double, ci_high double, p_value double"]))


def portable_ci(df: DataFrame, keys: list[str], value: str, order: list[str], resamples: int = 200) -> DataFrame:
    """A bootstrap whose draws are integer arithmetic, (r * 7919 + i * 104729 + 42) mod n, so that any SQL engine gets the same. Not the reference's random numbers. For small groups: it makes resamples x n rows."""
    ranked = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).alias("_i"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n"))
    draws = ranked.select(*keys, "_i", "_n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("_r"))
    picks = draws.select(*keys, "_r", ((F.col("_r") * 7919 + F.col("_i") * 104729 + 42) % F.col("_n")).alias("_i"))
    means = picks.join(ranked.select(*keys, "_i", "_v"), [*keys, "_i"]).groupBy(*keys, "_r").agg(F.avg("_v").alias("_m"))
    return means.groupBy(*keys).agg(F.percentile("_m", 0.025).alias("ci_low"), F.percentile("_m", 0.975).alias("ci_high"))


def paired_modes(results: DataFrame, metric: str = "leakage_tokens", keys: list[str] | None = None) -> DataFrame:
    """(keys, policy, mode_a, mode_b, run_id, trace_id, value_a, value_b, difference): every pair of modes on the same sequence.

    The modes of a sequence are few, so its rows are gathered once and paired in place: no self-join.
    """
    group = [*(keys or []), "policy", "rule", "run_id", "trace_id"]
    sets = results.where(F.col(metric).isNotNull()).groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("mode", F.col(metric).cast("double").alias("v")))).alias("_m"))
    pairs = F.flatten(F.transform("_m", lambda a: F.transform(F.filter("_m", lambda b: b["mode"] > a["mode"]), lambda b: F.struct(a["mode"].alias("mode_a"), b["mode"].alias("mode_b"), a["v"].alias("value_a"), b["v"].alias("value_b"), (a["v"] - b["v"]).alias("difference")))))
    return sets.select(*group, F.inline(pairs))


def paired_models(values: DataFrame, model: str, unit: str, metric: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, unit, model_a, model_b, value_a, value_b, difference): every pair of models on the same unit; the models of a unit are few. A model must have one value a unit."""
    sets = values.where(F.col(metric).isNotNull()).groupBy(*(keys or []), unit).agg(F.sort_array(F.collect_list(F.struct(F.col(model).alias("m"), F.col(metric).cast("double").alias("v")))).alias("_m"))
    pairs = F.flatten(F.transform("_m", lambda a: F.transform(F.filter("_m", lambda b: b["m"] > a["m"]), lambda b: F.struct(a["m"].alias("model_a"), b["m"].alias("model_b"), a["v"].alias("value_a"), b["v"].alias("value_b"), (a["v"] - b["v"]).alias("difference")))))
    return sets.select(*(keys or []), unit, F.inline(pairs))


def pairwise_tests(differences: DataFrame, order: str, seed: int = 42, resamples: int = 10_000) -> DataFrame:
    """Per pair of models: n, mean difference, interval and two-sided bootstrap p."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        d = frame.sort_values("_o")["difference"].to_numpy(float)
        rng = np.random.default_rng(seed)
        block = max(1, min(resamples, 4_000_000 // len(d)))
        e = np.concatenate([rng.choice(d, (min(block, resamples - k), len(d)), replace=True).mean(axis=1) for k in range(0, resamples, block)])
        low, high = np.percentile(e, [2.5, 97.5])
        p = min(1.0, 2 * min((e <= 0).mean(), (e >= 0).mean()))
        return pd.DataFrame([[frame["model_a"].iloc[0], frame["model_b"].iloc[0], len(d), float(d.mean()), float(low), float(high), float(p)]], columns=["model_a", "model_b", "n", "mean_difference", "ci_low", "ci_high", "p_value"])

    return differences.withColumn("_o", F.col(order)).groupBy("model_a", "model_b").applyInPandas(run, "model_a string, model_b string, n long, mean_difference double, ci_low double, ci_high double, p_value double")


def holm(tests: DataFrame, p: str, order: list[str], alpha: float = 0.05, keys: list[str] | None = None) -> DataFrame:
    """Holm's step-down over all tests (of the same keys) with a p: significant while every smaller p passed too. Tests are pairs of models, a short list."""
    parts = [*[F.col(k) for k in keys or []], F.col(p).isNull()]
    w = Window.partitionBy(*parts).orderBy(p, *order)
    m = F.count(p).over(Window.partitionBy(*parts))
    passed = F.col(p) <= alpha / (m - F.row_number().over(w) + 1)
    steps = tests.withColumn("_passed", F.coalesce(passed, F.lit(False)))
    return steps.withColumn("significant", F.bool_and("_passed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_passed")
