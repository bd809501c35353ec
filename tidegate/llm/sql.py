"""SQL for DuckDB that says what the queries of this package compute, written without them."""

from __future__ import annotations

#: Accuracy 0.01 and the fractions asked for.
_GAMMA = "(1.01e0 / 0.99e0)"
_ONCE = """
rows AS (
  SELECT run_id, shard, mode, policy, model_id, run_date, arg_max(leakage_median, ingested_at) AS leakage_median,
         arg_max(leakage_p90, ingested_at) AS leakage_p90, arg_max(detection_delay_median, ingested_at) AS detection_delay_median
  FROM streaming_metrics GROUP BY ALL),
long AS (
  SELECT model_id, mode, policy, run_date, unnest(['leakage_median', 'leakage_p90', 'detection_delay_median']) AS metric,
         unnest([leakage_median, leakage_p90, detection_delay_median]) AS x FROM rows)"""


def _quantiles(keys: str, fractions: str) -> str:
    """From the sorted values themselves: the value at the rank, put into its bucket afterwards."""
    return f"""WITH {_ONCE},
kept AS (SELECT {keys}, metric, x, row_number() OVER (PARTITION BY {keys}, metric ORDER BY x) - 1 AS place, count(*) OVER (PARTITION BY {keys}, metric) AS n
         FROM long WHERE x IS NOT NULL AND isfinite(x) AND x >= 0),
asked AS (SELECT *, floor(fraction * (n - 1))::BIGINT AS rank FROM kept, (SELECT unnest({fractions}) AS fraction)),
found AS (SELECT {keys}, metric, fraction, rank, n, CASE WHEN x = 0 THEN 0e0 ELSE 2 / ({_GAMMA} + 1) * pow({_GAMMA}, ceil(ln(x) / ln({_GAMMA}))) END AS v FROM asked WHERE place = rank)
SELECT {keys}, metric, fraction, rank, round(v, 6) AS value, round(v / 1.01, 6) AS low, round(v / 0.99, 6) AS high, n AS values FROM found"""


_ALL = "[0.1e0, 0.25e0, 0.5e0, 0.75e0, 0.9e0, 0.95e0, 0.99e0]"
_TOKEN = r"[A-Za-z0-9\x{c0}-\x{24f}\x{400}-\x{4ff}]{1,6}|[^A-Za-z0-9\x{c0}-\x{24f}\x{400}-\x{4ff}\x{9}-\x{d}\x{20}\x{a0}\x{3000}]"
_MARK = r"\x{9}-\x{d}\x{20}\x{a0}\x{3000}.!?…。！？।,;:、，；："
_RUN_EVENTS = r"""
once AS (SELECT run_id, trace_id, token_index, arg_max(risk_label, ingest_batch) AS risk_label, arg_max(scored_at, ingest_batch) AS scored_at
         FROM response_token_decision WHERE evaluated GROUP BY ALL),
named AS (SELECT *, nullif(lower(regexp_replace(risk_label, '^[\s\x{a0}\x{3000}\x{200b}\x{feff}]+|[\s\x{a0}\x{3000}\x{200b}\x{feff}]+$', '', 'g')), '') AS l FROM once),
meant AS (SELECT run_id, trace_id, token_index, scored_at, CASE WHEN l = 'uncertain' THEN 'controversial' ELSE l END AS label FROM named),
marked AS (SELECT *, CASE WHEN label IS NULL OR label IS DISTINCT FROM lag(label) OVER w THEN 1 ELSE 0 END AS new FROM meant WINDOW w AS (PARTITION BY run_id, trace_id ORDER BY token_index)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY run_id, trace_id ORDER BY token_index ROWS UNBOUNDED PRECEDING) AS run FROM marked),
runs AS (SELECT run_id, trace_id, label, run, min(token_index) AS first_token_index, max(token_index) AS last_token_index, count(*) AS events,
                (epoch_us(max(scored_at)) - epoch_us(min(scored_at))) / 1000e0 AS duration_ms FROM numbered WHERE label IS NOT NULL GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    days = _quantiles("model_id, mode, policy", _ALL)
    return {
        "p2_percentiles": days,
        "p2_merged_days": days,
        "p2_by_day": _quantiles("model_id, mode, policy, run_date", "[0.5e0, 0.9e0]"),
        "p4_found": rf"""WITH once AS (SELECT trace_id, arg_max(response, ingested_at) AS response FROM benchmark_example WHERE trace_id IS NOT NULL GROUP BY trace_id),
parts AS (SELECT trace_id, len(regexp_extract_all(response, '{_TOKEN}')) AS tokens, regexp_extract_all(response, '[^{_MARK}]*[{_MARK}]|[^{_MARK}]+') AS part FROM once WHERE response IS NOT NULL)
SELECT trace_id, CASE WHEN list_max(list_transform(part, lambda x: len(regexp_extract_all(x, '{_TOKEN}')))) > 200 THEN 'forced' ELSE 'natural' END AS cut_kind FROM parts WHERE tokens > 200""",
        "p5_found": f"WITH {_RUN_EVENTS} SELECT run_id, trace_id, first_token_index, last_token_index FROM runs WHERE events > 1",
        "p5_runs": f"WITH {_RUN_EVENTS} SELECT run_id, trace_id, label, first_token_index, last_token_index, events, round(duration_ms, 3) AS duration_ms FROM runs",
    }
