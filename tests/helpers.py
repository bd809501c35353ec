"""Small frames for replay tests: one run, one trace, one character a token unless a text is given."""

from __future__ import annotations

from tidegate.operators import replay as R

TOKEN = "run_id string, trace_id string, token_index int, end_character int, latency_ms double, unsafe_score double, controversial_score double, confidence double, evaluated boolean, label string"
SEQUENCE = "run_id string, trace_id string, model_id string, error string"
TRACE = "trace_id string, query string, response string, response_truth string, unsafe_start_character int, unsafe_start_token int, response_token_count int"
LETTERS = {"S": "safe", "U": "unsafe", "C": "controversial"}


def tokens(spark, labels: str, ends=None, trace="t", run="r", scores=None):
    rows = [(run, trace, i, ends[i - 1] if ends else i, 1.0, None if scores is None else scores[i - 1], None, None, True, LETTERS[x]) for i, x in enumerate(labels, 1)]
    return spark.createDataFrame(rows, TOKEN)


def traces(spark, rows):
    return spark.createDataFrame(rows, TRACE)


def sequences(spark, rows=(("r", "t", "m", None),)):
    return spark.createDataFrame(list(rows), SEQUENCE)


def results(spark, labels, rules, modes=("token",), text=None, truth="unsafe", onset=1, ends=None, onset_char=None, cap=128):
    n = len(labels)
    text = text if text is not None else "x" * n
    tr = traces(spark, [("t", "q", text, truth, len(text) if onset_char is None and truth == "safe" else (onset - 1 if onset_char is None else onset_char), onset, n)])
    sq = sequences(spark)
    return R.replay(R.numbered(tokens(spark, labels, ends), sq, tr, cap), sq, tr, rules, modes, cap).collect()


def dense(labels: str, rule: R.Rule, intervals: list[tuple[int, int]]):
    """Brute force: walk the tokens one by one. Returns (signal, intervention, released, checks)."""
    blocking = R.POLICIES[rule.policy]
    flags = [LETTERS[x] in blocking for x in labels]
    for i in range(1, len(flags) + 1):
        start, end, number = next((a, b, k) for k, (a, b) in enumerate(intervals, 1) if a < i <= b)
        k = {"cumulative": sum(flags[:i]), "window": sum(flags[max(0, i - (rule.trigger_window or 0)) : i]), "buffer": sum(flags[start:i])}.get(rule.trigger_mode)
        if rule.trigger_mode == "consecutive":
            k = 0
            while k < i and flags[i - 1 - k]:
                k += 1
        if flags[i - 1] and k >= rule.trigger_count:
            return i, end, start, number
    return None, None, len(flags), len(intervals)
