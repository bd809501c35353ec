import random
import re

import pytest
from pyspark.sql import functions as F

from tests.helpers import LETTERS, TOKEN, dense, results, sequences, tokens, traces
from tidegate.operators import replay as R

CASES = [
    ("SSCUS", "token", R.Rule("conservative"), (4, 4, 3)),
    ("CUUCU", "token", R.Rule("strict", "cumulative", 4), (4, 4, 3)),
    ("SSUSSUSSSSUS", "chunk_8", R.Rule("conservative", "cumulative", 2), (6, 8, 0)),
    ("UU", "token", R.Rule("conservative", "cumulative", 5), (None, None, 2)),
    ("UUSUUUSU", "token", R.Rule("conservative", "consecutive", 3), (6, 6, 5)),
    ("USUU", "chunk_16", R.Rule("conservative", "window", 2, 2), (4, 4, 0)),
    ("SUSSSSSSSUU", "chunk_8", R.Rule("conservative", "buffer", 2), (11, 11, 8)),
    ("SUSSSSSSSUU", "full_buffered", R.Rule("conservative", "buffer", 3), (11, 11, 0)),
]


@pytest.mark.parametrize("labels,mode,rule,expected", CASES)
def test_worked_cases(spark, labels, mode, rule, expected):
    (r,) = results(spark, labels, [rule], (mode,))
    assert (r.signal_token, r.intervention_token, r.released_tokens) == expected


def test_premature_and_delay(spark):
    (r,) = results(spark, "SSSCSSU", [R.Rule("strict")], onset=6)
    assert (r.released_tokens, r.leakage_tokens, r.signal_offset_tokens, r.premature_block, r.early_lead_tokens) == (3, 0, -2, True, 2)
    (r,) = results(spark, "SSSCSSU", [R.Rule("conservative")], onset=6)
    assert (r.detection_delay_tokens, r.premature_block, r.leakage_tokens) == (1, False, 1)


def test_leaked_text(spark):
    (r,) = results(spark, "SSSSSSUS", [R.Rule("conservative")], text="Fine so far. Then this part is bad", ends=[5, 8, 13, 18, 23, 28, 31, 34], onset=4, onset_char=13)
    assert (r.released_tokens, r.leakage_tokens, r.leakage_characters, r.leakage_words) == (6, 3, 15, 3)


def test_time_and_text_at_lost_indexes(spark):
    """A stop whose interval ends or starts at a lost index takes time and text of the last token before."""
    text = "abcdefghijkl"
    rows = [("r", "t", i, i, float(i), None, None, None, True, "unsafe" if i == 10 else "safe") for i in range(1, 13) if i not in (8, 12)]
    tr, sq = traces(spark, [("t", "q", text, "unsafe", 2, 3, 12)]), sequences(spark)
    got = {r.mode: r for r in R.replay(R.numbered(spark.createDataFrame(rows, TOKEN), sq, tr), sq, tr, [R.Rule()], ("chunk_8", "token", "sentence")).collect()}
    assert (got["chunk_8"].released_tokens, got["chunk_8"].intervention_token, got["chunk_8"].leakage_characters, got["chunk_8"].guard_time_ms) == (8, 11, 5, 58.0)
    assert (got["token"].released_tokens, got["token"].leakage_characters, got["token"].guard_time_ms) == (9, 7, 47.0)
    assert (got["sentence"].released_tokens, got["sentence"].leakage_characters) == (0, 0)


def test_tokens_move_once(spark):
    """One exchange of the tokens, however many modes and rules are replayed."""
    tr, sq = traces(spark, [("t", "q", "ab", "safe", 2, 3, 2)]), sequences(spark)
    placed = tokens(spark, "SS").withColumn("latency_ms", F.col("latency_ms") + 17.25).repartition("run_id", "trace_id")
    plan = R.replay(R.numbered(placed, sq, tr), sq, tr, [R.Rule("strict", "buffer", 2), R.Rule()])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("17.25") == 1


def test_failed_and_empty_sequences(spark):
    tr = traces(spark, [("t", "q", "ab", "safe", 2, 3, 2), ("e", "q", "", "safe", 0, 1, 0), ("f", "q", "ab", "unsafe", 0, 1, 2)])
    sq = sequences(spark, [("r", "t", "m", None), ("r", "e", "m", None), ("r", "f", "m", "broken")])
    got = {r.trace_id: r for r in R.replay(R.numbered(tokens(spark, "SS"), sq, tr), sq, tr, [R.Rule()], ("sentence",)).collect()}
    assert set(got) == {"t", "e", "f"}
    assert (got["e"].released_tokens, got["e"].checks, got["e"].blocked) == (0, 0, False)
    assert (got["f"].released_tokens, got["f"].checks, got["f"].leakage_tokens, got["f"].error) == (0, 0, None, "broken")
    assert got["t"].safe_withheld_tokens == 0


def test_empty_tables(spark):
    tr, sq, tk = traces(spark, []), sequences(spark, []), tokens(spark, "")
    assert R.replay(R.numbered(tk, sq, tr), sq, tr, [R.Rule()]).count() == 0


STOP = re.compile(r"[.!?。！？]+[\"'»”’)*\]]*$")


def sentence_intervals(text, ends, cap):
    out, start = [], 0
    for i, e in enumerate(ends, 1):
        if STOP.search(text[:e].rstrip()) or i - start >= cap or i == len(ends):
            out.append((start, i))
            start = i
    return out


def test_random_traces_against_a_walk(spark):
    """All modes and rules, texts with stops, quotes, CJK marks and odd white space, against a token-by-token walk."""
    rnd = random.Random(5)
    rules = [R.Rule(p, m, k, w) for p in R.POLICIES for m, k, w in (("cumulative", 1, None), ("cumulative", 3, None), ("consecutive", 2, None), ("window", 2, 4), ("buffer", 2, None))]
    rows, trs, sqs, known = [], [], [], {}
    for n in range(30):
        size = rnd.randint(1, 40)
        parts = [rnd.choice(["ab", "c ", ". ", "! ", "。", '."', " ", "　", "\U0001f600", "?)", " x", "e"]) for _ in range(size)]
        ends = [len("".join(parts[: i + 1])) for i in range(size)]
        labels = "".join(rnd.choice("SSUC") for _ in range(size))
        t = f"t{n}"
        rows += [("r", t, i, ends[i - 1], 1.0, None, None, None, True, LETTERS[x]) for i, x in enumerate(labels, 1)]
        trs.append((t, "q", "".join(parts), "unsafe", 0, 1, size))
        sqs.append(("r", t, "m", None))
        known[t] = ("".join(parts), ends, labels)
    tr, sq = traces(spark, trs), sequences(spark, sqs)
    cap = 5
    got = R.replay(R.numbered(spark.createDataFrame(rows, TOKEN), sq, tr, cap), sq, tr, rules, R.MODES, cap).collect()
    assert len(got) == 30 * len(rules) * len(R.MODES)
    for r in got:
        text, ends, labels = known[r.trace_id]
        n = len(labels)
        chunk = R.CHUNKS.get(r.mode, 1 if r.mode == "token" else n)
        intervals = sentence_intervals(text, ends, cap) if r.mode == "sentence" else [(a, min(a + chunk, n)) for a in range(0, n, chunk)]
        assert (r.signal_token, r.intervention_token, r.released_tokens, r.checks) == dense(labels, rules[r.rule], intervals), (r, text)


def test_rules_are_checked():
    for bad in ({"trigger_count": 0}, {"trigger_mode": "window"}, {"trigger_window": 3}, {"trigger_mode": "window", "trigger_count": 3, "trigger_window": 2}, {"policy": "x"}):
        with pytest.raises(ValueError):
            R.Rule(**bad)


def test_relabel_by_score(spark):
    t = tokens(spark, "SUSS", scores=[0.35, 0.1, 0.6, 0.8])
    assert [r.label for r in R.relabelled(t, 0.6).orderBy("token_index").collect()] == ["safe", "safe", "unsafe", "unsafe"]
    t = tokens(spark, "US")
    assert [r.label for r in R.relabelled(t, 0.7).orderBy("token_index").collect()] == ["unsafe", "safe"]
    with pytest.raises(Exception, match="has no score"):
        R.relabelled(t, 0.7, strict=True).collect()


def test_restriction_without_warmup_repeats_checkpoints(spark):
    labels = "S" * 23 + "U" + "S" * 6
    tr = traces(spark, [("t", "q", "x" * 30, "unsafe", 20, 21, 30)])
    sq = sequences(spark)
    numbered = R.numbered(tokens(spark, labels), sq, tr)
    blocked = {}
    for mode in ("chunk_8", "chunk_16", "chunk_32", "full_buffered"):
        (r,) = R.replay(R.restricted(numbered, mode), sq, tr, [R.Rule("conservative")], (mode,)).collect()
        blocked[mode] = r.blocked
    assert blocked == {"chunk_8": True, "chunk_16": False, "chunk_32": False, "full_buffered": False}
    (r,) = R.replay(R.restricted(numbered, "chunk_8", 128, 24), sq, tr, [R.Rule("conservative")], ("chunk_8",)).collect()
    assert not r.blocked
    with pytest.raises(ValueError, match="warm-up"):
        R.as_asked(numbered, "chunk_8", warmup=8)
    assert R.as_asked(numbered, "chunk_8") is numbered and R.as_asked(numbered, "chunk_8", restrict=True, warmup=8).where("label = 'unsafe'").count() == 1
