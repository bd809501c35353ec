import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegate.llm.p4_pieces import cut_kinds, cut_text, pieces
from tidegate.llm.tokens import TOKEN_RE


def check(text, limit, overlap):
    gap, cuts = cut_text(text, limit, overlap)
    n = len(TOKEN_RE.findall(text))
    if not n:
        assert cuts == []
        return gap, cuts
    assert cuts[0][2] == 0 and cuts[-1][3] == n
    for a, b in zip(cuts, cuts[1:]):
        assert a[3] - b[2] == overlap
    assert all(0 < x[3] - x[2] <= limit for x in cuts)
    return gap, cuts


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "word ", "x. ", "長い", "。", "\n\n", "\n", ", ", "🙂", "longerword"]), max_size=120), st.integers(2, 15))
def test_every_layout_holds(parts, limit):
    check("".join(parts), limit, limit // 3)


def test_boundaries_are_used():
    rnd = random.Random(3)
    text = " ".join("w" * rnd.randint(1, 5) + rnd.choice(["", "", ".", ","]) for _ in range(900))
    gap, cuts = check(text, 200, 20)
    assert gap == 1 or gap == 2
    assert all(how == "natural" for *_, how in cuts[:-1])
    assert len(cuts) == -(-(cuts[-1][3] - 200) // 180) + 1 or len(cuts) == -(-(cuts[-1][3] - 200) // 180) + 2
    blank = "a b c d. " * 30 + "\n\n" + "a b c d. " * 30
    _, cuts = check(blank, 200, 20)
    assert cuts[0][1] == len("a b c d. " * 30) - 1


def test_forced_cut():
    gap, cuts = check("漢" * 500, 200, 20)
    assert gap == 500 and {c[4] for c in cuts} == {"forced", "end"}


def test_table(spark):
    rows = [("n", "one two. " * 100, 1), ("f", "字" * 201, 2), ("s", "字" * 200, 3), (None, "字" * 201, 4), ("x", None, 5), ("e", "", 6)]
    df = spark.createDataFrame(rows, "trace_id string, response string, piece_no int")
    got = pieces(df, "trace_id", "response")
    assert {(r.trace_id, r.cut_kind) for r in cut_kinds(got, "trace_id").collect()} == {("n", "natural"), ("f", "forced"), (None, "forced")}
    assert pieces(df.limit(0), "trace_id", "response").count() == 0
    with pytest.raises(ValueError):
        pieces(df, "trace_id", "response", 20, 20)
