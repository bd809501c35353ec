import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegate.llm.p6_containers import best_fit, fill, pack
from tidegate.llm.p7_mix import fit, mix, shares


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(0, 12), max_size=12))
def test_best_fit_holds_and_is_dense(sizes):
    rows = best_fit(sizes, 30)
    used, seen = {}, {}
    for s, a, b, c, place in rows:
        for k in range(b - a):
            used.setdefault(c + k, []).append((place, s))
            seen.setdefault(s, []).append(a + k)
    assert {s: sorted(v) for s, v in seen.items()} == {s: list(range(n)) for s, n in sizes.items() if n}
    assert sorted(used) == list(range(len(used)))
    for slots in used.values():
        slots.sort()
        assert all(p + s <= q for (p, s), (q, _) in zip(slots, slots[1:])) and slots[-1][0] + slots[-1][1] <= 30
    total = sum(s * n for s, n in sizes.items())
    assert len(used) <= 1.7 * -(-total // 30) + 1


def test_pack(spark):
    rnd = random.Random(2)
    rows = [(i, 17 if i % 3 else rnd.choice([0, None, 1, 5, 64, 150]), 0) for i in range(600)] + [(None, 9, 0), (5, 17, 0)]
    df = spark.createDataFrame(rows, "doc_id long, tokens int, container int")
    for part in (1_000_000, 25):
        packed = pack(df, "doc_id", "tokens", [64, 100], part).collect()
        for c in (64, 100):
            mine = [r for r in packed if r.capacity_tokens == c]
            assert sum(r.tokens for r in mine) == sum(n or 0 for _, n, _ in rows)
            boxes = {}
            for r in mine:
                if r.container is not None:
                    boxes.setdefault(r.container, []).append((r.place, r.tokens))
                else:
                    assert r.tokens == 0
            assert sorted(boxes) == list(range(len(boxes)))
            for slots in boxes.values():
                slots.sort()
                assert all(p + s <= q for (p, s), (q, _) in zip(slots, slots[1:])) and sum(slots[-1]) <= c
            cut = [r for r in mine if r.piece_no > 1]
            assert {r.doc_id for r in cut} <= {i for i, n, _ in rows if n and n > c}
    f = {r.capacity_tokens: r for r in fill(pack(df, "doc_id", "tokens", [64])).collect()}[64]
    assert f.containers >= f.least_containers and f.filled > 0.9
    assert pack(df.limit(0), "doc_id", "tokens", [64]).count() == 0
    with pytest.raises(ValueError):
        pack(df, "doc_id", "tokens", [])


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 4), min_size=1, max_size=7), st.integers(0, 400))
def test_fit_is_the_best_choice(sizes, budget):
    lengths, counts = list(sizes), list(sizes.values())
    take = fit(lengths, counts, budget)
    assert all(0 <= t <= c for t, c in zip(take, counts))
    reach = {0}
    for n, c in sizes.items():
        reach = {x + n * k for x in reach for k in range(c + 1)}
    assert sum(n * t for n, t in zip(lengths, take)) == max(x for x in reach if x <= budget)


def test_large_budgets_are_met():
    rnd = random.Random(1)
    lengths = list(range(1, 2500))
    counts = [rnd.randint(0, 40) for _ in lengths]
    budget = sum(n * c for n, c in zip(lengths, counts)) // 3
    assert sum(n * t for n, t in zip(lengths, fit(lengths, counts, budget))) == budget


def test_mix(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["Big ", "BIG", "big"]), rnd.randint(1, 50), 1) for i in range(400)] + [(1000 + i, "small-one", rnd.randint(1, 20), 1) for i in range(10)] + [(2000, None, 5, 1), (2001, "other", 5, 1), (2002, "big", None, 1), (None, "big", 3, 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens int, uses int")
    targets = spark.createDataFrame([("big", 0.7, 1), ("small_one", 0.2, 4), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixed = mix(df, "doc_id", "source", "tokens", targets, rows_per_part=30)
    got = mixed.collect()
    assert max(r.uses for r in got if r.source == "small_one") <= 4 and {r.source for r in got} == {"big", "small_one"}
    s = {r.source: r for r in shares(mixed, targets).collect()}
    assert abs(s["big"].reached_share - 7 / 9) < 0.002 and abs(s["small_one"].reached_share - 2 / 9) < 0.002
    assert s["absent"].tokens == 0 and s["absent"].present_share == 0
    assert sorted(map(str, mix(df.orderBy("tokens"), "doc_id", "source", "tokens", targets).collect())) == sorted(map(str, mix(df, "doc_id", "source", "tokens", targets).collect()))
    assert mix(df.limit(0), "doc_id", "source", "tokens", targets).count() == 0
    assert sum(r.tokens * r.uses for r in mix(df, "doc_id", "source", "tokens", targets, 90).collect()) == 90
