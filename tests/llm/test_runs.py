import random

import pytest

from tidegate.llm import p5_runs
from tidegate.llm.p5_runs import agglomerate, normal_label, runs

SCHEMA = "run_id string, trace_id string, token_index int, label string, scored_at timestamp, ingest_batch int, score double, evaluated boolean, first_position int"


def table(spark, rows):
    from pyspark.sql import functions as F

    made = [(r, t, i, l, None if s is None else s, b, x, True, 0) for r, t, i, l, s, b, x in rows]
    schema = SCHEMA.replace("scored_at timestamp", "s double")
    return spark.createDataFrame(made, schema).withColumn("scored_at", F.timestamp_micros((F.col("s") * 1e6).cast("long")))


def collapse(rows):
    """Brute force for labels: the latest delivery of each position, then maximal stretches of one label."""
    out = {}
    latest = {}
    for r, t, i, l, s, b, x in rows:
        if None in (r, t, i):
            continue
        if (r, t, i) not in latest or b > latest[r, t, i][1]:
            latest[r, t, i] = (l, b, s)
    seq = {}
    for (r, t, i), (l, _, s) in latest.items():
        seq.setdefault((r, t), []).append((i, l, s))
    for k, v in seq.items():
        v.sort()
        a = 0
        for j in range(1, len(v) + 1):
            if j == len(v) or v[j][1] != v[a][1] or v[j][1] is None:
                if v[a][1] is not None:
                    out[*k, v[a][0]] = (v[j - 1][0], j - a)
                a = j
    return out


@pytest.mark.parametrize("bits", [16, 3])
def test_random_sequences(spark, monkeypatch, bits):
    """Also with blocks of eight positions, so that runs go over many block edges."""
    monkeypatch.setattr(p5_runs, "BLOCK_BITS", bits)
    monkeypatch.setattr(p5_runs, "BATCH_ROWS", 20)
    rnd = random.Random(bits)
    rows = []
    for t in range(6):
        label = "a"
        for i in range(rnd.randint(0, 90)):
            if rnd.random() < 0.2:
                label = rnd.choice(["a", "b", None])
            if rnd.random() < 0.1:
                continue
            rows.append(("r", f"t{t}", i, label, float(i), 1, None))
            if rnd.random() < 0.1:
                rows.append(("r", f"t{t}", i, rnd.choice(["a", "b"]), float(i), 2, None))
    rows += [(None, "t", 1, "a", 0.0, 1, None), ("r", None, 1, "a", 0.0, 1, None), ("r", "t0", None, "a", 0.0, 1, None)]
    rnd.shuffle(rows)
    expected = collapse(rows)
    df = table(spark, rows)
    got = runs(df, ["run_id", "trace_id"], "token_index", "label", "scored_at", "ingest_batch").where("label is not null").collect()
    assert {(r.run_id, r.trace_id, r.first_position): (r.last_position, r.events) for r in got} == expected
    two = runs(df, ["run_id", "trace_id"], "token_index", "label", "scored_at", "ingest_batch", min_events=2).collect()
    assert {(r.run_id, r.trace_id, r.first_position): (r.last_position, r.events) for r in two} == {k: v for k, v in expected.items() if v[1] > 1}


def test_duration_gap_and_scores(spark):
    rows = [("r", "t", i, "a", s, 1, x) for i, s, x in ((1, 0.0, 0.1), (2, 1.0, 0.15), (3, 9.0, 0.12), (4, None, 0.9))]
    df = table(spark, rows)
    args = (df, ["run_id", "trace_id"], "token_index", "label", "scored_at", "ingest_batch")
    (r,) = runs(*args).collect()
    assert (r.first_position, r.last_position, r.duration_ms) == (1, 4, 9000.0)
    got = sorted((r.first_position, r.last_position, r.duration_ms) for r in runs(*args, max_gap_s=5.0).collect())
    assert got == [(1, 2, 1000.0), (3, 4, 0.0)]
    got = sorted((r.first_position, r.last_position) for r in runs(*args, score="score", least=0.9).collect())
    assert got == [(1, 3), (4, 4)]
    assert runs(df.limit(0), *args[1:]).count() == 0
    with pytest.raises(ValueError):
        runs(*args, min_events=0)


def test_most_similar_pair_goes_first():
    """0.0 0.3 0.4 0.8 with limit 0.6: 0.3 and 0.4 join first and take 0.0, 0.8 stays; from the left 0.0-0.3 would."""
    n = 4
    v = [0.0, 0.3, 0.4, 0.8]
    count = [1] * n
    kept = agglomerate([0] * n, list(range(n)), last := list(range(n)), count, [0] * n, [0] * n, v[:], v[:], 1.0, 0.6, float("inf"))
    assert [(a, last[a], count[a]) for a in kept] == [(0, 2, 3), (3, 3, 1)]
    kept = agglomerate([0, -1, -1, 0], list(range(n)), list(range(n)), [1] * n, [0] * n, [0] * n, None, None, 1.0, 1.0, float("inf"))
    assert kept == [0, 1, 2, 3]


def test_labels(spark):
    said = [" Safe", "UnSafe", "unsafe ", "Uncertain ", "controversial\n", "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, l string")
    assert [r.l for r in df.select("i", normal_label(df.l).alias("l")).orderBy("i").collect()] == ["safe", "unsafe", "unsafe", "controversial", "controversial", None, None]
