import json

import pytest

from tests.helpers import traces
from tidegate.operators import replay as R
from tidegate.plans import runs, scoring
from tidegate.sources import io
from tidegate.streaming.live import live_signals


def config(tmp_path, **experiment):
    return {"name": "m", "dataset": {"revision": "a"}, "model": {"guard": "scripted", "settings": {"labels": ["safe", "unsafe"], "fail_on": "!"}}, "experiment": {"output_dir": str(tmp_path / "run"), "modes": ["token"], "policies": ["conservative"], **experiment}}


def test_run_is_scored_once_and_replayed(spark, tmp_path):
    tr = traces(spark, [("a", "q", "abcd", "unsafe", 1, 2, 4), ("b", "q", "x!", "safe", 2, 3, 2)])
    c = config(tmp_path)
    got = {r.trace_id: r for r in runs.run_or_load(spark, c, tr)["intervention_results"].collect()}
    assert got["a"].signal_token == 2 and got["b"].error.startswith("RuntimeError") and got["b"].released_tokens == 0
    stamp = (tmp_path / "run/token_decisions/_SUCCESS").stat().st_mtime_ns
    again = config(tmp_path, trigger_count=2)
    assert runs.scoring_identity(c) == runs.scoring_identity(again)
    got = {r.trace_id: r for r in runs.run_or_load(spark, again, tr)["intervention_results"].collect()}
    assert got["a"].signal_token == 4
    assert (tmp_path / "run/token_decisions/_SUCCESS").stat().st_mtime_ns == stamp
    other = config(tmp_path)
    other["dataset"]["revision"] = "b"
    assert not runs.run_exists(str(tmp_path / "run"), other)


def test_load_needs_all_tables(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        runs.load_run(spark, str(tmp_path))


def test_scoring_errors_resume_and_asks(spark):
    tr = traces(spark, [("a", "q", "Hi. Next! tail", "safe", 14, 15, 14), ("b", "q", None, "safe", 0, 1, 0), ("c", "q", "好。好！", "safe", 4, 5, 4)])
    guard = scoring.ScriptedGuard(("unsafe",))
    rows = scoring.score_traces(tr, guard, scoring.sentence_asks).where("evaluated").collect()
    assert sorted((r.trace_id, r.token_index) for r in rows) == [("a", 3), ("a", 9), ("a", 14), ("c", 2), ("c", 4)]
    done = spark.createDataFrame([("a",)], "trace_id string")
    assert {r.trace_id for r in scoring.score_traces(tr, guard, done=done).collect()} == {"c"}
    with pytest.raises(ValueError):
        scoring.build("nobody")


def test_sources(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"Query": "q", "Response": "Café ☕", "Query_Label": "safe", "Response_Label": "safe", "Unsafe_Start_Index": 6, "Safe_Prefix": "Café ☕"}]), encoding="utf-8")
    df = io.read_source_json(spark, str(tmp_path / "s.json"))
    assert df.first().response == "Café ☕" and df.first().unsafe_start_index == 6
    io.write_csv(df, str(tmp_path / "c"))
    assert io.read_csv(spark, str(tmp_path / "c"), io.SOURCE).collect() == df.collect()
    m = io.manifest(df, "here", "1").first()
    assert m.rows == 1 and m.query_labels == {"safe": 1}
    assert len(io.file_hash(spark, str(tmp_path / "s.json")).first().sha256) == 64
    with pytest.raises(ValueError):
        io.write_json({"x": float("nan")}, str(tmp_path / "x.json"))
    nested = spark.createDataFrame([("a", [("a", 1, "unsafe")])], "trace_id string, decisions array<struct<trace_id:string, token_index:int, risk_label:string>>")
    io.write_trace_files(nested, str(tmp_path / "t"))
    assert io.token_rows(io.read_trace_files(spark, str(tmp_path / "t")), "r").first().token_index == 1
    (tmp_path / "old").mkdir()
    (tmp_path / "old/a.json").write_text('{"trace_id": "a", "schema_version": 1}')
    with pytest.raises(Exception, match="schema version"):
        io.read_trace_files(spark, str(tmp_path / "old")).collect()


def test_live_equals_batch(spark, tmp_path):
    rows = [("r", "t", i, x, True, False) for i, x in enumerate("safe unsafe safe unsafe unsafe safe unsafe".split(), 1)]
    schema = "run_id string, trace_id string, token_index int, label string, evaluated boolean, terminal boolean"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    rules = [R.Rule("conservative", "cumulative", 2), R.Rule("conservative", "consecutive", 2), R.Rule("conservative", "window", 2, 3), R.Rule("conservative", "buffer", 2)]
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = live_signals(stream, rules, "chunk_8").writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.rule, r.signal_token, r.released_tokens) for r in spark.table("live").collect()} == {(0, 4, 0), (1, 5, 0), (2, 4, 0), (3, 4, 0)}


def test_command_line(spark, tmp_path):
    from tidegate.plans import cli

    tr = traces(spark, [("a", "two words", "abcd", "unsafe", 1, 2, 4)])
    tr.write.parquet(str(tmp_path / "traces"))
    import yaml

    (tmp_path / "m.yaml").write_text(yaml.safe_dump({k: v for k, v in config(tmp_path).items() if k != "name"}))
    cli.main(["run", str(tmp_path / "m.yaml"), str(tmp_path / "traces")])
    cli.main(["reports", str(tmp_path / "run"), str(tmp_path / "reports")])
    spark.createDataFrame([("scripted", 100)], "model_id string, parameters_millions int").write.parquet(str(tmp_path / "models"))
    cli.main(["cost", str(tmp_path / "run"), str(tmp_path / "traces"), str(tmp_path / "models"), str(tmp_path / "cost")])
    assert spark.read.csv(str(tmp_path / "cost"), header=True).first().tokens == "4.0"
    assert spark.read.csv(str(tmp_path / "reports/response_policy_metrics"), header=True).first().tp == "1"
    assert runs.load_saved_runs(spark, str(tmp_path)).first().model == "m"


def test_prompts_resume_and_models(spark, tmp_path):
    """Prompts of failed traces have their error and no label; a run that stopped midway scores the rest only; models are told apart."""
    tr = traces(spark, [("a", "q", "abcd", "unsafe", 1, 2, 4), ("b", "q", "x!", "safe", 2, 3, 2)])
    c = config(tmp_path)
    got = runs.run_or_load(spark, c, tr)
    prompts = {r.trace_id: r for r in got["prompt_decisions"].collect()}
    assert prompts["a"].risk_label == "not_evaluated" and prompts["b"].risk_label is None and prompts["b"].error.startswith("RuntimeError")
    assert [r.trace_id for r in got["errors"].collect()] == ["b"]
    saved = json.loads((tmp_path / "run/metadata.json").read_text())
    assert runs.same_model(saved, c["model"]) and not runs.same_model(saved, c["model"] | {"threshold": 0.4})
    (tmp_path / "run/metadata.json").unlink()
    more = tr.unionByName(traces(spark, [("c", "q", "yz", "safe", 2, 3, 2)]))
    results = runs.run_or_load(spark, c, more)["intervention_results"]
    assert {r.trace_id for r in results.collect()} == {"a", "b", "c"}
    assert spark.read.parquet(str(tmp_path / "run/token_decisions")).groupBy("trace_id", "token_index").count().where("count > 1").count() == 0
