"""Runs that end early and go on: what is done again, what is not, what is refused."""

import json
import os
import subprocess
import sys
import textwrap
from datetime import date
from pathlib import Path

import pytest

from tallyline.errors import RunInterrupted
from tallyline.plans import flow as flows
from tallyline.plans.flow import Flow

STEPS = [
    {"id": "S1", "type": "aggregate", "source_inputs": ["A"],
     "logic": {"group_by": ["k"], "aggregations": [{"field": "v", "operation": "sum", "alias": "v"}]}},
    {"id": "S2", "type": "sort", "source_inputs": ["S1"], "logic": {"keys": [{"column": "v", "direction": "desc"}]}},
    {"id": "S3", "type": "filter", "source_inputs": ["S2"], "logic": {"conditions": [{"field": "v", "operation": ">", "value": 20}]}},
    {"id": "S4", "type": "distinct", "source_inputs": ["S2"], "logic": {}},
]


def _config(tmp_path, steps=STEPS, **outputs):
    found = {"S3": {"format": "csv", "path": str(tmp_path / "out3")}, "S4": {"format": "parquet", "path": str(tmp_path / "out4")}}
    return {
        "Inputs": {"A": {"format": "parquet", "path": str(tmp_path / "a")}},
        "Transformations": {"steps": steps},
        "Outputs": outputs or found,
    }


@pytest.fixture
def rows(spark, tmp_path):
    spark.range(0, 1000, 1, 4).selectExpr("id % 10 as k", "id as v").write.parquet(str(tmp_path / "a"))
    return tmp_path


def _attempt(spark, monkeypatch, tmp_path, config, ends_at=None, **options):
    """Run; ends before a step. Returns the ids of the steps done, and the result if there is one."""
    done, real = [], flows.apply_step

    def watched(step, datasets, context):
        if step["id"] == ends_at:
            raise KeyboardInterrupt
        done.append(step["id"])
        return real(step, datasets, context)

    monkeypatch.setattr(flows, "apply_step", watched)
    try:
        Flow(spark, config, date(2026, 3, 5)).run(journal=str(tmp_path / "journal"), **options)
    except KeyboardInterrupt:
        pass
    finally:
        monkeypatch.setattr(flows, "apply_step", real)
    return done


def _journal(tmp_path):
    return [p for p in (tmp_path / "journal").glob("*/*") if not p.name.startswith(".")]


def test_goes_on_after_the_last_finished_step(spark, monkeypatch, rows):
    config = _config(rows)
    assert _attempt(spark, monkeypatch, rows, config, "S3") == ["S1", "S2"]
    assert {p.suffix for p in _journal(rows)} == {"", ".json"}
    assert _attempt(spark, monkeypatch, rows, config) == ["S3", "S4"]
    got = [r.v for r in spark.read.csv(str(rows / "out3"), header=True, inferSchema=True).collect()]
    assert len(got) == 10 and sorted(got) == [sum(range(k, 1000, 10)) for k in range(10)]
    assert spark.read.parquet(str(rows / "out4")).count() == 10
    assert _journal(rows) == []  # an ended run is forgotten, the next one starts anew
    assert _attempt(spark, monkeypatch, rows, config) == ["S1", "S2", "S3", "S4"]


def test_order_survives(spark, monkeypatch, rows):
    config = _config(rows)
    _attempt(spark, monkeypatch, rows, config, "S3")
    flow = Flow(spark, config, date(2026, 3, 5))
    made = flow.run(journal=str(rows / "journal"), keep=True)
    assert [r.v for r in made["S2"].collect()] == sorted((r.v for r in made["S1"].collect()), reverse=True)
    assert flow.context.ordered == {"S2", "S3"}
    assert [r.v for r in made["S3"].collect()] == [r.v for r in made["S2"].collect()]


def test_changed_inputs_or_description_start_anew(spark, monkeypatch, rows):
    config = _config(rows)
    _attempt(spark, monkeypatch, rows, config, "S3")
    other = json.loads(json.dumps(config))
    other["Transformations"]["steps"][0]["logic"]["aggregations"][0]["operation"] = "max"
    assert _attempt(spark, monkeypatch, rows, other, "S2") == ["S1"]
    spark.range(1).selectExpr("id as k", "id as v").write.mode("append").parquet(str(rows / "a"))
    assert _attempt(spark, monkeypatch, rows, config, "S3") == ["S1", "S2"]


def test_a_table_without_an_entry_is_not_read(spark, monkeypatch, rows):
    config = _config(rows)
    _attempt(spark, monkeypatch, rows, config, "S3")
    for entry in (rows / "journal").glob("*/step-0001.json"):
        entry.unlink()  # the table was written, the driver went away before it said so
    assert _attempt(spark, monkeypatch, rows, config) == ["S2", "S3", "S4"]


def test_written_outputs_stay(spark, monkeypatch, rows):
    config = _config(rows, S4={"format": "parquet", "path": str(rows / "added"), "write_mode": "append"},
                     S3={"format": "unheard of", "path": str(rows / "x")})
    for _ in range(2):
        with pytest.raises(Exception, match="unheard of"):
            _attempt(spark, monkeypatch, rows, config)
    assert spark.read.parquet(str(rows / "added")).count() == 10


def test_half_added_rows_are_not_added_again_unasked(spark, monkeypatch, rows):
    config = _config(rows, S4={"format": "parquet", "path": str(rows / "added"), "write_mode": "append"})
    finish = flows.Journal.finish
    monkeypatch.setattr(flows.Journal, "finish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    _attempt(spark, monkeypatch, rows, config)
    monkeypatch.setattr(flows.Journal, "finish", finish)
    with pytest.raises(RunInterrupted, match="S4"):
        _attempt(spark, monkeypatch, rows, config)
    assert spark.read.parquet(str(rows / "added")).count() == 10
    assert _attempt(spark, monkeypatch, rows, config, repeat=True) == ["S3"]
    assert spark.read.parquet(str(rows / "added")).count() == 20


def test_checked_rows_are_kept_and_not_added_twice(spark, monkeypatch, rows):
    check = {"id": "C", "type": "validate", "source_inputs": ["A"], "logic": {
        "fail_mode": "DROP", "abort_on_invalid": False, "validated_path": str(rows / "valid"),
        "rules": [{"field": "k", "data_type": "TEXT", "format": "REGEX", "pattern": "^[0-4]"}]}}
    after = {"id": "D", "type": "distinct", "source_inputs": ["C"], "logic": {}}
    config = _config(rows, [check, after], D={"format": "parquet", "path": str(rows / "out")})
    assert _attempt(spark, monkeypatch, rows, config, "D") == ["C"]
    assert _attempt(spark, monkeypatch, rows, config) == ["D"]
    assert spark.read.parquet(str(rows / "out")).count() == 500
    assert spark.read.parquet(str(rows / "valid")).count() == 500


def test_steps_without_shuffles_are_made_again_unless_kept(spark, monkeypatch, rows):
    narrow = [{**STEPS[2], "id": f"N{i}", "source_inputs": ["A"], "keep": keep} for i, keep in enumerate((True, False))]
    config = _config(rows, [*narrow, STEPS[0]], S1={"format": "parquet", "path": str(rows / "out")})
    assert _attempt(spark, monkeypatch, rows, config, "S1") == ["N0", "N1"]
    assert _attempt(spark, monkeypatch, rows, config) == ["N1", "S1"]


def test_a_column_of_no_type_is_not_kept(spark, monkeypatch, rows):
    empty = {"id": "E", "type": "withcolumn", "source_inputs": ["A"], "keep": True, "logic": {"column": "n", "expression": "null"}}
    config = _config(rows, [empty, STEPS[3] | {"source_inputs": ["E"]}], S4={"format": "json", "path": str(rows / "out")})
    assert _attempt(spark, monkeypatch, rows, config, "S4") == ["E"]
    assert _attempt(spark, monkeypatch, rows, config) == ["E", "S4"]
    assert spark.read.json(str(rows / "out")).count() == 1000


def test_a_driver_that_is_killed(spark, monkeypatch, rows):
    """Another process ends without cleaning up; this one goes on from its entries."""
    config = _config(rows)
    (rows / "flow.json").write_text(json.dumps(config))
    script = f"""
        import os
        from datetime import date
        from tallyline import build_session
        from tallyline.plans import flow as flows
        real = flows.apply_step
        flows.apply_step = lambda step, *rest: os._exit(9) if step["id"] == "S3" else real(step, *rest)
        spark = build_session("lost", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4"}})
        flows.Flow(spark, {str(rows / "flow.json")!r}, date(2026, 3, 5)).run(journal={str(rows / "journal")!r})
    """
    here = Path(flows.__file__).resolve().parents[2]
    ended = subprocess.run(
        [sys.executable, "-c", textwrap.dedent(script)], cwd=rows, env={**os.environ, "PYTHONPATH": str(here)},
        capture_output=True, timeout=120,
    )
    assert ended.returncode == 9, ended.stderr[-2000:]
    assert _attempt(spark, monkeypatch, rows, config) == ["S3", "S4"]
    assert spark.read.parquet(str(rows / "out4")).count() == 10
