import json

import pytest
import yaml

from assayer.cli import main
from assayer.errors import ConstructError, FixtureError, StaleInput
from assayer.operators import construct, freeze, provenance

STATED = {
    "version": 1, "stated_on": "2024-01-01", "owner": "o", "question": "q", "decision": "d", "target": {"name": "n", "definition": "d"}, "metric": {"name": "pr_auc", "reason": "r"},
    "tasks": [{"name": "t", "reason": "r"}], "reported_numbers": [{"name": "n", "decision": "d"}],
}


def project(folder):
    (folder / "construct.yaml").write_text(yaml.safe_dump(STATED))
    lines = ["id,phase,y,day"] + [f"N{i:04d},{'AB'[i % 2]},{int(i % 3 == 0)},2020-01-{i % 28 + 1:02d}" for i in range(300)]
    (folder / "t.csv").write_text("\n".join(lines) + "\n")
    raw = {"construct": "construct.yaml", "id_column": "id", "tasks": {"t": {"source": "t.csv", "type": "binary", "label_rule": {"column": "y"}, "cell_by": "phase"}}, "split": {"test": {"fraction": 0.2, "key": "v1"}, "validation": 0.2, "keys": ["k0", "k1"]}, "cutoffs": {"c": "2020-01-15"}, "arms": {"seen": {"cutoff": "c", "before": "day"}}}
    (folder / "spec.yaml").write_text(yaml.safe_dump(raw))
    return raw


def test_construct():
    assert construct.problems(STATED) == []
    assert len(construct.problems(STATED | {"version": True, "owner": "", "metric": {"name": "best"}, "odd": 1})) >= 4
    assert construct.problems(STATED | {"version": 2, "amendments": [{"version": 2, "date": "2024-02-02", "reason": "r"}]}) == []
    assert construct.problems(STATED | {"version": 2})
    with pytest.raises(ConstructError, match="there is no construct"):
        construct.load("/nowhere/construct.yaml")


def test_freeze_is_content_addressed(spark, tmp_path):
    raw = project(tmp_path)
    folder = freeze.freeze(spark, tmp_path / "spec.yaml", tmp_path / "out")
    assert freeze.freeze(spark, tmp_path / "spec.yaml", tmp_path / "out") == folder
    manifest, tables = freeze.load(spark, folder)
    assert manifest["digest"].startswith(folder.name) and tables["t"].count() == 300
    assert {r["cell"] for r in freeze.report(spark, folder).collect()} == {"t/A", "t/B"}
    text = (tmp_path / "t.csv").read_text()
    (tmp_path / "t.csv").write_text(text + "N0300,A,1,2020-01-01\n")
    with pytest.raises(StaleInput, match="freeze it again"):
        freeze.load(spark, folder)
    assert freeze.freeze(spark, tmp_path / "spec.yaml", tmp_path / "out") != folder
    (tmp_path / "t.csv").write_text(text)
    tables["t"].limit(10).write.mode("overwrite").parquet(str(tmp_path / "x"))
    spark.read.parquet(str(tmp_path / "x")).write.mode("overwrite").parquet(str(folder / "t.parquet"))
    with pytest.raises(StaleInput, match="is not what was frozen"):
        freeze.load(spark, folder)
    with pytest.raises(FixtureError, match="no frozen fixture"):
        freeze.load(spark, tmp_path / "none")
    raw["tasks"]["u"] = {"source": "t.csv", "type": "odd", "label_rule": "y"}
    raw["split"]["keys"] = ["k", "k"]
    found = " | ".join(freeze.spec_problems(raw, STATED))
    assert "not in the construct statement" in found and "must be {column}" in found and "distinct names" in found


def test_artifacts_go_stale(tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "in.txt").write_text("one")
    at = tmp_path / "out" / "a.json"
    provenance.write_artifact(at, {"v": "é"}, tmp_path, {"in": tmp_path / "in.txt"})
    assert provenance.read_artifact(at, tmp_path)["v"] == "é"
    (tmp_path / "a.py").write_bytes(b"x = 1\r\n")
    provenance.read_artifact(at, tmp_path)
    (tmp_path / "a.py").write_text("x = 2\n")
    with pytest.raises(StaleInput, match="other code wrote it"):
        provenance.read_artifact(at, tmp_path)
    (tmp_path / "in.txt").write_text("two")
    with pytest.raises(StaleInput, match="make it anew"):
        provenance.read_artifact(at)
    other = json.loads(at.read_text())
    other["_provenance"]["code_state"]["digest"] = "0"
    with pytest.raises(StaleInput, match="more than one state"):
        provenance.same_code([json.loads(at.read_text()), other])


def test_cli(spark, tmp_path, capsys):
    project(tmp_path)
    assert main(["construct", "check", str(tmp_path / "construct.yaml")]) == 0
    assert main(["construct", "check", str(tmp_path / "none.yaml")]) == 1 and "there is no construct" in capsys.readouterr().err
    assert main(["fixtures", "freeze", str(tmp_path / "spec.yaml"), "--out", str(tmp_path / "f")]) == 0
    (tmp_path / "questions.yaml").write_text(yaml.safe_dump({"grid": "g", "resolution": "r", "questions": [{"id": "Q1", "question": "q", "rule": "difference_clears_floor", "params": {"cell": "t/A", "a": "x", "b": "y"}}]}))
    log = ["--log", str(tmp_path / "c.jsonl")]
    own = ["--construct", str(tmp_path / "construct.yaml"), "--questions", str(tmp_path / "questions.yaml"), "--prediction", "effect", "--statement", "x is better", *log]
    assert main(["claims", "register", "C1", "--question", "Q1", *own]) == 0
    assert main(["claims", "register", "C1", "--question", "Q1", *own]) == 1
    assert main(["claims", "register", "C2", "--question", "Q9", *own]) == 1 and "no question 'Q9'" in capsys.readouterr().err
    assert main(["claims", "show", *log]) == 0 and "C1" in (said := capsys.readouterr().out) and "x is better" in said
