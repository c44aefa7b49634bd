import json

import pytest

from bomspark import api
from bomspark.__main__ import main
from bomspark.sinks import reports
from bomspark.streaming.monitor import monitor

OLD = {"bomFormat": "CycloneDX", "components": [{"name": "a", "version": "1", "purl": "pkg:npm/a@1"}, {"name": "b", "version": "1"}]}
NEW = {"bomFormat": "CycloneDX", "components": [{"name": "a", "version": "2", "purl": "pkg:npm/a@2"}, {"name": "c", "version": "1"}]}


@pytest.fixture
def paths(tmp_path):
    for name, doc in (("old", OLD), ("new", NEW), ("bad", {"x": 1})):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    (tmp_path / "policy.json").write_text(json.dumps({"max_added": 5, "warn_new_transitive": True, "unknown": 1}))
    return {n: str(tmp_path / f"{n}.json") for n in ("old", "new", "bad", "policy", "out")}


def test_diff_status_and_report(spark, paths):
    assert main(["diff", paths["old"], paths["new"], "-f", "json", "--policy", paths["policy"], "-o", paths["out"]], spark) == 1
    got = json.loads(open(paths["out"]).read())
    assert [c["id"] for c in got["added"]] == ["c"] and got["violations"] == [] and len(got["overview"]) == 2
    assert [f if isinstance(f, str) else f["message"] for f in got["findings"]] == ["1 version upgrades (1 major) among 1 shared packages"]
    assert main(["diff", paths["old"], paths["old"], "-o", paths["out"]], spark) == 0


def test_findings_of_one_document(spark, paths):
    _, found, _ = api.summarize(api.load(spark, paths["old"]))
    assert [r.message for r in found.collect()] == ["Top ecosystems: npm (1), unknown (1)", "License profile: 100% unknown", "Low license coverage: 0.0% (2 of 2 missing)", "Low hash coverage: 0.0% (2 of 2 missing)", "Low PURL coverage: 50.0% (1 of 2 missing)"]


def test_unknown_documents(spark, paths):
    document = api.load(spark, paths["bad"])
    assert document.components.isEmpty() and document.facts == {} and len(document.warnings) == 1
    with pytest.raises(ValueError, match="unknown SBOM format"):
        api.load(spark, paths["bad"], strict=True)


def test_monitor_compares_with_the_last_snapshot(spark, tmp_path):
    landing, folder = tmp_path / "in", tmp_path / "state"
    landing.mkdir()
    for name, doc in (("app@1.json", OLD), ("app@2.json", NEW)):
        (landing / name).write_text(json.dumps(doc))
        monitor(spark, str(landing), str(folder), once=True).awaitTermination()
    got = {(r.batch, r.inventory, r.id, r.status) for r in spark.read.parquet(f"{folder}/changes").collect()}
    assert got == {(0, "app", "pkg:npm/a", "added"), (0, "app", "b", "added"), (1, "app", "pkg:npm/a", "changed"), (1, "app", "b", "removed"), (1, "app", "c", "added")}


def test_report_on_one_document(spark, paths):
    doc = {"bomFormat": "CycloneDX", "metadata": {"tools": [{"name": "scan<er", "version": "1"}]}, "components": [*OLD["components"], {"name": "a", "version": "3", "purl": "pkg:npm/a@3", "licenses": [{"license": {"id": "MIT"}}]}]}
    open(paths["old"], "w").write(json.dumps(doc))
    open(paths["policy"], "w").write(json.dumps({"min_ntia_score": 100}))
    assert main(["stats", paths["old"], "-f", "json", "-o", paths["out"], "--policy", paths["policy"]], spark) == 1
    text = open(paths["out"]).read()
    got = json.loads(text)
    assert "<" not in text and got["info"]["tool_name"] == "scan<er" and got["stats"][0]["total"] == 3 and got["warnings"] == []
    assert got["by_license"] == [{"key": "MIT", "count": 1}] and got["duplicates"][0]["versions"] == ["1", "3"]
    checked = {c["check"]: (c["passed"], c["detail"]) for c in got["compliance"]}
    assert checked["ntia-version"] == (True, "All 3 components") and checked["cisa-license"] == (False, "1/3 components") and checked["cisa-tool"] == (True, "present")
    report = api.summary(api.load(spark, paths["old"]))
    lines = "".join(reports.html_lines(report))
    assert "<td>Tool</td><td>scan&lt;er</td>" in lines and "<td>License coverage</td><td>33.3%</td>" in lines and "<script" not in lines and "<td>overall</td>" in lines


def test_diff_report_has_overview_and_compliance(spark, paths):
    report = api.compare(api.load(spark, paths["old"]), api.load(spark, paths["new"]))
    text = "".join(reports.markdown_lines(report))
    assert "| Packages | 2 | 2 |" in text and "| PURL coverage | 50.0% | 50.0% |" in text and "| overall |" in text and "| cisa-hash | no | 0/2 components |" in text


def test_monitor_keeps_snapshots_of_untouched_inventories(spark, tmp_path):
    landing, folder = tmp_path / "in", tmp_path / "state"
    landing.mkdir()
    for name, doc in (("app@1.json", OLD), ("other@1.json", OLD), ("app@2.json", NEW)):
        (landing / name).write_text(json.dumps(doc))
        monitor(spark, str(landing), str(folder), once=True).awaitTermination()
    got = {(r.batch, r.inventory, r.id, r.status) for r in spark.read.parquet(f"{folder}/changes").where("batch > 0").collect()}
    assert got == {(1, "other", "pkg:npm/a", "added"), (1, "other", "b", "added"), (2, "app", "pkg:npm/a", "changed"), (2, "app", "b", "removed"), (2, "app", "c", "added")}
    assert {(r.batch, r.sbom_id) for r in spark.read.parquet(f"{folder}/versions").collect()} == {(0, "app"), (1, "other"), (2, "app")}
