import json

import pytest

from bomspark import api
from bomspark.sinks import reports

BEFORE = {
    "bomFormat": "CycloneDX", "metadata": {"tools": [{"name": "scan", "version": "1"}]},
    "components": [{"bom-ref": "app", "name": "app", "purl": "pkg:npm/app@1", "version": "1"}, {"bom-ref": "a", "name": "a", "purl": "pkg:npm/a@1", "version": "1"}, {"bom-ref": "a2", "name": "a", "purl": "pkg:npm/a@2", "version": "2"}, {"bom-ref": "d", "name": "d", "purl": "pkg:npm/d@1", "version": "1"}, {"bom-ref": "d2", "name": "D-other", "purl": "pkg:npm/d@2", "version": "2"}],
    "dependencies": [{"ref": "app", "dependsOn": ["a2"]}],
}
AFTER = {
    "bomFormat": "CycloneDX", "metadata": {"tools": [{"name": "scan", "version": "2"}]},
    "components": [{"bom-ref": "app", "name": "app", "purl": "pkg:npm/app@1", "version": "1"}, {"bom-ref": "a", "name": "a", "purl": "pkg:npm/a@2", "version": "2"}, {"bom-ref": "a3", "name": "a", "purl": "pkg:npm/a@3", "version": "3"}, {"bom-ref": "b|x", "name": "b<x", "purl": "pkg:npm/b@1", "version": "1"}, {"bom-ref": "c", "name": "c", "purl": "pkg:npm/c@1", "version": "1"}],
    "dependencies": [{"ref": "app", "dependsOn": ["a3", "c"]}, {"ref": "a3", "dependsOn": ["b|x"]}, {"ref": "b|x", "dependsOn": ["c"]}],
}


@pytest.fixture(scope="module")
def report(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("docs")
    for name, doc in (("b", BEFORE), ("a", AFTER)):
        (folder / f"{name}.json").write_text(json.dumps(doc))
    return api.compare(api.load(spark, str(folder / "b.json")), api.load(spark, str(folder / "a.json")))


def test_json_holds_the_whole_body(report):
    got = json.loads("".join(reports.json_lines(report)))
    dup = got["duplicates"]
    assert [(g["id"], g["versions"]) for g in dup["before"]] == [("pkg:npm/a", ["1", "2"]), ("pkg:npm/d", ["1", "2"])] and [(g["id"], g["versions"]) for g in dup["after"]] == [("pkg:npm/a", ["2", "3"])]
    assert [(g["id"], g["status"], g.get("versions_added"), g.get("versions_removed")) for g in dup["version_diff"]] == [("pkg:npm/a", "kept", ["3"], ["1"]), ("pkg:npm/d", "resolved", None, None)]
    assert dup["collisions"] == [{"id": "pkg:npm/d", "reason": "name_mismatch", "components": ["d 1", "d-other 2"]}]
    deps = got["dependencies"]
    assert [(x["src_id"], x["targets"]) for x in deps["added_deps"]] == [("pkg:npm/a", ["pkg:npm/b"]), ("pkg:npm/app", ["pkg:npm/c"]), ("pkg:npm/b", ["pkg:npm/c"])] and deps["removed_deps"] == []
    assert deps["transitive_new"] == [{"root": "pkg:npm/app", "target": "pkg:npm/b", "depth": 2, "path": ["pkg:npm/app", "pkg:npm/a", "pkg:npm/b"]}] and deps["transitive_lost"] == [] and deps["depth_summary"] == [{"depth_1": 0, "depth_2": 1, "depth_3_plus": 0}]
    assert got["drift_summary"] == [{"version_drift": 1, "integrity_drift": 0, "metadata_drift": 0}] and {(r["type"], r["total"]) for r in got["added_by_type"]} == {("npm", 2)}
    assert {r["side"]: (r["with_dependencies"], r["total_dependencies"]) for r in got["overview"]} == {"before": (1, 1), "after": (3, 4)}
    assert got["context"]["after"]["tool_version"] == "2" and got["warnings"] == []


def test_readable_forms_hold_the_body(report, tmp_path):
    text = "".join(reports.markdown_lines(report))
    for line in ("| a | 1, 2 |", "| pkg:npm/a | kept | 3 | 1 |", "| name_mismatch | pkg:npm/d | d 1, d-other 2 |", "| pkg:npm/b | 2 | pkg:npm/app > pkg:npm/a > pkg:npm/b |", "| a | version: 1 -> 2 |", "| Tool | scan | scan |", "| Dependencies | 1 | 4 |"):
        assert line in text, line
    reports.write_report(report, "html", f"{tmp_path}/parts/")
    whole = "".join(p.read_text() for p in sorted((tmp_path / "parts").glob("part-*")))
    assert "<td>b&lt;x</td>" in whole and "<h2>Identity collisions</h2>" in whole and "<td>pkg:npm/app</td><td>pkg:npm/c</td>" in whole


def test_text_lists_ten_licences_and_html_fifteen(spark, tmp_path):
    doc = {"bomFormat": "CycloneDX", "components": [{"name": f"c{i}", "licenses": [{"license": {"id": f"L-{i:02}"}}]} for i in range(20)]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    s = api.summary(api.load(spark, str(tmp_path / "d.json")))
    text = [r.line for r in reports.report_frame(s, "text").collect()]
    at = next(i for i, line in enumerate(text) if line.startswith("Top licenses"))
    assert text[at + 10].strip() == "L-09  1" and text[at + 11].strip() == "...and more  10"
    assert "<td>L-14</td>" in "".join(reports.html_lines(s)) and "<td>L-15</td>" not in "".join(reports.html_lines(s))
    assert "Dependencies  0" in "\n".join(text)
