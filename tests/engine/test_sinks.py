import json
import xml.etree.ElementTree as ET

import pytest

from bomspark.operators.diff import diff
from bomspark.operators.rules import Policy, evaluate
from bomspark.sinks import convert, reports
from bomspark.sources import info
from bomspark.sources.documents import components

BEFORE = {"bomFormat": "CycloneDX", "components": [{"name": "a<b", "version": "1", "purl": "pkg:npm/a@1", "licenses": [{"license": {"id": "MIT"}}], "hashes": [{"alg": "SHA-256", "content": "x"}]}, {"name": "same", "version": "1", "bom-ref": "s", "hashes": [{"alg": "SHA-1", "content": "1"}]}, {"name": "gone", "version": "1"}]}
AFTER = {"bomFormat": "CycloneDX", "components": [{"name": "a<b", "version": "2", "purl": "pkg:npm/a@2", "licenses": [{"license": {"id": "MIT"}}], "hashes": [{"alg": "SHA-256", "content": "y"}]}, {"name": "same", "version": "1", "bom-ref": "s", "hashes": [{"alg": "SHA-1", "content": "2"}]}, {"name": "new", "version": "3", "bom-ref": "n", "cpe": "cpe:/a:v:p:1"}], "dependencies": [{"ref": "s", "dependsOn": ["n"]}]}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("b", json.dumps(BEFORE)), ("a", json.dumps(AFTER))], "sbom_id string, text string")


@pytest.fixture(scope="module")
def report(docs):
    comps = components(docs)
    after = comps.where("sbom_id = 'a'")
    d = diff(comps.where("sbom_id = 'b'"), after)
    return reports.Report(d, evaluate(Policy(max_added=0, deny_integrity_drift=True, require_licenses=True), d, after))


def test_json_is_escaped_and_whole(report):
    text = "".join(reports.json_lines(report))
    assert "<" not in text and "\\u003c" in text
    got = json.loads(text)
    assert [c["name"] for c in got["added"]] == ["new"] and [c["name"] for c in got["removed"]] == ["gone"]
    assert {c["name"]: c["drift"] for c in got["changed"]} == {"a<b": "version", "same": "integrity"}
    assert {v["rule"] for v in got["violations"]} == {"deny_integrity_drift", "require_licenses"}


def test_sarif_order_and_fingerprints(report):
    results = json.loads("".join(reports.sarif_lines(report)))["runs"][0]["results"]
    assert [r["ruleId"] for r in results] == ["integrity-drift", "component-added", "component-removed", "version-change", "policy-violation", "policy-violation"]
    assert all(len(r["partialFingerprints"]["primary"]) == 34 for r in results)


def test_junit_counts_failures(report):
    suite = ET.fromstring("".join(reports.junit_lines(report)))
    assert suite.get("tests") == "5" and suite.get("failures") == str(len(suite.findall("testcase/failure"))) == "3"


def test_patch(report):
    got = json.loads("".join(reports.patch_lines(report)))
    assert [(o["op"], o["path"]) for o in got] == [("add", "/components/2"), ("remove", "/components/gone"), ("replace", "/components/pkg:npm/a/hashes"), ("replace", "/components/pkg:npm/a/version"), ("replace", "/components/ref:s/hashes")]
    assert got[3]["value"] == "2" and got[2]["value"] == {"SHA-256": "y"} and got[0]["value"]["name"] == "new"


def test_readable_forms(report, tmp_path):
    for form in ("markdown", "html", "text"):
        reports.write_report(report, form, str(tmp_path / form))
    assert "<td>a&lt;b</td>" in (tmp_path / "html").read_text()
    assert "| a<b | 1 | 2 | version |" in (tmp_path / "markdown").read_text()
    assert "  new  3\n" in (tmp_path / "text").read_text()


@pytest.mark.parametrize("target", ["cdx", "spdx", "syft"])
def test_converted_documents_read_back(spark, docs, tmp_path, target):
    after = docs.where("sbom_id = 'a'")
    comps, path = components(after), tmp_path / "out.json"
    convert.write_document(comps, info.edges(after), target, str(path), {"os_name": "alpine", "tool_name": "t"})
    again = spark.createDataFrame([("x", path.read_text())], "sbom_id string, text string")
    back = components(again).collect()
    assert sorted((r.name, r.version, r.purl, tuple(r.licenses)) for r in back) == sorted((r.name, r.version, r.purl, tuple(r.licenses)) for r in comps.collect())
    if target != "syft":  # that form holds no hashes
        assert {r.name: list(r.hashes.values()) for r in back} == {"a<b": ["y"], "same": ["2"], "new": []}
    names = {r.id: r.name for r in back}
    assert [(names[r.src_id], names[r.dst_id]) for r in info.edges(again).collect()] == [("same", "new")]


def test_export_one_component(docs):
    comps = components(docs)
    assert json.loads(convert.export_component(comps, "ref:s"))["name"] == "same" and convert.export_component(comps, "none") == ""


def _parts(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part-*")))


def test_part_files_in_order_are_the_document(spark, tmp_path):
    """Hubs, ties and many partitions: parts by name, one after the other, are one document."""
    n = 500
    doc = {"bomFormat": "CycloneDX", "components": [{"name": f"c{i}", "version": "1", "bom-ref": f"r{i}"} for i in range(n)] + [{"name": "c1", "version": "1", "bom-ref": "r1"}], "dependencies": [{"ref": "r0", "dependsOn": [f"r{i}" for i in range(n - 1, 0, -1)]}, {"ref": "r7", "dependsOn": ["r8", "gone"]}]}
    one = spark.createDataFrame([("x", json.dumps(doc))], "sbom_id string, text string")
    comps, edges = components(one).repartition(16), info.edges(one)
    convert.write_document(comps, edges, "cdx", f"{tmp_path}/cdx/")
    assert len(list((tmp_path / "cdx").glob("part-*"))) >= 1
    got = json.loads(_parts(tmp_path / "cdx"))
    assert [c["name"] for c in got["components"]] == [c["name"] for c in doc["components"]] and got["serialNumber"].startswith("urn:uuid:")
    assert got["dependencies"] == [{"ref": "r0", "dependsOn": [f"r{i}" for i in range(n - 1, 0, -1)]}, {"ref": "r7", "dependsOn": ["r8"]}]
    convert.write_document(comps, edges, "spdx", f"{tmp_path}/spdx/")
    relations = json.loads(_parts(tmp_path / "spdx"))["relationships"]
    assert [r["relationshipType"] for r in relations] == ["DESCRIBES"] * (n + 1) + ["DEPENDS_ON"] * n


def test_documents_without_components(spark, tmp_path):
    none = spark.createDataFrame([("x", json.dumps({"bomFormat": "CycloneDX"}))], "sbom_id string, text string")
    for target in ("cdx", "spdx", "syft"):
        convert.write_document(components(none), info.edges(none), target, str(tmp_path / target))
        assert {type(v) for k, v in json.loads((tmp_path / target).read_text()).items() if k in ("components", "dependencies", "packages", "relationships", "artifacts")} == {list}
    empty = reports.Report(diff(components(none), components(none)))
    assert json.loads("".join(reports.json_lines(empty))) == {"added": [], "removed": [], "changed": []} and json.loads("".join(reports.patch_lines(empty))) == []


def test_report_parts_and_escapes(spark, report, tmp_path):
    reports.write_report(report, "html", f"{tmp_path}/html/")
    assert _parts(tmp_path / "html") == "".join(reports.html_lines(report))
    odd = spark.createDataFrame([("error", "r", 'a"<&\n\'b', 1)], "severity string, rule string, message string, rule_ordinal int")
    suite = ET.fromstring("".join(reports.junit_lines(reports.Report(report.diff, odd))))
    assert suite.find("testcase/failure[@message]") is not None and [c.get("name") for c in suite.iter("testcase")][2] == 'policy: r: a"<&\n\'b'
