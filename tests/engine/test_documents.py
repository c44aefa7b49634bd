import json

from bomspark.operators import files
from bomspark.operators.diff import diff
from bomspark.sources import info
from bomspark.sources.documents import components, parse_warnings, read_documents

CDX = {"bomFormat": "CycloneDX", "components": [{"type": "library", "name": "Lib", "version": "1", "purl": "pkg:npm/lib@1", "licenses": [{"license": {"id": "MIT"}}, {"expression": "A OR B"}, {"license": {"name": "x"}}], "hashes": [{"alg": "SHA-256", "content": "a"}, {"alg": "SHA-256", "content": "b"}], "publisher": "P"}, {"name": "two", "bom-ref": "r2", "cpe": "cpe:/a:v:p:1"}]}
SPDX = {"spdxVersion": "SPDX-2.3", "packages": [{"SPDXID": "SPDXRef-a", "name": "a", "versionInfo": "2", "licenseConcluded": "NOASSERTION", "licenseDeclared": "MIT", "supplier": "Organization: O", "externalRefs": [{"referenceType": "purl", "referenceLocator": "pkg:deb/debian/a@2"}]}, {"SPDXID": "SPDXRef-b", "name": "b", "checksums": [{"algorithm": "SHA1", "checksumValue": "c"}]}]}
SYFT = {"artifacts": [{"id": "1", "name": "s", "version": "3", "type": "apk", "foundBy": "f", "licenses": [{"value": "MIT"}], "locations": [{"path": "/lib/s"}, {"path": ""}], "cpes": [{"cpe": "cpe:2.3:a:v:s:3:*"}]}], "descriptor": None}


def test_three_dialects_become_one_relation(spark, tmp_path):
    for name, doc in {"c": CDX, "p": SPDX, "s": SYFT, "bad": {"x": 1}, "empty": {"bomFormat": "CycloneDX"}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    (tmp_path / "text.json").write_text("not json {")
    docs = read_documents(spark, str(tmp_path))
    got = {r.name: r for r in components(docs).collect()}
    assert {k: r.id for k, r in got.items()} == {"Lib": "pkg:npm/lib", "two": "cpe:v:p", "a": "pkg:deb/a", "b": "ref:b", "s": "cpe:v:s"}
    assert got["Lib"].licenses == ["MIT", "A OR B"] and got["Lib"].hashes == {"SHA-256": "b"} and got["Lib"].supplier == "P"
    assert got["a"].licenses == ["MIT"] and got["a"].supplier == "O" and got["b"].hashes == {"SHA1": "c"}
    assert got["s"].locations == ["/lib/s"] and got["s"].found_by == "f" and got["two"].ordinal == 1
    assert {r.file.rpartition("/")[2] for r in parse_warnings(docs).collect()} == {"bad.json", "text.json"}


def test_diff_of_two_documents(spark):
    after = json.loads(json.dumps(CDX))
    after["components"][0] |= {"version": "2", "purl": "pkg:npm/lib@2"}
    after["components"][1] = {"name": "three"}
    docs = spark.createDataFrame([("b", json.dumps(CDX)), ("a", json.dumps(after))], "sbom_id string, text string")
    comps = components(docs)
    got = {r.id: (r.status, r.drift) for r in diff(comps.where("sbom_id = 'b'"), comps.where("sbom_id = 'a'")).rows.collect()}
    assert got == {"pkg:npm/lib": ("changed", "version"), "cpe:v:p": ("removed", None), "three": ("added", None)}


XML = """<?xml version="1.0"?>
<bom xmlns="http://cyclonedx.org/schema/bom/1.5"><metadata><timestamp>T</timestamp><tools><tool><name>t</name><version>9</version></tool></tools><component type="operating-system"><name>os</name><version>1</version></component><properties><property name="image:tag">img</property></properties></metadata>
<components><component type="library" bom-ref="x"><group>g</group><name>lib</name><version>1</version><hashes><hash alg="SHA-1">aa</hash></hashes><licenses><license><id>MIT</id></license></licenses><purl>pkg:npm/lib@1</purl></component><component type="library" bom-ref="y"><name>dep</name></component></components>
<dependencies><dependency ref="x"><dependency ref="y"/><dependency ref="gone"/></dependency></dependencies></bom>"""


def frame(spark, **docs):
    return spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in docs.items()], "sbom_id string, text string")


def test_xml_document(spark):
    docs = frame(spark, x="\ufeff " + XML, other="<bom xmlns='urn:other'/>")
    got = {r.id: r for r in components(docs).collect()}
    assert set(got) == {"pkg:npm/lib", "ref:y"} and got["pkg:npm/lib"].hashes == {"SHA-1": "aa"} and got["pkg:npm/lib"].licenses == ["MIT"]
    assert [(r.src_id, r.dst_id) for r in info.edges(docs).collect()] == [("pkg:npm/lib", "ref:y")]
    fact = info.document_info(docs).collect()
    assert [(f.sbom_id, f.tool_name, f.tool_version, f.os_name, f.source_name, f.sbom_timestamp) for f in fact] == [("x", "t", "9", "os", "img", "T")]
    assert [r.file for r in parse_warnings(docs).collect()] == ["other"]


def test_syft_hashes_skips_edges_and_facts(spark):
    art = lambda i, kind, md: {"id": i, "name": i, "version": "1", "metadataType": kind, "metadata": md}
    doc = {
        "artifacts": [art("j", "java-archive", {"digest": [{"algorithm": "sha1", "value": "a"}, {"algorithm": "md5", "value": "b"}]}), "junk", {"id": "n", "name": 5}, art("l", "javascript-npm-package-lock-entry", {"integrity": "sha512-x-y"}), art("r", "rpm-db-entry", {"files": [{"digest": {}}, {"digest": {"algorithm": "sha256", "value": "c"}}, {"digest": {"algorithm": "md5", "value": "d"}}], "maintainer": " M "})],
        "artifactRelationships": [{"parent": "j", "child": "l", "type": "dependency-of"}, {"parent": "j", "child": "f", "type": "contains"}],
        "files": [{"location": {"path": "/a", "layerID": "L"}, "metadata": {"size": 3, "type": "RegularFile"}, "digests": [{"algorithm": "sha256", "value": "d"}, {"algorithm": "md5", "value": ""}, None]}, {"location": {"path": ""}}],
        "source": {"id": "s", "type": "image", "target": {"userInput": "alpine"}}, "distro": [{"id": "alpine", "prettyName": "A"}], "descriptor": {"name": "scan", "version": "2", "configuration": {"search": {"scope": "Squashed"}}}, "schema": {"version": "16"},
    }
    docs = frame(spark, s=doc)
    got = {r.id: r for r in components(docs).collect()}
    assert {k: r.hashes for k, r in got.items()} == {"j": {"SHA1": "a", "MD5": "b"}, "l": {"SHA512": "x-y"}, "r": {"SHA256": "c"}}
    assert got["r"].supplier == "M"
    assert [(r.src_id, r.dst_id) for r in info.edges(docs).collect()] == [("j", "l")]
    f = info.document_info(docs).first()
    assert (f.os_name, f.os_pretty_name, f.source_name, f.search_scope, f.schema_version, f.files_count) == ("alpine", "A", "alpine", "Squashed", "16", 2)
    assert {r.key: r["count"] for r in info.relationship_counts(docs).collect()} == {"dependency-of": 1, "contains": 1}
    assert [(r.path, r.layer, r.size) for r in info.files(docs).collect()] == [("/a", "L", 3)]
    listed = {r.path: [tuple(d) for d in r.digests] for r in files.catalogue(info.files(docs), components(docs)).collect()}
    assert listed["/a"] == [("sha256", "d")] and all(not d for path, d in listed.items() if path != "/a")


def test_json_facts_and_edges(spark):
    cdx = CDX | {"metadata": {"authors": [{"name": ""}, {"name": "me"}], "tools": {"components": [{"name": "t", "version": "3"}]}, "component": {"type": "application", "name": "app"}}, "dependencies": [{"ref": "r2", "dependsOn": ["r2", "none"]}]}
    old = CDX | {"metadata": {"supplier": {"name": "S"}, "tools": [{"name": "u", "version": "4"}]}}
    spdx = SPDX | {"creationInfo": {"created": "now", "creators": ["Organization: O", "Tool: x-1.2"]}, "relationships": [{"spdxElementId": "SPDXRef-a", "relatedSpdxElement": "SPDXRef-b", "relationshipType": "DEPENDENCY_OF"}, {"spdxElementId": "SPDXRef-a", "relatedSpdxElement": "NONE", "relationshipType": "DEPENDS_ON"}]}
    docs = frame(spark, c=cdx, o=old, p=spdx)
    got = {r.sbom_id: (r.tool_name, r.tool_version, r.sbom_author, r.source_name) for r in info.document_info(docs).collect()}
    assert got == {"c": ("t", "3", "me", "app"), "o": ("u", "4", "S", ""), "p": ("x", "1.2", "O", "")}
    assert {(r.sbom_id, r.src_id, r.dst_id) for r in info.edges(docs).collect()} == {("c", "cpe:v:p", "cpe:v:p"), ("p", "ref:b", "pkg:deb/a")}


def test_declared_leaves_count_as_covered(spark):
    from bomspark.operators.profile import checks

    parts = [{"name": n, "bom-ref": n, "version": "1"} for n in "abc"]
    cdx = {"bomFormat": "CycloneDX", "components": parts, "dependencies": [{"ref": "a", "dependsOn": []}, {"ref": "b"}, {"ref": "gone"}]}
    packages = [{"SPDXID": f"SPDXRef-{n}", "name": n} for n in "abcd"]
    relations = [("a", "DEPENDS_ON", "NONE"), ("b", "DEPENDS_ON", "NOASSERTION"), ("c", "CONTAINS", "NONE")]
    spdx = {"spdxVersion": "SPDX-2.3", "packages": packages, "relationships": [{"spdxElementId": f"SPDXRef-{a}", "relationshipType": r, "relatedSpdxElement": b} for a, r, b in relations]}
    docs = frame(spark, c=cdx, p=spdx, x=XML, s=SYFT)
    flagged = info.with_declared(components(docs), docs)
    assert flagged.columns == [*components(docs).columns, "deps_declared"] and flagged.count() == components(docs).count()
    got = {(r.sbom_id, r.name) for r in flagged.where("deps_declared").collect()}
    assert got == {("c", "a"), ("c", "b"), ("p", "a"), ("x", "lib")}
    passed = lambda rows: {r.check: r.passed for r in checks(rows, info.edges(docs).limit(0), {}, "ntia").collect()}["ntia-dep-relation"]
    assert passed(flagged.where("sbom_id = 'c' AND name <> 'c'")) and not passed(flagged.where("sbom_id = 'c'"))
    assert not passed(components(docs).where("sbom_id = 'c' AND name <> 'c'"))


def test_raw_text_is_kept_searched_and_exported(spark):
    from bomspark.operators.explore import search
    from bomspark.sinks.convert import export_component

    cdx = {"bomFormat": "CycloneDX", "components": [{"name": "a", "x-note": "Needle <1>"}, 7, None, {"name": "b", "version": "1"}]}
    comps = components(frame(spark, c=cdx, x=XML, p=SPDX, s=SYFT)).cache()
    rows = comps.collect()
    assert {(r.sbom_id, r.raw != "") for r in rows} == {("c", True), ("s", True), ("x", False), ("p", False)}
    assert [(r.ordinal, json.loads(r.raw)) for r in rows if r.sbom_id == "c"] == [(0, cdx["components"][0]), (3, cdx["components"][3])]
    assert [r.name for r in search(comps, "needle <1>").collect()] == ["a"]
    assert json.loads(export_component(comps, "a")) == cdx["components"][0]
    assert json.loads(export_component(comps, "pkg:npm/lib"))["name"] == "lib"
