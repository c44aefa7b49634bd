import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from bomspark import api
from bomspark.explorer import Explorer
from bomspark.operators import files, listing
from bomspark.operators.bundle import Bundle
from bomspark.operators.search_index import SearchIndex
from bomspark.queries import QUERIES, Snapshots
from bomspark.sinks import lines
from bomspark.sources import archives

SF = "/root/testdata/sf0.001"

SYFT = {
    "artifacts": [
        {"id": "a1", "name": "  Big-Name ", "version": " 1.0", "type": "npm", "purl": "pkg:npm/big@1.0", "licenses": [{"value": "NOASSERTION"}, {"value": " mit"}], "locations": [{"path": "/app/package.json"}, {"path": "/app/extra"}]},
        {"id": "a2", "name": "lib", "version": "2", "type": "deb", "purl": "pkg:deb/lib@2", "locations": [{"path": "/usr/lib/lib.so"}]},
        {"id": "a3", "name": "lib", "version": "3", "type": "deb", "purl": "pkg:deb/lib@3", "locations": []},
        {"id": "a4", "name": "plain", "version": "1", "type": "binary"},
    ],
    "files": [
        {"id": "f1", "location": {"path": "/usr/lib/lib.so", "layerID": "l1"}, "metadata": {"mode": 644, "type": "RegularFile", "mimeType": "x/so", "size": 10}},
        {"id": "f2", "location": {"path": "/usr/share/doc", "layerID": "l2"}},
        {"id": "f2", "location": {"path": "/usr/share/doc2", "layerID": "l2"}, "metadata": {"size": 5}},
        {"id": "f3", "location": {"path": ""}},
    ],
    "artifactRelationships": [
        {"parent": "a2", "child": "f1", "type": "contains"}, {"parent": "a2", "child": "f1", "type": "evident-by"}, {"parent": "a3", "child": "f2", "type": "evident-by"}, {"parent": "a4", "child": "f1", "type": "evident-by"},
        {"parent": "nobody", "child": "f1", "type": "contains"}, {"parent": "a2", "child": "f9", "type": "contains"}, {"parent": "a1", "child": "a2", "type": "dependency-of"}, {"parent": "a2", "child": "a3", "type": "dependency-of"}, {"parent": "a2", "child": "a4", "type": "dependency-of"},
    ],
    "source": {"type": "directory", "target": "/x"}, "descriptor": {"name": "syft", "version": "1"},
}


@pytest.fixture(scope="module")
def explorer(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("doc") / "syft.json"
    path.write_text(json.dumps(SYFT))
    return Explorer(api.load(spark, str(path)))


def test_documents_are_normalised_when_loaded(explorer):
    row = explorer.document.components.where("ordinal = 0").first()
    assert (row.id, row.name, row.version, row.licenses) == ("pkg:npm/big", "big-name", "1.0", ["MIT"])


def test_relations_of_a_document(explorer):
    related = explorer.document.relations
    assert sorted((r.ordinal, r.path, r.relation) for r in related.collect()) == [(1, "/usr/lib/lib.so", "contains"), (1, "/usr/lib/lib.so", "evident-by"), (2, "/usr/share/doc2", "evident-by"), (3, "/usr/lib/lib.so", "evident-by")]
    assert sorted((r.path, r.ordinal, r.relation) for r in explorer.owners.collect()) == [("/app/extra", 0, "location"), ("/app/package.json", 0, "location"), ("/usr/lib/lib.so", 1, "contains"), ("/usr/lib/lib.so", 3, "evident-by"), ("/usr/share/doc2", 2, "evident-by")]
    file, comps = explorer.file("/usr/lib/lib.so")
    assert (file.first().size, file.first().mode, [(r.name, r.relation) for r in comps.collect()]) == (10, 644, [("lib", "contains"), ("plain", "evident-by")])


def test_explorer_calls(explorer):
    counts = explorer.statistics()["counts"].first()
    assert (counts.total, counts.with_dependencies, counts.total_dependencies, counts.files_count, counts.purl_percent, counts.license_percent) == (4, 2, 3, 5, 75.0, 25.0)
    assert [r.name for r in explorer.search("LIB").collect()] == ["lib", "lib"] and explorer.search("no such text").count() == 0
    found = explorer.component("pkg:deb/lib").collect()  # the last of two
    assert [(r.version, r.dependencies, r.files) for r in found] == [("3", [], 1)] and explorer.component("nothing").count() == 0
    tree, alone = explorer.tree().collect()
    assert alone.tree.name == "plain" and alone.tree.children == []
    assert tree.tree.id == "pkg:npm/big" and tree.tree.children_ids == ["pkg:deb/lib"] and tree.tree.children[0].version == "3" and not tree.tree.children[0].has_children
    entries, total = explorer.browse("/usr")
    assert total == 2 and [(r.name, r.is_dir, r.children) for r in entries.collect()] == [("lib", True, 1), ("share", True, 2)]
    entries, total = explorer.browse("/usr/share", offset=1, limit=1)
    assert total == 2 and [(r.name, r.size) for r in entries.collect()] == [("doc2", 5)]
    assert [r.path for r in explorer.browse(query="*.so")[0].collect()] == ["/usr/lib/lib.so"] and explorer.browse(layer="l2")[1] == 2
    assert [r.path for r in explorer.browse(component="pkg:npm/big", query="EXTRA")[0].collect()] == ["/app/extra"] and explorer.browse(component="x")[1] == 0
    assert {r.key: r.value for r in explorer.file_statistics().where("metric = 'unowned'").collect()} == {"": 1}
    assert [(r.layer, r.files) for r in explorer.layers().collect()] == [("l1", 1), ("l2", 2)]
    rows = explorer.listing().collect()
    assert [(r.title, r.description) for r in rows[::3]] == [("big-name 1.0", "Type: npm"), ("plain 1", "")] and [r.title for r in explorer.listing("bgn").collect()] == ["big-name 1.0"]


def test_a_later_component_of_an_id_without_dependencies_has_none(spark, tmp_path):
    doc = {"bomFormat": "CycloneDX", "components": [{"bom-ref": "r1", "name": "a", "purl": "pkg:npm/a@1"}, {"bom-ref": "rb", "name": "b", "purl": "pkg:npm/b@1"}, {"bom-ref": "r2", "name": "a", "purl": "pkg:npm/a@2"}, {"bom-ref": "rc", "name": "c"}], "dependencies": [{"ref": "r1", "dependsOn": ["rb"]}, {"ref": "rb", "dependsOn": ["rc"]}]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    loaded = api.load(spark, str(tmp_path / "d.json"))
    assert [(r.src_id, r.dst_id) for r in loaded.edges.collect()] == [("pkg:npm/b", "ref:rc")]
    other = json.loads(json.dumps(doc))
    other["components"][0], other["components"][2] = other["components"][2], other["components"][0]
    (tmp_path / "e.json").write_text(json.dumps(other))
    again = api.load(spark, str(tmp_path / "e.json"))
    both = Bundle.build({"before": (loaded.components, loaded.edges), "after": (again.components, again.edges)})
    diff = both.diff()
    assert [(r.src_id, r.targets) for r in diff.added.collect()] == [("pkg:npm/a", ["pkg:npm/b"])] and diff.removed.isEmpty() and not diff.is_empty()
    assert [(r.root, r.target, r.path) for r in diff.transitive_new.collect()] == [("pkg:npm/a", "ref:rc", ["pkg:npm/a", "pkg:npm/b", "ref:rc"])] and diff.summary().first().depth_2 == 1
    assert Bundle.build({"before": (loaded.components, loaded.edges), "after": (loaded.components, loaded.edges)}).diff().is_empty()


def test_trees_of_cycles_hubs_and_unknown_dependencies(spark, monkeypatch):
    monkeypatch.setattr("bomspark.operators.bundle.PIECE", 2)
    comps = spark.createDataFrame([(x, i, x.upper(), "1", "") for i, x in enumerate("abc")], "id string, ordinal long, name string, version string, purl string")
    edges = spark.createDataFrame([("a", "b", 0), ("b", "c", 0), ("c", "a", 0), ("a", "gone", 1), ("a", "c", 2)], "src_id string, dst_id string, adj_ordinal long")
    got = {(r.tree.id, r.page): r for r in Bundle.build({"": (comps, edges)}).tree("", comps).collect()}
    assert set(got) == {("a", 0), ("a", 1), ("b", 0), ("c", 0)}  # all are in a cycle; a comes in two pages
    assert got["a", 0].tree.children_ids == ["b", "gone", "c"] and [c.id for c in got["a", 0].tree.children] == ["b"] and [c.id for c in got["a", 1].tree.children] == ["c"]
    assert [(g.id, g.has_children) for g in got["b", 0].tree.children[0].children] == [("a", True)] and got["a", 0].total_children == 3


def test_directories_of_files_and_folders_mixed(spark):
    paths = ["/b/x.txt", "/b/c/y", "/a", "/a/z", "top", "rel/deep/file", "/b/x.txt", ""] + [f"/many/f{i:03}" for i in range(25)]
    index = files.directory_index(spark.createDataFrame([(p,) for p in paths], "path string"))
    at = lambda folder, *page: [(r.name, r.is_dir, r.children) for r in files.directory_page(index, folder, *page).orderBy("position").collect()]
    assert at("/") == [("a", True, 1), ("b", True, 2), ("many", True, 25), ("rel", True, 1), ("top", False, 0)]
    assert at("/b") == [("c", True, 1), ("x.txt", False, 0)] and at("rel") == [("deep", True, 1)]
    assert [n for n, _, _ in at("/many", 10, 10)] == [f"f{i:03}" for i in range(10, 20)] and len(at("/many", 20, 10)) == 5 and at("/many", 25, 10) == []
    assert files.directory_index(spark.createDataFrame([], "path string")).count() == 0


def scan_metric(df):
    """Bytes of the files that the scans of an executed plan read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    todo, total = [leaves.apply(i) for i in range(leaves.size())], 0
    while todo:
        node = todo.pop()
        if "QueryStage" in node.nodeName() or "ReusedExchange" in node.nodeName():
            inner = (node.plan() if "QueryStage" in node.nodeName() else node.child()).collectLeaves()
            todo += [inner.apply(i) for i in range(inner.size())]
        elif node.metrics().contains("filesSize"):
            total += node.metrics().apply("filesSize").value()
    return total


def test_the_index_answers_as_the_scan_and_reads_less(spark):
    from bomspark.operators.explore import search

    s = Snapshots(spark, SF)
    comps = s.after.withColumn("raw", F.concat(F.lit('{"N":"'), "name", F.lit('"}')))
    index = SearchIndex.build(comps)
    rnd = random.Random(1)
    texts = [r.purl for r in comps.select("purl").limit(30).collect()]
    queries = ["a", "-", "np", "mit", "GPL-3.0", "no such component", '"n":"', "%2e"] + [t[i : i + n] for n in (1, 2, 3, 4, 9, 20) for t in [rnd.choice(texts)] for i in [rnd.randrange(0, 8)]]
    for q in queries:
        want = sorted(r.ordinal for r in search(comps, q).collect())
        got = index.search(spark, q)
        assert [r.ordinal for r in got.collect()] == want, q
        assert set(got.columns) == {*comps.columns, "position"}
    whole = scan_metric(spark.read.parquet(f"{index.folder}/postings").select("gram", "position"))
    read = scan_metric(spark.read.parquet(f"{index.folder}/postings").where("bucket = 3").select("gram", "position"))
    assert 0 < read < whole / 10


def brute_score(text, pattern):
    text_l, n = text.lower(), len(text)
    p, best, at, last, run, score = 0, -1, -1, -1, 0, 0
    for j in range(n):
        if p < len(pattern) and text_l[j] == pattern[p].lower():
            worth = 10 if j == 0 else 0
            if j and text[j - 1].islower() and text[j].isupper():
                worth += 20
            if j and text[j - 1] in "/-_ .\\":
                worth += 20
            if last >= 0:
                bonus = run * 2 + 5 if last == j - 1 else 0
                worth, run = worth + bonus, run + bonus
            if worth > best:
                best, at = worth, j
        if at >= 0 and (j == n - 1 or (p + 1 < len(pattern) and text_l[j + 1] == pattern[p + 1].lower())):
            score += best + (max(at * -5, -15) if last < 0 else 0)
            p, last, best, at = p + 1, at, -1, -1
    return score - (n - len(pattern)) if p == len(pattern) else None


def test_list_filter_against_a_plain_scorer(spark):
    s = Snapshots(spark, SF)
    rows = s.after.select("ordinal", listing.filter_value(F.col("name"), F.col("purl"), F.col("licenses")).alias("t")).collect()
    for pattern in ("npmit", "Lib", "a-1", "zzzzzz", "pkg:", "g0"):
        want = sorted(((brute_score(r.t, pattern), r.ordinal) for r in rows if brute_score(r.t, pattern) is not None), key=lambda x: (-x[0], x[1]))
        assert [(r.score, r.ordinal) for r in listing.ranked(s.after, pattern).collect()] == want
    odd = ["", "fooBarBaz", "foo_bar", "FOO/bar", "a", "aaaa", "fb", "éaÉb"]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    for pattern in ("fb", "a", "aa", "bar", "é", "foobarbaz!"):
        assert {r.t: r.s for r in df.select("t", listing.subsequence_score(F.col("t"), pattern).alias("s")).collect()} == {t: brute_score(t, pattern) for t in odd}
    assert QUERIES["flt_list_ranked"](spark, SF).count() > 0


@pytest.mark.parametrize("most", [900_000, 60_000, 5_000])
def test_bounded_texts_are_cut_exactly(spark, most, tmp_path):
    texts = [f"line {i} " + "x" * (i * 7919 % 90) for i in range(2500)] + ["y" * 40_000, "end"]
    whole = "\n".join(texts) + "\n"
    made = lines.document(spark, [lines.rows(spark.createDataFrame(list(enumerate(texts)), "n int, t string").repartition(7), F.col("t"), "n")])
    cut = lines.bounded(made, most)
    cut.write.text(str(tmp_path / "parts"))
    got = [line for p in sorted((tmp_path / "parts").glob("part-*")) for line in p.read_text().splitlines()]
    assert got == [r.line for r in cut.collect()]
    if len(whole) - 1 <= most:
        assert got == texts
    else:
        body = "\n".join(got[:-3])
        assert (body + "\n")[:most] == whole[:most] and len(body) <= most and got[-3:] == ["", f"_{len(texts) - whole[:most].count(chr(10)) - (whole[most] == chr(10))} lines are cut or left out._", lines.CUT]


def packed(*entries, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, text in entries:
            z.writestr(name, text)
    return out.getvalue()


def test_archive_entries(spark, tmp_path):
    doc = json.dumps({"bomFormat": "CycloneDX", "components": [{"name": "x", "purl": "pkg:npm/x@1"}]})
    (tmp_path / "a.zip").write_bytes(packed(("other", "no"), ("out/sbom.json", doc)))
    (tmp_path / "b.zip").write_bytes(packed(("./out/sbom.json", doc), method=zipfile.ZIP_STORED))
    got = archives.read_archives(spark, str(tmp_path), "out/sbom.json").collect()
    assert len(got) == 2 and {r.text for r in got} == {doc}
    good = packed(("sbom.json", doc * 50), method=zipfile.ZIP_STORED)
    assert archives.entry(good, "./sbom.json").decode() == doc * 50
    broken = bytearray(good)
    broken[good.index(b"CycloneDX")] ^= 1
    link = zipfile.ZipInfo("sbom.json")
    link.external_attr = 0o120777 << 16
    for bad, path in ((bytes(broken), "sbom.json"), (good, "missing.json"), (good[: len(good) // 2], "sbom.json"), (packed(("a", "1"), ("./a", "2")), "a"), (packed((link, "x")), "sbom.json"), (packed(("../a", "1")), "a"), (good, "../sbom.json"), (b"", "a")):
        with pytest.raises(archives.ArchiveError):
            archives.entry(bad, path)
    with pytest.raises(archives.ArchiveError):
        archives.entry(good, "sbom.json", most=100)


def test_the_newest_run_with_the_artifact(spark):
    runs = spark.createDataFrame([(9, 0, "failure", "main", "push"), (8, 1, "success", "dev", "push"), (7, 2, "success", "main", "pull_request"), (6, 3, "success", "main", "push"), (5, 4, "success", "main", "schedule"), (4, 5, "success", "main", "push")], "run_id long, place int, conclusion string, head_branch string, event string")
    held = spark.createDataFrame([(9, 1, "sbom", False), (7, 2, "sbom", False), (6, 3, "sbom", True), (6, 4, "logs", False), (5, 5, "sbom", False), (5, 6, "sbom", True), (4, 7, "sbom", False), (4, 8, "sbom", False)], "run_id long, artifact_id long, name string, expired boolean")
    pick = lambda r, name="sbom": [tuple(x) for x in archives.newest_artifact(r, held, "main", name).collect()]
    assert pick(runs) == [(5, 5)] and pick(runs, "logs") == [(6, 4)] and pick(runs, "none") == []
    with pytest.raises(Exception, match="several artifacts"):
        pick(runs.where("run_id = 4"))


def test_the_list_filter_takes_a_text_apart_once(spark):
    df = spark.createDataFrame([("lib/" * 400 + "npm it",)], "t string")
    plan = df.select(listing.subsequence_score(F.col("t"), "npmit").alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    odd = ["n\np\nm i\tt", "NPMIT", "npmi", "tnpmi", "nppmmiitt", "%n_p.m]i[t", "npKit", "nİpmit", "", "ΣnpmitΣ", "n" * 50 + "pmit"]
    df = spark.createDataFrame(list(enumerate(odd)), "ordinal int, name string").withColumns({"purl": F.lit(""), "licenses": F.array().cast("array<string>")})
    for pattern in ("npmit", "k", "]", "^i", "%", "σn", "it"):
        want = {i: brute_score(t + "  ", pattern) for i, t in enumerate(odd) if "İ" not in t}  # lower-cased to two characters by Python
        got = {r.ordinal: r.score for r in listing.ranked(df, pattern).collect() if r.ordinal in want}
        assert got == {i: s for i, s in want.items() if s is not None}, pattern


def test_postings_are_lists_and_whole(spark):
    s = Snapshots(spark, SF)
    index = SearchIndex.build(s.after.unionByName(s.after.limit(1).withColumns({"name": F.lit("Straße 😀"), "ordinal": F.lit(10**6)})))
    want = {(t[i : i + n], r.position) for r in spark.read.parquet(f"{index.folder}/rows").collect() for t in [r.search_text] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    rows = spark.read.parquet(f"{index.folder}/postings").collect()
    got = [(r.gram, p) for r in rows for p in r.position]
    assert len(got) == len(want) and set(got) == want and len(rows) < len(want) / 10
    assert [r.ordinal for r in index.search(spark, "😀").collect()] == [10**6] == [r.ordinal for r in index.search(spark, "ße 😀").collect()]
