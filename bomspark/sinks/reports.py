"""Reports of a diff: result rows as frames, and their JSON, SARIF, JUnit, Markdown, HTML, text forms.

Every form is a list of pieces (``lines``): what grows with the inventory is a frame, rendered,
sorted and written by Spark; only heads and tables of fixed length are made by the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from html import escape as html_escape
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators.bundle import DependencyDiff
from ..operators.diff import DiffResult, samples_by_type
from ..operators.profile import scores_of, top
from .lines import Piece, Rows, document, quoted, rows, texts, write

# Fixed: rule ids and levels of the SARIF form.
RULES = {"integrity-drift": "error", "deep-dependency": "warning", "component-added": "note", "component-removed": "note", "version-change": "note", "policy-violation": "error"}
DEEP = 3


@dataclass(frozen=True)
class Body:
    """What a diff of two documents says beside added, removed and changed components."""

    duplicates_before: DataFrame
    duplicates_after: DataFrame
    duplicate_versions: DataFrame
    collisions: DataFrame
    dependencies: DependencyDiff
    facts: dict[str, dict]
    warnings: list[str]


@dataclass(frozen=True)
class Report:
    """All frames that a rendering needs; graph and policy parts may be missing."""

    diff: DiffResult
    violations: DataFrame | None = None
    transitive: DataFrame | None = None
    findings: DataFrame | None = None
    overview: DataFrame | None = None
    compliance: DataFrame | None = None
    body: Body | None = None


@dataclass(frozen=True)
class Summary:
    """All frames of a report on one document."""

    facts: dict
    findings: DataFrame
    stats: DataFrame
    types: DataFrame
    licenses: DataFrame
    duplicates: DataFrame
    compliance: DataFrame
    warnings: list[str]


# Fixed: facts named in the scan context, and labels of the coverage rows.
CONTEXT = {"tool_name": "Tool", "schema_version": "Schema", "search_scope": "Scan scope", "source_type": "Source type", "source_name": "Source", "os_pretty_name": "OS"}
CATEGORIES = ("permissive", "copyleft", "public_domain", "unknown")
# Fixed: how many licences a report lists, fewer in plain text.
LICENSES, TEXT_LICENSES = 15, 10
COVERAGE = {"with_purl": "PURL coverage", "with_licenses": "License coverage", "with_hashes": "Hash coverage", "with_cpes": "CPE coverage"}


DEPENDENCIES = {"with_dependencies": "With dependencies", "total_dependencies": "Dependencies"}


def fingerprint(kind: str, identity: Column) -> Column:
    digest = F.sha2(F.concat(F.lit(kind), F.char(F.lit(0)), identity), 256)
    return F.concat(F.substring(digest, 1, 32), F.lit(":1"))


def result_rows(report: Report) -> DataFrame:
    """ordinal, rule, level, identity, message, fingerprint: one row per SARIF result."""
    d = report.diff

    def results(df: DataFrame, ordinal: int, rule: str, identity: Column, message: Column, level: Column | None = None) -> DataFrame:
        level = F.lit(RULES[rule]) if level is None else level
        return df.select(F.lit(ordinal).alias("ordinal"), F.lit(rule).alias("rule"), level.alias("level"), identity.alias("identity"), message.alias("message"), fingerprint(rule, identity).alias("fingerprint"))

    version = lambda c: F.when(fn.text(c) != "", F.concat(F.lit(" "), c)).otherwise("")
    named = lambda purl: F.coalesce(*[F.nullif(c, F.lit("")) for c in (F.col("id"), purl)], F.col("name"))
    id_, changed_id = named(F.col("purl")), named(F.col("a.purl"))
    out = [results(d.changed.where("drift = 'integrity'"), 1, "integrity-drift", changed_id, F.concat("name", F.lit(": hash changed without version change")))]
    if report.transitive is not None:
        out.append(results(report.transitive.where(F.col("depth") >= DEEP), 2, "deep-dependency", F.col("target"), F.concat(F.lit("New transitive dependency "), "target", F.lit(" at depth "), F.col("depth").cast("string"))))
    out.append(results(d.added, 3, "component-added", id_, F.concat(F.lit("Added "), "name", version(F.col("version")))))
    out.append(results(d.removed, 4, "component-removed", id_, F.concat(F.lit("Removed "), "name", version(F.col("version")))))
    out.append(results(d.changed.where("b.version <> a.version"), 5, "version-change", changed_id, F.concat("name", F.lit(": "), "b.version", F.lit(" -> "), "a.version")))
    if report.violations is not None:
        out.append(results(report.violations, 6, "policy-violation", F.concat_ws("|", "rule", "message"), F.col("message"), F.col("severity")))
    return reduce(DataFrame.unionByName, out)


def patch_rows(diff: DiffResult) -> DataFrame:
    """op, path, value (JSON text): the JSON patch from the before to the after snapshot."""
    base = "/components/"
    add = diff.added.select(F.lit("add").alias("op"), F.concat(F.lit(base), F.col("ordinal").cast("string")).alias("path"), F.to_json(F.struct("id", "name", "version", "purl", "licenses", "hashes")).alias("value"))
    remove = diff.removed.select(F.lit("remove").alias("op"), F.concat(F.lit(base), "id").alias("path"), F.lit(None).cast("string").alias("value"))
    text = lambda c: F.get_json_object(F.to_json(F.struct(c.alias("v"))), "$.v")
    parts = [("version", F.col("b.version") != F.col("a.version"), quoted(F.col("a.version"))), ("licenses", F.col("b.licenses") != F.col("a.licenses"), text(F.col("a.licenses"))), ("hashes", F.array_sort(F.map_entries("b.hashes")) != F.array_sort(F.map_entries("a.hashes")), text(F.col("a.hashes")))]
    each = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(name).alias("name"), value.alias("value"))) for name, cond, value in parts]))
    replace = diff.changed.select("id", F.explode(each).alias("r")).select(F.lit("replace").alias("op"), F.concat(F.lit(base), "id", F.lit("/"), "r.name").alias("path"), F.col("r.value").alias("value"))
    return add.unionByName(remove).unionByName(replace)


def _replaced(c: Column, signs: dict[str, str]) -> Column:
    return reduce(lambda x, s: F.replace(x, F.lit(s), F.lit(signs[s])), signs, c)


# Fixed: signs that JSON inside HTML, HTML and attributes of XML write otherwise.
JSON_SIGNS = {"&": "\\u0026", "<": "\\u003c", ">": "\\u003e"}
HTML_SIGNS = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#x27;"}
ATTRIBUTE_SIGNS = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "\n": "&#10;", "\r": "&#13;", "\t": "&#9;"}


def _escaped(text: str) -> str:
    """JSON that can stand inside HTML."""
    return reduce(lambda x, s: x.replace(s, JSON_SIGNS[s]), JSON_SIGNS, text)


def _objects(name: str, df: DataFrame, *order: str) -> list[Piece]:
    """The rows of ``df`` as the member ``name`` of an object."""
    made = F.to_json(F.struct(*[c for c in df.columns if c != "raw"]))
    return [f'"{name}":[', rows(df, _replaced(made, JSON_SIGNS), *order, separator=","), "]"]


def _objects_of(parts: list[tuple[str, DataFrame, tuple[str, ...]]], first: bool = False) -> Iterator[Piece]:
    """Members one after the other; a comma stands before all but the ``first``."""
    for i, (name, frame, order) in enumerate(parts):
        if i or not first:
            yield ","
        yield from _objects(name, frame, *order)


def summary_json(summary: Summary) -> Iterator[Piece]:
    """Facts, findings, statistics, compliance and warnings of one document as one JSON object."""
    yield _escaped('{"info":' + json.dumps(summary.facts))
    for name, frame, order in (("findings", summary.findings, ("finding_ordinal",)), ("stats", summary.stats, ()), ("by_type", summary.types, ("key",)), ("by_license", summary.licenses, ("key",)), ("duplicates", summary.duplicates, ("id",)), ("compliance", summary.compliance, ("standard", "check"))):
        yield ","
        yield from _objects(name, frame, *order)
    yield _escaped(f',"warnings":{json.dumps(summary.warnings)}}}')


def report_json(report: Report) -> Iterator[Piece]:
    """Overview, findings, diff with its body, violations, compliance and warnings as one JSON object."""
    d = report.diff
    changed = d.changed.select("id", "name", "drift", F.col("b.version").alias("before"), F.col("a.version").alias("after"), fn.change_strings(*[F.col(f"{s}.{c}") for c in ("version", "licenses", "hashes") for s in ("b", "a")]).alias("changes"))
    parts = [(name, frame, order) for name, frame, order in (("overview", report.overview, ()), ("findings", report.findings, ("finding_ordinal",)), ("added", d.added, ("id",)), ("removed", d.removed, ("id",)), ("changed", changed, ("id",)), ("violations", report.violations, ("rule_ordinal", "message")), ("compliance", report.compliance, ("standard", "check"))) if frame is not None]
    yield "{"
    for i, (name, frame, order) in enumerate(parts):
        if i:
            yield ","
        yield from _objects(name, frame, *order)
    if report.body is not None:
        b = report.body
        yield from _objects_of([("drift_summary", d.drift_summary(), ()), ("added_by_type", samples_by_type(d.added), ("type", "rank")), ("removed_by_type", samples_by_type(d.removed), ("type", "rank"))])
        yield ',"duplicates":{'
        yield from _objects_of([("before", b.duplicates_before, ("id",)), ("after", b.duplicates_after, ("id",)), ("version_diff", b.duplicate_versions, ("id",)), ("collisions", b.collisions, ("id", "reason"))], first=True)
        yield '},"dependencies":{'
        n = b.dependencies
        yield from _objects_of([("added_deps", n.added, ("src_id",)), ("removed_deps", n.removed, ("src_id",)), ("transitive_new", n.transitive_new, ("target",)), ("transitive_lost", n.transitive_lost, ("target",)), ("depth_summary", n.summary(), ())], first=True)
        yield _escaped(f'}},"context":{json.dumps(b.facts)},"warnings":{json.dumps(b.warnings)}')
    yield "}"


def sarif(report: Report, tool: str = "bomspark") -> Iterator[Piece]:
    rules = [{"id": r, "defaultConfiguration": {"level": level}} for r, level in RULES.items()]
    yield '{"version":"2.1.0","runs":[{"tool":{"driver":' + json.dumps({"name": tool, "rules": rules}) + '},"results":['
    result = F.struct(F.col("rule").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints"))
    yield rows(result_rows(report), F.to_json(result), "ordinal", "identity", "message", separator=",")
    yield "]}]}"


def junit(report: Report) -> Iterator[Piece]:
    """Tests for integrity, deep dependencies, each violation, and a summary."""
    counts = report.diff.counts().first()
    deep = report.transitive.where(F.col("depth") >= DEEP).count() if report.transitive is not None else 0
    errors = report.violations.where("severity = 'error'").count() if report.violations is not None else 0
    total = 3 + (report.violations.count() if report.violations is not None else 0)
    case = lambda name, failure: f"<testcase name={quoteattr(name)} time=\"0\">" + (f"<failure message={quoteattr(failure)}/>" if failure else "") + "</testcase>"
    yield f'<?xml version="1.0" encoding="UTF-8"?><testsuite name="bomspark" tests="{total}" failures="{int(counts.integrity > 0) + int(deep > 0) + errors}">'
    yield case("integrity", f"{counts.integrity} components changed hash without version change" if counts.integrity else "")
    yield case("deep dependencies", f"{deep} new dependencies at depth {DEEP} or more" if deep else "")
    if report.violations is not None:
        message = _replaced(F.col("message"), ATTRIBUTE_SIGNS)
        failure = F.when(F.col("severity") == "error", F.concat(F.lit('<failure message="'), message, F.lit('"/>'))).otherwise("")
        yield rows(report.violations, F.concat(F.lit('<testcase name="policy: '), "rule", F.lit(": "), message, F.lit('" time="0">'), failure, F.lit("</testcase>")), "rule_ordinal", "message")
    yield case(f"summary: {counts.added} added, {counts.removed} removed, {counts.changed} changed", "") + "</testsuite>"


def patch(report: Report) -> Iterator[Piece]:
    """Operations in the order add, remove, replace, each by path."""
    value = F.coalesce(F.concat(F.lit(',"value":'), "value"), F.lit(""))
    made = F.concat(F.regexp_replace(F.to_json(F.struct("op", "path")), r"\}$", ""), value, F.lit("}"))
    yield "["
    yield rows(patch_rows(report.diff), _replaced(made, JSON_SIGNS), "op", "path", separator=",")
    yield "]"


@dataclass(frozen=True)
class Section:
    """A table of a readable report: the first columns of ``frame``, as many as heads, in order."""

    title: str
    heads: list[str]
    frame: DataFrame
    order: tuple[str, ...]


def _small(spark: SparkSession, title: str, heads: list[str], values: list[tuple]) -> Section:
    """A table of fixed length, made by the driver, in the order given."""
    names = [f"c{i}" for i in range(len(heads))]
    made = [(*[str(v) for v in row], i) for i, row in enumerate(values)]
    return Section(title, heads, spark.createDataFrame(made, ", ".join([f"{c} string" for c in names] + ["position long"])).coalesce(1), ("position",))


def _compliance(checked: DataFrame) -> Iterator[Section]:
    scores = scores_of(checked).select("standard", "score", F.format_string("%d/%d", "passed", "total").alias("checks")).orderBy("standard").collect()  # a row a standard
    overall = [("overall", sum(r.score for r in scores) // len(scores), "")] if scores else []
    yield _small(checked.sparkSession, "Compliance", ["Standard", "Score", "Checks passed"], [*map(tuple, scores), *overall])
    yield Section("Compliance checks", ["Check", "Passed", "Detail"], checked.select("check", F.when(F.col("passed"), "yes").otherwise("no").alias("passed"), "detail"), ("check",))


def _coverage() -> list[Column]:
    """The rows of coverage of a profile as texts."""
    return [fn.percent_text(F.col("total") - F.col("without_license") if c == "with_licenses" else F.col(c), F.col("total")).alias(c) for c in COVERAGE]


def _overview(overview: DataFrame) -> Section:
    """Both sides beside each other: totals and coverage."""
    sides = {r.side: r for r in overview.select("side", F.col("total").cast("string").alias("total"), *_coverage(), *[F.col(c).cast("string").alias(c) for c in DEPENDENCIES if c in overview.columns]).collect()}  # two rows
    value = lambda side, c: sides[side][c] if side in sides else "0"
    counted = {c: label for c, label in DEPENDENCIES.items() if c in overview.columns}
    return _small(overview.sparkSession, "Overview", ["", "Before", "After"], [(label, value("before", c), value("after", c)) for c, label in ({"total": "Packages"} | COVERAGE | counted).items()])


def _summary_sections(s: Summary, licenses: int) -> Iterator[Section]:
    spark = s.stats.sparkSession
    yield _small(spark, "Scan context", ["Field", "Value"], [(label, s.facts[k]) for k, label in CONTEXT.items() if s.facts.get(k)])
    yield Section("Key findings", ["Finding"], s.findings.select("message", "finding_ordinal"), ("finding_ordinal",))
    counted = {c: label for c, label in DEPENDENCIES.items() if c in s.stats.columns}
    stats = s.stats.select("total", *_coverage(), *counted, *[f"lic_{c}" for c in CATEGORIES]).first()
    yield _small(spark, "Statistics", ["Measure", "Value"], [(label, stats[c]) for c, label in ({"total": "Components"} | COVERAGE | counted).items()])
    yield Section("By package type", ["Type", "Count"], s.types.select("key", "count"), ("key",))
    kinds = s.licenses.count()
    first = top(s.licenses, licenses).select("key", "count").orderBy(F.desc("count"), "key").collect()  # few rows
    more = [("...and more", kinds - licenses)] if kinds > licenses else []
    yield _small(spark, "Top licenses", ["License", "Count"], [*map(tuple, first), *more])
    yield _small(spark, "License categories", ["Category", "Count"], [(c, stats[f"lic_{c}"]) for c in CATEGORIES])
    yield Section("Duplicates", ["Name", "Versions"], s.duplicates.select("name", F.array_join("versions", ", ").alias("versions")), ("name", "versions"))
    yield from _compliance(s.compliance)
    yield _small(spark, "Warnings", ["Message"], [(w,) for w in s.warnings])


def _body_sections(d: DiffResult, b: Body) -> Iterator[Section]:
    """Changes in full, duplicates, collisions, dependencies and warnings of a diff."""
    listed = lambda c: F.array_join(c, ", ")
    said = d.changed.select("name", F.posexplode(fn.change_strings(*[F.col(f"{s}.{c}") for c in ("version", "licenses", "hashes") for s in ("b", "a")])).alias("at", "change"), "id")
    yield Section("Changes", ["Name", "Change"], said.select("name", "change", "id", "at"), ("name", "id", "at"))
    for side, frame in (("first", b.duplicates_before), ("second", b.duplicates_after)):
        yield Section(f"Duplicates in {side} document", ["Name", "Versions"], frame.select("name", listed("versions").alias("versions"), "id"), ("name", "id"))
    yield Section("Duplicate groups that differ", ["Id", "Status", "Versions added", "Versions removed"], b.duplicate_versions.select("id", "status", listed("versions_added").alias("plus"), listed("versions_removed").alias("minus")), ("id",))
    yield Section("Identity collisions", ["Reason", "Id", "Components"], b.collisions.select("reason", "id", listed("components").alias("components")), ("id", "reason"))
    n = b.dependencies
    for title, frame in (("Added dependencies", n.added), ("Removed dependencies", n.removed)):
        yield Section(title, ["Component", "Dependencies"], frame.select("src_id", listed("targets").alias("targets")), ("src_id",))
    yield Section("New transitive dependencies", ["Target", "Depth", "Via"], n.transitive_new.select("target", "depth", F.array_join("path", " > ").alias("via")), ("target",))
    yield Section("Removed transitive dependencies", ["Target", "Depth"], n.transitive_lost.select("target", "depth"), ("target",))
    yield Section("New dependencies by depth", ["1 (direct)", "2", "3+"], n.summary(), ())
    spark, of = d.rows.sparkSession, lambda side, k: b.facts.get(side, {}).get(k) or "(none)"
    yield _small(spark, "Scan context", ["Field", "Before", "After"], [(label, of("before", k), of("after", k)) for k, label in CONTEXT.items() if any(f.get(k) for f in b.facts.values())])
    yield _small(spark, "Warnings", ["Message"], [(w,) for w in b.warnings])


def _sections(report: Report | Summary, licenses: int = LICENSES) -> Iterator[Section]:
    """The tables of a readable report."""
    if isinstance(report, Summary):
        yield from _summary_sections(report, licenses)
        return
    d = report.diff
    if report.overview is not None:
        yield _overview(report.overview)
    yield Section("Summary", ["Added", "Removed", "Changed", "Integrity"], d.counts().select("added", "removed", "changed", "integrity"), ())
    yield Section("Drift", ["Version", "Integrity", "Metadata"], d.drift_summary().select("version_drift", "integrity_drift", "metadata_drift"), ())
    if report.findings is not None:
        yield Section("Key findings", ["Finding"], report.findings.select("message", "finding_ordinal"), ("finding_ordinal",))
    for title, side in (("Added", d.added), ("Removed", d.removed)):
        yield Section(f"{title} by type, first five of each", ["Type", "Total", "Id", "Rank"], samples_by_type(side).select("type", "total", "id", "rank"), ("type", "rank"))
        yield Section(title, ["Name", "Version"], side.select("name", "version"), ("name", "version"))
    yield Section("Changed", ["Name", "Before", "After", "Drift"], d.changed.select("name", F.col("b.version").alias("before"), F.col("a.version").alias("after"), "drift"), ("name", "before"))
    if report.body is not None:
        yield from _body_sections(d, report.body)
    if report.violations is not None:
        yield Section("Policy", ["Severity", "Rule", "Message"], report.violations.select("severity", "rule", "message"), ("rule", "message"))
    if report.compliance is not None:
        yield from _compliance(report.compliance)


def _table(s: Section, cell: Callable[[Column], Column], begin: str, between: str, end: str) -> Rows:
    """Each row as one line of cells."""
    cells = [cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in s.frame.columns[: len(s.heads)]]
    return rows(s.frame, F.concat(F.lit(begin), F.concat_ws(between, *cells), F.lit(end)), *s.order)


def markdown(report: Report | Summary) -> Iterator[Piece]:
    for s in _sections(report):
        yield f"## {s.title}\n\n| {' | '.join(s.heads)} |\n|{'---|' * len(s.heads)}"
        yield _table(s, lambda c: _replaced(c, {"|": "\\|", "\n": " "}), "| ", " | ", " |")
        yield ""


def html(report: Report | Summary) -> Iterator[Piece]:
    yield '<!DOCTYPE html><html><head><meta charset="utf-8"><title>Inventory report</title></head><body>'
    for s in _sections(report):
        yield f"<h2>{html_escape(s.title)}</h2><table><tr>{''.join(f'<th>{h}</th>' for h in s.heads)}</tr>"
        yield _table(s, lambda c: _replaced(c, HTML_SIGNS), "<tr><td>", "</td><td>", "</td></tr>")
        yield "</table>"
    yield "</body></html>"


def text(report: Report | Summary) -> Iterator[Piece]:
    for s in _sections(report, TEXT_LICENSES):
        yield f"{s.title} ({', '.join(s.heads).lower()})"
        yield _table(s, lambda c: c, "  ", "  ", "")


FORMATS = {"json": report_json, "sarif": sarif, "junit": junit, "markdown": markdown, "md": markdown, "html": html, "text": text, "patch": patch}

SUMMARY_FORMATS = {"json": summary_json, "markdown": markdown, "md": markdown, "html": html, "text": text}


def report_frame(report: Report | Summary, form: str) -> DataFrame:
    """line: the report in a form, sorted."""
    spark = (report.stats if isinstance(report, Summary) else report.diff.rows).sparkSession
    return document(spark, list((SUMMARY_FORMATS if isinstance(report, Summary) else FORMATS)[form](report)))


def json_lines(report: Report | Summary) -> Iterator[str]:
    return texts(report_frame(report, "json"))


def sarif_lines(report: Report) -> Iterator[str]:
    return texts(report_frame(report, "sarif"))


def junit_lines(report: Report) -> Iterator[str]:
    return texts(report_frame(report, "junit"))


def patch_lines(report: Report) -> Iterator[str]:
    return texts(report_frame(report, "patch"))


def markdown_lines(report: Report | Summary) -> Iterator[str]:
    return texts(report_frame(report, "markdown"))


def html_lines(report: Report | Summary) -> Iterator[str]:
    return texts(report_frame(report, "html"))


def write_report(report: Report | Summary, form: str, path: str) -> None:
    """To one local file, or to a folder of part files if ``path`` ends with a slash."""
    write(report_frame(report, form), path)
