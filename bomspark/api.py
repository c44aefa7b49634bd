"""Documents in, reports out: the calls behind the command line."""

from __future__ import annotations

import sys
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import findings, graph, headlines, profile, rules
from .operators.bundle import Bundle
from .operators.diff import collision_report, diff, duplicate_version_diff, duplicates
from .sinks.reports import Body, Report, Summary
from .sources import documents, info
from .tables import settle


@dataclass(frozen=True)
class Document:
    """One inventory document: its components, edges (the graph of ids), facts, parse warnings,
    dependencies of every component, listed files and their relations."""

    components: DataFrame
    edges: DataFrame
    facts: dict
    warnings: list[str]
    dependencies: DataFrame | None = None
    files: DataFrame | None = None
    relations: DataFrame | None = None


def load(spark: SparkSession, path: str, strict: bool = False) -> Document:
    """The document at ``path`` (``-``: standard input). One of no known dialect is an error if
    ``strict``, else empty with a warning."""
    raw = spark.createDataFrame([("-", sys.stdin.read())], "sbom_id string, text string") if path == "-" else documents.read_documents(spark, path)
    raw = settle(documents.detected(raw), "documents")
    warnings = [f"{r.file}: {r.message}" for r in documents.parse_warnings(raw).collect()]
    if strict and warnings:
        raise ValueError("; ".join(warnings))
    facts = info.document_info(raw).first()
    comps = settle(profile.normalize(info.with_declared(documents.components(raw), raw)), "components")
    known = facts.asDict() | {"relationship_counts": {r["key"]: r["count"] for r in info.relationship_counts(raw).toLocalIterator()}} if facts else {}
    listed = settle(info.files(raw), "files")
    related = settle(info.relations(raw, comps, listed), "relations")
    depends = settle(info.dependencies(raw, comps), "dependencies")
    return Document(comps, settle(graph.adjacency(comps, depends, "sbom_id").drop("src_ordinal"), "edges"), known, warnings, depends, listed, related)


def compare(before: Document, after: Document, policy: rules.Policy | None = None) -> Report:
    """The diff of two documents with findings, transitive changes and broken rules."""
    b, a, spark = before.components, after.components, after.components.sparkSession
    result = diff(b, a)
    result = replace(result, rows=settle(result.rows, "diff"))
    depends = Bundle.build({"before": (b, before.edges), "after": (a, after.edges)}).diff()
    new = depends.transitive_new
    checked = settle(profile.compliance(a, after.edges, after.facts), "checks")
    scores = profile.scores_of(checked)
    sides = b.withColumn("side", F.lit("before")).unionByName(a.withColumn("side", F.lit("after")))
    found = [findings.context(spark, before.facts, after.facts), headlines.surface(sides, before.facts, after.facts), headlines.ecosystems(b, a), findings.os_change(spark, before.facts, after.facts), headlines.version_changes(b, result), headlines.integrity(result)]
    found += [findings.dominant_path(rows, direction) for rows, direction in ((result.removed, "removed"), (result.added, "added"))]
    found += [headlines.change_hotspots(result), headlines.stable_types(b, a), headlines.license_shift(sides), headlines.cataloger_gaps(b, a)]
    overview = settle(_with_dependencies(profile.profile(sides, "side"), before, after), "overview")
    groups = [settle(duplicates(c).select("id", "name", "count", "versions"), "duplicates") for c in (b, a)]
    body = Body(*groups, settle(duplicate_version_diff(b, a), "versions"), settle(collision_report(b, a), "collisions"), depends, {"before": before.facts, "after": after.facts}, [*before.warnings, *after.warnings])
    violations = rules.evaluate(policy, result, a, new, scores) if policy else None
    return Report(result, violations, new, reduce(DataFrame.unionByName, found), overview, checked, body)


def _with_dependencies(overview: DataFrame, before: Document, after: Document) -> DataFrame:
    """The overview of both sides with with_dependencies and total_dependencies."""
    every = before.dependencies.withColumn("side", F.lit("before")).unionByName(after.dependencies.withColumn("side", F.lit("after")))
    return overview.join(profile.dependency_counts(every, "side"), "side", "left").na.fill(0)  # two rows


def failed(report: Report) -> bool:
    """Whether anything was added, removed or changed, or a rule of severity error is broken."""
    n = report.diff.counts().first()
    broken = report.violations is not None and not report.violations.where("severity = 'error'").isEmpty()
    return broken or n.added + n.removed + n.changed > 0


def summarize(document: Document) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The statistics, findings and framework scores of one document."""
    c, spark = document.components, document.components.sparkSession
    stats = profile.profile(c)
    pk, counts = profile.packages(c), [(k, n) for k, n in (document.facts.get("relationship_counts") or {}).items()]
    found = [findings.operating_system(spark, document.facts), headlines.dominant_type(pk), findings.files(spark, document.facts), findings.relationships(spark.createDataFrame(counts, "key string, count long")), headlines.hotspots(c)]
    found += [headlines.license_profile(pk), findings.quality(profile.profile(pk)), findings.duplicate_groups(c), headlines.top_catalogers(c)]
    return stats, reduce(DataFrame.unionByName, found).orderBy("finding_ordinal"), profile.framework_scores(c, document.edges, document.facts)


def summary(document: Document) -> Summary:
    """The report on one document: facts, findings, statistics, completeness and warnings."""
    stats, found, _ = summarize(document)
    c = document.components
    checked = settle(profile.compliance(c, document.edges, document.facts), "checks")
    return Summary(document.facts, settle(found, "findings"), settle(stats.crossJoin(profile.dependency_counts(document.dependencies)), "stats"), profile.by_type(c), settle(profile.by_license(c), "licenses"), duplicates(c), checked, document.warnings)
