"""``python -m bomspark stats|diff|convert``: exit status 1 if a diff is not empty or a rule is broken."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from . import api
from .operators.profile import scores_of
from .operators.rules import Policy, evaluate_scores
from .sinks import convert, reports


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("bomspark")
    top.add_argument("--strict", action="store_true")
    commands = top.add_subparsers(dest="command", required=True)
    stats = commands.add_parser("stats")
    stats.add_argument("document")
    stats.add_argument("-f", "--format", choices=sorted(reports.SUMMARY_FORMATS), default="text")
    stats.add_argument("--policy")
    diff = commands.add_parser("diff")
    diff.add_argument("before")
    diff.add_argument("after")
    diff.add_argument("-f", "--format", choices=sorted(reports.FORMATS), default="text")
    diff.add_argument("--policy")
    conv = commands.add_parser("convert")
    conv.add_argument("document")
    conv.add_argument("--to", choices=sorted(convert.ALIASES), required=True)
    for command in (stats, diff, conv):
        command.add_argument("-o", "--output", default="/dev/stdout")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("bomspark").getOrCreate()
    if args.command == "diff":
        policy = Policy.load(Path(args.policy).read_text()) if args.policy else None
        report = api.compare(api.load(spark, args.before, args.strict), api.load(spark, args.after, args.strict), policy)
        reports.write_report(report, args.format, args.output)
        return int(api.failed(report))
    document = api.load(spark, args.document, args.strict)
    if args.command == "convert":
        convert.write_document(document.components, document.edges, args.to, args.output, document.facts)
    else:
        report = api.summary(document)
        reports.write_report(report, args.format, args.output)
        policy = Policy.load(Path(args.policy).read_text()) if args.policy else None
        broken = evaluate_scores(policy, scores_of(report.compliance)) if policy else None
    for warning in document.warnings:
        print(warning, file=sys.stderr)
    violations = list(broken.toLocalIterator()) if args.command == "stats" and broken is not None else []  # one row a framework at most
    for v in violations:
        print(f"{v.severity}: {v.message}", file=sys.stderr)
    return int(bool(violations))


if __name__ == "__main__":
    sys.exit(main())
