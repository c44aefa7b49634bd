"""Policy rules and key findings as small frames of violations and messages."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .diff import DiffResult, duplicates


@dataclass(frozen=True)
class Policy:
    """The knobs of a policy; a limit of 0 is off."""

    max_added: int = 0
    max_removed: int = 0
    max_changed: int = 0
    max_depth: int = 0
    deny_licenses: tuple[str, ...] = ()
    require_licenses: bool = False
    deny_duplicates: bool = False
    deny_integrity_drift: bool = False
    warn_supplier_change: bool = False
    warn_new_transitive: bool = False
    min_ntia_score: int = 0
    min_cisa_score: int = 0
    min_bsi_score: int = 0
    min_overall_compliance: int = 0

    @classmethod
    def load(cls, text: str) -> Policy:
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(text).items() if k in known})


def _row(df: DataFrame, ordinal: int, rule: str, message: Column, severity: str = "error") -> DataFrame:
    return df.select(F.lit(ordinal).alias("rule_ordinal"), F.lit(rule).alias("rule"), message.alias("message"), F.lit(severity).alias("severity"))


def evaluate(policy: Policy, result: DiffResult, after: DataFrame, transitive_new: DataFrame | None = None, scores: DataFrame | None = None) -> DataFrame:
    """rule_ordinal, rule, message, severity of every rule that is broken."""
    out: list[DataFrame] = []
    counts = result.counts()
    for i, (what, limit) in enumerate((("added", policy.max_added), ("removed", policy.max_removed), ("changed", policy.max_changed)), 1):
        if limit > 0:
            out.append(_row(counts.where(F.col(what) > limit), i, f"max_{what}", F.format_string(f"{what} %d > max {limit}", F.col(what))))
    if policy.deny_licenses:
        denied = result.added.select("name", F.explode("licenses").alias("lic")).where(F.col("lic").isin(*policy.deny_licenses))
        out.append(_row(denied, 4, "deny_licenses", F.concat("name", F.lit(": denied license "), "lic")))
    if policy.require_licenses:
        out.append(_row(result.added.where(F.size("licenses") == 0), 5, "require_licenses", F.concat("name", F.lit(": no license"))))
    if policy.deny_duplicates:
        n = duplicates(after).agg(F.count("*").alias("n")).where("n > 0")
        out.append(_row(n, 6, "deny_duplicates", F.format_string("%d duplicates found", F.col("n"))))
    if policy.deny_integrity_drift:
        out.append(_row(result.changed.where("drift = 'integrity'"), 7, "deny_integrity_drift", F.concat("name", F.lit(": hash changed without version change"))))
    if policy.max_depth > 0 and transitive_new is not None:
        deep = transitive_new.where(F.col("depth") >= policy.max_depth).agg(F.array_sort(F.collect_list(F.concat("target", F.lit(" (depth "), F.col("depth").cast("string"), F.lit(")")))).alias("t")).where(F.size("t") > 0)
        out.append(_row(deep, 8, "max_depth", F.concat(F.lit(f"transitive deps at depth >= {policy.max_depth}: ["), F.array_join("t", " "), F.lit("]"))))
    if policy.warn_supplier_change:
        moved = result.changed.where(F.col("b.supplier") != F.col("a.supplier"))
        out.append(_row(moved, 9, "warn_supplier_change", F.concat("name", F.lit(': supplier "'), "b.supplier", F.lit('" -> "'), "a.supplier", F.lit('"')), "warning"))
    if policy.warn_new_transitive and transitive_new is not None:
        n = transitive_new.agg(F.count("*").alias("n")).where("n > 0")
        out.append(_row(n, 10, "warn_new_transitive", F.format_string("%d new transitive deps", F.col("n")), "warning"))
    if scores is not None:
        out += _score_rows(policy, scores)
    return _all(out, after)


def evaluate_scores(policy: Policy, scores: DataFrame) -> DataFrame:
    """The broken rules of one document alone: those over framework scores."""
    return _all(_score_rows(policy, scores), scores)


# The frameworks' names in messages. The wording of all messages here is fixed too.
FRAMEWORKS = {"ntia": "NTIA", "cisa": "CISA", "bsi": "BSI TR-03183"}


def _score_rows(policy: Policy, scores: DataFrame) -> list[DataFrame]:
    """From standard, passed, total, score; a framework without a row wasn't evaluated and counts as 0."""
    out: list[DataFrame] = []
    for i, (name, least) in enumerate((("ntia", policy.min_ntia_score), ("cisa", policy.min_cisa_score), ("bsi", policy.min_bsi_score)), 11):
        if least > 0:
            got = scores.where(F.col("standard") == name).agg(*[F.max(c).cast("long").alias(c) for c in ("score", "passed", "total")])
            text = F.format_string(f"{FRAMEWORKS[name]} compliance score %d < minimum {least} (%d/%d checks passed)", "score", "passed", "total")
            text = F.when(F.col("score").isNull(), f"{FRAMEWORKS[name]} compliance not evaluated (score 0) < minimum {least}").otherwise(text)
            out.append(_row(got.where(F.coalesce("score", F.lit(0)) < least), i, f"min_{name}_score", text))
    if policy.min_overall_compliance > 0:
        got = scores.agg(F.floor(F.coalesce(F.avg("score"), F.lit(0.0))).alias("score"))
        out.append(_row(got.where(F.col("score") < policy.min_overall_compliance), 14, "min_overall_compliance", F.format_string(f"overall compliance score %d < minimum {policy.min_overall_compliance}", F.col("score").cast("long"))))
    return out


def _all(out: list[DataFrame], some: DataFrame) -> DataFrame:
    if not out:
        return some.sparkSession.createDataFrame([], "rule_ordinal int, rule string, message string, severity string")
    return reduce(DataFrame.unionByName, out)


def verdict(fail_on: str, counts: DataFrame, violations: DataFrame) -> DataFrame:
    """One row: whether a run fails under policy, integrity-drift, any-change or never."""
    errors = violations.agg((F.count_if(F.col("severity") == "error") > 0).alias("policy_failed"))
    both = counts.crossJoin(errors)  # one row each
    failed = {"policy": F.col("policy_failed"), "integrity-drift": F.col("policy_failed") | (F.col("integrity") > 0), "any-change": F.col("policy_failed") | (F.col("added") + F.col("removed") + F.col("changed") > 0), "never": F.lit(False)}[fail_on]
    return both.select(F.lit(fail_on).alias("fail_on"), F.when(failed, "fail").otherwise("pass").alias("verdict"))


def ecosystem_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """key, change, count: types whose count went to or came from zero."""
    j = before.select("key", F.col("count").alias("b")).join(after.select("key", F.col("count").alias("a")), "key", "full")
    return j.where(F.col("b").isNull() | F.col("a").isNull()).select("key", F.when(F.col("a").isNull(), "vanished").otherwise("new").alias("change"), F.coalesce("b", "a").alias("count"))


def stable(before: DataFrame, after: DataFrame, above: int = 10) -> DataFrame:
    return before.where(F.col("count") > above).join(after, ["key", "count"], "left_semi")


def gaps(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.join(after, "key", "left_anti")
