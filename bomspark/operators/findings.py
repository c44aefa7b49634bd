"""Key findings as rows of (finding_ordinal, message).

Document facts (``info``) are one small mapping per document; everything counted stays a frame.
Percentages are quotients of doubles times 100, rounded half to even on their exact binary value.

The wording of the messages consists of fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn
from .diff import duplicates

SCHEMA = "finding_ordinal int, message string"


def _facts(spark: SparkSession, ordinal: int, messages: list[str]) -> DataFrame:
    return spark.createDataFrame([(ordinal, m) for m in messages], SCHEMA)


def _finding(df: DataFrame, ordinal: int, message: Column) -> DataFrame:
    return df.select(F.lit(ordinal).alias("finding_ordinal"), message.alias("message"))


def percent(part: Column, whole: Column) -> Column:
    return fn.percent_of(part, whole)


def os_name(info: dict) -> str:
    return info.get("os_pretty_name") or info.get("os_name") or ""


def operating_system(spark: SparkSession, info: dict) -> DataFrame:
    name, version = os_name(info), info.get("os_version") or ""
    shown = f"{name} {version}" if version and version not in name else name
    return _facts(spark, 1, [f"OS/Distro: {shown}"] if name else [])


def files(spark: SparkSession, info: dict) -> DataFrame:
    n = info.get("files_count") or 0
    return _facts(spark, 3, [f"{n:,} files tracked on filesystem"] if n else [])


def relationships(counts: DataFrame) -> DataFrame:
    """From key and count of all relationship types: containment and dependency, if there are any."""
    of = lambda key: F.coalesce(F.sum(F.when(F.col("key") == key, F.col("count"))), F.lit(0))
    both = counts.agg(of("contains").alias("c"), of("dependency-of").alias("d")).where("c > 0 or d > 0")
    part = lambda c, word: F.when(F.col(c) > 0, F.concat(fn.fmt_count(F.col(c)), F.lit(f" {word}")))
    return _finding(both, 4, F.concat(F.lit("Relationships: "), F.concat_ws(" + ", part("c", "containment"), part("d", "dependency"))))


def quality(stats: DataFrame) -> DataFrame:
    """From the one row of ``profile``: low coverage of licences, hashes and purls."""
    total = F.col("total")
    cases = [("license", total - F.col("without_license"), 50), ("hash", F.col("with_hashes"), 50), ("PURL", F.col("with_purl"), 80)]
    rows = [F.when(have * 100 / total < least, F.concat(F.lit(f"Low {what} coverage: "), percent(have, total), F.format_string("%% (%d of %d missing)", total - have, total))) for what, have, least in cases]
    return _finding(stats.where("total > 0").select(F.explode(F.array_compact(F.array(*rows))).alias("m")), 7, F.col("m"))


def duplicate_groups(comps: DataFrame) -> DataFrame:
    n = duplicates(comps).agg(F.count("*").alias("n")).where("n > 0")
    return _finding(n, 8, F.format_string("%d duplicate component groups detected", F.col("n")))


def context(spark: SparkSession, before: dict, after: dict) -> DataFrame:
    """Scan scope or schema version of both documents differ."""
    rows = []
    for key, what, hint in (("search_scope", "scan scope", "diff may reflect scan depth, not system changes"), ("schema_version", "schema version", "PURL format may differ")):
        b, a = before.get(key), after.get(key)
        if b and a and b != a:
            rows.append(f"Warning: {what} changed ({b} → {a}) — {hint}")
    return _facts(spark, 10, rows)


def os_change(spark: SparkSession, before: dict, after: dict) -> DataFrame:
    b, a = os_name(before), os_name(after)
    if b == a:
        return _facts(spark, 13, [])
    verb = "detection gained" if not b else "detection lost" if not a else "changed"
    return _facts(spark, 13, [f"OS {verb}: {b or 'unknown'} → {a or 'unknown'}"])


def dominant_path(rows: DataFrame, direction: str) -> DataFrame:
    """One type and path prefix makes up half of at least 20 rows, and at least 10 of them."""
    typed = rows.select(fn.effective_type(F.col("purl"), F.col("id")).alias("type"), fn.path_prefix(F.col("locations")).alias("path"))
    pairs = typed.groupBy("type", "path").agg(F.count("*").alias("n"))
    best = pairs.agg(F.sum("n").alias("total"), F.max(F.when(F.col("path") != "", F.struct("n", "type", "path"))).alias("best"))
    best = best.where("total >= 20 and best.n >= 10 and best.n * 100 / total >= 50")
    return _finding(best, 16, F.concat(percent(F.col("best.n"), F.col("total")), F.lit(f"% of {direction} packages are "), "best.type", F.lit(", concentrated in "), "best.path"))
