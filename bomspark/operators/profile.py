"""Profile statistics, facets, top-k and completeness checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..functions.licenses import valid_components


def packages(comps: DataFrame) -> DataFrame:
    return comps.where(~F.col("type").isin("file", "operating-system"))


def normalize(comps: DataFrame) -> DataFrame:
    """Trimmed fields, lower-case name, cleaned licences; an id once set is kept."""
    plain = {c: fn.trim(F.col(c)) for c in ("version", "purl", "supplier", "bom_ref", "spdxid", "namespace") if c in comps.columns}
    return comps.withColumns(plain | {"name": fn.normalize_name(F.col("name")), "licenses": fn.normalize_licenses(F.col("licenses"))})


def profile_aggregates() -> list[Column]:
    none = F.size("licenses") == 0
    first = fn.license_category(F.get("licenses", F.lit(0)))
    return [
        F.count("*").alias("total"), F.count_if(none).alias("without_license"), F.count_if(F.size("hashes") > 0).alias("with_hashes"), F.count_if(F.size("hashes") == 0).alias("without_hashes"), F.count_if(F.size("cpes") > 0).alias("with_cpes"), F.count_if(F.col("purl") != "").alias("with_purl"),
        *[F.count_if(first == c).alias(f"lic_{c}") for c in ("copyleft", "permissive", "public_domain", "unknown")],
    ]


def profile(comps: DataFrame, *by: str) -> DataFrame:
    """All scalar statistics and licence categories in one pass."""
    return comps.groupBy(*by).agg(*profile_aggregates())


def by_type(comps: DataFrame, *by: str) -> DataFrame:
    return comps.groupBy(*by, fn.stats_type(F.col("purl"), F.col("id"), F.col("type")).alias("key")).agg(F.count("*").alias("count"))


def by_license(comps: DataFrame, *by: str) -> DataFrame:
    return comps.select(*by, F.explode("licenses").alias("key")).groupBy(*by, "key").agg(F.count("*").alias("count"))


def by_column(comps: DataFrame, column: str, *by: str) -> DataFrame:
    return comps.where(F.col(column) != "").groupBy(*by, F.col(column).alias("key")).agg(F.count("*").alias("count"))


def by_prefix(comps: DataFrame, *by: str) -> DataFrame:
    return comps.groupBy(*by, fn.path_prefix(F.col("locations")).alias("key")).agg(F.count("*").alias("count")).where("key <> ''")


def top(counts: DataFrame, n: int, *by: str) -> DataFrame:
    """The n largest counts, ties by key; per group if ``by`` is given."""
    order = [F.desc("count"), F.asc("key")]
    if not by:
        return counts.orderBy(*order).limit(n)
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n).drop("rank")


def graph_coverage(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """Components that have or are a dependency, or declare that they have none (``deps_declared``, where known)."""
    touched = edges.select(F.col("src_id").alias("id")).unionByName(edges.select(F.col("dst_id").alias("id"))).distinct()
    if "deps_declared" not in comps.columns:
        return comps.join(touched, "id", "left_semi")
    return comps.join(touched.withColumn("__touched", F.lit(True)), "id", "left").where(F.col("deps_declared") | F.col("__touched")).drop("__touched")


def dependency_counts(edges: DataFrame, *by: str) -> DataFrame:
    """with_dependencies, total_dependencies: components that have dependencies (rows, where ``edges`` tells
    those of one id apart by src_ordinal), and all of these."""
    return edges.groupBy(*by).agg(F.count_distinct("src_ordinal" if "src_ordinal" in edges.columns else "src_id").alias("with_dependencies"), F.count("*").alias("total_dependencies"))


def bars(counts: DataFrame, n: int) -> DataFrame:
    """key, count and share of the largest count, for the n largest counts."""
    return top(counts, n).withColumn("share", F.col("count") / F.max("count").over(Window.partitionBy()))


COMPONENT_CHECKS: dict[str, list[tuple[str, str]]] = {
    "ntia": [("name", "name"), ("version", "version"), ("supplier", "supplier"), ("unique-id", "uid"), ("dep-relation", "deps")],
    "cisa": [("name", "name"), ("version", "version"), ("supplier", "supplier"), ("unique-id", "uid"), ("dep-relation", "deps"), ("license", "license"), ("hash", "hash")],
    "bsi": [("name", "name"), ("version", "version"), ("creator", "contact"), ("unique-id", "uid"), ("license", "spdx"), ("sha512", "sha512"), ("dep-relation", "deps")],
}


def compliance_counts(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """One row with the number of packages that pass each component check."""
    pk = packages(comps)
    covered = graph_coverage(pk.select("id", *[c for c in ("deps_declared",) if c in pk.columns]), edges).agg(F.count("*").alias("deps"))
    counts = pk.agg(
        F.count("*").alias("total"), *[F.count_if(F.col(c) != "").alias(c) for c in ("name", "version", "supplier")], F.count_if(fn.has_lookup_id(F.col("purl"), F.col("cpes"))).alias("uid"), F.count_if(F.size("licenses") > 0).alias("license"), F.count_if(F.size("hashes") > 0).alias("hash"),
        F.count_if(fn.has_contact(F.col("supplier"))).alias("contact"), F.count_if(F.map_contains_key("hashes", F.lit("SHA-512")) | F.map_contains_key("hashes", F.lit("SHA512"))).alias("sha512"),
    )
    return counts.crossJoin(covered).crossJoin(valid_components(pk))  # one row each


def _made(info: dict, standard: str) -> list[Column]:
    """A struct (standard, check, passed, detail) of each check, over compliance_counts."""
    has = lambda *keys: any(info.get(k) for k in keys)
    author = info.get("sbom_author") or ""
    document = {
        "ntia": [("author", has("sbom_author", "tool_name")), ("timestamp", has("sbom_timestamp"))],
        "cisa": [("tool", has("tool_name")), ("author", has("sbom_author")), ("timestamp", has("sbom_timestamp"))],
        "bsi": [("author", "@" in author or author.startswith(("http://", "https://"))), ("timestamp", has("sbom_timestamp"))],
    }[standard]
    whole = lambda c: F.col(c) == F.col("total")
    share = lambda c: F.when(whole(c), F.format_string("All %d components", "total")).otherwise(F.format_string("%d/%d components", c, "total"))
    passed = [(k, whole(c), share(c)) for k, c in COMPONENT_CHECKS[standard]] + [(k, F.lit(bool(ok)), F.lit("present" if ok else "missing")) for k, ok in document]
    return [F.struct(F.lit(standard).alias("standard"), F.lit(f"{standard}-{k}").alias("check"), ok.alias("passed"), detail.alias("detail")) for k, ok, detail in passed]


def _checked(comps: DataFrame, edges: DataFrame, info: dict, *standards: str) -> DataFrame:
    made = [c for s in standards for c in _made(info, s)]
    return compliance_counts(comps, edges).where("total > 0").select(F.explode(F.array(*made)).alias("c")).select("c.*")


def checks(comps: DataFrame, edges: DataFrame, info: dict, standard: str) -> DataFrame:
    """check, passed: component checks pass when all packages do, document checks by ``info``."""
    return _checked(comps, edges, info, standard).select("check", "passed")


def compliance(comps: DataFrame, edges: DataFrame, info: dict) -> DataFrame:
    """standard, check, passed, detail of every check of all frameworks."""
    return _checked(comps, edges, info, *COMPONENT_CHECKS)


def scores_of(checked: DataFrame) -> DataFrame:
    """standard, passed, total, score (whole percent) of a frame of checks."""
    out = checked.groupBy("standard").agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"))
    return out.select("standard", "passed", "total", F.floor(F.col("passed") * 100 / F.col("total")).alias("score"))


def framework_scores(comps: DataFrame, edges: DataFrame, info: dict) -> DataFrame:
    """standard, passed, total, score (whole percent) of the standards that apply, from one count."""
    return scores_of(compliance(comps, edges, info))
