"""Search, lookup, paging and directory listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn


def search(comps: DataFrame, query: str, kind: str = "") -> DataFrame:
    text = fn.search_text({c: F.col(c) for c in ("name", "version", "purl", "id", "supplier", "cpes", "licenses", "raw") if c in comps.columns})
    found = comps.where(F.contains(text, F.lit(query.lower())))
    return found.where(F.contains(F.lower(fn.pkg_type(F.col("purl"))), F.lit(kind.lower()))) if kind else found


def tree_matches(comps: DataFrame, query: str) -> DataFrame:
    """Components whose name, version, type or id holds the query, whatever its case."""
    return comps.where(F.contains(F.lower(F.concat_ws(" ", "name", "version", "type", "id")), F.lit(query.lower())))


def lookup(comps: DataFrame, id_: str) -> DataFrame:
    """The last component with this id."""
    return comps.where(F.col("id") == id_).orderBy(F.desc("ordinal")).limit(1)


def page(comps: DataFrame, offset: int = 0, limit: int = 200) -> DataFrame:
    return comps.orderBy("ordinal").offset(offset).limit(limit)


def directory(files: DataFrame, folder: str) -> DataFrame:
    """Entries directly below ``folder``: name, is_dir, files beneath; directories first."""
    prefix = folder.rstrip("/") + "/"
    rest = F.substring(F.col("path"), len(prefix) + 1, 1 << 30)
    below = files.where(F.col("path").startswith(prefix)).select(F.substring_index(rest, "/", 1).alias("name"), F.contains(rest, F.lit("/")).alias("is_dir"))
    return below.groupBy("name", "is_dir").agg(F.count("*").alias("files")).orderBy(F.desc("is_dir"), "name")


def filter_files(files: DataFrame, query: str) -> DataFrame:
    """Glob match if the query is a glob, else a substring of the path."""
    if any(c in query for c in "*?["):
        return files.where(fn.glob_match(F.col("path"), query))
    return files.where(F.contains(F.lower("path"), F.lit(query.lower())))
