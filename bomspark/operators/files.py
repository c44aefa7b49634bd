"""File catalogue: catalogued and location-only files, owners, layers and statistics.

``files`` has path, layer, size, file_type, mime and may have digests; ``relations`` has ordinal (of a component),
path and relation (contains or evident-by).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..tables import numbered
from .profile import top

# Fixed order: of several relations of one component and file the first counts.
RELATIONS = ("contains", "evident-by", "location")


def locations(comps: DataFrame) -> DataFrame:
    return comps.select("ordinal", F.explode("locations").alias("path"))


def catalogue(files: DataFrame, comps: DataFrame) -> DataFrame:
    """Files with a path, and each location that is not among them once."""
    known = files.where(fn.text(F.col("path")) != "")
    more = locations(comps).select("path").distinct().join(known.select("path"), "path", "left_anti")
    out = known.unionByName(more, allowMissingColumns=True).na.fill("").na.fill(0)
    return out.withColumn("digests", F.coalesce("digests", F.array())) if "digests" in out.columns else out


def owners(files: DataFrame, comps: DataFrame, relations: DataFrame) -> DataFrame:
    """path, ordinal, relation: every component of every file, by its first relation."""
    rank = F.array_position(F.array(*map(F.lit, RELATIONS)), F.col("relation"))
    known = relations.join(comps.select("ordinal"), "ordinal", "left_semi").select("ordinal", "path", "relation")
    named = known.unionByName(locations(comps).withColumn("relation", F.lit("location")))
    named = named.join(files.select("path").distinct(), "path", "left_semi")
    return named.groupBy("path", "ordinal").agg(F.min_by("relation", rank).alias("relation"))


def component_files(files: DataFrame, comps: DataFrame, relations: DataFrame) -> DataFrame:
    """ordinal, path: the files of every component, each once."""
    return owners(files, comps, relations).select("ordinal", "path")


def artifact_key(name: Column, version: Column, purl: Column) -> Column:
    return F.when(fn.text(purl) != "", purl).otherwise(F.concat(fn.text(name), F.char(F.lit(0)), fn.text(version)))


def match_artifacts(artifacts: DataFrame, comps: DataFrame) -> DataFrame:
    """artifact, ordinal: the first component with an artifact's purl, else its name and version."""
    key = artifact_key(F.col("name"), F.col("version"), F.col("purl")).alias("key")
    first = comps.groupBy(key).agg(F.min("ordinal").alias("ordinal"))
    return artifacts.select("artifact", key).join(first, "key").select("artifact", "ordinal")


def layers(files: DataFrame) -> DataFrame:
    """layer, files, size, first_path (layers are shown in its order)."""
    return files.where("layer <> ''").groupBy("layer").agg(F.count("*").alias("files"), F.sum("size").alias("size"), F.min("path").alias("first_path"))


def statistics(files: DataFrame, comps: DataFrame, relations: DataFrame, most: int = 15) -> DataFrame:
    """metric, key, value: totals, unowned files, counts by type, the most frequent mimes and extensions."""
    owned = owners(files, comps, relations).select("path").distinct()
    one = lambda df, metric, key, value: df.select(F.lit(metric).alias("metric"), key.alias("key"), value.cast("long").alias("value"))
    totals = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))
    unowned = files.join(owned, "path", "left_anti").agg(F.count("*").alias("n"))
    by = lambda c: files.select(c.alias("key")).where("key <> ''").groupBy("key").count()
    out = one(totals, "files", F.lit(""), F.col("n")).unionByName(one(totals, "size", F.lit(""), F.col("size"))).unionByName(one(unowned, "unowned", F.lit(""), F.col("n")))
    out = out.unionByName(one(by(F.col("file_type")), "file_type", F.col("key"), F.col("count")))
    for metric, column in (("mime", F.col("mime")), ("extension", fn.extension(F.col("path")))):
        out = out.unionByName(one(top(by(column), most), metric, F.col("key"), F.col("count")))
    return out


def directory_index(files: DataFrame) -> DataFrame:
    """folder, name, path, is_dir, children, position: the entries of every folder, the root included.

    Every file gives one entry in its folder and one for each folder above it, which are combined
    before they are shuffled. Directories come first, then names; position counts from 0 within a
    folder. A name that is both a file and a folder is a folder. ``children`` counts the entries of a
    directory, and is 0 for a file. The positions come from one sort of all entries, so no task holds a folder."""
    steps = F.split("path", "/")
    prefix = lambda k: F.array_join(F.slice(steps, 1, k), "/")
    above = F.filter(F.transform(F.sequence(F.lit(0), F.size(steps) - 1), prefix), lambda d: d != "")
    entries = files.where(fn.text(F.col("path")) != "").select(F.explode(F.array_union(above, F.array("path"))).alias("entry"), "path")
    entries = entries.groupBy("entry").agg((F.count_if(F.col("entry") != F.col("path")) > 0).alias("is_dir"))
    folder = F.regexp_replace("entry", "/[^/]*$", "")
    top = ~F.contains(F.col("entry"), F.lit("/")) | (folder == "")
    entries = entries.select(F.when(top, "/").otherwise(folder).alias("folder"), F.substring_index("entry", "/", -1).alias("name"), F.col("entry").alias("path"), "is_dir").where("name <> ''")
    placed = numbered(entries, "at", "folder", F.desc("is_dir"), "name", "path")
    folders = placed.groupBy("folder").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    placed = placed.join(folders.select("folder", "first"), "folder").join(folders.select(F.col("folder").alias("path"), F.col("n").alias("children")), "path", "left")
    return placed.select("folder", "name", "path", "is_dir", F.when(F.col("is_dir"), F.coalesce("children", F.lit(0))).otherwise(0).alias("children"), (F.col("at") - F.col("first")).alias("position"))


def directory_page(index: DataFrame, folder: str = "/", offset: int = 0, limit: int = 100) -> DataFrame:
    """The entries of one folder from ``offset`` on, by their positions."""
    return index.where((F.col("folder") == folder) & F.col("position").between(offset, offset + limit - 1))
