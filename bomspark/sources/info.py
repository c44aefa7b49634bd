"""Document-level facts and dependency edges of inventory documents.

Both read the same one-row-per-document frame as ``documents.components``. Facts absent from a
document are the empty string, ``files_count`` 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators.graph import adjacency
from ..operators.files import artifact_key
from . import xml
from .documents import components, detected

FACTS = ("tool_name", "tool_version", "os_name", "os_version", "os_pretty_name", "source_name", "source_type", "source_id", "search_scope", "schema_version", "sbom_author", "sbom_timestamp")
NAMED = "struct<name:string,version:string>"
METADATA = f"metadata struct<timestamp:string,component:struct<type:string,name:string,version:string>,authors:array<struct<name:string>>,supplier:struct<name:string>,tools:string,properties:array<struct<name:string,value:string>>>"
DEPENDENCIES = "dependencies array<struct<ref:string,dependsOn:array<string>>>"
DISTRO = "struct<name:string,prettyName:string,version:string,id:string>"
RELATIONS = "relationships array<struct<spdxElementId:string,relatedSpdxElement:string,relationshipType:string>>"

# Fixed property names that fill facts when those are empty, in lower case.
OS_NAME = ("syft:distro:name", "distro:name", "os:name")
OS_VERSION = ("syft:distro:version", "distro:version", "os:version")
IMAGE = ("syft:image:tag", "image:tag")


def _first(*choices: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices], F.lit(""))


def _facts(df: DataFrame, files_count: Column | None = None, **facts: Column) -> DataFrame:
    count = F.coalesce(files_count, F.lit(0)) if files_count is not None else F.lit(0)
    return df.select("sbom_id", "dialect", *[fn.text(facts[k]).alias(k) if k in facts else F.lit("").alias(k) for k in FACTS], count.cast("long").alias("files_count"))


def _cyclonedx(df: DataFrame, metadata: Column, tool: Column) -> DataFrame:
    df = df.select("sbom_id", "dialect", metadata.alias("m"), tool.alias("t"))
    m, kind = F.col("m"), F.col("m.component.type")
    prop = lambda names: F.get(F.filter(m["properties"], lambda p: F.lower(p["name"]).isin(*names) & (fn.text(p["value"]) != "")), F.lit(0))["value"]
    system, file = kind.isin("operating-system", "container"), kind.isin("application", "file")
    author = F.get(F.filter(m["authors"], lambda a: fn.text(a["name"]) != ""), F.lit(0))["name"]
    return _facts(
        df, tool_name=F.col("t.name"), tool_version=F.col("t.version"), sbom_timestamp=m["timestamp"], sbom_author=_first(author, m["supplier"]["name"]), source_type=F.when(system | file, kind),
        os_name=_first(F.when(system, m["component"]["name"]), prop(OS_NAME)), os_version=_first(F.when(system, m["component"]["version"]), prop(OS_VERSION)), source_name=_first(F.when(file, m["component"]["name"]), prop(IMAGE)),
    )


def _cyclonedx_json(df: DataFrame) -> DataFrame:
    metadata = F.from_json("text", METADATA)["metadata"]
    modern = F.get(F.from_json(metadata["tools"], f"components array<{NAMED}>")["components"], F.lit(0))
    old = F.get(F.from_json(metadata["tools"], f"array<{NAMED}>"), F.lit(0))
    return _cyclonedx(df, metadata, F.coalesce(modern, old))


def _cyclonedx_xml(df: DataFrame) -> DataFrame:
    bom = df.withColumn("b", xml.bom(F.col("text")))
    return _cyclonedx(bom, xml.metadata(F.col("b")), xml.tool(F.col("b")))


def _spdx(df: DataFrame) -> DataFrame:
    made = F.from_json("text", "creationInfo struct<created:string,creators:array<string>>")["creationInfo"]
    df = df.select("sbom_id", "dialect", made.alias("m"))
    tools = F.filter("m.creators", lambda c: c.startswith("Tool:"))
    others = F.filter("m.creators", lambda c: ~c.startswith("Tool:"))
    said = lambda c: F.regexp_replace(F.get(c, F.lit(0)), r"^[A-Za-z]+:\s*", "")
    name, version = fn.tool_split(said(tools))
    return _facts(df, tool_name=name, tool_version=version, sbom_author=said(others), sbom_timestamp=F.col("m.created"))


def _syft(df: DataFrame) -> DataFrame:
    d = F.from_json("text", "descriptor struct<name:string,version:string,configuration:struct<search:struct<scope:string>>>, schema struct<version:string>, source string, distro string, files array<string>")
    df = df.select("sbom_id", "dialect", d.alias("d"))
    distro = F.coalesce(F.when(fn.text(F.col("d.distro")).startswith("{"), F.from_json("d.distro", DISTRO)), F.get(F.from_json("d.distro", f"array<{DISTRO}>"), F.lit(0)))
    source = F.from_json("d.source", "struct<id:string,name:string,type:string,target:string>")
    user = F.get_json_object(source["target"], "$.userInput")
    return _facts(
        df, F.greatest(F.size("d.files"), F.lit(0)), tool_name=F.col("d.descriptor.name"), tool_version=F.col("d.descriptor.version"), schema_version=F.col("d.schema.version"), search_scope=F.col("d.descriptor.configuration.search.scope"),
        source_type=source["type"], source_id=source["id"], source_name=_first(user, source["name"]), os_name=_first(distro["name"], distro["id"]), os_version=distro["version"], os_pretty_name=distro["prettyName"],
    )


def document_info(documents: DataFrame) -> DataFrame:
    """sbom_id, dialect, the facts and files_count, one row per document of a known dialect."""
    typed = detected(documents)
    parts = [build(typed.where(F.col("dialect") == name)) for name, build in (("cyclonedx", _cyclonedx_json), ("cyclonedx-xml", _cyclonedx_xml), ("spdx", _spdx), ("syft", _syft))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _refs(documents: DataFrame) -> DataFrame:
    """sbom_id, src_ref, dst_ref, adj_ordinal as written in each document."""
    typed = detected(documents)
    of = lambda name: typed.where(F.col("dialect") == name)
    row = lambda df: df.select("sbom_id", "src_ref", "dst_ref", F.col("adj_ordinal").cast("long").alias("adj_ordinal"))
    json_deps = of("cyclonedx").select("sbom_id", F.explode(F.from_json("text", DEPENDENCIES)["dependencies"]).alias("d")).select("sbom_id", F.col("d.ref").alias("src_ref"), F.posexplode("d.dependsOn").alias("adj_ordinal", "dst_ref"))
    xml_deps = of("cyclonedx-xml").select("sbom_id", F.explode(xml.bom(F.col("text"))["dependencies"]["dependency"]).alias("d")).select("sbom_id", F.col("d._ref").alias("src_ref"), F.posexplode("d.dependency").alias("adj_ordinal", "t")).withColumn("dst_ref", F.col("t._ref"))
    strip = lambda c: F.regexp_replace(c, "^SPDXRef-", "")
    spdx = of("spdx").select("sbom_id", F.posexplode(F.from_json("text", RELATIONS)["relationships"]).alias("adj_ordinal", "r"))
    back = F.col("r.relationshipType") == "DEPENDENCY_OF"
    spdx = spdx.where(F.col("r.relationshipType").isin("DEPENDS_ON", "DEPENDENCY_OF") & ~F.col("r.relatedSpdxElement").isin("NONE", "NOASSERTION"))
    here, there = strip(F.col("r.spdxElementId")), strip(F.col("r.relatedSpdxElement"))
    spdx = spdx.select("sbom_id", "adj_ordinal", F.when(back, there).otherwise(here).alias("src_ref"), F.when(back, here).otherwise(there).alias("dst_ref"))
    syft = of("syft").select("sbom_id", F.posexplode(syft_relations()).alias("adj_ordinal", "r")).where("r.type = 'dependency-of'").select("sbom_id", "adj_ordinal", F.col("r.parent").alias("src_ref"), F.col("r.child").alias("dst_ref"))
    return row(json_deps).unionByName(row(xml_deps)).unionByName(row(spdx)).unionByName(row(syft))


def declared(documents: DataFrame) -> DataFrame:
    """sbom_id, ref of components whose dependencies are declared: an entry of their own, also an
    empty one, in CycloneDX, and a dependency on NONE in SPDX. Syft has no such statement."""
    typed = detected(documents)
    of = lambda name: typed.where(F.col("dialect") == name)
    row = lambda df, ref: df.select("sbom_id", ref.alias("ref"))
    found = row(of("cyclonedx").select("sbom_id", F.explode(F.from_json("text", DEPENDENCIES)["dependencies"]).alias("d")), F.col("d.ref"))
    found = found.unionByName(row(of("cyclonedx-xml").select("sbom_id", F.explode(xml.bom(F.col("text"))["dependencies"]["dependency"]).alias("d")), F.col("d._ref")))
    spdx = of("spdx").select("sbom_id", F.explode(F.from_json("text", RELATIONS)["relationships"]).alias("r")).where("r.relationshipType = 'DEPENDS_ON' AND r.relatedSpdxElement = 'NONE'")
    return found.unionByName(row(spdx, F.regexp_replace("r.spdxElementId", "^SPDXRef-", ""))).where("ref <> ''").distinct()


def with_declared(comps: DataFrame, documents: DataFrame) -> DataFrame:
    """``comps`` with deps_declared; of components that share a reference the last is meant."""
    meant = comps.where("ref <> ''").groupBy("sbom_id", "ref").agg(F.max("ordinal").alias("ordinal"))
    flags = meant.join(declared(documents), ["sbom_id", "ref"], "left_semi").select("sbom_id", "ordinal", F.lit(True).alias("deps_declared")).distinct()
    return comps.join(flags, ["sbom_id", "ordinal"], "left").withColumn("deps_declared", F.coalesce("deps_declared", F.lit(False))).select(*comps.columns, "deps_declared")


def syft_relations() -> Column:
    return F.from_json("text", "artifactRelationships array<struct<parent:string,child:string,type:string>>")["artifactRelationships"]


def dependencies(documents: DataFrame, comps: DataFrame) -> DataFrame:
    """sbom_id, src_id, src_ordinal, dst_id, adj_ordinal: the dependencies of every component of one
    document. A reference means the last component that has it; references without one go."""
    meant = comps.where("ref <> ''").groupBy("sbom_id", "ref").agg(F.max(F.struct("ordinal", "id")).alias("c"))
    end = lambda side: meant.select("sbom_id", F.col("ref").alias(f"{side}_ref"), F.col("c.id").alias(f"{side}_id"), F.col("c.ordinal").alias(f"{side}_ordinal"))
    found = _refs(documents).join(end("src"), ["sbom_id", "src_ref"]).join(end("dst"), ["sbom_id", "dst_ref"])
    return found.select("sbom_id", "src_id", "src_ordinal", "dst_id", "adj_ordinal")


def edges(documents: DataFrame) -> DataFrame:
    """sbom_id, src_id, dst_id, adj_ordinal: the graph, in which the last component of an id replaces those before it."""
    comps = components(documents)
    return adjacency(comps, dependencies(documents, comps), "sbom_id").drop("src_ordinal")


def relationship_counts(documents: DataFrame) -> DataFrame:
    """sbom_id, key, count of every relation type of Syft documents."""
    syft = detected(documents).where("dialect = 'syft'")
    return syft.select("sbom_id", F.explode(syft_relations()["type"]).alias("key")).groupBy("sbom_id", "key").count()


def files(documents: DataFrame) -> DataFrame:
    """sbom_id, file_id, path, layer, size, file_type, mime, mode, user_id, group_id, digests (algorithm,
    value; those with a value) of the file lists of Syft documents; list_ordinal is the place in the list."""
    listed = F.from_json("text", "files array<struct<id:string,location:struct<path:string,layerID:string>,metadata:struct<mode:bigint,type:string,mimeType:string,userID:bigint,groupID:bigint,size:bigint>,digests:array<struct<algorithm:string,value:string>>>>")["files"]
    rows = detected(documents).where("dialect = 'syft'").select("sbom_id", F.posexplode(listed).alias("list_ordinal", "f")).where("f.location.path <> ''")
    m = F.col("f.metadata")
    number = lambda k: F.coalesce(m[k], F.lit(0)).alias({"userID": "user_id", "groupID": "group_id"}.get(k, k))
    return rows.select(
        "sbom_id", "list_ordinal", fn.text(F.col("f.id")).alias("file_id"), F.col("f.location.path").alias("path"), fn.text(F.col("f.location.layerID")).alias("layer"), number("size"), fn.text(m["type"]).alias("file_type"), fn.text(m["mimeType"]).alias("mime"), number("mode"), number("userID"), number("groupID"),
        F.coalesce(F.filter("f.digests", lambda x: fn.text(x["value"]) != ""), F.array()).alias("digests"),
    )


def relations(documents: DataFrame, comps: DataFrame, listed: DataFrame) -> DataFrame:
    """sbom_id, ordinal, path, relation: which component contains, or is evident by, which file.

    Syft documents relate ids of artifacts to ids of files in one list with all other relations. An
    artifact stands for the first component with its purl, else its name and version; of artifacts, or
    of listed files (``files``), with one id the last counts. Relations with unknown ends go."""
    syft = detected(documents).where("dialect = 'syft'")
    related = syft.select("sbom_id", F.explode(syft_relations()).alias("r")).where(F.col("r.type").isin("contains", "evident-by"))
    related = related.select("sbom_id", F.col("r.parent").alias("artifact"), F.col("r.child").alias("file_id"), F.col("r.type").alias("relation")).distinct()
    artifacts = syft.select("sbom_id", F.posexplode(F.from_json("text", "artifacts array<struct<id:string,name:string,version:string,purl:string>>")["artifacts"]).alias("at", "a"))
    key = lambda at: artifact_key(*(F.col(f"{at}{c}") for c in ("name", "version", "purl"))).alias("key")
    artifacts = artifacts.where("a.id <> ''").select("sbom_id", F.col("a.id").alias("artifact"), "at", key("a."))
    first = comps.groupBy("sbom_id", key("")).agg(F.min("ordinal").alias("ordinal"))
    known = artifacts.join(first, ["sbom_id", "key"]).groupBy("sbom_id", "artifact").agg(F.max_by("ordinal", "at").alias("ordinal"))
    place = listed.groupBy("sbom_id", "file_id").agg(F.max_by("path", "list_ordinal").alias("path"))
    return related.join(known, ["sbom_id", "artifact"]).join(place, ["sbom_id", "file_id"]).select("sbom_id", "ordinal", "path", "relation").distinct()
