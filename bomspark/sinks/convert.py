"""Components and edges of one document as a CycloneDX, SPDX or Syft document.

Every element and every dependency is a row of JSON text; Spark puts them in order into the
envelope, the only part that the driver makes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from .lines import Piece, Rows, document, quoted, rows, write

ALIASES = {"cyclonedx": "cyclonedx", "cdx": "cyclonedx", "spdx": "spdx", "syft": "syft"}


def _set(c: Column) -> Column:
    """Null instead of the empty string, so that ``to_json`` leaves the field out."""
    return F.nullif(c, F.lit(""))


def _some(c: Column) -> Column:
    return F.when(F.size(c) > 0, c)


def cyclonedx_element() -> Column:
    prop = lambda name, value: F.when(fn.text(value) != "", F.struct(F.lit(name).alias("name"), value.alias("value")))
    many = lambda name, values: F.transform(values, lambda v: F.struct(F.lit(name).alias("name"), v.alias("value")))
    single = F.array_compact(F.array(prop("spdx:id", F.col("spdxid")), prop("syft:package:language", F.col("language")), prop("syft:package:foundBy", F.col("found_by"))))
    properties = F.concat(single, many("syft:cpe23", F.slice("cpes", 2, F.greatest(F.size("cpes") - 1, F.lit(0)))), many("syft:location", F.col("locations")))
    hashes = F.transform(F.array_sort(F.map_entries("hashes")), lambda e: F.struct(fn.hash_alg(e["key"]).alias("alg"), e["value"].alias("content")))
    return F.to_json(
        F.struct(
            fn.bom_ref(F.col("bom_ref"), F.col("purl"), F.col("name"), F.col("version"), F.col("id")).alias("bom-ref"), fn.cdx_type(F.col("type")).alias("type"), F.when(fn.text(F.col("supplier")) != "", F.struct(F.col("supplier").alias("name"))).alias("supplier"),
            _set(F.col("namespace")).alias("group"), F.col("name"), _set(F.col("version")).alias("version"), _some(hashes).alias("hashes"), _some(F.transform("licenses", lambda x: F.struct(F.struct(x.alias("id")).alias("license")))).alias("licenses"),
            F.get("cpes", F.lit(0)).alias("cpe"), _set(F.col("purl")).alias("purl"), _some(properties).alias("properties"),
        )
    )


def _spdx_id() -> Column:
    return F.concat(F.lit("SPDXRef-"), fn.spdx_id(F.col("spdxid"), F.col("name"), F.col("version"), F.col("ordinal")))


def spdx_element() -> Column:
    ref = lambda category, kind, value: F.struct(F.lit(category).alias("referenceCategory"), F.lit(kind).alias("referenceType"), value.alias("referenceLocator"))
    refs = F.concat(F.array_compact(F.array(F.when(fn.text(F.col("purl")) != "", ref("PACKAGE-MANAGER", "purl", F.col("purl"))))), F.transform("cpes", lambda c: ref("SECURITY", "cpe23Type", c)))
    sums = F.transform(F.array_sort(F.map_entries("hashes")), lambda e: F.struct(fn.hash_alg(e["key"], "spdx").alias("algorithm"), e["value"].alias("checksumValue")))
    licence = F.when(F.size("licenses") > 0, F.array_join("licenses", " AND ")).otherwise("NOASSERTION")
    return F.to_json(
        F.struct(
            F.col("name"), _spdx_id().alias("SPDXID"), _set(F.col("version")).alias("versionInfo"), F.when(fn.text(F.col("supplier")) != "", F.concat(F.lit("Organization: "), "supplier")).alias("supplier"), F.lit("NOASSERTION").alias("downloadLocation"),
            F.lit(False).alias("filesAnalyzed"), _some(sums).alias("checksums"), licence.alias("licenseConcluded"), licence.alias("licenseDeclared"), _some(refs).alias("externalRefs"),
        )
    )


def _syft_id() -> Column:
    return F.substring(F.sha2(F.concat_ws("\x01", "id", "version", F.col("ordinal").cast("string")), 256), 1, 16)


def syft_element() -> Column:
    return F.to_json(
        F.struct(
            _syft_id().alias("id"), F.col("name"), F.col("version"), fn.syft_type(F.col("purl"), F.col("type")).alias("type"), _set(F.col("found_by")).alias("foundBy"), F.transform("locations", lambda p: F.struct(p.alias("path"))).alias("locations"),
            F.transform("licenses", lambda x: F.struct(x.alias("value"), x.alias("spdxExpression"), F.lit("declared").alias("type"))).alias("licenses"), _set(F.col("language")).alias("language"), F.transform("cpes", lambda c: F.struct(c.alias("cpe"))).alias("cpes"), _set(F.col("purl")).alias("purl"),
        )
    )


_ELEMENT: dict[str, Callable[[], Column]] = {"cyclonedx": cyclonedx_element, "spdx": spdx_element, "syft": syft_element}
_REF: dict[str, Callable[[], Column]] = {"cyclonedx": lambda: fn.bom_ref(F.col("bom_ref"), F.col("purl"), F.col("name"), F.col("version"), F.col("id")), "spdx": _spdx_id, "syft": _syft_id}


def element_rows(comps: DataFrame, target: str) -> DataFrame:
    """ordinal, ref, element: each component as JSON text of the target format."""
    name = ALIASES[target]
    full = comps.withColumns({c: F.lit("") for c in ("bom_ref", "spdxid", "namespace", "found_by", "language") if c not in comps.columns})
    return full.select("ordinal", "id", _REF[name]().alias("ref"), _ELEMENT[name]().alias("element"))


def relation_rows(comps: DataFrame, edges: DataFrame, target: str) -> DataFrame:
    """src_ref, adj_ordinal, dst_ref: dependencies between elements, a row each; ends that the
    document lacks go."""
    first = element_rows(comps, target).groupBy("id").agg(F.min_by("ref", "ordinal").alias("ref"))
    ends = edges.join(first.select(F.col("id").alias("src_id"), F.col("ref").alias("src_ref")), "src_id").join(first.select(F.col("id").alias("dst_id"), F.col("ref").alias("dst_ref")), "dst_id")
    return ends.select("src_ref", "adj_ordinal", "dst_ref").distinct()


def _depends_on(relations: DataFrame) -> Rows:
    """One object per source, written a row per dependency: the first row of a source opens the
    object, the last one closes it, so that no list of targets is ever gathered."""
    at = F.struct("adj_ordinal", "dst_ref")
    ends = relations.groupBy("src_ref").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    opening = F.when(at.eqNullSafe(F.col("first")), F.concat(F.lit('{"ref":'), quoted(F.col("src_ref")), F.lit(',"dependsOn":['))).otherwise("")
    closing = F.when(at.eqNullSafe(F.col("last")), "]}").otherwise("")
    return rows(relations.join(ends, "src_ref"), F.concat(opening, quoted(F.col("dst_ref")), closing), "src_ref", "adj_ordinal", "dst_ref", separator=",")


def _spdx_relations(elements: DataFrame, relations: DataFrame) -> Rows:
    """What the document describes, in the order of elements, then the dependencies."""
    described = elements.select(F.lit(0).alias("part"), F.col("ordinal").alias("at"), F.lit("SPDXRef-DOCUMENT").alias("src_ref"), F.col("ref").alias("dst_ref"), F.lit("DESCRIBES").alias("kind"))
    depends = relations.select(F.lit(1).alias("part"), F.col("adj_ordinal").alias("at"), "src_ref", "dst_ref", F.lit("DEPENDS_ON").alias("kind"))
    line = F.to_json(F.struct(F.col("src_ref").alias("spdxElementId"), F.col("dst_ref").alias("relatedSpdxElement"), F.col("kind").alias("relationshipType")))
    return rows(described.unionByName(depends), line, "part", "src_ref", "at", "dst_ref", separator=",")


def _pieces(comps: DataFrame, edges: DataFrame, target: str, info: dict, namespace: str) -> Iterator[Piece]:
    name, q = ALIASES[target], json.dumps
    made, relations = element_rows(comps, name), relation_rows(comps, edges, name)
    elements = rows(made, F.col("element"), "ordinal", separator=",")
    tool = {"name": info.get("tool_name") or "bomspark", "version": info.get("tool_version") or ""}
    stamp = info.get("sbom_timestamp") or ""
    if name == "cyclonedx":
        meta = {"timestamp": stamp, "tools": {"components": [{"type": "application", **tool}]}} | ({"component": {"type": "operating-system", "name": info["os_name"], "version": info.get("os_version") or ""}} if info.get("os_name") else {})
        yield f'{{"bomFormat":"CycloneDX","specVersion":"1.6","serialNumber":{q(namespace)},"version":1,"metadata":{q(meta)},"components":['
        yield elements
        yield '],"dependencies":['
        yield _depends_on(relations)
        yield "]}"
    elif name == "spdx":
        head = {"spdxVersion": "SPDX-2.3", "dataLicense": "CC0-1.0", "SPDXID": "SPDXRef-DOCUMENT", "name": info.get("source_name") or info.get("os_name") or "document", "documentNamespace": namespace, "creationInfo": {"created": stamp, "creators": [f"Tool: {tool['name']}-{tool['version']}".rstrip("-")]}}
        yield q(head)[:-1] + ',"packages":['
        yield elements
        yield '],"relationships":['
        yield _spdx_relations(made, relations)
        yield "]}"
    else:
        yield '{"artifacts":['
        yield elements
        yield '],"artifactRelationships":['
        line = F.to_json(F.struct(F.col("src_ref").alias("parent"), F.col("dst_ref").alias("child"), F.lit("dependency-of").alias("type")))
        yield rows(relations, line, "src_ref", "adj_ordinal", "dst_ref", separator=",")
        tail = {"source": {"id": info.get("source_id") or "", "name": info.get("source_name") or "", "type": info.get("source_type") or ""}, "distro": {"name": info.get("os_name") or "", "version": info.get("os_version") or "", "prettyName": info.get("os_pretty_name") or ""}, "descriptor": tool, "schema": {"version": info.get("schema_version") or ""}}
        yield "]," + q(tail)[1:]


def write_document(comps: DataFrame, edges: DataFrame, target: str, path: str, info: dict | None = None, namespace: str | None = None) -> None:
    """One document as a local file, or as a folder of part files written by the executors if
    ``path`` ends with a slash. ``namespace``: its serial number, a new UUID unless given."""
    write(document(comps.sparkSession, list(_pieces(comps, edges, target, info or {}, namespace or f"urn:uuid:{uuid.uuid4()}"))), path)


def export_component(comps: DataFrame, id_: str) -> str:
    """The last component with this id as JSON text: its own text where that is JSON, else its
    fields; empty if there is none."""
    fields = F.to_json(F.struct(*[c for c in comps.columns if c != "raw"]))
    own = F.when(F.try_parse_json("raw").isNotNull(), F.col("raw")) if "raw" in comps.columns else F.lit(None)
    row = comps.where(F.col("id") == id_).orderBy(F.desc("ordinal")).limit(1).select(F.coalesce(own, fields).alias("j")).first()
    return row.j if row else ""
