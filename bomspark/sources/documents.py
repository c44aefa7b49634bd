"""Inventory documents (CycloneDX JSON and XML, SPDX JSON, Syft JSON) as component rows.

One row per document in, one row per component out, in one scan for all dialects: dialect by
ordered detection, elements as JSON text, typed ``from_json`` per element, position kept as
ordinal, identity computed from the row. Fields are as they are written
(``profile.normalize`` cleans them); ``ref`` is the name by which the document refers to a component. ``raw`` is the element's own
JSON text, empty for XML and SPDX. Elements that are no objects are skipped. Documents of no dialect and malformed ones
go to ``parse_warnings``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn
from . import xml

CYCLONEDX = "struct<type:string,name:string,version:string,purl:string,cpe:string,group:string,`bom-ref`:string,licenses:array<struct<license:struct<id:string,name:string>,expression:string>>,hashes:array<struct<alg:string,content:string>>,supplier:struct<name:string>,publisher:string>"
SPDX = "struct<SPDXID:string,name:string,versionInfo:string,licenseConcluded:string,licenseDeclared:string,supplier:string,originator:string,externalRefs:array<struct<referenceCategory:string,referenceType:string,referenceLocator:string>>,checksums:array<struct<algorithm:string,checksumValue:string>>>"
SYFT = "id string, name string, version string, purl string, type string, language string, foundBy string, metadataType string, metadata string, locations array<struct<path:string>>, licenses array<struct<value:string,spdxExpression:string>>, cpes array<struct<cpe:string>>"
SYFT_STRINGS, SYFT_LISTS = ("id", "name", "version", "purl", "type", "language", "foundBy", "metadataType"), ("locations", "licenses", "cpes")
FIELDS = ("cpes", "bom_ref", "spdxid", "namespace", "language", "found_by", "type", "syft_id", "locations", "name", "version", "purl", "licenses", "hashes", "supplier")
DIGEST = "struct<algorithm:string,value:string>"
STRINGS = "array<string>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """sbom_id (the file), text: whole documents."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("sbom_id"), F.col("value").alias("text"))


def dialect(text: Column) -> Column:
    keys = F.json_object_keys(text)
    has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False))
    field = lambda k: fn.text(F.get_json_object(text, f"$.{k}"))
    cdx = (field("bomFormat") == "CycloneDX") | F.contains(F.lower(field("$schema")), F.lit("cyclonedx"))
    return F.when(cdx, "cyclonedx").when(xml.is_cyclonedx(text), "cyclonedx-xml").when(field("spdxVersion").startswith("SPDX-"), "spdx").when(has("artifacts") & (has("source") | has("distro") | has("descriptor")), "syft").otherwise("unknown")


def _strings(c: Column) -> Column:
    return F.filter(F.coalesce(c, F.array().cast(STRINGS)), lambda x: x.isNotNull() & (x != ""))


def _pairs(c: Column, key: str, value: str) -> Column:
    entries = F.filter(c, lambda h: h[key].isNotNull() & h[value].isNotNull())
    pairs = F.transform(entries, lambda h: F.struct(h[key].alias("key"), h[value].alias("value")))
    last = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"])))
    return F.coalesce(last, F.create_map().cast("map<string,string>"))


def _component(c: Column, **fields: Column) -> dict[str, Column]:
    none, empty = F.lit(""), F.array().cast(STRINGS)
    f = dict.fromkeys(FIELDS, none) | {"cpes": empty, "locations": empty} | fields
    return {k: v if k in ("licenses", "cpes", "locations", "hashes") else fn.text(v) for k, v in f.items()}


def _cyclonedx(c: Column) -> dict[str, Column]:
    licenses = F.transform(c["licenses"], lambda x: F.coalesce(F.nullif(x["license"]["id"], F.lit("")), x["expression"]))
    return _component(c, name=c["name"], version=c["version"], purl=c["purl"], licenses=_strings(licenses), cpes=_strings(F.array(c["cpe"])), hashes=_pairs(c["hashes"], "alg", "content"), bom_ref=c["bom-ref"], namespace=c["group"], supplier=F.coalesce(F.nullif(c["supplier"]["name"], F.lit("")), c["publisher"]), type=c["type"])


def _spdx(c: Column) -> dict[str, Column]:
    said = lambda x: F.when(~F.upper(fn.trim(x)).isin("", "NONE", "NOASSERTION"), x)
    refs = lambda *kinds: F.transform(F.filter(c["externalRefs"], lambda r: r["referenceType"].isin(*kinds)), lambda r: r["referenceLocator"])
    actor = lambda x: F.regexp_replace(F.when(fn.text(x) != "NOASSERTION", fn.text(x)).otherwise(""), r"^(Organization|Person|Tool):\s*", "")
    return _component(c, name=c["name"], version=c["versionInfo"], purl=F.get(F.reverse(_strings(refs("purl"))), F.lit(0)), licenses=_strings(F.array(F.coalesce(said(c["licenseConcluded"]), said(c["licenseDeclared"])))), cpes=_strings(refs("cpe22Type", "cpe23Type")), hashes=_pairs(c["checksums"], "algorithm", "checksumValue"), spdxid=F.regexp_replace(fn.text(c["SPDXID"]), "^SPDXRef-", ""), supplier=F.coalesce(F.nullif(actor(c["supplier"]), F.lit("")), actor(c["originator"])))


def _syft(c: Column) -> dict[str, Column]:
    licenses = F.transform(c["licenses"], lambda x: F.coalesce(F.nullif(x["spdxExpression"], F.lit("")), x["value"]))
    return _component(c, name=c["name"], version=c["version"], purl=c["purl"], licenses=_strings(licenses), cpes=_strings(F.transform(c["cpes"], lambda x: x["cpe"])), hashes=_syft_hashes(c), supplier=fn.trim(F.get_json_object(c["metadata"], "$.maintainer")), syft_id=c["id"], language=c["language"], found_by=c["foundBy"], type=c["type"], locations=_strings(F.transform(c["locations"], lambda x: x["path"])))


def _syft_hashes(c: Column) -> Column:
    """Digests by kind of metadata: all of an archive, a lock entry's, the first of a package's files."""
    md, kind = c["metadata"], c["metadataType"]
    upper = lambda ds: F.transform(F.filter(ds, lambda d: (fn.text(d["algorithm"]) != "") & (fn.text(d["value"]) != "")), lambda d: F.struct(F.upper(d["algorithm"]).alias("alg"), d["value"].alias("content")))
    archive = upper(F.from_json(md, f"digest array<{DIGEST}>")["digest"])
    files = F.slice(upper(F.from_json(md, f"files array<struct<digest:{DIGEST}>>")["files"]["digest"]), 1, 1)
    lock = F.get_json_object(md, "$.integrity")
    split = F.contains(lock, F.lit("-"))
    entry = F.when(fn.text(lock) != "", F.array(F.struct(F.when(split, F.upper(F.substring_index(lock, "-", 1))).otherwise("INTEGRITY").alias("alg"), F.when(split, F.regexp_replace(lock, "(?s)^[^-]*-", "")).otherwise(lock).alias("content"))))
    return _pairs(F.when(kind == "java-archive", archive).when(kind == "javascript-npm-package-lock-entry", entry).when(kind.isin("rpm-db-entry", "rpm-archive", "python-package"), files), "alg", "content")


def _syft_valid(raw: Column) -> Column:
    """An object whose typed fields have the right JSON types; other artifacts are skipped."""
    v = F.try_parse_json(raw)
    kind = lambda k: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")), F.lit("VOID"))
    ok = fn.text(raw).startswith("{") & v.isNotNull()
    for k in SYFT_STRINGS:
        ok = ok & kind(k).isin("STRING", "VOID")
    for k in SYFT_LISTS:
        ok = ok & ((kind(k) == "VOID") | kind(k).startswith("ARRAY<"))
    return ok


def detected(documents: DataFrame) -> DataFrame:
    """sbom_id, text, dialect; a dialect found before is kept."""
    return documents if "dialect" in documents.columns else documents.select("sbom_id", "text", dialect(F.col("text")).alias("dialect"))


def _elements(kind: Column, text: Column) -> Column:
    """The component elements of a document as JSON texts."""
    listed = lambda name: F.from_json(text, f"{name} {STRINGS}")[name]
    of_xml = F.transform(xml.components(xml.bom(text)), lambda c: F.to_json(c))
    return F.when(kind == "cyclonedx", listed("components")).when(kind == "cyclonedx-xml", of_xml).when(kind == "spdx", listed("packages")).when(kind == "syft", listed("artifacts"))


def components(documents: DataFrame) -> DataFrame:
    """sbom_id, ordinal, id, ref, the fields and the raw JSON text of every component of every document."""
    kind, raw = F.col("dialect"), F.col("raw")
    rows = detected(documents).select("sbom_id", "dialect", F.posexplode(_elements(kind, F.col("text"))).alias("ordinal", "raw")).where(raw.startswith("{"))
    rows = rows.where(F.when(kind == "syft", _syft_valid(raw)).otherwise(F.lit(True)))
    parsed = [F.from_json(F.when(kind.isin(*kinds), raw), schema).alias(kinds[0]) for kinds, schema in ((("cyclonedx", "cyclonedx-xml"), CYCLONEDX), (("spdx",), SPDX), (("syft",), SYFT))]
    rows = rows.select("sbom_id", "ordinal", "dialect", F.when(kind.isin("cyclonedx", "syft"), raw).otherwise("").alias("raw"), *parsed)
    cdx, spdx, syft = _cyclonedx(F.col("cyclonedx")), _spdx(F.col("spdx")), _syft(F.col("syft"))
    fields = [F.when(kind == "spdx", spdx[k]).when(kind == "syft", syft[k]).otherwise(cdx[k]).alias(k) for k in FIELDS]
    rows = rows.select("sbom_id", F.col("ordinal").cast("long").alias("ordinal"), *fields, "raw")
    ref = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("bom_ref", "spdxid", "syft_id")], F.lit(""))
    rows = rows.withColumn("id", fn.compute_id(*map(F.col, ("purl", "cpes", "bom_ref", "spdxid", "namespace", "name"))))
    return rows.withColumn("ref", ref)


def parse_warnings(documents: DataFrame) -> DataFrame:
    unknown = detected(documents).where("dialect = 'unknown'")
    return unknown.select(F.col("sbom_id").alias("file"), F.lit("unknown SBOM format").alias("message"))
