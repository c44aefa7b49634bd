"""CycloneDX XML documents, brought to the shape of the JSON schema by ``from_xml``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMED = "struct<name:string,version:string>"
COMPONENT = "struct<_type:string,`_bom-ref`:string,supplier:struct<name:string>,publisher:string,group:string,name:string,version:string,purl:string,cpe:string,hashes:struct<hash:array<struct<_alg:string,_VALUE:string>>>,licenses:struct<license:array<struct<id:string,name:string>>,expression:array<string>>>"
BOM = (
    f"metadata struct<timestamp:string,tools:struct<tool:array<{NAMED}>,components:struct<component:array<{NAMED}>>>,authors:struct<author:array<struct<name:string>>>,component:struct<_type:string,name:string,version:string>,supplier:struct<name:string>,properties:struct<property:array<struct<_name:string,_VALUE:string>>>>, "
    f"components struct<component:array<{COMPONENT}>>, dependencies struct<dependency:array<struct<_ref:string,dependency:array<struct<_ref:string>>>>>"
)


def is_cyclonedx(text: Column) -> Column:
    """A root element ``bom`` in the CycloneDX namespace, after white space, marks and comments."""
    head = r"^[\s\x{FEFF}]*(?:<\?[^>]*\?>\s*|<!--(?s:.)*?-->\s*|<!DOCTYPE[^>]*>\s*)*<(?:[\w.\-]+:)?bom\s[^>]*xmlns(?::[\w.\-]+)?\s*=\s*[\"']http://cyclonedx\.org/schema/bom"
    return F.coalesce(F.regexp_like(text, F.lit(head)), F.lit(False))


def bom(text: Column) -> Column:
    plain = F.regexp_replace(text, r"^[\s\x{FEFF}]+", "")
    return F.from_xml(plain, BOM, {"mode": "PERMISSIVE"})


def components(b: Column) -> Column:
    """The components as structs named like those of the JSON form."""
    licenses = lambda c: F.concat(
        F.coalesce(F.transform(c["licenses"]["license"], lambda x: F.struct(x.alias("license"), F.lit(None).cast("string").alias("expression"))), F.array()),
        F.coalesce(F.transform(c["licenses"]["expression"], lambda x: F.struct(F.lit(None).cast("struct<id:string,name:string>").alias("license"), x.alias("expression"))), F.array()),
    )
    return F.transform(
        b["components"]["component"],
        lambda c: F.struct(
            c["_type"].alias("type"), c["name"].alias("name"), c["version"].alias("version"), c["purl"].alias("purl"), c["cpe"].alias("cpe"), c["group"].alias("group"), c["_bom-ref"].alias("bom-ref"), licenses(c).alias("licenses"),
            F.transform(c["hashes"]["hash"], lambda h: F.struct(h["_alg"].alias("alg"), h["_VALUE"].alias("content"))).alias("hashes"), c["supplier"].alias("supplier"), c["publisher"].alias("publisher"),
        ),
    )


def metadata(b: Column) -> Column:
    m = b["metadata"]
    kind = F.struct(m["component"]["_type"].alias("type"), m["component"]["name"].alias("name"), m["component"]["version"].alias("version"))
    properties = F.transform(m["properties"]["property"], lambda p: F.struct(p["_name"].alias("name"), p["_VALUE"].alias("value")))
    return F.struct(m["timestamp"].alias("timestamp"), kind.alias("component"), m["authors"]["author"].alias("authors"), m["supplier"].alias("supplier"), properties.alias("properties"))


def tool(b: Column) -> Column:
    tools = b["metadata"]["tools"]
    return F.coalesce(F.get(tools["components"]["component"], F.lit(0)), F.get(tools["tool"], F.lit(0)))
