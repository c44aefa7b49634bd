"""Component snapshots (before, after) made from the ``part`` table, for queries on driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..tables import growing, read

INFO = {
    "before": {"os_name": "alpine", "os_version": "3.18", "os_pretty_name": "Alpine Linux v3.18", "search_scope": "Squashed", "schema_version": "16.0.1", "tool_name": "scanner", "sbom_author": "ci@example.org", "sbom_timestamp": "2024-01-01T00:00:00Z", "files_count": 1200},
    "after": {"os_name": "alpine", "os_version": "3.19", "os_pretty_name": "Alpine Linux v3.19", "search_scope": "AllLayers", "schema_version": "16.0.4", "tool_name": "scanner", "sbom_author": "", "sbom_timestamp": "2024-02-01T00:00:00Z", "files_count": 1500},
}


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both snapshots with a ``side`` column; ordinal is the part key."""
    k, after = F.col("k"), F.col("side") == "after"
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_brand", "p_type", "p_size")
    p = p.repartition("k")  # a small file of many rows comes in few tasks
    p = p.withColumn("side", F.explode(F.when(k % 10 == 3, F.array(F.lit("after"))).when(k % 10 == 7, F.array(F.lit("before"))).otherwise(F.array(F.lit("before"), F.lit("after")))))
    kind = F.element_at(F.array(*map(F.lit, ("npm", "rpm/amzn", "pypi", "maven/org", "golang"))), (k % 5 + 1).cast("int"))
    major = F.col("p_size") + 1 - F.when(after & (k % 11 == 0), 1).otherwise(0)
    minor = k % 7 + F.when(after & (k % 4 == 0), 1).otherwise(0)
    p = p.withColumn("version", F.concat_ws(".", major.cast("string"), minor.cast("string"), (k % 3).cast("string"))).withColumn("name", F.concat(F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))), F.lit("-"), k.cast("string")))
    p = p.withColumn("purl", F.concat(F.lit("pkg:"), kind, F.lit("/"), "name", F.lit("@"), "version", F.lit("?arch=x")))
    lic = F.element_at(F.array(*map(F.lit, ("MIT", "Apache-2.0", "GPL-3.0-only", "MIT OR Apache-2.0", "", "MIT", "LGPL-2.1", "CC0-1.0"))), (k % 8 + 1).cast("int"))
    lic = F.when(after & (k % 13 == 0), "BSD-3-Clause").otherwise(lic)
    digest = F.sha2(F.concat(k.cast("string"), F.lit(":"), "version", F.when(after & (k % 9 == 0), "x").otherwise("")), 256)
    strings = "array<string>"
    return p.select(
        "side", k.alias("ordinal"), fn.compute_id(F.col("purl"), F.array().cast(strings), F.lit(""), F.lit(""), F.lit(""), F.col("name")).alias("id"), "name", "version", "purl",
        F.when(lic == "", F.array().cast(strings)).otherwise(F.array(lic)).alias("licenses"), F.array().cast(strings).alias("cpes"),
        F.when(k % 6 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("SHA-256"), digest)).alias("hashes"),
        F.concat("p_brand", F.when(after & (k % 17 == 0), "-new").otherwise("")).alias("supplier"),
        F.element_at(F.array(*map(F.lit, ("javascript", "", "python", "java", "go"))), (k % 5 + 1).cast("int")).alias("language"),
        F.when(after & (k % 5 == 4), "").otherwise(F.element_at(F.array(*map(F.lit, ("npm-cataloger", "rpm-cataloger", "python-cataloger", "java-cataloger", "go-cataloger"))), (k % 5 + 1).cast("int"))).alias("found_by"),
        F.lit("library").alias("type"), F.array(F.concat(F.lit("/usr/lib/"), "p_brand", F.lit("/"), k.cast("string"))).alias("locations"),
    )


def edges(comps: DataFrame) -> DataFrame:
    """side, src_id, dst_id, adj_ordinal: k to 3k+1..3k+3, and k to k+5 for every 50th after."""
    k = F.col("ordinal")
    targets = F.when((F.col("side") == "after") & (k % 50 == 0), F.array(3 * k + 1, 3 * k + 2, 3 * k + 3, k + 5)).otherwise(F.array(3 * k + 1, 3 * k + 2, 3 * k + 3))
    wanted = comps.select("side", F.col("id").alias("src_id"), F.posexplode(targets).alias("adj_ordinal", "target"))
    known = comps.select(F.col("side").alias("side2"), F.col("ordinal").alias("target2"), F.col("id").alias("dst_id"))
    return wanted.join(growing(known), (F.col("side") == F.col("side2")) & (F.col("target") == F.col("target2"))).select("side", "src_id", "dst_id", F.col("adj_ordinal").cast("long").alias("adj_ordinal"))


def files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Catalogued files, and relations of component ordinals to paths."""
    k = F.col("p_partkey")
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_size").cast("long").alias("p_size"))
    of = lambda *values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    lib, share = F.concat(F.lit("/usr/lib/"), "p_brand", F.lit("/"), k.cast("string")), F.concat(F.lit("/usr/share/"), "p_brand", F.lit("/"), k.cast("string"), of(".so", ".txt", ""))
    kind = F.when(k % 9 == 0, "SymbolicLink").otherwise("RegularFile")
    row = lambda path, layer, size: [path.alias("path"), F.concat(F.lit("layer-"), (k % layer).cast("string")).alias("layer"), size.alias("size"), kind.alias("file_type"), of("", "text/plain", "application/x-sharedlib", "text/plain").alias("mime")]
    listed = p.where(k % 2 == 0).select(*row(lib, 3, F.col("p_size") * 100)).unionByName(p.select(*row(share, 2, F.col("p_size"))))
    rel = lambda df, path, name: df.select(k.alias("ordinal"), path.alias("path"), F.lit(name).alias("relation"))
    return listed, rel(p.where(k % 3 == 0), share, "contains").unionByName(rel(p.where(k % 4 == 0), lib, "evident-by")).unionByName(rel(p.where(k % 8 == 0), lib, "contains"))


#: The same tables for DuckDB: ``comp`` (licence and hash as scalars, '' when absent) and ``edge``.
SQL = """
WITH RECURSIVE comp AS (
  SELECT side, k AS ordinal, 'pkg:' || (CASE k % 5 WHEN 0 THEN 'npm' WHEN 1 THEN 'rpm' WHEN 2 THEN 'pypi' WHEN 3 THEN 'maven/org' ELSE 'golang' END) || '/' || name AS id,
    name, version, 'pkg:' || (CASE k % 5 WHEN 0 THEN 'npm' WHEN 1 THEN 'rpm/amzn' WHEN 2 THEN 'pypi' WHEN 3 THEN 'maven/org' ELSE 'golang' END) || '/' || name || '@' || version || '?arch=x' AS purl,
    CASE k % 5 WHEN 0 THEN 'npm' WHEN 1 THEN 'rpm' WHEN 2 THEN 'pypi' WHEN 3 THEN 'maven' ELSE 'golang' END AS ptype,
    CASE WHEN side = 'after' AND k % 13 = 0 THEN 'BSD-3-Clause' ELSE (CASE k % 8 WHEN 0 THEN 'MIT' WHEN 1 THEN 'Apache-2.0' WHEN 2 THEN 'GPL-3.0-only' WHEN 3 THEN 'MIT OR Apache-2.0' WHEN 4 THEN '' WHEN 5 THEN 'MIT' WHEN 6 THEN 'LGPL-2.1' ELSE 'CC0-1.0' END) END AS lic,
    CASE WHEN k % 6 = 0 THEN '' ELSE sha256(k || ':' || version || CASE WHEN side = 'after' AND k % 9 = 0 THEN 'x' ELSE '' END) END AS hash,
    p_brand || CASE WHEN side = 'after' AND k % 17 = 0 THEN '-new' ELSE '' END AS supplier,
    CASE k % 5 WHEN 0 THEN 'javascript' WHEN 1 THEN '' WHEN 2 THEN 'python' WHEN 3 THEN 'java' ELSE 'go' END AS language,
    CASE k % 5 WHEN 0 THEN 'npm-cataloger' WHEN 1 THEN 'rpm-cataloger' WHEN 2 THEN 'python-cataloger' WHEN 3 THEN 'java-cataloger' ELSE (CASE WHEN side = 'after' THEN '' ELSE 'go-cataloger' END) END AS found_by,
    '/usr/lib/' || p_brand || '/' || k AS location
  FROM (
    SELECT s.side, p_partkey AS k, p_brand, lower(replace(p_name, ' ', '-')) || '-' || p_partkey AS name,
      (p_size + 1 - CASE WHEN s.side = 'after' AND p_partkey % 11 = 0 THEN 1 ELSE 0 END) || '.' || (p_partkey % 7 + CASE WHEN s.side = 'after' AND p_partkey % 4 = 0 THEN 1 ELSE 0 END) || '.' || (p_partkey % 3) AS version
    FROM part, (VALUES ('before'), ('after')) s(side)
    WHERE NOT (s.side = 'before' AND p_partkey % 10 = 3) AND NOT (s.side = 'after' AND p_partkey % 10 = 7)
  ) x
), b AS (SELECT * FROM comp WHERE side = 'before'), a AS (SELECT * FROM comp WHERE side = 'after'),
ch AS (
  SELECT b.id, b.name, b.ptype, b.version AS version_from, a.version AS version_to, b.lic AS lic_from, a.lic AS lic_to, b.hash AS hash_from, a.hash AS hash_to, b.supplier AS supplier_from, a.supplier AS supplier_to,
    CASE WHEN b.version = a.version AND b.hash <> a.hash THEN 'integrity' WHEN b.version <> a.version THEN 'version' WHEN b.lic <> a.lic THEN 'metadata' ELSE 'none' END AS drift
  FROM b JOIN a ON a.id = b.id WHERE b.version <> a.version OR b.lic <> a.lic OR (b.hash <> a.hash AND b.hash <> '' AND a.hash <> '')
), added AS (SELECT * FROM a WHERE id NOT IN (SELECT id FROM b)), removed AS (SELECT * FROM b WHERE id NOT IN (SELECT id FROM a)),
edge AS (
  SELECT DISTINCT s.side, s.id AS src_id, d.id AS dst_id
  FROM comp s JOIN comp d ON d.side = s.side AND (d.ordinal IN (3 * s.ordinal + 1, 3 * s.ordinal + 2, 3 * s.ordinal + 3) OR (s.side = 'after' AND s.ordinal % 50 = 0 AND d.ordinal = s.ordinal + 5))
), roots AS (SELECT side, id FROM comp WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.side = comp.side AND e.dst_id = comp.id))
"""
REACH = """, reach(side, root, node, depth) AS (
  SELECT r.side, r.id, e.dst_id, 1 FROM roots r JOIN edge e ON e.side = r.side AND e.src_id = r.id
  UNION
  SELECT t.side, t.root, e.dst_id, t.depth + 1 FROM reach t JOIN edge e ON e.side = t.side AND e.src_id = t.node WHERE t.depth < 40
), far AS (SELECT side, root, node, min(depth) AS depth FROM reach WHERE node <> root GROUP BY ALL)
"""
#: The file catalogue of the after side: ``file`` and ``rel``.
FILES = SQL + """, listed AS (
  SELECT '/usr/lib/' || p_brand || '/' || p_partkey AS path, 'layer-' || (p_partkey % 3) AS layer, CAST(p_size AS BIGINT) * 100 AS size, p_partkey AS k FROM part WHERE p_partkey % 2 = 0
  UNION ALL SELECT '/usr/share/' || p_brand || '/' || p_partkey || (CASE p_partkey % 3 WHEN 0 THEN '.so' WHEN 1 THEN '.txt' ELSE '' END), 'layer-' || (p_partkey % 2), CAST(p_size AS BIGINT), p_partkey FROM part
), file AS (
  SELECT path, layer, size, CASE WHEN k % 9 = 0 THEN 'SymbolicLink' ELSE 'RegularFile' END AS file_type, CASE k % 4 WHEN 0 THEN '' WHEN 2 THEN 'application/x-sharedlib' ELSE 'text/plain' END AS mime FROM listed
  UNION ALL SELECT DISTINCT location, '', CAST(0 AS BIGINT), '', '' FROM a WHERE location NOT IN (SELECT path FROM listed)
), rel AS (
  SELECT ordinal, path, arg_min(relation, r) AS relation FROM (
    SELECT p_partkey AS ordinal, '/usr/share/' || p_brand || '/' || p_partkey || '.so' AS path, 'contains' AS relation, 1 AS r FROM part WHERE p_partkey % 3 = 0
    UNION ALL SELECT p_partkey, '/usr/lib/' || p_brand || '/' || p_partkey, 'contains', 1 FROM part WHERE p_partkey % 8 = 0
    UNION ALL SELECT p_partkey, '/usr/lib/' || p_brand || '/' || p_partkey, 'evident-by', 2 FROM part WHERE p_partkey % 4 = 0
    UNION ALL SELECT ordinal, location, 'location', 3 FROM a) WHERE ordinal IN (SELECT ordinal FROM a) AND path IN (SELECT path FROM file) GROUP BY ALL
)
"""
