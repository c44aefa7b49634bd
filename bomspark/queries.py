"""The registered queries of the engine over the driver tables, with DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import licenses
from .functions import scalars as fn
from .functions.licenses import valid_expression, valid_spdx
from .operators import diff as df_
from .operators import explore, files, findings, graph, headlines, listing, profile, rules
from .operators.bundle import Bundle
from .operators.search_index import SearchIndex
from .plans.adaptor import FILES, INFO, REACH, SQL, components, edges
from .plans.adaptor import files as file_tables
from .sinks import lines
from .tables import read, settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
LIST = ["name", "version", "purl", "licenses", "hashes"]


def query(key: str, sql: str | None, base: str = SQL):
    def register(f):
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = f"{base} {sql}" if base else sql
        return f

    return register


class Snapshots:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.all = components(spark, sf_dir)
        self.before, self.after = (self.all.where(F.col("side") == s).drop("side") for s in ("before", "after"))
        self.edges = edges(self.all)
        self.diff = df_.diff(self.before, self.after)

    def edges_of(self, side: str) -> DataFrame:
        return self.edges.where(F.col("side") == side).drop("side")


def scalar(key: str, column: Callable[[], object], sql: str) -> None:
    """A function over every component of both snapshots."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return components(spark, sf_dir).select("side", "ordinal", column().alias("out"))

    query(key, f"SELECT side, ordinal, {sql} AS out FROM comp")(run)


C = F.col
scalar("fn_trim", lambda: fn.trim(F.concat(F.lit(" \t\n"), C("name"), F.lit(" \r"))), "name")
scalar("fn_normalize_name", lambda: fn.normalize_name(F.concat(F.lit("\t"), F.upper("name"), F.lit(" "))), "name")
scalar("fn_normalize_license", lambda: fn.normalize_license(F.when(C("ordinal") % 3 == 0, "mit ").when(C("ordinal") % 3 == 1, "NoAssertion").otherwise(C("supplier"))), "CASE ordinal % 3 WHEN 0 THEN 'MIT' WHEN 1 THEN '' ELSE supplier END")
scalar("fn_normalize_purl", lambda: fn.normalize_purl(C("purl")), r"regexp_replace(regexp_replace(split_part(split_part(purl, '#', 1), '?', 1), '@[^@]*$', ''), '^pkg:(rpm|deb|apk|alpm)/[^/]*/', 'pkg:\1/')")
scalar("fn_purl_version", lambda: fn.purl_version(F.replace("purl", F.lit("."), F.lit("%2E"))), "version")
scalar("fn_purl_type", lambda: fn.purl_type(F.when(C("ordinal") % 2 == 0, C("purl")).otherwise(C("name"))), "CASE WHEN ordinal % 2 = 0 THEN ptype ELSE 'unknown' END")
scalar("fn_pkg_type", lambda: fn.pkg_type(C("purl")), "ptype")
scalar("fn_effective_type", lambda: fn.effective_type(F.lit(""), C("id")), "ptype")
scalar("fn_stats_type", lambda: fn.stats_type(F.lit(""), C("name"), C("type")), "'library'")
scalar("fn_normalize_cpe", lambda: fn.normalize_cpe(F.when(C("ordinal") % 3 == 0, F.concat(F.lit("cpe:2.3:a:vend:"), C("name"), F.lit(":1:*"))).when(C("ordinal") % 3 == 1, F.concat(F.lit("cpe:/a:vend:"), C("name"), F.lit(":2"))).otherwise("cpe:2.3:a:*:x")), "CASE ordinal % 3 WHEN 2 THEN '' ELSE 'cpe:vend:' || name END")
scalar("fn_tool_split", lambda: F.concat_ws("|", *fn.tool_split(F.concat(F.lit("scan-tool-"), C("version")))), "'scan-tool|' || version")
scalar("fn_compute_id", lambda: fn.compute_id(F.when(C("ordinal") % 4 == 0, C("purl")).otherwise(""), F.when(C("ordinal") % 4 == 1, F.array(F.lit("cpe:/a:v:p"))), F.when(C("ordinal") % 4 == 2, C("name")).otherwise(""), F.lit(""), F.lit("ns"), C("name")), "CASE ordinal % 4 WHEN 0 THEN id WHEN 1 THEN 'cpe:v:p' WHEN 2 THEN 'ref:' || name ELSE 'ns/' || name END")
scalar("fn_license_category", lambda: fn.license_category(F.coalesce(F.get("licenses", F.lit(0)), F.lit(""))), "CASE WHEN regexp_matches(upper(lic), 'GPL|MPL|EPL|CPL|CDDL|EUPL') THEN 'copyleft' WHEN regexp_matches(upper(lic), 'MIT|BSD|APACHE|ISC|ZLIB|UNLICENSE|WTFPL|CC0|EXPAT|X11') THEN 'permissive' ELSE 'unknown' END")
scalar("fn_version_parts", lambda: F.array_join(F.transform(fn.version_parts(F.concat(F.lit("v."), C("version"), F.lit("rc-7"))), lambda x: x.cast("string")), ","), "replace(version, '.', ',') || ',7'")
scalar("fn_path_prefix", lambda: fn.path_prefix(C("locations")), "regexp_extract(location, '^(/[^/]*/[^/]*/[^/]*)', 1)")
scalar("fn_fmt_count", lambda: fn.fmt_count(C("ordinal") * 1001), "format('{:,}', ordinal * 1001)")
scalar("fn_pct", lambda: C("ordinal") * 100 / 7, "CAST(ordinal * 100 AS DOUBLE) / 7")
scalar("fn_multiset_eq", lambda: fn.multiset_eq(F.array("name", "supplier"), F.array("supplier", F.when(C("ordinal") % 2 == 0, C("name")).otherwise("x"))), "ordinal % 2 = 0")
scalar("fn_has_contact", lambda: fn.has_contact(F.when(C("ordinal") % 3 == 0, "a@b").when(C("ordinal") % 3 == 1, "https://x").otherwise("http:/x")), "ordinal % 3 < 2")
scalar("fn_has_lookup_id", lambda: fn.has_lookup_id(F.when(C("ordinal") % 2 == 0, C("purl")).otherwise(""), C("cpes")), "ordinal % 2 = 0")
scalar("fn_valid_spdx", lambda: valid_spdx(C("licenses")), "lic NOT IN ('', 'NOASSERTION')")
scalar("fn_valid_expression", lambda: valid_expression(F.concat(F.when(C("ordinal") % 3 == 0, "((").otherwise("("), F.coalesce(F.get("licenses", F.lit(0)), F.lit("")), F.lit(") AND gpl-2.0+ WITH Classpath-exception-2.0"), F.when(C("ordinal") % 3 == 0, " OR LicenseRef-x)").when(C("ordinal") % 3 == 1, " OR no-such-id").otherwise(""))), "lic <> '' AND ordinal % 3 <> 1")
scalar("fn_hash_alg", lambda: F.concat_ws("|", *[fn.hash_alg(F.when(C("ordinal") % 2 == 0, "sha-256").otherwise("blake3"), t) for t in ("cyclonedx", "spdx")]), "CASE ordinal % 2 WHEN 0 THEN 'SHA-256|SHA256' ELSE 'BLAKE3|BLAKE3' END")
scalar("fn_cdx_type", lambda: fn.cdx_type(F.when(C("ordinal") % 2 == 0, "Firmware").otherwise("npm")), "CASE ordinal % 2 WHEN 0 THEN 'firmware' ELSE 'library' END")
scalar("fn_bom_ref", lambda: fn.bom_ref(F.lit(""), F.when(C("ordinal") % 2 == 0, C("purl")).otherwise(""), C("name"), C("version"), C("id")), "CASE ordinal % 2 WHEN 0 THEN purl ELSE name || '@' || version END")
scalar("fn_spdx_id", lambda: fn.spdx_id(F.lit(""), C("name"), F.concat(C("version"), F.lit("+x")), C("ordinal")), "regexp_replace(name || '-' || version || '+x', '[^a-zA-Z0-9.-]', '-', 'g')")
scalar("fn_syft_type", lambda: fn.syft_type(C("purl"), F.lit("")), "CASE ptype WHEN 'pypi' THEN 'python' WHEN 'maven' THEN 'java-archive' WHEN 'golang' THEN 'go-module' ELSE ptype END")
scalar("fn_glob", lambda: fn.glob_match(F.get("locations", F.lit(0)), "/usr/**/*1?"), "regexp_matches(location, '^/usr/(?:.*/)?[^/]*1[^/]$')")
scalar("fn_path_parts", lambda: F.concat_ws("|", fn.dirname(F.get("locations", F.lit(0))), fn.basename(F.get("locations", F.lit(0)))), "'/usr/lib/' || split_part(location, '/', 4) || '|' || ordinal")
scalar("fn_breadcrumbs", lambda: F.array_join(fn.breadcrumbs(F.get("locations", F.lit(0))), ","), "'/,/usr,/usr/lib,/usr/lib/' || split_part(location, '/', 4) || ',' || location")
scalar("fn_search_text", lambda: fn.search_text({c: C(c) for c in ("name", "version", "purl", "id", "supplier", "cpes", "licenses")}), "lower(name || ' ' || version || ' ' || purl || ' ' || id || ' ' || supplier || '  ' || lic)")
scalar("prj_normalize", lambda: F.struct(fn.normalize_name(C("name")).alias("n"), F.array_join(fn.normalize_licenses(C("licenses")), ",").alias("l")).cast("string"), "'{' || name || ', ' || lic || '}'")


def snap(key: str, sql: str | None):
    """A query of the two snapshots."""

    def register(f: Callable[[Snapshots], DataFrame]):
        query(key, sql)(lambda spark, sf_dir: f(Snapshots(spark, sf_dir)))
        return f

    return register


PAIR = ("b.version", "a.version", "b.licenses", "a.licenses", "b.hashes", "a.hashes")
snap("fn_compare_versions", "SELECT id, CASE WHEN list_transform(string_split(version_from, '.'), lambda x: CAST(x AS BIGINT)) < list_transform(string_split(version_to, '.'), lambda x: CAST(x AS BIGINT)) THEN 1 WHEN version_from = version_to THEN 0 ELSE -1 END AS out FROM ch")(lambda s: s.diff.changed.select("id", fn.compare_versions(C("b.version"), C("a.version")).alias("out")))
snap("fn_semver_class", "SELECT id, CASE WHEN split_part(version_from, '.', 1) <> split_part(version_to, '.', 1) THEN 'major' WHEN split_part(version_from, '.', 2) <> split_part(version_to, '.', 2) THEN 'minor' ELSE 'patch' END AS out FROM ch")(lambda s: s.diff.changed.select("id", fn.semver_class(C("b.version"), C("a.version")).alias("out")))
snap("fn_hash_diff", "SELECT id, CASE WHEN hash_from <> '' AND hash_to <> '' AND hash_from <> hash_to THEN 1 ELSE 0 END AS n_changed FROM ch")(lambda s: s.diff.changed.select("id", F.size(fn.hash_diff(C("b.hashes"), C("a.hashes"))["changed"]).alias("n_changed")))
CHANGES = "array_to_string(list_filter([CASE WHEN version_from <> version_to THEN 'version: ' || version_from || ' -> ' || version_to END, CASE WHEN lic_from <> lic_to THEN 'licenses: [' || lic_from || '] -> [' || lic_to || ']' END, CASE WHEN hash_from <> '' AND hash_to <> '' AND hash_from <> hash_to THEN 'hash[SHA-256]: ' || hash_from || ' -> ' || hash_to END], lambda x: x IS NOT NULL), '; ')"
for _key in ("fn_change_strings", "drift_changes"):
    snap(_key, f"SELECT id, {CHANGES} AS changes FROM ch")(lambda s: s.diff.changed.select("id", F.array_join(fn.change_strings(*map(C, PAIR)), "; ").alias("changes")))
snap("flt_packages", "SELECT side, ordinal, id FROM comp")(lambda s: profile.packages(s.all).select("side", "ordinal", "id"))
snap("flt_changed", "SELECT id FROM ch")(lambda s: s.diff.changed.select("id"))
snap("jn_first_wins", "SELECT id, name, version FROM b")(lambda s: df_.first_wins(s.before).select("id", "name", "version"))
snap("jn_added", "SELECT id, name, version FROM added")(lambda s: s.diff.added.select("id", "name", "version"))
snap("jn_removed", "SELECT id, name, version FROM removed")(lambda s: s.diff.removed.select("id", "name", "version"))
snap("jn_changed", "SELECT id, name, version_from, version_to FROM ch")(lambda s: s.diff.changed.select("id", "name", C("b.version").alias("version_from"), C("a.version").alias("version_to")))
snap("jn_full_diff", "SELECT coalesce(b.id, a.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' WHEN ch.id IS NOT NULL THEN 'changed' ELSE 'same' END AS status, coalesce(ch.drift, '') AS drift FROM b FULL JOIN a ON a.id = b.id LEFT JOIN ch ON ch.id = b.id")(lambda s: s.diff.rows.select("id", "status", F.coalesce("drift", F.lit("")).alias("drift")))
snap("drift_classify", "SELECT id, drift FROM ch")(lambda s: s.diff.changed.select("id", "drift"))
snap("set_license_delta", "SELECT id, CASE WHEN lic_from = lic_to THEN '' ELSE trim(CASE WHEN lic_to <> '' THEN '+' || lic_to ELSE '' END || ',' || CASE WHEN lic_from <> '' THEN '-' || lic_from ELSE '' END, ',') END AS delta FROM ch")(lambda s: s.diff.changed.select("id", F.array_join(df_.license_delta(C("b.licenses"), C("a.licenses")), ",").alias("delta")))
snap("agg_drift_summary", "SELECT count(*) FILTER (drift = 'version') AS version_drift, count(*) FILTER (drift = 'integrity') AS integrity_drift, count(*) FILTER (drift = 'metadata') AS metadata_drift FROM ch")(lambda s: s.diff.drift_summary())
COUNTS = "(SELECT count(*) FROM added) AS added, (SELECT count(*) FROM removed) AS removed, (SELECT count(*) FROM ch) AS changed, (SELECT count(*) FROM ch WHERE drift = 'integrity') AS integrity"
snap("agg_report_counts", f"SELECT {COUNTS}")(lambda s: s.diff.counts())
PROFILE = "count(*) AS total, count(*) FILTER (lic = '') AS without_license, count(*) FILTER (hash <> '') AS with_hashes, count(*) FILTER (hash = '') AS without_hashes, CAST(0 AS BIGINT) AS with_cpes, count(*) AS with_purl, count(*) FILTER (regexp_matches(upper(lic), 'GPL')) AS lic_copyleft, count(*) FILTER (NOT regexp_matches(upper(lic), 'GPL') AND lic <> '') AS lic_permissive, CAST(0 AS BIGINT) AS lic_public_domain, count(*) FILTER (lic = '') AS lic_unknown"
snap("agg_profile", f"SELECT {PROFILE} FROM b")(lambda s: profile.profile(s.before))
snap("agg_overview", f"SELECT side, {PROFILE} FROM comp GROUP BY side")(lambda s: profile.profile(s.all, "side"))
snap("agg_license_category", "SELECT CASE WHEN regexp_matches(lic, 'GPL') THEN 'copyleft' WHEN lic = '' THEN 'unknown' ELSE 'permissive' END AS key, count(*) AS count FROM a GROUP BY 1")(lambda s: s.after.groupBy(fn.license_category(F.coalesce(F.get("licenses", F.lit(0)), F.lit(""))).alias("key")).count())
snap("agg_by_type", "SELECT side, ptype AS key, count(*) AS count FROM comp GROUP BY ALL")(lambda s: profile.by_type(s.all, "side"))
snap("agg_by_license", "SELECT side, lic AS key, count(*) AS count FROM comp WHERE lic <> '' GROUP BY ALL")(lambda s: profile.by_license(s.all, "side"))
snap("agg_by_language", "SELECT side, language AS key, count(*) AS count FROM comp WHERE language <> '' GROUP BY ALL")(lambda s: profile.by_column(s.all, "language", "side"))
snap("agg_by_found_by", "SELECT side, found_by AS key, count(*) AS count FROM comp WHERE found_by <> '' GROUP BY ALL")(lambda s: profile.by_column(s.all, "found_by", "side"))
snap("agg_count_if", "SELECT count(*) FILTER (lic = 'MIT') AS n FROM b")(lambda s: s.before.agg(F.count_if(F.array_contains("licenses", "MIT")).alias("n")))
snap("agg_coverage", "SELECT side, count(*) AS total, count(*) FILTER (hash <> '') AS hashes, count(*) FILTER (lic <> '') AS licenses FROM comp GROUP BY side")(lambda s: s.all.groupBy("side").agg(F.count("*").alias("total"), F.count_if(F.size("hashes") > 0).alias("hashes"), F.count_if(F.size("licenses") > 0).alias("licenses")))
snap("agg_path_prefix", "SELECT side, regexp_extract(location, '^(/[^/]*/[^/]*/[^/]*)', 1) AS key, count(*) AS count FROM comp GROUP BY ALL")(lambda s: profile.by_prefix(s.all, "side"))
snap("agg_dominant_pattern", "SELECT ptype || ' ' || regexp_extract(location, '^(/[^/]*/[^/]*/[^/]*)', 1) AS key, count(*) AS count FROM removed GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")(lambda s: profile.top(s.diff.removed.groupBy(F.concat_ws(" ", fn.effective_type(C("purl"), C("id")), fn.path_prefix(C("locations"))).alias("key")).count(), 1))
snap("agg_samples_by_type", "SELECT * FROM (SELECT ptype AS type, id, count(*) OVER (PARTITION BY ptype) AS total, CAST(row_number() OVER (PARTITION BY ptype ORDER BY id) AS INTEGER) AS rank FROM added) WHERE rank <= 5")(lambda s: df_.samples_by_type(s.diff.added))
snap("topk_by_value", "SELECT lic AS key, count(*) AS count FROM a WHERE lic <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")(lambda s: profile.top(profile.by_license(s.after), 3))
snap("topk_licenses", "SELECT side, key, count FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY count DESC, key) AS r FROM (SELECT side, lic AS key, count(*) AS count FROM comp WHERE lic <> '' GROUP BY ALL)) WHERE r <= 10")(lambda s: profile.top(profile.by_license(s.all, "side"), 10, "side"))
snap("sort_by_name", "SELECT name, ordinal FROM b ORDER BY name, ordinal LIMIT 50")(lambda s: s.before.orderBy("name", "ordinal").select("name", "ordinal").limit(50))
snap("sort_by_name_all", "SELECT name, ordinal FROM b ORDER BY name, ordinal")(lambda s: s.before.orderBy("name", "ordinal").select("name", "ordinal"))
snap("page_components", "SELECT ordinal, id FROM b ORDER BY ordinal LIMIT 20 OFFSET 40")(lambda s: explore.page(s.before, 40, 20).select("ordinal", "id"))
snap("page_directory", "SELECT split_part(location, '/', 4) AS name, true AS is_dir, count(*) AS files FROM b GROUP BY 1")(lambda s: explore.directory(s.before.select(F.explode("locations").alias("path")), "/usr/lib"))
snap("flt_search", "SELECT ordinal FROM a WHERE contains(lower(name || ' ' || version || ' ' || purl || ' ' || id || ' ' || supplier || '  ' || lic), 'gpl')")(lambda s: explore.search(s.after, "GPL").select("ordinal"))
snap("flt_search_type", "SELECT ordinal FROM a WHERE contains(lower(name || ' ' || version || ' ' || purl || ' ' || id || ' ' || supplier || '  ' || lic), 'mit') AND contains(ptype, 'np')")(lambda s: explore.search(s.after, "mit", "np").select("ordinal"))
snap("flt_lookup", "SELECT id, name, version FROM b WHERE id = (SELECT id FROM b WHERE ordinal = 12)")(lambda s: explore.lookup(s.before, s.before.where("ordinal = 12").first()["id"]).select("id", "name", "version"))
snap("flt_files", "SELECT ordinal FROM a WHERE regexp_matches(location, '/[^/]*8$')")(lambda s: explore.filter_files(s.after.select("ordinal", F.get("locations", F.lit(0)).alias("path")), "*8").select("ordinal"))
snap("set_type_union", "SELECT coalesce(x.k, y.k) AS key, coalesce(x.n, 0) AS before, coalesce(y.n, 0) AS after FROM (SELECT ptype k, count(*) n FROM b GROUP BY 1) x FULL JOIN (SELECT ptype k, count(*) n FROM a GROUP BY 1) y ON x.k = y.k")(lambda s: profile.by_type(s.before).withColumnRenamed("count", "x").join(profile.by_type(s.after).withColumnRenamed("count", "y"), "key", "full").select("key", F.coalesce("x", F.lit(0)).alias("before"), F.coalesce("y", F.lit(0)).alias("after")))
snap("set_intersect_files", "SELECT location AS path FROM a WHERE lic = 'MIT' INTERSECT SELECT location FROM b WHERE hash <> ''")(lambda s: s.after.where(F.array_contains("licenses", "MIT")).select(F.explode("locations").alias("path")).intersect(s.before.where(F.size("hashes") > 0).select(F.explode("locations").alias("path"))))

# Duplicates and collisions on lineitem: id = part and supplier, version = line number, hash = quantity.
ITEMS = "WITH i AS (SELECT l_partkey || '/' || l_suppkey AS id, CAST(l_linenumber AS VARCHAR) AS version, l_returnflag AS name, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS hash, l_shipdate < TIMESTAMP '1995-06-01' AS early FROM lineitem), d AS (SELECT id, count(*) AS count, array_to_string(list_sort(list_distinct(list(version))), ',') AS versions FROM i GROUP BY id HAVING count(*) > 1)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.concat_ws("/", C("l_partkey").cast("string"), C("l_suppkey").cast("string")).alias("id"), C("l_linenumber").cast("string").alias("version"), C("l_returnflag").alias("name"), F.create_map(F.lit("Q"), C("l_quantity").cast("bigint").cast("string")).alias("hashes"), (C("l_shipdate") < F.lit("1995-06-01").cast("timestamp")).alias("early"), C("l_orderkey").alias("ordinal")
    )


query("agg_duplicates", "SELECT * FROM d", ITEMS)(lambda spark, d: df_.duplicates(items(spark, d)).select("id", "count", F.array_join("versions", ",").alias("versions")))
query("jn_dup_versions", "SELECT coalesce(x.id, y.id) AS id, CASE WHEN x.id IS NULL THEN 'new' WHEN y.id IS NULL THEN 'resolved' ELSE 'kept' END AS status FROM (SELECT id, list_sort(list_distinct(list(version))) v FROM i WHERE early GROUP BY 1 HAVING count(*) > 1) x FULL JOIN (SELECT id, list_sort(list_distinct(list(version))) v FROM i WHERE NOT early GROUP BY 1 HAVING count(*) > 1) y ON x.id = y.id WHERE x.id IS NULL OR y.id IS NULL OR x.v <> y.v", ITEMS)(lambda spark, d: df_.duplicate_version_diff(items(spark, d).where("early"), items(spark, d).where("not early")).select("id", "status"))
query("agg_collision_name", "SELECT id FROM i GROUP BY id HAVING count(DISTINCT name) > 1", ITEMS)(lambda spark, d: df_.collisions(items(spark, d)).where("reason = 'name_mismatch'").select("id"))
query("agg_collision_hash", "SELECT DISTINCT id FROM (SELECT id, version FROM i GROUP BY ALL HAVING count(DISTINCT hash) > 1) WHERE id NOT IN (SELECT id FROM i GROUP BY id HAVING count(DISTINCT name) > 1)", ITEMS)(lambda spark, d: df_.collisions(items(spark, d)).where("reason = 'hash_mismatch'").select("id"))
query("agg_relationships", "SELECT event_type AS key, count(*) AS count FROM events GROUP BY 1", "")(lambda spark, d: read(spark, d, "events").groupBy(C("event_type").alias("key")).count())
query("topk_extensions", "SELECT regexp_extract(url, '(\\.[^./]*)$', 1) AS key, count(*) AS count FROM (SELECT split_part(split_part(url, '?', 1), '#', 1) AS url FROM pages) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15", "")(lambda spark, d: profile.top(read(spark, d, "pages").select(fn.extension(F.substring_index(F.substring_index("url", "?", 1), "#", 1)).alias("key")).groupBy("key").count(), 15))

# Graphs.
snap("gr_edges", "SELECT side, src_id, dst_id FROM edge")(lambda s: s.edges.select("side", "src_id", "dst_id").distinct())
snap("gr_roots", "SELECT id FROM roots WHERE side = 'after'")(lambda s: graph.roots(s.after, s.edges_of("after")))
snap("jn_edge_diff", "SELECT src_id, CASE side WHEN 'after' THEN 'added' ELSE 'removed' END AS change, string_agg(dst_id, ',' ORDER BY dst_id) AS targets FROM edge e WHERE NOT EXISTS (SELECT 1 FROM edge o WHERE o.side <> e.side AND o.src_id = e.src_id AND o.dst_id = e.dst_id) GROUP BY ALL")(lambda s: graph.edge_diff(s.edges_of("before"), s.edges_of("after")).select("src_id", "change", F.array_join("targets", ",").alias("targets")))
def bundle_of(s: Snapshots) -> Bundle:
    return Bundle.build({side: (getattr(s, side), s.edges_of(side)) for side in ("before", "after")})


def reached(s: Snapshots, side: str) -> DataFrame:
    b = Bundle.build({side: (getattr(s, side), s.edges_of(side))})
    return b.named(b.reach(side, b.roots(side)))


query("gr_reachable", SQL + REACH + " SELECT root, node FROM far WHERE side = 'after'", "")(lambda spark, d: reached(Snapshots(spark, d), "after").select("root", "node"))
query("gr_shortest_path", SQL + REACH + " SELECT root, node, depth, CAST(depth + 1 AS INTEGER) AS path_nodes FROM far WHERE side = 'before'", "")(lambda spark, d: reached(Snapshots(spark, d), "before").select("root", "node", "depth", (F.col("depth") + 1).alias("path_nodes")))


def transitive(s: Snapshots, side: str) -> DataFrame:
    return bundle_of(s).transitive(side, "before" if side == "after" else "after", paths=False)


def _transitive_sql(side: str) -> str:
    other = "before" if side == "after" else "after"
    return SQL + REACH + f""", beyond AS (
  SELECT f.root, f.node, f.depth FROM far f WHERE f.side = '{side}' AND f.depth > 1 AND NOT EXISTS (SELECT 1 FROM reach2 o WHERE o.root = f.root AND o.node = f.node)
) SELECT arg_min(root, root) AS root, node AS target, arg_min(depth, root) AS depth FROM beyond GROUP BY node""".replace("reach2", "far3").replace(", beyond AS", f""", far2(root, node, depth) AS (
  SELECT r.id, e.dst_id, 1 FROM roots r JOIN edge e ON e.side = '{other}' AND e.src_id = r.id WHERE r.side = '{side}'
  UNION SELECT t.root, e.dst_id, t.depth + 1 FROM far2 t JOIN edge e ON e.side = '{other}' AND e.src_id = t.node WHERE t.depth < 40
), far3 AS (SELECT DISTINCT root, node FROM far2), beyond AS""")


query("gr_transitive_new", _transitive_sql("after"), "")(lambda spark, d: transitive(Snapshots(spark, d), "after").select("root", "target", "depth"))
query("gr_transitive_lost", _transitive_sql("before"), "")(lambda spark, d: transitive(Snapshots(spark, d), "before").select("root", "target", "depth"))
query("agg_depth_summary", f"SELECT count(*) FILTER (depth = 1) AS depth_1, count(*) FILTER (depth = 2) AS depth_2, count(*) FILTER (depth >= 3) AS depth_3_plus FROM ({_transitive_sql('after')})", "")(lambda spark, d: graph.depth_summary(transitive(Snapshots(spark, d), "after")))
snap("gr_tree", "SELECT r.id AS root, coalesce(c.dst_id, '') AS child, coalesce(g.dst_id, '') AS grandchild FROM roots r LEFT JOIN edge c ON c.side = 'after' AND c.src_id = r.id LEFT JOIN edge g ON g.side = 'after' AND g.src_id = c.dst_id WHERE r.side = 'after'")(lambda s: graph.tree(s.after, s.edges_of("after")).na.fill(""))
snap("gr_coverage", "SELECT count(DISTINCT id) AS n FROM (SELECT src_id AS id FROM edge WHERE side = 'after' UNION SELECT dst_id FROM edge WHERE side = 'after')")(lambda s: profile.graph_coverage(s.after, s.edges_of("after")).agg(F.count("*").alias("n")))

# Compliance.
COVER = "(SELECT count(DISTINCT id) FROM (SELECT src_id AS id FROM edge WHERE side = 'after' UNION SELECT dst_id FROM edge WHERE side = 'after')) = (SELECT count(*) FROM a)"
_always = {"name": "true", "version": "true", "supplier": "true", "unique-id": "true", "dep-relation": COVER, "license": "(SELECT bool_and(lic <> '') FROM a)", "hash": "(SELECT bool_and(hash <> '') FROM a)"}
_cmp = {
    "ntia": _always | {"author": "true", "timestamp": "true"},
    "cisa": _always | {"tool": "true", "author": "false", "timestamp": "true"},
    "bsi": {"name": "true", "version": "true", "creator": "false", "unique-id": "true", "license": _always["license"], "sha512": "false", "dep-relation": COVER, "author": "false", "timestamp": "true"},
}
_cmp["ntia"] = {k: v for k, v in _cmp["ntia"].items() if k not in ("license", "hash")}
_rows = {s: " UNION ALL ".join(f"SELECT '{s}-{k}' AS check, {v} AS passed" for k, v in checks.items()) for s, checks in _cmp.items()}
for _s in _cmp:
    snap(f"cmp_{_s}", _rows[_s])(lambda s, std=_s: profile.checks(s.after, s.edges_of("after"), INFO["after"], std))
_scores = " UNION ALL ".join(f"SELECT '{s}' AS standard, count(*) FILTER (passed) AS passed, count(*) AS total, CAST(floor(count(*) FILTER (passed) * 100 / count(*)) AS BIGINT) AS score FROM ({r})" for s, r in _rows.items())
snap("cmp_overall", _scores)(lambda s: profile.framework_scores(s.after, s.edges_of("after"), INFO["after"]))

# Policy.
VIOLATION = "SELECT '{rule}' AS rule, {message} AS message, '{severity}' AS severity FROM {rows}"


def brief(rule, message):
    """The short form of a message on a score."""
    name = F.regexp_extract(rule, "^min_([a-z]+)_", 1)
    return F.regexp_replace(F.concat(name, F.regexp_replace(message, "^.*? compliance", "")), r"minimum (\d+).*$", "min $1")


def policy(key: str, knobs: dict, rule: str, message: str, rows: str, severity: str = "error", graph_needed: bool = False, scores: bool = False) -> None:
    def run(s: Snapshots) -> DataFrame:
        new = settle(transitive(s, "after"), "transitive") if graph_needed else None
        found = profile.framework_scores(s.after, s.edges_of("after"), INFO["after"]) if scores else None
        broken = rules.evaluate(rules.Policy(**knobs), s.diff, s.after, new, found).select("rule", "message", "severity")
        return broken.withColumn("message", brief(C("rule"), C("message"))) if scores else broken

    sql = VIOLATION.format(rule=rule, message=message, severity=severity, rows=rows)
    query(key, sql, "" if graph_needed else SQL)(lambda spark, d: run(Snapshots(spark, d)))


for _w in ("added", "removed", "changed"):
    policy(f"pol_max_{_w}", {f"max_{_w}": 5}, f"max_{_w}", f"'{_w} ' || {_w} || ' > max 5'", f"(SELECT {COUNTS}) WHERE {_w} > 5")
policy("pol_deny_licenses", {"deny_licenses": ("CC0-1.0", "Apache-2.0")}, "deny_licenses", "name || ': denied license ' || lic", "added WHERE lic IN ('CC0-1.0', 'Apache-2.0')")
policy("pol_require_licenses", {"require_licenses": True}, "require_licenses", "name || ': no license'", "added WHERE lic = ''")
policy("pol_deny_duplicates", {"deny_duplicates": True}, "deny_duplicates", "n || ' duplicates found'", "(SELECT count(*) AS n FROM (SELECT id FROM a GROUP BY id HAVING count(*) > 1)) WHERE n > 0")
policy("pol_deny_integrity", {"deny_integrity_drift": True}, "deny_integrity_drift", "name || ': hash changed without version change'", "ch WHERE drift = 'integrity'")
policy("pol_warn_supplier", {"warn_supplier_change": True}, "warn_supplier_change", "name || ': supplier \"' || supplier_from || '\" -> \"' || supplier_to || '\"'", "ch WHERE supplier_from <> supplier_to", "warning")
_NEW = _transitive_sql("after")
policy("pol_max_depth", {"max_depth": 3}, "max_depth", "'transitive deps at depth >= 3: [' || t || ']'", f"(SELECT string_agg(d, ' ' ORDER BY d) AS t FROM (SELECT target || ' (depth ' || depth || ')' AS d FROM ({_NEW}) WHERE depth >= 3)) WHERE t IS NOT NULL", graph_needed=True)
policy("pol_warn_transitive", {"warn_new_transitive": True}, "warn_new_transitive", "n || ' new transitive deps'", f"(SELECT count(*) AS n FROM ({_NEW})) WHERE n > 0", "warning", graph_needed=True)
for _n in ("ntia", "cisa", "bsi"):
    policy(f"pol_min_{_n}", {f"min_{_n}_score": 100}, f"min_{_n}_score", f"'{_n} score ' || score || ' < min 100'", f"({_scores}) WHERE standard = '{_n}' AND score < 100", scores=True)
policy("pol_min_overall", {"min_overall_compliance": 100}, "min_overall_compliance", "'overall score ' || score || ' < min 100'", f"(SELECT CAST(floor(avg(score)) AS BIGINT) AS score FROM ({_scores})) WHERE score < 100", scores=True)
snap("pol_verdict", "SELECT 'any-change' AS fail_on, CASE WHEN (SELECT count(*) FROM added) + (SELECT count(*) FROM removed) + (SELECT count(*) FROM ch) > 0 THEN 'fail' ELSE 'pass' END AS verdict")(lambda s: rules.verdict("any-change", s.diff.counts(), rules.evaluate(rules.Policy(max_added=1), s.diff, s.after)))

# Findings over aggregates.
snap("fnd_dominant_type", "SELECT ptype AS key, count(*) AS count FROM a GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")(lambda s: profile.top(profile.by_type(s.after), 3))
snap("fnd_hotspots", "SELECT regexp_extract(location, '^(/[^/]*/[^/]*/[^/]*)', 1) AS key, count(*) AS count FROM a GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4")(lambda s: profile.top(profile.by_prefix(s.after), 4))
snap("fnd_catalogers", "SELECT found_by AS key, count(*) AS count FROM a WHERE found_by <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")(lambda s: profile.top(profile.by_column(s.after, "found_by"), 3))
snap("fnd_cataloger_gaps", "SELECT found_by AS key, count(*) AS count FROM b WHERE found_by <> '' AND found_by NOT IN (SELECT found_by FROM a) GROUP BY 1")(lambda s: rules.gaps(profile.by_column(s.before, "found_by"), profile.by_column(s.after, "found_by")))
snap("fnd_ecosystems", "SELECT coalesce(x.lic, y.lic) AS key, CASE WHEN y.lic IS NULL THEN 'vanished' ELSE 'new' END AS change, coalesce(x.n, y.n) AS count FROM (SELECT lic, count(*) n FROM b WHERE lic <> '' GROUP BY 1) x FULL JOIN (SELECT lic, count(*) n FROM a WHERE lic <> '' GROUP BY 1) y ON x.lic = y.lic WHERE x.lic IS NULL OR y.lic IS NULL")(lambda s: rules.ecosystem_changes(profile.by_license(s.before), profile.by_license(s.after)))
snap("fnd_stable", "SELECT x.k AS key, x.n AS count FROM (SELECT ptype k, count(*) n FROM b GROUP BY 1) x JOIN (SELECT ptype k, count(*) n FROM a GROUP BY 1) y ON x.k = y.k AND x.n = y.n WHERE x.n > 10")(lambda s: rules.stable(profile.by_type(s.before), profile.by_type(s.after)))
snap("fnd_integrity", "SELECT ptype AS key, count(*) AS count FROM ch WHERE drift = 'integrity' GROUP BY 1")(lambda s: s.diff.changed.where("drift = 'integrity'").groupBy(fn.effective_type(C("b.purl"), C("id")).alias("key")).count())
snap("fnd_versions", "SELECT CASE WHEN drift <> 'version' THEN 'other' ELSE CASE WHEN list_transform(string_split(version_from, '.'), lambda x: CAST(x AS BIGINT)) < list_transform(string_split(version_to, '.'), lambda x: CAST(x AS BIGINT)) THEN 'upgrade' ELSE 'downgrade' END END AS key, count(*) AS count FROM ch WHERE drift = 'version' GROUP BY 1")(lambda s: s.diff.changed.where("drift = 'version'").groupBy(F.when(fn.compare_versions(C("b.version"), C("a.version")) > 0, "upgrade").when(fn.compare_versions(C("b.version"), C("a.version")) < 0, "downgrade").otherwise("unclear").alias("key")).count())
snap("fnd_surface", "SELECT (SELECT count(*) FROM b) AS before, (SELECT count(*) FROM a) AS after")(lambda s: s.all.agg(F.count_if(C("side") == "before").alias("before"), F.count_if(C("side") == "after").alias("after")))
snap("fnd_license_shift", "SELECT side, count(*) FILTER (regexp_matches(lic, 'GPL')) AS copyleft, count(*) FILTER (lic <> '' AND NOT regexp_matches(lic, 'GPL')) AS permissive FROM comp GROUP BY side")(lambda s: profile.profile(s.all, "side").select("side", C("lic_copyleft").alias("copyleft"), C("lic_permissive").alias("permissive")))
snap("fnd_license_profile", "SELECT count(*) FILTER (regexp_matches(lic, 'GPL')) AS copyleft, count(*) FILTER (lic <> '' AND NOT regexp_matches(lic, 'GPL')) AS permissive, count(*) FILTER (lic = '') AS unknown FROM a")(lambda s: profile.profile(s.after).select(C("lic_copyleft").alias("copyleft"), C("lic_permissive").alias("permissive"), C("lic_unknown").alias("unknown")))
snap("fnd_removal_hotspots", "SELECT regexp_extract(location, '^(/[^/]*/[^/]*/[^/]*)', 1) AS key, count(*) AS count FROM removed GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4")(lambda s: profile.top(profile.by_prefix(s.diff.removed), 4))

# Files.


def catalogue(key: str, sql: str):
    """A query of the after side's files, components and relations."""

    def register(f: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            after = Snapshots(spark, sf_dir).after
            listed, relations = file_tables(spark, sf_dir)
            return f(files.catalogue(listed, after), after, relations)

        query(key, sql, FILES)(run)
        return f

    return register


catalogue("jn_file_owners", "SELECT path, ordinal, relation FROM rel")(lambda f, c, r: files.owners(f, c, r))
catalogue("jn_comp_files", "SELECT ordinal, path FROM rel")(lambda f, c, r: files.component_files(f, c, r))
catalogue("agg_layers", "SELECT layer, count(*) AS files, CAST(sum(size) AS BIGINT) AS size, min(path) AS first_path FROM file WHERE layer <> '' GROUP BY 1")(lambda f, c, r: files.layers(f))
catalogue(
    "agg_file_stats",
    "SELECT 'files' AS metric, '' AS key, count(*) AS value FROM file UNION ALL SELECT 'size', '', CAST(sum(size) AS BIGINT) FROM file UNION ALL SELECT 'unowned', '', count(*) FROM file WHERE path NOT IN (SELECT path FROM rel) "
    "UNION ALL SELECT 'file_type', file_type, count(*) FROM file WHERE file_type <> '' GROUP BY 2 UNION ALL SELECT 'mime', mime, count(*) FROM file WHERE mime <> '' GROUP BY 2 UNION ALL SELECT 'extension', ext, count(*) FROM (SELECT regexp_extract(path, '(\\.[^./]*)$', 1) AS ext FROM file) WHERE ext <> '' GROUP BY 2",
)(lambda f, c, r: files.statistics(f, c, r))
KEYED = "CASE WHEN {t}.ordinal % 4 = 0 THEN {t}.name || '|' || {t}.version ELSE {t}.purl END"
snap("jn_artifact_key", f"SELECT a.ordinal AS artifact, min(2 * c.ordinal + CASE c.side WHEN 'after' THEN 1 ELSE 0 END) AS ordinal FROM a JOIN comp c ON {KEYED.format(t='c')} = {KEYED.format(t='a')} GROUP BY 1")(
    lambda s: (lambda bare: files.match_artifacts(bare.where("side = 'after'").withColumn("artifact", C("ordinal")), bare.withColumn("ordinal", 2 * C("ordinal") + (C("side") == "after").cast("long"))))(s.all.withColumn("purl", F.when(C("ordinal") % 4 == 0, "").otherwise(C("purl"))))
)
snap("jn_resolve_refs", "SELECT src_id, dst_id FROM edge WHERE side = 'after'")(
    lambda s: (lambda k: graph.resolve_refs(s.after.select(k.cast("string").alias("ref"), "id", "ordinal"), s.after.select(k.cast("string").alias("src_ref"), F.posexplode(F.concat(F.array(3 * k + 1, 3 * k + 2, 3 * k + 3), F.when(k % 50 == 0, F.array(k + 5)).otherwise(F.array().cast("array<bigint>")))).alias("adj_ordinal", "dst")).withColumn("dst_ref", C("dst").cast("string"))))(C("ordinal")).select("src_id", "dst_id").distinct()
)
query("flt_tree", SQL + ", up(id) AS (SELECT id FROM a WHERE contains(lower(name || ' ' || version || ' library ' || id), '77') UNION SELECT e.src_id FROM up JOIN edge e ON e.side = 'after' AND e.dst_id = up.id) SELECT id FROM up", "")(lambda spark, d: (lambda s: graph.with_ancestors(explore.tree_matches(s.after, "77"), s.edges_of("after")))(Snapshots(spark, d)))
_side = lambda cond: f"SELECT id, 'name_mismatch' AS reason FROM i WHERE {cond} GROUP BY id HAVING count(DISTINCT name) > 1 UNION SELECT id, 'hash_mismatch' FROM i WHERE {cond} AND id NOT IN (SELECT id FROM i WHERE {cond} GROUP BY id HAVING count(DISTINCT name) > 1) GROUP BY id, version HAVING count(DISTINCT hash) > 1"
query("set_collisions", f"{_side('early')} UNION {_side('NOT early')}", ITEMS)(lambda spark, d: df_.both_collisions(items(spark, d).where("early"), items(spark, d).where("not early")))

# Findings as messages.
query("fnd_os", "SELECT 'OS/Distro: Alpine Linux v3.19' AS message", "")(lambda spark, d: findings.operating_system(spark, INFO["after"]).select("message"))
query("fnd_files", "SELECT '1,500 files tracked on filesystem' AS message", "")(lambda spark, d: findings.files(spark, INFO["after"]).select("message"))
query("fnd_context", "SELECT unnest(['Warning: scan scope changed (Squashed → AllLayers) — diff may reflect scan depth, not system changes', 'Warning: schema version changed (16.0.1 → 16.0.4) — PURL format may differ']) AS message", "")(lambda spark, d: findings.context(spark, INFO["before"], INFO["after"]).select("message"))
query("fnd_os_change", "SELECT 'OS changed: Alpine Linux v3.18 → Alpine Linux v3.19' AS message", "")(lambda spark, d: findings.os_change(spark, INFO["before"], INFO["after"]).select("message"))
query("fnd_relationships", "SELECT 'Relationships: ' || format('{:,}', (SELECT count(*) FROM rel WHERE relation = 'contains')) || ' containment + ' || format('{:,}', (SELECT count(*) FROM edge WHERE side = 'after')) || ' dependency' AS message", FILES)(
    lambda spark, d: (lambda s, t: findings.relationships(files.owners(files.catalogue(t[0], s.after), s.after, t[1]).groupBy(C("relation").alias("key")).count().unionByName(s.edges_of("after").select("src_id", "dst_id").distinct().groupBy(F.lit("dependency-of").alias("key")).count())))(Snapshots(spark, d), file_tables(spark, d)).select("message")
)
snap("fnd_quality", "SELECT 'Low ' || what || ' coverage: ' || printf('%.1f', (total - missing) * 100.0 / total) || '% (' || missing || ' of ' || total || ' missing)' AS message FROM (SELECT unnest(['license', 'hash']) AS what, unnest([lic, hash]) AS missing, total FROM (SELECT count(*) AS total, count(*) FILTER (lic = '') AS lic, count(*) FILTER (hash = '') AS hash FROM a WHERE ordinal % 24 = 12 OR ordinal % 90 = 0)) WHERE (total - missing) * 100.0 / total < 50")(lambda s: findings.quality(profile.profile(s.after.where("ordinal % 24 = 12 or ordinal % 90 = 0"))).select("message"))
query("fnd_duplicates", "SELECT count(*) || ' duplicate component groups detected' AS message FROM d HAVING count(*) > 0", ITEMS)(lambda spark, d: findings.duplicate_groups(items(spark, d)).select("message"))
snap("fnd_dominant_path", "SELECT printf('%.1f', n * 100.0 / total) || '% of added packages are ' || ptype || ', concentrated in /usr/lib/Brand#13' AS message FROM (SELECT ptype, count(*) AS n, sum(count(*)) OVER () AS total FROM comp WHERE location LIKE '/usr/lib/Brand#13/%' AND (ordinal % 5 = 0 OR ordinal % 10 = 1) GROUP BY 1) WHERE total >= 20 AND n >= 10 AND n * 100.0 / total >= 50 ORDER BY n DESC, ptype DESC LIMIT 1")(lambda s: findings.dominant_path(s.all.where(F.get("locations", F.lit(0)).startswith("/usr/lib/Brand#13/") & ((C("ordinal") % 5 == 0) | (C("ordinal") % 10 == 1))), "added").select("message"))


# The findings over counts, as messages.
def _listing(rows: str, limit: int, prefix: str, more: bool) -> str:
    rest = f" || CASE WHEN count(*) > {limit} THEN ' + ' || (count(*) - {limit}) || ' more' ELSE '' END" if more else ""
    return f"SELECT '{prefix}: ' || string_agg(key || ' (' || format('{{:,}}', n) || ')', ', ' ORDER BY n DESC, key) FILTER (r <= {limit}){rest} AS message FROM (SELECT *, row_number() OVER (ORDER BY n DESC, key) AS r FROM (SELECT key, count(*) AS n FROM ({rows}) GROUP BY 1)) HAVING sum(n) >= {1 if more else 20}"


PREFIX = "SELECT regexp_extract(location, '^(/[^/]*/[^/]*/[^/]*)', 1) AS key FROM "
DELTA = "CASE WHEN a <> b THEN printf('%+d', a - b) || ' {what} (' || printf('%.1f', (a - b) * 100.0 / b) || '%)' END"
UPDOWN = "list_transform(string_split(version_{}, '.'), lambda x: CAST(x AS BIGINT))"


def message(key: str, sql: str):
    """Messages of a finding over the two snapshots."""

    def register(f: Callable[[Snapshots], DataFrame]):
        snap(key, sql)(lambda s: f(s).select("message"))
        return f

    return register


message(
    "msg_dominant_type",
    _listing("SELECT ptype AS key FROM a", 3, "Top ecosystems", True) + " UNION ALL SELECT 'Dominated by npm: ' || format('{:,}', n) || ' of ' || format('{:,}', t) || ' packages (' || printf('%.1f', n * 100.0 / t) || '%)' FROM (SELECT count(*) FILTER (ptype = 'npm') AS n, count(*) AS t FROM b WHERE ordinal % 5 = 0 OR ordinal % 25 = 1)",
)(lambda s: headlines.dominant_type(s.after).unionByName(headlines.dominant_type(s.before.where("ordinal % 5 = 0 or ordinal % 25 = 1"))))
WHOLE_TYPES = "SELECT CASE WHEN max(n) * 100.0 / sum(n) >= 60 THEN 'Dominated by ' || max(key) FILTER (r = 1) || ': ' || format('{{:,}}', max(n)) || ' of ' || format('{{:,}}', CAST(sum(n) AS BIGINT)) || ' packages (' || printf('%.1f', max(n) * 100.0 / sum(n)) || '%)' ELSE 'Top ecosystems: ' || string_agg(key || ' (' || format('{{:,}}', n) || ')', ', ' ORDER BY n DESC, key) FILTER (r <= 3) || CASE WHEN count(*) > 3 THEN ' + ' || (count(*) - 3) || ' more' ELSE '' END END AS message FROM (SELECT *, row_number() OVER (ORDER BY n DESC, key) AS r FROM (SELECT ptype AS key, count(*) AS n FROM {} GROUP BY 1))"
WHOLE_PATH = "SELECT * FROM (SELECT printf('%.1f', n * 100.0 / total) || '% of {0} packages are ' || ptype || ', concentrated in ' || path AS message FROM (SELECT ptype, regexp_extract(location, '^(/[^/]*/[^/]*/[^/]*)', 1) AS path, count(*) AS n, sum(count(*)) OVER () AS total FROM {0} GROUP BY 1, 2) WHERE path <> '' AND total >= 20 AND n >= 10 AND n * 100.0 / total >= 50 ORDER BY n DESC, ptype DESC, path DESC LIMIT 1)"
# The same findings over all rows of the snapshots and their diff; no row where a rule doesn't fire.
message("fnd_dominant_path_all", WHOLE_PATH.format("removed") + " UNION ALL " + WHOLE_PATH.format("added"))(lambda s: findings.dominant_path(s.diff.removed, "removed").unionByName(findings.dominant_path(s.diff.added, "added")))
message("msg_dominant_type_all", WHOLE_TYPES.format("a") + " UNION ALL " + WHOLE_TYPES.format("b"))(lambda s: headlines.dominant_type(s.after).unionByName(headlines.dominant_type(s.before)))
message("msg_surface_all", f"SELECT 'Attack surface: ' || concat_ws(', ', {DELTA.format(what='packages')}, '+300 files (25.0%)') AS message FROM (SELECT (SELECT count(*) FROM b) AS b, (SELECT count(*) FROM a) AS a)")(lambda s: headlines.surface(s.all, INFO["before"], INFO["after"]))
message("msg_ecosystems_all", "SELECT ptype || ' ecosystem entirely removed (' || format('{:,}', count(*)) || ' → 0 packages)' AS message FROM b WHERE ptype NOT IN (SELECT ptype FROM a) GROUP BY ptype UNION ALL SELECT 'New ecosystem: ' || ptype || ' (' || count(*) || ' packages)' FROM a WHERE ptype NOT IN (SELECT ptype FROM b) GROUP BY ptype")(lambda s: headlines.ecosystems(s.before, s.after))
message("msg_hotspots", _listing(PREFIX + "a", 4, "Top directories", False))(lambda s: headlines.hotspots(s.after))
message("msg_change_hotspots", f"SELECT * FROM ({_listing(PREFIX + 'removed', 4, 'Top removal areas', False)}) UNION ALL SELECT * FROM ({_listing(PREFIX + 'added', 4, 'Top addition areas', False)})")(lambda s: headlines.change_hotspots(s.diff))
message("msg_catalogers", _listing("SELECT found_by AS key FROM b WHERE found_by <> ''", 3, "Top catalogers", True))(lambda s: headlines.top_catalogers(s.before))
message("msg_license_profile", "SELECT 'License profile: ' || printf('%.0f', p * 100.0 / t) || '% permissive, ' || printf('%.0f', c * 100.0 / t) || '% copyleft' || CASE WHEN u * 100.0 / t > 10 THEN ', ' || printf('%.0f', u * 100.0 / t) || '% unknown' ELSE '' END AS message FROM (SELECT count(*) AS t, count(*) FILTER (lic = '') AS u, count(*) FILTER (contains(lic, 'GPL')) AS c, count(*) FILTER (lic <> '' AND NOT contains(lic, 'GPL')) AS p FROM a)")(lambda s: headlines.license_profile(s.after))
message(
    "msg_surface",
    f"SELECT 'Attack surface: ' || concat_ws(', ', {DELTA.format(what='packages')}, '+300 files (25.0%)') AS message FROM (SELECT (SELECT count(*) FROM b) AS b, (SELECT count(*) FROM a WHERE ordinal % 7 > 0) AS a)",
)(lambda s: headlines.surface(s.all.where("side = 'before' or ordinal % 7 > 0"), INFO["before"], INFO["after"]))
message(
    "msg_ecosystems",
    "SELECT 'npm ecosystem entirely removed (' || format('{:,}', count(*)) || ' → 0 packages)' AS message FROM b WHERE ptype = 'npm' UNION ALL SELECT 'New ecosystem: rpm (' || count(*) || ' packages)' FROM a WHERE ptype = 'rpm'",
)(lambda s: headlines.ecosystems(s.before.where("ordinal % 5 <> 1"), s.after.where("ordinal % 5 <> 0")))
message(
    "msg_versions",
    f""", moved AS (SELECT id, name, version_from, version_to, CASE WHEN {UPDOWN.format('from')} > {UPDOWN.format('to')} THEN 'down' WHEN split_part(version_from, '.', 1) <> split_part(version_to, '.', 1) THEN 'major'
    WHEN split_part(version_from, '.', 2) <> split_part(version_to, '.', 2) THEN 'minor' ELSE 'patch' END AS kind, row_number() OVER (PARTITION BY {UPDOWN.format('from')} > {UPDOWN.format('to')} ORDER BY id) AS r FROM ch WHERE drift = 'version')
    SELECT count(*) || ' version downgrades detected: ' || string_agg(name || ' ' || version_from || '→' || version_to, ', ' ORDER BY id) FILTER (r <= 5) || CASE WHEN count(*) > 5 THEN ' + ' || (count(*) - 5) || ' more' ELSE '' END AS message FROM moved WHERE kind = 'down'
    UNION ALL SELECT count(*) || ' version upgrades (' || concat_ws(', ', CASE WHEN count(*) FILTER (kind = 'major') > 0 THEN count(*) FILTER (kind = 'major') || ' major' END, CASE WHEN count(*) FILTER (kind = 'minor') > 0 THEN count(*) FILTER (kind = 'minor') || ' minor' END,
      CASE WHEN count(*) FILTER (kind = 'patch') > 0 THEN count(*) FILTER (kind = 'patch') || ' patch' END) || ') among ' || format('{{:,}}', (SELECT count(*) FROM b) - (SELECT count(*) FROM removed)) || ' shared packages' FROM moved WHERE kind <> 'down'""",
)(lambda s: headlines.version_changes(s.before, s.diff))
message("msg_integrity", "SELECT 'Integrity drift (' || CAST(sum(n) AS BIGINT) || ' total): ' || string_agg(n || ' ' || ptype || CASE ptype WHEN 'rpm' THEN ' (expected for rebuilds)' ELSE ' (review recommended)' END, ', ' ORDER BY n DESC, ptype) AS message FROM (SELECT ptype, count(*) AS n FROM ch WHERE drift = 'integrity' GROUP BY 1) HAVING count(*) > 0")(lambda s: headlines.integrity(s.diff))
message(
    "msg_stable_types",
    "SELECT 'Core system packages stable: ' || string_agg(k || ' (' || format('{:,}', n) || ')', ', ' ORDER BY n DESC, k) || ' unchanged' AS message FROM (SELECT ptype AS k, count(*) AS n FROM b GROUP BY 1 INTERSECT SELECT ptype, count(*) FROM a GROUP BY 1) WHERE n > 10 HAVING count(*) > 0",
)(lambda s: headlines.stable_types(s.before, s.after))
message(
    "msg_license_shift",
    "SELECT 'License shift: ' || concat_ws(', ', CASE WHEN c <> 0 THEN 'copyleft ' || printf('%+d', c) END, CASE WHEN p <> 0 THEN 'permissive ' || printf('%+d', p) END) AS message FROM (SELECT sum(s) FILTER (contains(lic, 'GPL'))::BIGINT AS c, sum(s) FILTER (lic <> '' AND NOT contains(lic, 'GPL'))::BIGINT AS p FROM (SELECT lic, CASE side WHEN 'after' THEN 1 ELSE -1 END AS s FROM comp)) WHERE c <> 0 OR p <> 0",
)(lambda s: headlines.license_shift(s.all))
message("msg_cataloger_gaps", "SELECT found_by || ' found ' || format('{:,}', count(*)) || ' packages in Before but none in After' AS message FROM b WHERE found_by <> '' AND found_by NOT IN (SELECT found_by FROM a) GROUP BY found_by")(lambda s: headlines.cataloger_gaps(s.before, s.after))

# Declared dependencies, adjacency of repeated ids, and small texts.
DECLARED = "(SELECT DISTINCT id FROM (SELECT src_id AS id FROM edge WHERE side = 'after' UNION SELECT dst_id FROM edge WHERE side = 'after' UNION SELECT id FROM a WHERE ordinal % 3 = 0))"
_declared = lambda s, flag: s.after.withColumn("deps_declared", flag)
snap("gr_coverage_declared", f"SELECT count(*) AS n FROM {DECLARED}")(lambda s: profile.graph_coverage(_declared(s, C("ordinal") % 3 == 0), s.edges_of("after")).agg(F.count("*").alias("n")))
for _s in _cmp:
    _sql = _rows[_s].replace(COVER, "true")
    snap(f"cmp_{_s}_declared", _sql)(lambda s, std=_s: profile.checks(_declared(s, F.lit(True)), s.edges_of("after"), INFO["after"], std))
snap("agg_dependencies", "SELECT side, count(DISTINCT src_id) AS with_dependencies, count(*) AS total_dependencies FROM edge GROUP BY side")(lambda s: profile.dependency_counts(s.edges, "side"))
query("gr_adjacency", "SELECT id, ordinal, dst FROM (SELECT l_partkey || '/' || l_suppkey AS id, l_orderkey * 8 + l_linenumber AS ordinal, l_returnflag || l_linestatus AS dst, max(l_orderkey * 8 + l_linenumber) OVER (PARTITION BY l_partkey, l_suppkey) AS last FROM lineitem) WHERE ordinal = last", "")(
    lambda spark, d: (lambda i: graph.adjacency(i, i.select(C("id").alias("src_id"), C("ordinal").alias("src_ordinal"), C("dst").alias("dst_id"))).select(C("src_id").alias("id"), C("src_ordinal").alias("ordinal"), C("dst_id").alias("dst")))(
        read(spark, d, "lineitem").select(F.concat_ws("/", C("l_partkey").cast("string"), C("l_suppkey").cast("string")).alias("id"), (C("l_orderkey") * 8 + C("l_linenumber")).alias("ordinal"), F.concat("l_returnflag", "l_linestatus").alias("dst"))
    )
)
scalar("fn_file_size", lambda: fn.file_size(C("ordinal") * C("ordinal") * 512), "CASE WHEN ordinal * ordinal * 512 >= 1073741824 THEN printf('%.1f GB', ordinal * ordinal * 512 / 1073741824.0::DOUBLE) WHEN ordinal * ordinal * 512 >= 1048576 THEN printf('%.0f MB', ordinal * ordinal * 512 / 1048576.0::DOUBLE) WHEN ordinal * ordinal * 512 >= 1024 THEN printf('%.0f KB', ordinal * ordinal * 512 / 1024.0::DOUBLE) ELSE ordinal * ordinal * 512 || ' B' END")
scalar("fn_percent_text", lambda: fn.percent_text(C("ordinal") % 50, C("ordinal") % 40), "CASE WHEN ordinal % 40 = 0 THEN '0.0%' ELSE printf('%.1f%%', (ordinal % 50) * 100.0::DOUBLE / (ordinal % 40)) END")
scalar("fn_or_none", lambda: fn.or_none(C("language")), "CASE WHEN language = '' THEN '(none)' ELSE language END")
scalar("fn_octal_mode", lambda: fn.octal_mode(C("ordinal") * 37), "to_base((ordinal * 37) & 4095, 8)")
snap("topk_bars", "SELECT key, count, CAST(count AS DOUBLE) / max(count) OVER () AS share FROM (SELECT lic AS key, count(*) AS count FROM a WHERE lic <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)")(lambda s: profile.bars(profile.by_license(s.after), 3))

# Operators on rows that they act upon: mixed types, CPEs, repeated ids, missing licences, raw fields.
MIXED = "CASE ordinal % 7 WHEN 0 THEN 'file' WHEN 1 THEN 'operating-system' ELSE 'library' END"
_mixed = lambda: F.when(C("ordinal") % 7 == 0, "file").when(C("ordinal") % 7 == 1, "operating-system").otherwise("library")
_cpes = lambda: F.when(C("ordinal") % 3 == 0, F.array(F.concat(F.lit("cpe:2.3:a:v:"), "name"))).otherwise(F.array().cast("array<string>"))
snap("flt_packages_mixed", f"SELECT side, ordinal, id FROM comp WHERE {MIXED} = 'library'")(lambda s: profile.packages(s.all.withColumn("type", _mixed())).select("side", "ordinal", "id"))
snap("agg_profile_cpes", f"SELECT {PROFILE.replace('CAST(0 AS BIGINT) AS with_cpes', 'count(*) FILTER (ordinal % 3 = 0) AS with_cpes')} FROM a")(lambda s: profile.profile(s.after.withColumn("cpes", _cpes())))
scalar("fn_has_lookup_id_cpes", lambda: fn.has_lookup_id(F.when(C("ordinal") % 2 == 0, C("purl")).otherwise(""), _cpes()), "ordinal % 2 = 0 OR ordinal % 3 = 0")
scalar("fn_effective_type_mixed", lambda: fn.effective_type(F.when(C("ordinal") % 3 == 0, "pkg:gem/x@1").otherwise(""), F.when(C("ordinal") % 3 == 2, C("name")).otherwise(C("id"))), "CASE ordinal % 3 WHEN 0 THEN 'gem' WHEN 2 THEN 'unknown' ELSE ptype END")
scalar("fn_stats_type_mixed", lambda: fn.stats_type(F.when(C("ordinal") % 2 == 0, C("purl")).otherwise(""), C("name"), _mixed()), f"CASE WHEN ordinal % 2 = 0 THEN ptype ELSE {MIXED} END")
snap("prj_normalize_raw", "SELECT side, ordinal, name, version, CASE WHEN ordinal % 3 = 0 THEN '' ELSE 'MIT' END AS licenses FROM comp")(
    lambda s: profile.normalize(s.all.withColumns({"name": F.concat(F.lit(" "), F.upper("name"), F.lit("\t")), "version": F.concat("version", F.lit("\n")), "licenses": F.array(F.when(C("ordinal") % 3 == 0, " None").otherwise("mit "))})).select("side", "ordinal", "name", "version", F.array_join("licenses", ",").alias("licenses"))
)
query("jn_first_wins_repeated", "SELECT id, arg_min(version, pos) AS version, arg_min(name, pos) AS name FROM (SELECT l_partkey || '/' || l_suppkey AS id, CAST(l_linenumber AS VARCHAR) AS version, l_returnflag AS name, l_orderkey * 8 + l_linenumber AS pos FROM lineitem) GROUP BY id", "")(
    lambda spark, d: df_.first_wins(items(spark, d).withColumn("ordinal", C("ordinal") * 8 + C("version").cast("long"))).select("id", "version", "name")
)
snap("pol_require_licenses_missing", "SELECT 'require_licenses' AS rule, name || ': no license' AS message, 'error' AS severity FROM added WHERE ordinal % 3 = 0")(
    lambda s: (lambda bare: rules.evaluate(rules.Policy(require_licenses=True), df_.diff(s.before, bare), bare).select("rule", "message", "severity"))(s.after.withColumn("licenses", F.when(C("ordinal") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("MIT")))))
)
query("pol_deny_duplicates_repeated", "SELECT 'deny_duplicates' AS rule, count(*) || ' duplicates found' AS message, 'error' AS severity FROM d HAVING count(*) > 0", ITEMS)(
    lambda spark, d: (lambda s: rules.evaluate(rules.Policy(deny_duplicates=True), s.diff, items(spark, d)).select("rule", "message", "severity"))(Snapshots(spark, d))
)
snap("prj_compliance_details", "SELECT * FROM (SELECT 'cisa-license' AS check, n = t AS passed, CASE WHEN n = t THEN 'All ' || t || ' components' ELSE n || '/' || t || ' components' END AS detail FROM (SELECT count(*) AS t, count(*) FILTER (lic <> '') AS n FROM a) UNION ALL SELECT 'cisa-version', true, 'All ' || (SELECT count(*) FROM a) || ' components' UNION ALL SELECT 'cisa-tool', true, 'present' UNION ALL SELECT 'cisa-author', false, 'missing')")(
    lambda s: profile.compliance(s.after, s.edges_of("after"), INFO["after"]).where(C("check").isin("cisa-license", "cisa-version", "cisa-tool", "cisa-author")).select("check", "passed", "detail")
)


# Messages on scores in full, exact rounding, the whole licence list.
LABELS = {"ntia": "NTIA", "cisa": "CISA", "bsi": "BSI TR-03183"}


def scored(key: str, knobs: dict, rule: str, sql: str, empty: bool = False) -> None:
    def run(s: Snapshots) -> DataFrame:
        rows = s.after.where("false") if empty else s.after
        found = profile.framework_scores(rows, s.edges_of("after"), INFO["after"])
        return rules.evaluate_scores(rules.Policy(**knobs), found).select("rule", "message", "severity")

    query(key, f"SELECT '{rule}' AS rule, {sql}")(lambda spark, d: run(Snapshots(spark, d)))


for _n, _label in LABELS.items():
    scored(f"pol_score_{_n}", {f"min_{_n}_score": 100}, f"min_{_n}_score", f"'{_label} compliance score ' || score || ' < minimum 100 (' || passed || '/' || total || ' checks passed)' AS message, 'error' AS severity FROM ({_scores}) WHERE standard = '{_n}' AND score < 100")
    scored(f"pol_unscored_{_n}", {f"min_{_n}_score": 60}, f"min_{_n}_score", f"'{_label} compliance not evaluated (score 0) < minimum 60' AS message, 'error' AS severity FROM (SELECT count(*) AS n FROM a WHERE false) WHERE n = 0", empty=True)
scored("pol_score_overall", {"min_overall_compliance": 100}, "min_overall_compliance", f"'overall compliance score ' || CAST(floor(avg(score)) AS BIGINT) || ' < minimum 100' AS message, 'error' AS severity FROM ({_scores}) HAVING avg(score) < 100")
query("fn_percent_exact", "SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey = 0 THEN '0.0%' ELSE printf('%.1f%%', CAST(l_partkey % 2000 AS DOUBLE) / CAST(l_suppkey * 80 AS DOUBLE) * 100) END AS out FROM lineitem", "")(
    lambda spark, d: read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fn.percent_text(C("l_partkey") % 2000, C("l_suppkey") * 80).alias("out"))
)
LISTED = "CASE ordinal % 6 WHEN 0 THEN 'Elastic-2.0' WHEN 1 THEN 'cc-pddc' WHEN 2 THEN 'PolyForm-Noncommercial-1.0.0 OR MIT' WHEN 3 THEN 'GPL-2.0-only WITH Autoconf-exception-macro' WHEN 4 THEN 'Elastic-9.9' ELSE coalesce(nullif(lic, ''), 'free text') END"
_listed = lambda s: s.all.withColumn("licenses", F.array(F.when(C("ordinal") % 6 == 0, "Elastic-2.0").when(C("ordinal") % 6 == 1, "cc-pddc").when(C("ordinal") % 6 == 2, "PolyForm-Noncommercial-1.0.0 OR MIT").when(C("ordinal") % 6 == 3, "GPL-2.0-only WITH Autoconf-exception-macro").when(C("ordinal") % 6 == 4, "Elastic-9.9").otherwise(F.coalesce(F.get("licenses", F.lit(0)), F.lit("free text")))))
snap("agg_license_dictionary", f"SELECT license, count(*) AS count, license NOT IN ('Elastic-9.9', 'free text') AS valid FROM (SELECT {LISTED} AS license FROM comp) GROUP BY 1")(lambda s: licenses.dictionary(_listed(s)))
snap("cmp_valid_licenses", f"SELECT side, CAST(count(*) AS BIGINT) AS spdx FROM (SELECT side, {LISTED} AS license FROM comp) WHERE license NOT IN ('Elastic-9.9', 'free text') GROUP BY side")(lambda s: licenses.valid_components(_listed(s), "side"))

# Folders, stored indexes, nested trees, the list filter, bundles and bounded texts.
PATHS = """WITH RECURSIVE f AS (SELECT DISTINCT split_part(split_part(split_part(url, '://', 2), '?', 1), '#', 1) AS path FROM pages),
x AS (SELECT path, array_to_string(s[1:k], '/') AS entry FROM (SELECT path, s, unnest(range(1, len(s) + 1)) AS k FROM (SELECT path, string_split(path, '/') AS s FROM f WHERE path <> ''))),
d AS (SELECT entry AS path, bool_or(entry <> path) AS is_dir, regexp_extract(entry, '[^/]*$') AS name, CASE WHEN contains(entry, '/') THEN regexp_replace(entry, '/[^/]*$', '') ELSE '/' END AS folder FROM x WHERE entry <> '' GROUP BY entry),
k AS (SELECT folder, count(*) AS n FROM d WHERE name <> '' GROUP BY 1)"""
_page_files = lambda spark, d: read(spark, d, "pages").select(F.substring_index(F.substring_index(F.regexp_replace("url", "^[^:]*://", ""), "?", 1), "#", 1).alias("path"))
query("page_directory_index", "SELECT d.folder, name, path, is_dir, CASE WHEN is_dir THEN coalesce(k.n, 0) ELSE 0 END AS children, row_number() OVER (PARTITION BY d.folder ORDER BY is_dir DESC, name, path) - 1 AS position FROM d LEFT JOIN k ON k.folder = d.path WHERE name <> ''", PATHS)(lambda spark, d: files.directory_index(_page_files(spark, d)))
query("page_directory_root", "SELECT name, is_dir, k.n AS children FROM d JOIN k ON k.folder = d.path WHERE d.folder = '/' AND is_dir ORDER BY name LIMIT 20 OFFSET 10", PATHS)(lambda spark, d: files.directory_page(files.directory_index(_page_files(spark, d)), "/", 10, 20).select("name", "is_dir", "children"))
TEXT = "lower(name || ' ' || version || ' ' || purl || ' ' || id || ' ' || supplier || '  ' || lic)"
for _name, _query in (("flt_search_index", "gpl-3.0"), ("flt_search_gram", "77"), ("flt_search_letter", "z")):
    snap(_name, f"SELECT ordinal FROM a WHERE contains({TEXT}, '{_query}')")(lambda s, q=_query: SearchIndex.build(s.after).search(s.after.sparkSession, q).select("ordinal"))
snap("flt_lookup_index", "SELECT id, name, version FROM b WHERE id = (SELECT id FROM b WHERE ordinal = 12)")(lambda s: SearchIndex.build(s.before).lookup(s.before.sparkSession, s.before.where("ordinal = 12").first()["id"]).select("id", "name", "version"))
snap("page_index", "SELECT ordinal, id FROM b ORDER BY ordinal LIMIT 20 OFFSET 40")(lambda s: SearchIndex.build(s.before).page(s.before.sparkSession, 40, 20).select("ordinal", "id"))
NESTED = """, g AS (SELECT src_id, string_agg(dst_id, ',' ORDER BY nr) AS t, count(*) AS n FROM (SELECT e.src_id, e.dst_id, c.ordinal - 3 * p.ordinal AS nr FROM edge e JOIN a p ON p.id = e.src_id JOIN a c ON c.id = e.dst_id WHERE e.side = 'after') GROUP BY 1),
m AS (SELECT e.src_id, string_agg(e.dst_id || '(' || coalesce(g.t, '') || ')', ';' ORDER BY c.ordinal - 3 * p.ordinal) AS t FROM edge e JOIN a p ON p.id = e.src_id JOIN a c ON c.id = e.dst_id LEFT JOIN g ON g.src_id = e.dst_id WHERE e.side = 'after' GROUP BY 1)"""
# the fourth dependency, k + 5, of a snapshot's every 50th component comes last whatever its distance
NESTED = NESTED.replace("c.ordinal - 3 * p.ordinal AS nr", "CASE WHEN c.ordinal - 3 * p.ordinal BETWEEN 1 AND 3 THEN c.ordinal - 3 * p.ordinal ELSE 4 END AS nr").replace("ORDER BY c.ordinal - 3 * p.ordinal)", "ORDER BY CASE WHEN c.ordinal - 3 * p.ordinal BETWEEN 1 AND 3 THEN c.ordinal - 3 * p.ordinal ELSE 4 END)")
query("gr_tree_nested", SQL + NESTED + " SELECT r.id AS root, coalesce(g.n, 0) AS children, g.n IS NOT NULL AS has_children, coalesce(m.t, '') AS tree FROM roots r LEFT JOIN g ON g.src_id = r.id LEFT JOIN m ON m.src_id = r.id WHERE r.side = 'after'", "")(
    lambda spark, d: (lambda s: Bundle.build({"after": (s.after, s.edges_of("after"))}).tree("after", s.after))(Snapshots(spark, d)).select(
        C("tree.id").alias("root"), C("total_children").cast("long").alias("children"), C("tree.has_children").alias("has_children"), F.array_join(F.transform("tree.children", lambda c: F.concat(c["id"], F.lit("("), F.array_join(F.transform(c["children"], lambda g: g["id"]), ","), F.lit(")"))), ";").alias("tree")
    )
)
query("gr_bundle", f"SELECT (SELECT count(*) FROM edge e WHERE side = 'after' AND NOT EXISTS (SELECT 1 FROM edge o WHERE o.side = 'before' AND o.src_id = e.src_id AND o.dst_id = e.dst_id)) AS added, (SELECT count(*) FROM edge e WHERE side = 'before' AND NOT EXISTS (SELECT 1 FROM edge o WHERE o.side = 'after' AND o.src_id = e.src_id AND o.dst_id = e.dst_id)) AS removed")(
    lambda spark, d: (lambda b: b.edge_diff("after", "before").agg(F.coalesce(F.sum(F.size("targets")), F.lit(0)).alias("added")).crossJoin(b.edge_diff("before", "after").agg(F.coalesce(F.sum(F.size("targets")), F.lit(0)).alias("removed"))))(bundle_of(Snapshots(spark, d)))  # one row each
)
query("flt_list_ranked", None)(lambda spark, d: listing.ranked(Snapshots(spark, d).after, "npmit"))
snap("prj_list_rows", "SELECT ordinal, name || ' ' || version AS title, 'Type: ' || ptype AS description FROM a")(lambda s: s.after.select("ordinal", listing.title(C("name"), C("version")).alias("title"), listing.description(C("purl"), C("licenses"), F.lit(0)).alias("description")))
_lines = lambda s: lines.document(s.after.sparkSession, [lines.rows(s.after, F.concat_ws(" ", "name", "version"), "ordinal")])
BOUND = 5000
snap("snk_bounded", f"SELECT CASE WHEN start + n <= {BOUND} THEN line ELSE substr(line, 1, CAST({BOUND} - start AS BIGINT)) END AS line FROM (SELECT line, length(line) + 1 AS n, sum(length(line) + 1) OVER (ORDER BY ordinal) - length(line) - 1 AS start FROM (SELECT ordinal, name || ' ' || version AS line FROM a)) WHERE start < {BOUND} UNION ALL SELECT CASE i WHEN 0 THEN '' WHEN 1 THEN '_' || (SELECT count(*) FILTER (upto - 1 > {BOUND}) FROM (SELECT sum(length(name || ' ' || version) + 1) OVER (ORDER BY ordinal) AS upto FROM a)) || ' lines are cut or left out._' ELSE '{lines.CUT}' END FROM range(3) t(i) WHERE (SELECT sum(length(name || ' ' || version) + 1) - 1 FROM a) > {BOUND}")(lambda s: lines.bounded(_lines(s), BOUND))


# Findings over facts that come from the tables.
def table_facts(spark: SparkSession, sf_dir: str, key: int) -> dict:
    """The facts of one document: a nation's name and region, and how many line items there are."""
    row = read(spark, sf_dir, "nation").where(C("n_nationkey") == key).join(read(spark, sf_dir, "region"), C("n_regionkey") == C("r_regionkey")).first()
    lines_of = read(spark, sf_dir, "lineitem").where(C("l_suppkey") % 25 == key).count()
    return {"os_name": row.n_name, "os_version": f"{row.n_nationkey}.{row.n_regionkey}", "search_scope": row.r_name, "schema_version": f"16.0.{key}", "files_count": lines_of}


SYSTEM = "n_name || CASE WHEN contains(n_name, n_nationkey || '.' || n_regionkey) THEN '' ELSE ' ' || n_nationkey || '.' || n_regionkey END"
query("fnd_os_table", f"SELECT 'OS/Distro: ' || {SYSTEM} AS message FROM nation WHERE n_nationkey = 3", "")(lambda spark, d: findings.operating_system(spark, table_facts(spark, d, 3)).select("message"))
query("fnd_files_table", "SELECT format('{:,}', count(*)) || ' files tracked on filesystem' AS message FROM lineitem WHERE l_suppkey % 25 = 3 HAVING count(*) > 0", "")(lambda spark, d: findings.files(spark, table_facts(spark, d, 3)).select("message"))
query("fnd_context_table", "SELECT 'Warning: scan scope changed (' || x.r_name || ' → ' || y.r_name || ') — diff may reflect scan depth, not system changes' AS message FROM (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 3) x, (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 6) y WHERE x.r_name <> y.r_name UNION ALL SELECT 'Warning: schema version changed (16.0.3 → 16.0.6) — PURL format may differ'", "")(
    lambda spark, d: findings.context(spark, table_facts(spark, d, 3), table_facts(spark, d, 6)).select("message")
)
query("fnd_os_change_table", "SELECT 'OS changed: ' || x.n_name || ' → ' || y.n_name AS message FROM nation x, nation y WHERE x.n_nationkey = 3 AND y.n_nationkey = 6 AND x.n_name <> y.n_name", "")(lambda spark, d: findings.os_change(spark, table_facts(spark, d, 3), table_facts(spark, d, 6)).select("message"))
snap("fnd_quality_all", "SELECT 'Low ' || what || ' coverage: ' || printf('%.1f', CAST(total - missing AS DOUBLE) / total * 100) || '% (' || missing || ' of ' || total || ' missing)' AS message FROM (SELECT unnest(['license', 'hash', 'PURL']) AS what, unnest([50, 50, 80]) AS least, unnest([lic, hash, purl]) AS missing, total FROM (SELECT count(*) AS total, count(*) FILTER (ordinal % 7 < 4 OR lic = '') AS lic, count(*) FILTER (hash = '') AS hash, count(*) FILTER (ordinal % 4 = 1) AS purl FROM a)) WHERE (total - missing) * 100.0 / total < least")(
    lambda s: findings.quality(profile.profile(s.after.withColumn("licenses", F.when(C("ordinal") % 7 < 4, F.array().cast("array<string>")).otherwise(C("licenses"))).withColumn("purl", F.when(C("ordinal") % 4 == 1, "").otherwise(C("purl"))))).select("message")
)
