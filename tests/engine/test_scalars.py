import pytest
from pyspark.sql import functions as F

from bomspark.functions import scalars as fn


def run(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("out")).first()[0]


@pytest.mark.parametrize("purl, want", [("pkg:rpm/amzn/bash@4.2", "pkg:rpm/bash"), ("pkg:npm/@angular/core@14", "pkg:npm/@angular/core"), ("pkg:maven/org.x/y@1?t=jar#p", "pkg:maven/org.x/y"), ("pkg:npm/@s/n", "pkg:npm/"), ("", "")])
def test_purl_identity(spark, purl, want):
    assert run(spark, fn.normalize_purl(F.col("p")), p=purl) == want


@pytest.mark.parametrize("purl, want", [("pkg:a/b@1%2B2?x=1#s", "1+2"), ("pkg:a/b@1+2", "1 2"), ("pkg:a/b@%zz", "%zz"), ("pkg:a/b", "")])
def test_purl_version(spark, purl, want):
    assert run(spark, fn.purl_version(F.col("p")), p=purl) == want


@pytest.mark.parametrize("cpe, want", [("cpe:2.3:a:v:p:1:*", "cpe:v:p"), ("cpe:/a:v:p:1", "cpe:v:p"), ("cpe:2.3:a:*:p", ""), ("cpe:2.3:a:v", ""), ("cpe:/a:v", ""), ("x", ""), ("", "")])
def test_cpe_identity(spark, cpe, want):
    assert run(spark, fn.normalize_cpe(F.col("c")), c=cpe) == want


@pytest.mark.parametrize("value, want", [("mit", "MIT"), (" noassertion ", ""), ("NONE", ""), ("Apache-2.0 ", "Apache-2.0")])
def test_license(spark, value, want):
    assert run(spark, fn.normalize_license(F.col("c")), c=value) == want


@pytest.mark.parametrize("value, want", [("MPL-2.0", "copyleft"), ("EPL-1.0", "copyleft"), ("Zlib", "permissive"), ("Expat", "permissive"), ("public-domain", "public_domain"), ("x", "unknown"), ("", "unknown")])
def test_license_category(spark, value, want):
    assert run(spark, fn.license_category(F.col("c")), c=value) == want


@pytest.mark.parametrize("a, b, order, kind", [("1.2", "1.2.0", 0, "patch"), ("1.9", "1.10", 1, "minor"), ("2.0", "1.0", -1, "major"), ("x", "1", 0, "unknown"), ("1-2_3", "1.2.4", 1, "patch")])
def test_versions(spark, a, b, order, kind):
    assert run(spark, fn.compare_versions(F.col("a"), F.col("b")), a=a, b=b) == order
    assert run(spark, fn.semver_class(F.col("a"), F.col("b")), a=a, b=b) == kind


@pytest.mark.parametrize("pattern, path, want", [("*.jar", "/a/b/x.jar", True), ("*.jar", "/a/x.jar/b", False), ("/etc/**", "/etc/a/b", True), ("/etc/*.yaml", "/etc/a.yaml", True), ("/etc/*.yaml", "/etc/d/a.yaml", False), ("/etc/**/*.yaml", "/etc/d/e/a.yaml", True), ("/etc/**/*.yaml", "/etc/a.yaml", True), ("[ab]?", "/x/b1", True), ("[^ab]?", "/x/b1", False), ("[", "/x/[", False)])
def test_glob(spark, pattern, path, want):
    assert run(spark, fn.glob_match(F.col("p"), pattern), p=path) is want


def test_added_hash_is_no_change(spark):
    maps = {"b": F.create_map(F.lit("SHA-256"), F.lit("1")), "a": F.create_map(F.lit("SHA-256"), F.lit("1"), F.lit("SHA1"), F.lit("2"))}
    df = spark.range(1).select(*[v.alias(k) for k, v in maps.items()], F.array(F.lit("MIT")).alias("l"), F.lit("1").alias("v"))
    assert df.select(fn.changed(F.col("v"), F.col("v"), F.col("l"), F.col("l"), F.col("b"), F.col("a"))).first()[0] is False


def test_tool_and_paths(spark):
    assert run(spark, F.concat_ws("|", *fn.tool_split(F.col("t"))), t="a-b-1.2") == "a-b|1.2"
    assert run(spark, F.concat_ws("|", *fn.tool_split(F.col("t"))), t="a-b") == "a-b|"
    assert run(spark, fn.extension(F.col("p")), p="/a.b/c.tar.gz") == ".gz"
    assert run(spark, fn.dirname(F.col("p")), p="/a") == "/"
    assert run(spark, F.array_join(fn.breadcrumbs(F.col("p")), ","), p="/a/b") == "/,/a,/a/b"
