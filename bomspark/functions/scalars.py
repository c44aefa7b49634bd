"""Column builders for component identity, licences, versions, paths and mappings.

All are JVM-side expressions. Strings are never null here: absent is the empty string.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
OS_PURL_TYPES = ("rpm", "deb", "apk", "alpm")
COPYLEFT = ("GPL", "LGPL", "AGPL", "MPL", "EPL", "CPL", "CDDL", "EUPL")
PERMISSIVE = ("MIT", "BSD", "APACHE", "ISC", "ZLIB", "UNLICENSE", "WTFPL", "CC0", "EXPAT", "X11")
PUBLIC_DOMAIN = ("PUBLIC-DOMAIN", "PUBLIC DOMAIN", "PUBLICDOMAIN")
NO_LICENSE = ("noassertion", "none", "unknown")


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def trim(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text(c), r"(?U)^\s+|\s+$", "")


def normalize_name(c: Column) -> Column:
    return F.lower(trim(c))


def normalize_license(c: Column) -> Column:
    t = trim(c)
    low = F.lower(t)
    return F.when(low.isin(*NO_LICENSE), "").when(low == "mit", "MIT").otherwise(t)


def normalize_licenses(c: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.filter(F.transform(F.coalesce(c, empty), normalize_license), lambda x: x != "")


def _purl_core(p: Column) -> Column:
    return F.substring_index(F.substring_index(text(p), "#", 1), "?", 1)


def normalize_purl(p: Column) -> Column:
    """Without subpath, qualifiers, version, and without the namespace of OS packages."""
    bare = F.regexp_replace(_purl_core(p), r"(?s)@[^@]*$", "")
    return F.regexp_replace(bare, rf"(?s)^pkg:({'|'.join(OS_PURL_TYPES)})/[^/]*/", "pkg:$1/")


def purl_version(p: Column) -> Column:
    core = _purl_core(p)
    raw = F.when(F.contains(core, F.lit("@")), F.substring_index(core, "@", -1)).otherwise("")
    return F.coalesce(F.try_url_decode(raw), raw)


def pkg_type(p: Column) -> Column:
    """The type of a purl, empty when it has none."""
    return F.regexp_extract(text(p), r"(?s)^pkg:([^/]*)/", 1)


def purl_type(p: Column) -> Column:
    return F.when(F.regexp_like(text(p), F.lit("(?s)^pkg:[^/]*/")), pkg_type(p)).otherwise("unknown")


def effective_type(p: Column, id_: Column) -> Column:
    return F.when(text(p) != "", purl_type(p)).otherwise(purl_type(id_))


def stats_type(p: Column, id_: Column, kind: Column) -> Column:
    t = effective_type(p, id_)
    return F.when((t == "unknown") & (text(kind) != ""), kind).otherwise(t)


def normalize_cpe(c: Column) -> Column:
    """``cpe:vendor:product`` of a 2.3 or 2.2 name, empty when it has none."""
    long, short = F.split(text(c), ":"), F.split(F.substring(text(c), 6, 1 << 30), ":")
    product = lambda v, i: F.concat_ws(":", F.lit("cpe"), F.get(v, F.lit(i)), F.get(v, F.lit(i + 1)))
    named = lambda v, i, bad: (F.size(v) > i + 1) & ~F.get(v, F.lit(i)).isin(*bad) & ~F.get(v, F.lit(i + 1)).isin(*bad)
    return F.when(text(c).startswith("cpe:2.3:") & named(long, 3, ("", "*")), product(long, 3)).when(text(c).startswith("cpe:/") & named(short, 1, ("",)), product(short, 1)).otherwise("")


def tool_split(c: Column) -> tuple[Column, Column]:
    """Name and version of ``name-version``, split at the last dash before a digit."""
    found = F.regexp_like(text(c), F.lit(r"(?s)^.+-[0-9][^-]*$"))
    return F.when(found, F.regexp_extract(text(c), r"(?s)^(.+)-([0-9][^-]*)$", 1)).otherwise(text(c)), F.when(found, F.regexp_extract(text(c), r"(?s)^(.+)-([0-9][^-]*)$", 2)).otherwise("")


def compute_id(purl: Column, cpes: Column, bom_ref: Column, spdxid: Column, namespace: Column, name: Column) -> Column:
    usable = F.filter(F.transform(F.coalesce(cpes, F.array().cast("array<string>")), normalize_cpe), lambda x: x != "")
    return (
        F.when(text(purl) != "", normalize_purl(purl)).when(F.size(usable) > 0, F.get(usable, F.lit(0))).when(text(bom_ref) != "", F.concat(F.lit("ref:"), bom_ref)).when(text(spdxid) != "", F.concat(F.lit("ref:"), spdxid)).when(text(namespace) != "", F.concat_ws("/", namespace, text(name))).otherwise(text(name))
    )


def _any_of(c: Column, words: tuple[str, ...]) -> Column:
    return F.regexp_like(F.upper(text(c)), F.lit("|".join(map(re.escape, words))))


def license_category(c: Column) -> Column:
    return F.when(text(c) == "", "unknown").when(_any_of(c, COPYLEFT), "copyleft").when(_any_of(c, PERMISSIVE), "permissive").when(_any_of(c, PUBLIC_DOMAIN), "public_domain").otherwise("unknown")


def version_parts(v: Column) -> Column:
    return F.transform(F.regexp_extract_all(text(v), F.lit(r"(?:^|[.\-_])(\d+)"), F.lit(1)), lambda x: x.cast("bigint"))


def compare_versions(a: Column, b: Column) -> Column:
    """1 for an upgrade from a to b, -1 for a downgrade, 0 when equal or without numbers."""
    x, y = version_parts(a), version_parts(b)
    n = F.greatest(F.size(x), F.size(y))
    zero = F.lit(0).cast("bigint")
    px, py = F.concat(x, F.array_repeat(zero, n - F.size(x))), F.concat(y, F.array_repeat(zero, n - F.size(y)))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0).when(px < py, 1).when(px > py, -1).otherwise(0)


def semver_class(a: Column, b: Column) -> Column:
    x, y = version_parts(a), version_parts(b)
    at = lambda v, i: F.coalesce(F.get(v, F.lit(i)), F.lit(0).cast("bigint"))
    known = (F.size(x) > 0) & (F.size(y) > 0)
    return F.when(~known, "unknown").when(at(x, 0) != at(y, 0), "major").when(at(x, 1) != at(y, 1), "minor").otherwise("patch")


def path_prefix(locations: Column) -> Column:
    """The first location's first three segments."""
    first = F.get(locations, F.lit(0))
    return F.when(text(first) == "", "").otherwise(F.concat(F.lit("/"), F.array_join(F.slice(F.split(F.regexp_replace(first, "^/", ""), "/"), 1, 3), "/")))


def multiset_eq(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def hash_diff(before: Column, after: Column) -> Column:
    """Struct of maps added, removed and changed (algorithm to value, or to before and after)."""
    both = F.map_filter(before, lambda k, _: F.map_contains_key(after, k))
    return F.struct(
        F.map_filter(after, lambda k, _: ~F.map_contains_key(before, k)).alias("added"),
        F.map_filter(before, lambda k, _: ~F.map_contains_key(after, k)).alias("removed"),
        F.map_filter(F.transform_values(both, lambda k, v: F.struct(v.alias("before"), F.element_at(after, k).alias("after"))), lambda _, v: v["before"] != v["after"]).alias("changed"),
    )


def has_contact(c: Column) -> Column:
    return F.contains(text(c), F.lit("@")) | text(c).startswith("http://") | text(c).startswith("https://")


def has_lookup_id(purl: Column, cpes: Column) -> Column:
    return (text(purl) != "") | (F.size(F.coalesce(cpes, F.array().cast("array<string>"))) > 0)


# Fixed mapping tables of the target formats.
CDX_HASHES = {"MD5": "MD5", "SHA1": "SHA-1", "SHA256": "SHA-256", "SHA384": "SHA-384", "SHA512": "SHA-512"}
SPDX_HASHES = {"MD5": "MD5", "SHA1": "SHA1", "SHA224": "SHA224", "SHA256": "SHA256", "SHA384": "SHA384", "SHA512": "SHA512"}
CDX_TYPES = ("application", "framework", "library", "container", "operating-system", "device", "firmware", "file")
SYFT_TYPES = {"npm": "npm", "pypi": "python", "gem": "gem", "maven": "java-archive", "golang": "go-module", "cargo": "rust-crate", "rpm": "rpm", "deb": "deb", "apk": "apk", "nuget": "dotnet", "cocoapods": "pod", "hex": "hex", "composer": "php-composer"}


def _mapped(c: Column, table: dict[str, str], otherwise: Column) -> Column:
    out = otherwise
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def hash_alg(c: Column, target: str = "cyclonedx") -> Column:
    key = F.replace(F.upper(text(c)), F.lit("-"), F.lit(""))
    return _mapped(key, CDX_HASHES if target == "cyclonedx" else SPDX_HASHES, F.upper(text(c)))


def cdx_type(c: Column) -> Column:
    return F.when(F.lower(text(c)).isin(*CDX_TYPES), F.lower(text(c))).otherwise("library")


def bom_ref(ref: Column, purl: Column, name: Column, version: Column, id_: Column) -> Column:
    return F.when(text(ref) != "", ref).when(text(purl) != "", purl).when((text(name) != "") & (text(version) != ""), F.concat_ws("@", name, version)).when(text(name) != "", name).otherwise(id_)


def spdx_id(spdxid: Column, name: Column, version: Column, index: Column) -> Column:
    clean = lambda c: F.regexp_replace(c, r"[^a-zA-Z0-9.\-]", "-")
    named = F.when(text(version) != "", F.concat_ws("-", name, version)).otherwise(name)
    return F.when(text(spdxid) != "", clean(F.regexp_replace(spdxid, "^SPDXRef-", ""))).when(text(name) != "", clean(named)).otherwise(F.concat(F.lit("Package-"), index.cast("string")))


def syft_type(purl: Column, kind: Column) -> Column:
    return F.when(text(kind) != "", kind).otherwise(_mapped(pkg_type(purl), SYFT_TYPES, F.lit("unknown")))


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regular expression; ``*`` and ``?`` never cross ``/``."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append(f"[{body}]")
            i = end
        elif c == "[":
            return r"(?!)"  # a broken class matches nothing
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def glob_match(path: Column, pattern: str) -> Column:
    if not pattern.startswith("/"):
        return F.regexp_like(F.substring_index(path, "/", -1), F.lit(f"(?s)^{glob_regex(pattern)}$"))
    if "**" not in pattern:
        return F.regexp_like(path, F.lit(f"(?s)^{glob_regex(pattern)}$"))
    prefix, _, suffix = pattern.partition("**")
    tail = suffix.removeprefix("/")
    return F.regexp_like(path, F.lit(f"(?s)^{re.escape(prefix)}" + (f"(?:.*/)?{glob_regex(tail)}$" if tail else "")))


def dirname(p: Column) -> Column:
    cut = F.regexp_replace(p, "(?s)/[^/]*$", "")
    return F.when(~F.contains(p, F.lit("/")), ".").when(cut == "", "/").otherwise(cut)


def basename(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def extension(p: Column) -> Column:
    return F.regexp_extract(basename(p), r"(?s)(\.[^.]*)$", 1)


def breadcrumbs(p: Column) -> Column:
    parts = F.filter(F.split(p, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))


def search_text(c: dict[str, Column]) -> Column:
    return F.lower(F.concat_ws(" ", *[text(c[k]) for k in ("name", "version", "purl", "id", "supplier")], F.array_join(c["cpes"], " "), F.array_join(c["licenses"], " "), *[text(c[k]) for k in ("raw",) if k in c]))


def change_strings(bv: Column, av: Column, bl: Column, al: Column, bh: Column, ah: Column) -> Column:
    show = lambda x: F.concat(F.lit("["), F.array_join(x, " "), F.lit("]"))
    arrow = F.lit(" -> ")
    version = F.when(bv != av, F.array(F.concat(F.lit("version: "), bv, arrow, av)))
    licenses = F.when(~multiset_eq(bl, al), F.array(F.concat(F.lit("licenses: "), show(bl), arrow, show(al))))
    changed = F.array_sort(F.transform(F.map_entries(hash_diff(bh, ah)["changed"]), lambda e: F.concat(F.lit("hash["), e["key"], F.lit("]: "), e["value"]["before"], arrow, e["value"]["after"])))
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(version, none), F.coalesce(licenses, none), changed)


def changed(bv: Column, av: Column, bl: Column, al: Column, bh: Column, ah: Column) -> Column:
    return (bv != av) | ~multiset_eq(bl, al) | (F.size(hash_diff(bh, ah)["changed"]) > 0)


def fmt_count(n: Column) -> Column:
    return F.format_number(n, 0)


def fixed(x: Column) -> Column:
    """A double with one decimal place, rounded half to even on its exact binary value.

    The fraction, times 2**59, is a whole number (but for bits far below a tenth); ten times that is
    tenths above the 59th bit and what is cut off below it, which integers compare with a half. Whole
    parts of 2**53 and more are split in two, so that they are exact up to 2**116."""
    size, one = F.abs(x), 1 << 59
    big = size >= F.lit(float(1 << 53))
    low = F.when(big, 0.0).otherwise(size)
    part = F.floor((low - F.floor(low).cast("double")) * F.lit(float(one))) * 10
    tenths, rest = F.shiftright(part, 59), part.bitwiseAND(F.lit(one - 1))
    up = (rest > one >> 1) | ((rest == one >> 1) & (tenths % 2 == 1))
    tenths = tenths + F.when(up, 1).otherwise(0)
    high = F.floor(F.when(big, size).otherwise(0.0) / F.lit(float(1 << 53)))
    split = high.cast("decimal(20,0)") * F.lit(1 << 53).cast("decimal(16,0)") + F.floor(size - high.cast("double") * F.lit(float(1 << 53))).cast("decimal(20,0)")
    whole = F.when(big, split.cast("string")).otherwise((F.floor(low) + F.when(tenths == 10, 1).otherwise(0)).cast("string"))
    text = F.concat(F.when(x < 0, "-").otherwise(""), whole, F.lit("."), (tenths % 10).cast("string"))
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "+Inf").when(x == float("-inf"), "-Inf").when(x.isNotNull(), text)


def percent_of(count: Column, total: Column) -> Column:
    """count of total in percent with one decimal place: the quotient of doubles times 100, as the messages have it."""
    return fixed(F.try_divide(count.cast("double"), total.cast("double")) * 100.0)


def percent_text(count: Column, total: Column) -> Column:
    """``percent_of`` with its sign, 0.0% of nothing."""
    return F.when(total == 0, "0.0%").otherwise(F.concat(percent_of(count, total), F.lit("%")))


def file_size(n: Column) -> Column:
    """GB with one digit, MB and KB whole, else bytes; steps of 1,024, rounded half to even."""
    whole = lambda unit, name: F.format_string(f"%.0f {name}", F.bround(n / unit, 0))
    return F.when(n >= 1 << 30, F.concat(fixed(n.cast("double") / float(1 << 30)), F.lit(" GB"))).when(n >= 1 << 20, whole(1 << 20, "MB")).when(n >= 1 << 10, whole(1 << 10, "KB")).otherwise(F.format_string("%d B", n.cast("bigint")))


def or_none(c: Column) -> Column:
    return F.when(text(c) == "", "(none)").otherwise(c)


def octal_mode(mode: Column) -> Column:
    """The permission bits of a file mode, as octal digits."""
    return F.conv(mode.bitwiseAND(F.lit(0o7777)).cast("string"), 10, 8)
