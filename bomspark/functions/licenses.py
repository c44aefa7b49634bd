"""Validity of licence expressions, as JVM-side column expressions.

Known ids and exceptions are parameters. By default they are the whole public list as the ``packaging``
library carries it; without it, pass a list, or the families below (``known_ids``), on purpose.
"""

from __future__ import annotations

from collections.abc import Collection
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public licence identifiers, by family and version.
GNU = {"AGPL": ("1.0", "3.0"), "GPL": ("1.0", "2.0", "3.0"), "LGPL": ("2.0", "2.1", "3.0"), "GFDL": ("1.1", "1.2", "1.3")}
GNU_ENDS = ("", "-only", "-or-later")
CREATIVE_COMMONS = ("CC-BY", "CC-BY-NC", "CC-BY-NC-ND", "CC-BY-NC-SA", "CC-BY-ND", "CC-BY-SA")
CREATIVE_COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
VERSIONED = {
    "AFL": ("1.1", "1.2", "2.0", "2.1", "3.0"), "Apache": ("1.0", "1.1", "2.0"), "APSL": ("1.0", "1.1", "1.2", "2.0"), "Artistic": ("1.0", "2.0"), "BitTorrent": ("1.0", "1.1"), "BlueOak": ("1.0.0",), "BSL": ("1.0",), "BUSL": ("1.1",), "bzip2": ("1.0.6",),
    "CC0": ("1.0",), "CDDL": ("1.0", "1.1"), "CECILL": ("1.0", "1.1", "2.0", "2.1"), "CPAL": ("1.0",), "CPL": ("1.0",), "ECL": ("1.0", "2.0"), "EFL": ("1.0", "2.0"), "EPL": ("1.0", "2.0"), "EUPL": ("1.0", "1.1", "1.2"), "IPL": ("1.0",), "libpng": ("2.0",),
    "LPPL": ("1.0", "1.1", "1.2", "1.3a", "1.3c"), "MPL": ("1.0", "1.1", "2.0", "2.0-no-copyleft-exception"), "MulanPSL": ("1.0", "2.0"), "NASA": ("1.3",), "NPL": ("1.0", "1.1"), "NPOSL": ("3.0",), "ODbL": ("1.0",), "ODC-By": ("1.0",), "OFL": ("1.0", "1.1"),
    "OLDAP": ("1.1", "1.2", "1.3", "1.4", "2.0", "2.0.1", "2.1", "2.2", "2.2.1", "2.2.2", "2.3", "2.4", "2.5", "2.6", "2.7", "2.8"), "OSL": ("1.0", "1.1", "2.0", "2.1", "3.0"), "PDDL": ("1.0",), "PHP": ("3.0", "3.01"), "PSF": ("2.0",), "Python": ("2.0", "2.0.1"),
    "QPL": ("1.0",), "RPL": ("1.1", "1.5"), "SPL": ("1.0",), "SSPL": ("1.0",), "Unicode-DFS": ("2015", "2016"), "Unicode": ("3.0",), "UPL": ("1.0",), "Watcom": ("1.0",), "ZPL": ("1.1", "2.0", "2.1"),
}
SINGLE = (
    "0BSD", "AAL", "Beerware", "BSD-1-Clause", "BSD-2-Clause", "BSD-2-Clause-Patent", "BSD-2-Clause-Views", "BSD-3-Clause", "BSD-3-Clause-Attribution", "BSD-3-Clause-Clear", "BSD-3-Clause-LBNL", "BSD-4-Clause", "BSD-4-Clause-UC", "BSD-Protection", "BSD-Source-Code", "CNRI-Python", "curl", "Fair", "FTL",
    "HPND", "HPND-sell-variant", "ICU", "IJG", "Info-ZIP", "Intel", "ISC", "JSON", "Libpng", "libtiff", "MIT", "MIT-0", "MIT-advertising", "MIT-CMU", "MIT-enna", "MIT-feh", "MIT-Modern-Variant", "MITNFA", "MS-PL", "MS-RL", "Multics", "NCSA", "Nokia", "NTP", "OpenSSL", "PostgreSQL", "Qhull", "Ruby", "SAX-PD",
    "SISSL", "Sleepycat", "SMLNJ", "TCL", "Unicode-TOU", "Unlicense", "Vim", "W3C", "WTFPL", "X11", "Xnet", "Zlib", "zlib-acknowledgement",
)
EXCEPTIONS = (
    "Autoconf-exception-2.0", "Autoconf-exception-3.0", "Bison-exception-2.2", "Bootloader-exception", "Classpath-exception-2.0", "eCos-exception-2.0", "FLTK-exception", "Font-exception-2.0", "GCC-exception-2.0", "GCC-exception-3.1", "GPL-CC-1.0", "Libtool-exception", "Linux-syscall-note", "LLVM-exception", "mif-exception",
    "OCaml-LGPL-linking-exception", "OpenJDK-assembly-exception-1.0", "openvpn-openssl-exception", "Qt-GPL-exception-1.0", "Qt-LGPL-exception-1.1", "Swift-exception", "u-boot-exception-2.0", "Universal-FOSS-exception-1.0", "WxWindows-exception-3.1",
)


def known_ids() -> list[str]:
    gnu = [f"{name}-{v}{end}" for name, versions in GNU.items() for v in versions for end in GNU_ENDS]
    cc = [f"{name}-{v}" for name in CREATIVE_COMMONS for v in CREATIVE_COMMONS_VERSIONS]
    return [*gnu, *cc, *(f"{name}-{v}" for name, versions in VERSIONED.items() for v in versions), *SINGLE]


@cache
def public_list() -> tuple[tuple[str, ...], tuple[str, ...]]:
    """All public licence ids and exceptions; an error where the list isn't installed."""
    try:
        from packaging.licenses import _spdx
    except ImportError as error:
        raise RuntimeError("no public licence list: install packaging 24.2 or later, or pass ids and exceptions") from error
    return tuple(x["id"] for x in _spdx.LICENSES.values()), tuple(x["id"] for x in _spdx.EXCEPTIONS.values())


def valid_expression(c: Column, ids: Collection[str] | None = None, exceptions: Collection[str] | None = None) -> Column:
    """Known ids (any case, a final + allowed) or LicenseRefs, with exceptions, joined by AND and OR, in balanced brackets.

    Each word becomes one letter; brackets around a joined list are then replaced by one licence,
    as often as there are brackets, until nothing but a joined list may be left."""
    ids = public_list()[0] if ids is None else ids
    exceptions = public_list()[1] if exceptions is None else exceptions
    words = F.filter(F.split(F.regexp_replace(c, r"([()])", " $1 "), r"\s+"), lambda w: w != "")
    known = lambda w: F.lower(F.regexp_replace(w, r"\+$", "")).isin(*[i.lower() for i in ids]) | F.regexp_like(w, F.lit(r"^(?:DocumentRef-[A-Za-z0-9.\-]+:)?LicenseRef-[A-Za-z0-9.\-]+$"))
    letter = lambda w: F.when(w.isin("(", ")"), w).when(w.isin("AND", "OR"), "A").when(w == "WITH", "W").when(known(w), "L").when(F.lower(w).isin(*[e.lower() for e in exceptions]), "E").otherwise("?")
    plain = F.regexp_replace(F.array_join(F.transform(words, letter), ""), "LWE", "L")
    depth = F.size(F.filter(words, lambda w: w == "("))
    flat = F.aggregate(F.sequence(F.lit(0), depth), plain, lambda text, _: F.regexp_replace(text, r"\(L(?:AL)*\)", "L"))
    return F.coalesce(F.regexp_like(flat, F.lit("^L(?:AL)*$")), F.lit(False))


def valid_spdx(licenses: Column, ids: Collection[str] | None = None) -> Column:
    """At least one licence, and each a valid expression."""
    return (F.size(licenses) > 0) & F.forall(licenses, lambda x: valid_expression(x, ids))


def dictionary(comps: DataFrame, *by: str, ids: Collection[str] | None = None) -> DataFrame:
    """license, count, valid: every different licence text with its number of uses, validated once."""
    texts = comps.select(*by, F.explode("licenses").alias("license")).groupBy(*by, "license").agg(F.count("*").alias("count"))
    return texts.withColumn("valid", valid_expression(F.col("license"), ids))


def valid_components(comps: DataFrame, *by: str, ids: Collection[str] | None = None) -> DataFrame:
    """spdx: how many components have licences that are all valid; each different list is validated once."""
    lists = comps.groupBy(*by, "licenses").agg(F.count("*").alias("n")).where(valid_spdx(F.col("licenses"), ids))
    return lists.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("spdx"))
