"""Key findings over counts, as rows of (finding_ordinal, message).

Every finding is counted by aggregation first; only the few keys a message names are brought
together. Percentages are rounded half to even on their decimal form.

The wording of the messages consists of fixed values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from .diff import DiffResult
from .findings import _finding, percent
from .profile import by_column, by_prefix, by_type, profile_aggregates, top
from .rules import ecosystem_changes, gaps, stable

# What an integrity change means by package type.
EXPECTED, REVIEW = ("rpm", "deb", "apk"), ("maven", "npm", "pypi", "golang")
ENTRY = "struct<o:bigint,key:string>"


def _ranked(counts: DataFrame, limit: int | None = None) -> DataFrame:
    """One row: entries (o = -count, key) of the largest keys in order, n_keys and total of all; none without keys."""
    kept = (top(counts, limit) if limit else counts).select(F.struct((-F.col("count")).alias("o"), F.col("key").alias("key")).cast(ENTRY).alias("e"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("t"))
    whole = counts.agg(F.count("*").alias("k"), F.sum("count").alias("t")).select(F.lit(None).cast(ENTRY).alias("e"), "k", "t")
    return kept.unionByName(whole).agg(F.array_sort(F.collect_list("e")).alias("entries"), F.sum("k").alias("n_keys"), F.sum("t").alias("total")).where("n_keys > 0")


def _shown() -> Column:
    return F.array_join(F.transform("entries", lambda e: F.concat(e["key"], F.lit(" ("), fn.fmt_count(-e["o"]), F.lit(")"))), ", ")


def _more() -> Column:
    left = F.col("n_keys") - F.size("entries")
    return F.when(left > 0, F.format_string(" + %d more", left)).otherwise("")


def _joined(*parts: Column) -> Column:
    """The parts that are not null, with commas; null when there are none."""
    kept = F.array_compact(F.array(*parts))
    return F.when(F.size(kept) > 0, F.array_join(kept, ", "))


def _some(row: DataFrame, ordinal: int, prefix: str, *parts: Column) -> DataFrame:
    return _finding(row.withColumn("parts", _joined(*parts)).where("parts is not null"), ordinal, F.concat(F.lit(prefix), "parts"))


def dominant_type(comps: DataFrame) -> DataFrame:
    """A type that makes up 60 percent, else the three largest types."""
    lead, n = F.col("entries")[0]["key"], -F.col("entries")[0]["o"]
    single = F.concat(F.lit("Dominated by "), lead, F.lit(": "), fn.fmt_count(n), F.lit(" of "), fn.fmt_count(F.col("total")), F.lit(" packages ("), percent(n, F.col("total")), F.lit("%)"))
    return _finding(_ranked(by_type(comps), 3), 2, F.when(n * 100 / F.col("total") >= 60, single).otherwise(F.concat(F.lit("Top ecosystems: "), _shown(), _more())))


def hotspots(comps: DataFrame, ordinal: int = 5, what: str = "directories") -> DataFrame:
    """The four path prefixes with most components, from 20 components on."""
    prefix = fn.path_prefix(F.col("locations"))
    enough = comps.groupBy(prefix.alias("key")).agg(F.count("*").alias("count"))
    small = enough.agg(F.sum("count").alias("all")).where("all >= 20")
    listed = _ranked(by_prefix(comps), 4).select(_shown().alias("text"), F.lit(1).alias("one"))
    return _finding(listed.join(small.withColumn("one", F.lit(1)), "one"), ordinal, F.concat(F.lit(f"Top {what}: "), "text"))


def change_hotspots(diff: DiffResult) -> DataFrame:
    return hotspots(diff.removed, 17, "removal areas").unionByName(hotspots(diff.added, 17, "addition areas"))


def license_profile(comps: DataFrame) -> DataFrame:
    """Shares of permissive and copyleft licences, and of unknown ones above 10 percent."""
    share = lambda c: F.col(f"lic_{c}") * 100 / F.col("total")
    part = lambda c, least: F.when(share(c) > least, F.concat(F.format_string("%.0f", F.bround(share(c), 0)), F.lit(f"% {c}")))
    return _some(comps.agg(*profile_aggregates()).where("total > 0"), 6, "License profile: ", part("permissive", 0), part("copyleft", 0), part("unknown", 10))


def top_catalogers(comps: DataFrame) -> DataFrame:
    return _finding(_ranked(by_column(comps, "found_by"), 3), 9, F.concat(F.lit("Top catalogers: "), _shown(), _more()))


def surface(comps: DataFrame, before: dict, after: dict) -> DataFrame:
    """Changes in the number of packages, files and containments; ``comps`` has both sides in ``side``."""
    of = lambda info, key: F.lit(int(info.get(key) or 0)).cast("long")
    of_relation = lambda info: F.lit(int((info.get("relationship_counts") or {}).get("contains") or 0)).cast("long")
    row = comps.agg(F.count_if(F.col("side") == "before").alias("b"), F.count_if(F.col("side") == "after").alias("a")).where("a > 0 or b > 0")

    def delta(b: Column, a: Column, what: str) -> Column:
        share = F.when(b == 0, "+Inf").otherwise(percent(a - b, F.when(b != 0, b)))
        return F.when(a != b, F.concat(F.format_string("%+d", a - b), F.lit(f" {what} ("), share, F.lit("%)")))

    known = lambda b, a, what: F.when((b > 0) & (a > 0), delta(b, a, what))
    return _some(row, 11, "Attack surface: ", delta(F.col("b"), F.col("a"), "packages"), known(of(before, "files_count"), of(after, "files_count"), "files"), known(of_relation(before), of_relation(after), "relationships"))


def ecosystems(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row for each type that only one side has."""
    changes = ecosystem_changes(by_type(before), by_type(after))
    gone = F.concat("key", F.lit(" ecosystem entirely removed ("), fn.fmt_count(F.col("count")), F.lit(" → 0 packages)"))
    return _finding(changes, 12, F.when(F.col("change") == "vanished", gone).otherwise(F.concat(F.lit("New ecosystem: "), F.col("key"), F.format_string(" (%d packages)", "count"))))


def version_changes(before: DataFrame, diff: DiffResult) -> DataFrame:
    """Downgrades (five named, by id) and upgrades among the packages that both sides share."""
    old, new = F.col("b.version"), F.col("a.version")
    way = fn.compare_versions(old, new)
    moved = diff.changed.where("drift = 'version'").select("id", "name", old.alias("old"), new.alias("new"), F.when(way > 0, fn.semver_class(old, new)).when(way < 0, "down").otherwise("unclear").alias("kind"))
    tally = [moved.groupBy("kind").count().select("kind", F.col("count").alias("n")), before.agg(F.count("*").alias("n")).select(F.lit("shared").alias("kind"), "n"), diff.removed.agg((-F.count("*")).alias("n")).select(F.lit("shared").alias("kind"), "n")]
    named = moved.where("kind = 'down'").orderBy("id").limit(5).select(F.struct("id", F.concat("name", F.lit(" "), "old", F.lit("→"), "new").alias("text")).alias("e"))
    no_entry = F.lit(None).cast("struct<id:string,text:string>").alias("e")
    rows = reduce(DataFrame.unionByName, [t.select("kind", "n", no_entry) for t in tally] + [named.select(F.lit("named").alias("kind"), F.lit(0).cast("long").alias("n"), "e")])
    kinds = ("shared", "down", "major", "minor", "patch", "unclear")
    row = rows.agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in kinds], F.array_sort(F.collect_list("e")).alias("list")).where("shared > 0")
    up = F.col("major") + F.col("minor") + F.col("patch")
    among = F.concat(F.lit(" among "), fn.fmt_count(F.col("shared")), F.lit(" shared packages"))
    left = F.col("down") - F.size("list")
    downs = F.concat(F.format_string("%d version downgrades detected: ", "down"), F.array_join("list.text", ", "), F.when(left > 0, F.format_string(" + %d more", left)).otherwise(""))
    split = F.when((F.col("major") > 0) | (F.col("minor") > 0), F.concat(F.lit(" ("), _joined(*[F.when(F.col(k) > 0, F.format_string(f"%d {k}", k)) for k in ("major", "minor", "patch")]), F.lit(")"))).otherwise("")
    none = F.when(up + F.col("down") + F.col("unclear") == 0, F.concat(F.lit("0 version changes"), among, F.lit(" — no actual upgrades")))
    messages = F.array_compact(F.array(none, F.when(F.col("down") > 0, downs), F.when(up > 0, F.concat(F.format_string("%d version upgrades", up), split, among))))
    return _finding(row.select(F.explode(messages).alias("m")), 14, F.col("m"))


def integrity(diff: DiffResult) -> DataFrame:
    """Integrity drift by package type, with what it means for the type."""
    counts = diff.changed.where("drift = 'integrity'").groupBy(fn.effective_type(F.col("b.purl"), F.col("id")).alias("key")).count()
    note = lambda k: F.when(k.isin(*EXPECTED), " (expected for rebuilds)").when(k.isin(*REVIEW), " (review recommended)").otherwise("")
    listed = F.array_join(F.transform("entries", lambda e: F.concat((-e["o"]).cast("string"), F.lit(" "), e["key"], note(e["key"]))), ", ")
    return _finding(_ranked(counts), 15, F.concat(F.format_string("Integrity drift (%d total): ", "total"), listed))


def stable_types(before: DataFrame, after: DataFrame) -> DataFrame:
    return _finding(_ranked(stable(by_type(before), by_type(after))), 18, F.concat(F.lit("Core system packages stable: "), _shown(), F.lit(" unchanged")))


def license_shift(comps: DataFrame) -> DataFrame:
    """Change of copyleft and permissive counts; ``comps`` has both sides in ``side``."""
    first = fn.license_category(F.get("licenses", F.lit(0)))
    after = F.col("side") == "after"
    change = lambda c: F.sum(F.when(first == c, F.when(after, 1).otherwise(-1)).otherwise(0)).alias(c)
    row = comps.agg(change("copyleft"), change("permissive"), F.count_if(after).alias("a"), F.count_if(~after).alias("b")).where("a > 0 and b > 0")
    return _some(row, 19, "License shift: ", *[F.when(F.col(c) != 0, F.format_string(f"{c} %+d", c)) for c in ("copyleft", "permissive")])


def cataloger_gaps(before: DataFrame, after: DataFrame) -> DataFrame:
    lost = gaps(by_column(before, "found_by"), by_column(after, "found_by"))
    return _finding(lost, 20, F.concat("key", F.lit(" found "), fn.fmt_count(F.col("count")), F.lit(" packages in Before but none in After")))
