"""Snapshot diff, drift classes, duplicates and collisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..tables import growing


def first_wins(comps: DataFrame, key: str = "id") -> DataFrame:
    """The first row of each id by ordinal, as one aggregation with partial combine."""
    rest = [c for c in comps.columns if c != key]
    return comps.groupBy(key).agg(F.min_by(F.struct(*rest), "ordinal").alias("_r")).select(key, "_r.*").select(*comps.columns)


def full_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row per id: status, drift, b and a (the first component of each side as a struct)."""
    side = lambda df, name: first_wins(df).select("id", F.struct(*[c for c in df.columns if c != "id"]).alias(name))
    joined = side(before, "b").join(side(after, "a"), "id", "full")
    args = [F.col(f"{s}.{c}") for c in ("version", "licenses", "hashes") for s in ("b", "a")]
    status = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(fn.changed(*args), "changed").otherwise("same")
    return joined.withColumn("status", status).withColumn("drift", F.when(F.col("status") == "changed", drift_class("b", "a")))


def license_delta(before: Column, after: Column) -> Column:
    plus = F.array_sort(F.transform(F.array_except(after, before), lambda x: F.concat(F.lit("+"), x)))
    minus = F.array_sort(F.transform(F.array_except(before, after), lambda x: F.concat(F.lit("-"), x)))
    return F.concat(plus, minus)


def drift_class(b: str, a: str) -> Column:
    """integrity, version, metadata or none for a changed pair."""
    d = fn.hash_diff(F.col(f"{b}.hashes"), F.col(f"{a}.hashes"))
    hashes = F.size(d["added"]) + F.size(d["removed"]) + F.size(d["changed"]) > 0
    version = F.col(f"{b}.version") != F.col(f"{a}.version")
    delta = F.size(license_delta(F.col(f"{b}.licenses"), F.col(f"{a}.licenses"))) > 0
    return F.when(hashes & ~version, "integrity").when(version, "version").when(delta, "metadata").otherwise("none")


@dataclass(frozen=True)
class DiffResult:
    """Lazily derived frames of one full outer join."""

    rows: DataFrame

    def _side(self, status: str, s: str) -> DataFrame:
        return self.rows.where(F.col("status") == status).select("id", f"{s}.*")

    @property
    def added(self) -> DataFrame:
        return self._side("added", "a")

    @property
    def removed(self) -> DataFrame:
        return self._side("removed", "b")

    @property
    def changed(self) -> DataFrame:
        return self.rows.where(F.col("status") == "changed").withColumn("name", F.col("b.name"))

    def drift_summary(self) -> DataFrame:
        return self.changed.agg(*[F.count_if(F.col("drift") == k).alias(f"{k}_drift") for k in ("version", "integrity", "metadata")])

    def counts(self) -> DataFrame:
        return self.rows.agg(*[F.count_if(F.col("status") == k).alias(k) for k in ("added", "removed", "changed")], F.count_if(F.col("drift") == "integrity").alias("integrity"))


def diff(before: DataFrame, after: DataFrame) -> DiffResult:
    return DiffResult(full_diff(before, after))


def duplicates(comps: DataFrame) -> DataFrame:
    """Groups of one id with several rows: count, distinct versions, first name."""
    return comps.groupBy("id").agg(F.count("*").alias("count"), F.sort_array(F.collect_set("version")).alias("versions"), F.min_by("name", "ordinal").alias("name")).where("count > 1")


def duplicate_version_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Groups new, resolved, or on both sides with versions added or removed."""
    b = duplicates(before).select("id", F.col("versions").alias("bv"))
    a = duplicates(after).select("id", F.col("versions").alias("av"))
    j = b.join(a, "id", "full")
    j = j.withColumn("status", F.when(F.col("bv").isNull(), "new").when(F.col("av").isNull(), "resolved").otherwise("kept"))
    j = j.withColumn("versions_added", F.when(F.col("status") == "kept", F.array_except("av", "bv"))).withColumn("versions_removed", F.when(F.col("status") == "kept", F.array_except("bv", "av")))
    return j.where((F.col("status") != "kept") | (F.size("versions_added") + F.size("versions_removed") > 0))


def collisions(comps: DataFrame) -> DataFrame:
    """(id, reason): one id with several names, else one id and version with several hashes."""
    # ids hardly repeat within a task: rows go to their id's task first, as tables made before that would hold a task's whole input
    differ = lambda c: (F.min(c) != F.max(c)).alias("differ")
    names = comps.select("id", "name").repartition("id").groupBy("id").agg(differ("name")).where("differ").select("id", F.lit("name_mismatch").alias("reason"))
    hashes = comps.select("id", "version", F.explode("hashes").alias("alg", "value")).repartition("id").groupBy("id", "version", "alg").agg(differ("value")).where("differ").select("id").distinct()
    return names.unionByName(hashes.join(growing(names), "id", "left_anti").withColumn("reason", F.lit("hash_mismatch")))


def both_collisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Collisions of either side, each (id, reason) once."""
    return collisions(before).unionByName(collisions(after)).distinct()


def collision_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, reason, components: collisions of either side with the different names and versions of their components."""
    rows = before.select("id", "name", "version").unionByName(after.select("id", "name", "version")).distinct()
    named = F.sort_array(F.collect_list(F.concat_ws(" ", "name", "version")))
    return both_collisions(before, after).join(rows, "id").groupBy("id", "reason").agg(named.alias("components"))


def samples_by_type(comps: DataFrame, most: int = 5) -> DataFrame:
    """type, total and the first ``most`` ids, in id order."""
    t = comps.select(fn.effective_type(F.col("purl"), F.col("id")).alias("type"), "id")
    rank = F.row_number().over(Window.partitionBy("type").orderBy("id"))
    # the rank alone is a group limit, which tasks apply before the shuffle
    first = t.withColumn("rank", rank).where(F.col("rank") <= most)
    return first.join(t.groupBy("type").agg(F.count("*").alias("total")), "type").select("type", "id", "total", "rank")
