"""Dependency graphs of one or two documents, numbered and written once.

Ids become dense longs in id order, shared by all sides; a node's dependencies stand in rows of at
most ``PIECE`` numbers, in adjacency order. Roots, reachability, paths, trees and differences read
these two tables. Reachability goes a level a round for all roots at once: a level is added to the
folder of its predecessors, which is what the next one leaves out. Where paths are wanted, each pair
keeps its parent, the one found first, instead of its path; paths are put together for those pairs
alone that are asked for.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..tables import growing, numbered, settle, shared_folder

PIECE = 4096


@dataclass(frozen=True)
class DependencyDiff:
    """Direct dependencies added and removed per node, and targets newly or no longer reached."""

    added: DataFrame
    removed: DataFrame
    transitive_new: DataFrame
    transitive_lost: DataFrame

    def summary(self) -> DataFrame:
        """depth_1, depth_2, depth_3_plus of what is newly reached."""
        depth = F.col("depth")
        return self.transitive_new.agg(F.count_if(depth == 1).alias("depth_1"), F.count_if(depth == 2).alias("depth_2"), F.count_if(depth >= 3).alias("depth_3_plus"))

    def is_empty(self) -> bool:
        return all(f.isEmpty() for f in (self.added, self.removed, self.transitive_new, self.transitive_lost))


@dataclass(frozen=True)
class Bundle:
    """``nodes``: node, id, sides (those that have it as a component); ``lists``: side, node, piece, targets."""

    nodes: DataFrame
    lists: DataFrame

    @classmethod
    def build(cls, sides: dict[str, tuple[DataFrame, DataFrame]]) -> Bundle:
        """From components (id) and edges (src_id, dst_id, adj_ordinal) of each side."""
        known = reduce(DataFrame.unionByName, [c.select("id", F.lit(s).alias("side")) for s, (c, _) in sides.items()])
        edges = reduce(DataFrame.unionByName, [e.select(F.lit(s).alias("side"), "src_id", "dst_id", F.col("adj_ordinal").cast("long").alias("at")) for s, (_, e) in sides.items()])
        edges = settle(edges, "edges")  # read for the nodes and again for the lists
        ends = edges.select(F.explode(F.array("src_id", "dst_id")).alias("id"), F.lit(None).cast("string").alias("side"))
        nodes = settle(numbered(known.unionByName(ends).groupBy("id").agg(F.collect_set("side").alias("sides")), "node", "id"), "nodes")
        number = lambda end: nodes.select(F.col("id").alias(f"{end}_id"), F.col("node").alias(end))
        coded = edges.join(growing(number("src")), "src_id").join(growing(number("dst")), "dst_id")
        lists = coded.groupBy("side", F.col("src").alias("node"), F.floor(F.col("at") / PIECE).alias("piece")).agg(F.array_sort(F.collect_list(F.struct("at", "dst"))).alias("t"))
        return cls(nodes, settle(lists.select("side", "node", "piece", F.col("t.dst").alias("targets")), "lists"))

    def encoded(self, ids: DataFrame) -> DataFrame:
        return self.nodes.join(growing(ids.select("id").distinct()), "id", "left_semi").select("node")

    def named(self, pairs: DataFrame, *columns: str) -> DataFrame:
        """``pairs`` with ids for the numbers in ``columns``."""
        for c in columns or ("root", "node"):
            pairs = pairs.join(growing(self.nodes.select(F.col("node").alias(c), F.col("id").alias("__id"))), c).drop(c).withColumnRenamed("__id", c)
        return pairs

    def edges(self, side: str) -> DataFrame:
        """src, dst as numbers, with their place (piece, at)."""
        return self.lists.where(F.col("side") == side).select(F.col("node").alias("src"), "piece", F.posexplode("targets").alias("at", "dst"))

    def members(self, side: str) -> DataFrame:
        return self.nodes.where(F.array_contains("sides", side)).select("node")

    def roots(self, side: str) -> DataFrame:
        """Components that nobody depends on, all of them when there is none: node."""
        found = self.members(side).join(growing(self.edges(side).select(F.col("dst").alias("node"))), "node", "left_anti")
        return self.members(side) if found.isEmpty() else found

    def reach(self, side: str, starts: DataFrame, most: int = 1000, parents: bool = False) -> DataFrame:
        """root, node, depth (from 1) of all pairs that are joined by a path; with ``parents`` also parent."""
        spark, folder = starts.sparkSession, shared_folder(starts.sparkSession, "reach")
        kept = "root long, node long" + (", parent long, seq long" if parents else "")
        lists = self.lists.where(F.col("side") == side).select(F.col("node").alias("at_node"), "piece", "targets")
        nothing = [F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("seq")] if parents else []
        starts.select(F.col("node").alias("root"), "node", *nothing).write.parquet(f"{folder}/depth=0")
        for depth in range(1, most + 2):
            level = spark.read.schema(kept).parquet(f"{folder}/depth={depth - 1}")
            step = level.join(growing(lists), F.col("node") == F.col("at_node"))
            if parents:
                step = step.select("root", F.col("node").alias("parent"), "seq", "piece", F.posexplode("targets").alias("at", "node"))
                step = step.groupBy("root", "node").agg(F.min(F.struct("seq", "piece", "at", "parent")).alias("m"))
            else:
                step = step.select("root", F.explode("targets").alias("node")).distinct()
            step = step.join(growing(spark.read.schema("root long, node long").parquet(folder)), ["root", "node"], "left_anti")
            if parents:  # the order in which the pairs of a level are found decides between parents of the next
                step = step.orderBy("m.seq", "m.piece", "m.at").select("root", "node", "m.parent", F.monotonically_increasing_id().alias("seq"))
            if depth > most and not step.isEmpty():
                raise RuntimeError(f"paths are longer than {most}")
            seen = Observation()
            step.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}/depth={depth}")
            if not seen.get["n"]:
                break
        return spark.read.schema(f"{kept}, depth int").parquet(folder).where("depth > 0").drop("seq")

    def with_paths(self, side: str, pairs: DataFrame, reached: DataFrame | None = None) -> DataFrame:
        """``pairs`` (root, node, depth, parent: rows of ``reach``) with path, the ids from root to node."""
        reached = pairs if reached is None else reached
        up = reached.select("root", F.col("node").alias("parent"), F.col("parent").alias("above"))
        rows, longest = pairs.withColumn("way", F.array("node")), pairs.agg(F.max("depth")).first()[0] or 0
        for _ in range(longest - 1):
            rows = rows.join(growing(up), ["root", "parent"], "left").withColumn("way", F.when(F.col("above").isNull(), F.col("way")).otherwise(F.concat(F.array("parent"), "way"))).withColumn("parent", F.coalesce("above", "parent")).drop("above")
            rows = settle(rows, "paths")
        steps = rows.select("root", "node", F.posexplode(F.concat(F.array("root"), "way")).alias("at", "step"))
        paths = self.named(steps, "step").groupBy("root", "node").agg(F.array_sort(F.collect_list(F.struct("at", "step"))).alias("p"))
        return pairs.join(growing(paths.select("root", "node", F.col("p.step").alias("path"))), ["root", "node"]).drop("parent")

    def transitive(self, here: str, there: str, paths: bool = True) -> DataFrame:
        """root, target, depth and path: what a root of ``here`` reaches below its direct dependencies and
        does not reach on the other side; each target once, from its first such root in id order."""
        starts = settle(self.roots(here), "roots")
        reached = self.reach(here, starts, parents=paths)
        before = self.reach(there, starts.join(growing(self.members(there)), "node", "left_semi"))
        new = reached.where("depth > 1").join(growing(before), ["root", "node"], "left_anti")
        keep = ["root", "depth", *(["parent"] if paths else [])]
        new = new.groupBy("node").agg(F.min(F.struct(*keep)).alias("m")).select("node", *(f"m.{c}" for c in keep))
        if paths:
            new = self.with_paths(here, settle(new, "transitive"), reached)
        return self.named(new).withColumnRenamed("node", "target").select("root", "target", "depth", *(["path"] if paths else []))

    def tree(self, side: str, comps: DataFrame) -> DataFrame:
        """root_at, page, total_children, tree: two levels below every root that is a component, as nested structs of id,
        name, version, type, has_children, children_ids and children (none at the last level).

        Built from the bottom: a node's own struct, then lists of its children's structs in adjacency
        order, then of those. Dependencies without a component are in children_ids alone. A hub comes in
        pages of at most ``PIECE`` children, each a row of its own."""
        last = comps.groupBy("id").agg(F.max_by(F.struct("name", "version", fn.pkg_type(F.col("purl")).alias("type")), "ordinal").alias("c"))
        lists = self.lists.where(F.col("side") == side)
        ids = self.named(lists.select("node", "piece", F.posexplode("targets").alias("at", "dst")), "dst")
        ids = ids.groupBy("node", "piece").agg(F.array_sort(F.collect_list(F.struct("at", "dst"))).alias("t")).select("node", "piece", F.col("t.dst").alias("ids"))
        all_ids = ids.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("p")).select("node", F.flatten("p.ids").alias("children_ids"))
        listed = F.coalesce("children_ids", F.array().cast("array<string>"))
        own = settle(self.nodes.join(growing(last), "id").join(growing(all_ids), "node", "left").select("node", F.struct("id", "c.*", (F.size(listed) > 0).alias("has_children"), listed.alias("children_ids")).alias("own")), "tree")
        steps = settle(self.edges(side).join(growing(own.select(F.col("node").alias("dst"), "own")), "dst").select("src", "dst", "piece", "at", "own"), "tree")

        def gathered(rows: DataFrame, *by: str) -> DataFrame:
            return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("order", "child"))).alias("k")).select(*by, F.col("k.child").alias("children"))

        place = F.struct("piece", "at").alias("order")
        leaves = gathered(steps.select(F.col("src").alias("dst"), place, F.col("own").alias("child")), "dst")
        none = F.array().cast(leaves.schema["children"].dataType)
        middle = steps.join(growing(leaves), "dst", "left").select("src", "piece", place, F.struct("own.*", F.coalesce("children", none).alias("children")).alias("child"))
        pages = gathered(middle, "src", "piece")
        roots = self.roots(side).join(growing(own), "node").join(growing(pages.withColumnRenamed("src", "node")), "node", "left")
        none = F.array().cast(pages.schema["children"].dataType)
        return roots.select(F.col("node").alias("root_at"), F.coalesce("piece", F.lit(0).cast("long")).alias("page"), F.size("own.children_ids").alias("total_children"), F.struct("own.*", F.coalesce("children", none).alias("children")).alias("tree"))

    def edge_diff(self, here: str, there: str) -> DataFrame:
        """src_id, targets: dependencies that a node has on ``here`` alone, sorted, repeated ones kept."""
        other = self.edges(there).select("src", "dst").distinct()
        only = self.edges(here).select("src", "dst").join(growing(other), ["src", "dst"], "left_anti")
        rows = self.named(only, "dst").groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("targets"))
        return self.named(rows, "src").select(F.col("src").alias("src_id"), "targets")

    def diff(self, before: str = "before", after: str = "after", paths: bool = True) -> DependencyDiff:
        frames = (self.edge_diff(after, before), self.edge_diff(before, after), self.transitive(after, before, paths), self.transitive(before, after, paths))
        return DependencyDiff(*(settle(f, "dependency-diff") for f in frames))
