"""Dependency graphs: roots, reachability, shortest paths, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..tables import growing, settle, shared_folder
from .bundle import Bundle


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that nobody depends on; all nodes when there is none."""
    found = nodes.select("id").join(growing(edges.select(F.col("dst_id").alias("id"))), "id", "left_anti")
    return nodes.select("id") if found.isEmpty() else found


def adjacency(comps: DataFrame, edges: DataFrame, *by: str) -> DataFrame:
    """``edges`` (src_id, src_ordinal, dst_id) of the last component of each id alone: it
    replaces the dependencies of those before it, also where it has none."""
    last = comps.groupBy(*by, F.col("id").alias("src_id")).agg(F.max("ordinal").alias("src_ordinal"))
    return edges.join(growing(last), [*by, "src_id", "src_ordinal"], "left_semi")


def reachable(starts: DataFrame, edges: DataFrame, most: int = 1000) -> DataFrame:
    """root, node, depth, path: shortest paths, first found in adjacency order. Paths longer than ``most`` are an error."""
    bundle = Bundle.build({"": (starts.select("id").unionByName(edges.select(F.col("src_id").alias("id"))), edges)})
    return bundle.named(bundle.with_paths("", bundle.reach("", bundle.encoded(starts), most, parents=True))).select("root", "node", "depth", "path")


def edge_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """src_id, change, targets: edges of one side only, per node, sorted, duplicates kept."""
    rows = before.select("src_id", "dst_id", F.lit("removed").alias("change")).unionByName(after.select("src_id", "dst_id", F.lit("added").alias("change")))
    # each side is read once: the copies of an edge on either side meet in its group
    sides = rows.groupBy("src_id", "dst_id").agg(F.count_if(F.col("change") == "removed").alias("old"), F.count_if(F.col("change") == "added").alias("new")).where("old = 0 OR new = 0")
    copies = F.explode(F.array_repeat("dst_id", F.greatest("old", "new").cast("int")))
    return sides.select("src_id", F.when(F.col("old") == 0, "added").otherwise("removed").alias("change"), copies.alias("dst_id")).groupBy("src_id", "change").agg(F.sort_array(F.collect_list("dst_id")).alias("targets"))


def transitive_changes(nodes: DataFrame, edges: DataFrame, other_nodes: DataFrame, other_edges: DataFrame) -> DataFrame:
    """root, target, depth, path: targets that a root of this side reaches below its direct
    dependencies, and that the same root does not reach on the other side; each target once,
    from its first such root."""
    return Bundle.build({"here": (nodes, edges), "there": (other_nodes, other_edges)}).transitive("here", "there")


def depth_summary(transitive: DataFrame) -> DataFrame:
    return transitive.agg(F.count_if(F.col("depth") == 1).alias("depth_1"), F.count_if(F.col("depth") == 2).alias("depth_2"), F.count_if(F.col("depth") >= 3).alias("depth_3_plus"))


def tree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """root, child, grandchild (null where there is none): two levels below every root."""
    nodes, edges = settle(nodes.select("id"), "nodes"), settle(edges.select("src_id", "dst_id"), "edges")  # read several times
    e = edges
    known = nodes.select(F.col("id").alias("dst_id")).distinct()
    e = e.join(growing(known), "dst_id", "left_semi").select("src_id", "dst_id")
    first = roots(nodes, edges).select(F.col("id").alias("root")).join(growing(e.select(F.col("src_id").alias("root"), F.col("dst_id").alias("child"))), "root", "left")
    return first.join(growing(e.select(F.col("src_id").alias("child"), F.col("dst_id").alias("grandchild"))), "child", "left").select("root", "child", "grandchild")


def resolve_refs(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """src_id, dst_id, adj_ordinal of references between components; the last component of a
    reference counts, unresolved ones go. ``nodes``: ref, id, ordinal."""
    known = nodes.where("ref <> ''").groupBy("ref").agg(F.max_by("id", "ordinal").alias("id"))
    end = lambda name: known.select(F.col("ref").alias(f"{name}_ref"), F.col("id").alias(f"{name}_id"))
    return refs.join(growing(end("src")), "src_ref").join(growing(end("dst")), "dst_ref").select("src_id", "dst_id", "adj_ordinal")


def with_ancestors(matches: DataFrame, edges: DataFrame, most: int = 1000) -> DataFrame:
    """The matching ids and everything above them, one level up per round, added to the folder of those
    before it; chains longer than ``most`` are an error."""
    spark, folder = matches.sparkSession, shared_folder(matches.sparkSession, "ancestors")
    up = settle(edges.select("src_id", "dst_id").distinct(), "up")
    matches.select("id").distinct().write.parquet(f"{folder}/level=0")
    found = lambda part="": spark.read.schema("id string").parquet(folder + part).select("id")
    for level in range(1, most + 1):
        step = found(f"/level={level - 1}").join(growing(up), F.col("id") == F.col("dst_id")).select(F.col("src_id").alias("id")).distinct().join(growing(found()), "id", "left_anti")
        seen = Observation()
        step.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}/level={level}")
        if not seen.get["n"]:
            return found()
    raise RuntimeError(f"chains are longer than {most}")
