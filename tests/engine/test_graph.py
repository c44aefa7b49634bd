import pytest

from bomspark.operators.graph import adjacency, edge_diff, reachable, roots, transitive_changes, with_ancestors
from bomspark.queries import QUERIES

SF = "/root/testdata/sf0.001"


def frames(spark, adjacency):
    nodes = spark.createDataFrame([(n,) for n in sorted({*adjacency, *(t for v in adjacency.values() for t in v)})], "id string")
    edges = spark.createDataFrame([(s, t, i) for s, v in adjacency.items() for i, t in enumerate(v)], "src_id string, dst_id string, adj_ordinal long")
    return nodes, edges


def test_shortest_paths_in_adjacency_order_and_cycles(spark):
    nodes, edges = frames(spark, {"app": ["b", "a"], "a": ["c"], "b": ["c"], "c": ["d", "app"], "d": ["d"]})
    assert sorted(r.id for r in roots(nodes, edges).collect()) == ["a", "app", "b", "c", "d"]  # all are depended on
    got = {r.node: r.path for r in reachable(spark.createDataFrame([("app",)], "id string"), edges).collect()}
    assert got == {"a": ["app", "a"], "b": ["app", "b"], "c": ["app", "b", "c"], "d": ["app", "b", "c", "d"]}


def test_new_transitive_targets(spark):
    before, after = frames(spark, {"app": ["a"]}), frames(spark, {"app": ["a"], "a": ["b"], "b": ["c"]})
    got = {r.target: (r.root, r.depth) for r in transitive_changes(*after, *before).collect()}
    assert got == {"b": ("app", 2), "c": ("app", 3)}
    assert transitive_changes(*before, *after).count() == 0


def test_the_last_component_of_an_id_replaces_the_others(spark):
    comps = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2), ("c", 3), ("c", 4)], "id string, ordinal long")
    edges = spark.createDataFrame([("a", 1, "b"), ("a", 5, "c"), ("b", 2, "c"), ("c", 3, "a")], "src_id string, src_ordinal long, dst_id string")
    assert sorted((r.src_id, r.dst_id) for r in adjacency(comps, edges).collect()) == [("a", "c"), ("b", "c")]


def test_a_limit_on_levels_is_an_error_and_no_silent_cut(spark):
    nodes, edges = frames(spark, {f"n{i}": [f"n{i + 1}"] for i in range(6)})
    start = spark.createDataFrame([("n0",)], "id string")
    with pytest.raises(RuntimeError):
        reachable(start, edges, most=3)
    with pytest.raises(RuntimeError):
        with_ancestors(spark.createDataFrame([("n6",)], "id string"), edges, most=3)
    assert reachable(start, edges, most=7).count() == 6


@pytest.mark.parametrize("key", ["jn_edge_diff", "gr_edges", "gr_tree", "gr_reachable", "gr_shortest_path", "gr_transitive_new", "gr_transitive_lost"])
def test_tables_that_grow_are_not_broadcast(spark, key):
    store = spark._jsparkSession.sharedState().statusStore()
    bus = spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    last = max([-1, *(store.executionsList().apply(i).executionId() for i in range(store.executionsList().size()))])
    QUERIES[key](spark, SF).collect()
    bus.waitUntilEmpty(30_000)
    runs = store.executionsList()
    plans = [runs.apply(i).physicalPlanDescription() for i in range(runs.size()) if runs.apply(i).executionId() > last]
    assert plans and not [p for p in plans if "BroadcastHashJoin" in p and "__first" not in p]  # that table has a row for each partition


def test_edge_diff_keeps_copies_and_reads_both_sides(spark):
    rows = lambda *e: spark.createDataFrame(e, "src_id string, dst_id string")
    got = edge_diff(rows(("a", "b"), ("a", "c"), ("a", "c"), ("d", "x")), rows(("a", "b"), ("a", "b"), ("a", "z"), ("a", "y"), ("a", "y")))
    assert sorted((r.src_id, r.change, r.targets) for r in got.collect()) == [("a", "added", ["y", "y", "z"]), ("a", "removed", ["c", "c"]), ("d", "removed", ["x"])]
