from bomspark.operators.diff import collisions
from bomspark.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_collisions_of_names_and_hashes(spark):
    comps = spark.createDataFrame([("a", "x", "1", {}), ("a", "y", "1", {}), ("b", "x", "1", {"S": "1"}), ("b", "x", "1", {"S": "2"}), ("c", "x", "1", {"S": "1"}), ("c", "x", "2", {"S": "2"}), ("c", "x", "1", {"T": "3"}), ("d", None, "1", {"S": None}), ("d", "x", "1", {"S": "2"}), ("a", "y", "1", {"S": "1"}), ("a", "y", "1", {"S": "2"})], "id string, name string, version string, hashes map<string, string>")
    assert sorted((r.id, r.reason) for r in collisions(comps).collect()) == [("a", "name_mismatch"), ("b", "hash_mismatch")]


def test_rows_meet_before_they_are_grouped(spark):
    """A table made before the exchange would hold all ids of a task's input."""
    for key in ("agg_collision_name", "agg_collision_hash"):
        plan = QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString().split("\n")
        scans = [i for i, x in enumerate(plan) if "Scan parquet" in x]
        assert scans
        for scan in scans:  # going up from each scan, an exchange comes before an aggregate
            first = next(x for x in reversed(plan[:scan]) if "Exchange" in x or "Aggregate" in x)
            assert "Exchange" in first, key
