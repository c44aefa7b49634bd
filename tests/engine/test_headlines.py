"""Cases of the finding messages that the driver tables don't reach."""

from bomspark.operators import headlines
from bomspark.operators.diff import diff
from bomspark.queries import Snapshots

SF = "/root/testdata/sf0.001"


def messages(df):
    return [r.message for r in df.orderBy("finding_ordinal", "message").collect()]


def test_nothing_to_say(spark):
    s = Snapshots(spark, SF)
    none = s.before.where("false")
    for found in (headlines.dominant_type(none), headlines.hotspots(s.before.limit(19)), headlines.license_profile(none), headlines.top_catalogers(none), headlines.integrity(diff(none, none)), headlines.stable_types(s.before, none), headlines.license_shift(s.all.where("side = 'after'")), headlines.cataloger_gaps(none, s.after), headlines.version_changes(none, diff(none, s.after)), headlines.surface(s.all.where("false"), {}, {})):
        assert messages(found) == []


def test_from_nothing_grows_without_bound(spark):
    s = Snapshots(spark, SF)
    n = s.after.count()
    assert messages(headlines.surface(s.all.where("side = 'after'"), {}, {})) == [f"Attack surface: +{n} packages (+Inf%)"]


def test_same_snapshot_has_no_version_changes(spark):
    s = Snapshots(spark, SF)
    assert messages(headlines.version_changes(s.after, diff(s.after, s.after))) == [f"0 version changes among {s.after.count()} shared packages — no actual upgrades"]
