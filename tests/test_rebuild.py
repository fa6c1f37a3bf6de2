"""The rebuild makes what its steps share once, and its steps count what the queries alone count."""

from conftest import SF

from strataflow.operators import history as op
from strataflow.plans import evidence, history, registry, snapshots

registry.load()


def test_shared_tables_are_made_once(spark, monkeypatch):
    made = []
    for name in ("logical_coupling", "authored"):
        monkeypatch.setattr(op, name, lambda *a, n=name, f=getattr(op, name), **k: made.append(n) or f(*a, **k))
    done = evidence.r30_rebuild(spark, SF).collect()
    assert [r.status for r in done] == ["OK"] * 16
    assert sorted(made) == ["authored", "logical_coupling"]


def test_steps_give_the_rows_of_the_queries(spark):
    shared = evidence.Rebuilt(spark, SF)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(history.r1_logical_coupling(spark, SF, shared.coupled)) == rows(history.r1_logical_coupling(spark, SF))
    assert rows(history.r2_file_expertise(spark, SF, shared.files)) == rows(history.r2_file_expertise(spark, SF))
    assert rows(history.r3_drift_findings(spark, SF, shared.parts)) == rows(history.r3_drift_findings(spark, SF))
    assert rows(history.r5_hotspots(spark, SF, shared.parts)) == rows(history.r5_hotspots(spark, SF))
    assert rows(snapshots.r6_validity(spark, SF, shared.parts)) == rows(snapshots.r6_validity(spark, SF))
    assert rows(snapshots.r12_incident_predictions(spark, SF, shared.parts)) == rows(snapshots.r12_incident_predictions(spark, SF))
