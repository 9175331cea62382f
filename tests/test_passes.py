"""What several aggregates read is computed once."""

from framewright import queries as Q
from framewright.operators import checks as C

SF = "/root/testdata/sf0.001"


def test_idling_is_computed_once(spark, monkeypatch):
    ds, ctx = Q._supp(spark, SF)
    times, idling = [], C.signals.idling
    monkeypatch.setattr(C.signals, "idling", lambda *a: times.append(1) or idling(*a))
    m, _ = C.idle(ds, ctx, Q.CFG)
    assert len(times) == 1 and "Window" not in m.select("episode_index", "idle_fraction")._jdf.queryExecution().optimizedPlan().toString().replace("Window [row_number", "")
