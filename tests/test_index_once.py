"""An update of an index reads its inputs once."""

from codeloom.operators import flows
from codeloom.plans import index_reports


def test_update_makes_imports_once(spark, monkeypatch):
    """Some imports are of `ext.lib`, a constant of the plan that makes them."""
    made, plain = [], flows.saved

    def saved(d):
        made.append(d._jdf.queryExecution().optimizedPlan().toString().count("ext.lib") > 0)
        return plain(d)

    monkeypatch.setattr(flows, "saved", saved)
    d = index_reports.index_update_edges(spark, "/root/testdata/sf0.001")
    assert "ext.lib" not in d._jdf.queryExecution().optimizedPlan().toString() and sum(made) == 1
