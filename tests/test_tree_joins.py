"""Rows that grow with the tree never go through the driver, in no round of the contraction and not after it."""

import re

from kinweave.operators import clusters as cl
from kinweave.queries import _heap

DATA = "/root/testdata/sf0.001"


def test_no_broadcast_of_tree_rows(spark, monkeypatch):
    joins = []
    keep = cl.stored

    def seen(df, name):
        joins.extend(re.findall(r"Join .*", df._jdf.queryExecution().optimizedPlan().toString()))
        return keep(df, name)

    monkeypatch.setattr(cl, "stored", seen)
    for points in (cl.radial_layout(_heap(spark, DATA)), cl.cosimilarity(_heap(spark, DATA))):
        assert points.count() > 100
        assert "BroadcastHashJoin" not in points._jdf.queryExecution().executedPlan().toString()
        joins.extend(re.findall(r"Join .*", points._jdf.queryExecution().optimizedPlan().toString()))
    assert len(joins) > 10 and all("strategy=merge" in j for j in joins)
