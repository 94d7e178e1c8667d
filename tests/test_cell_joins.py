"""Queries that look up the reference by cells: no job of theirs broadcasts the cell index, which would go through the driver."""

import os
import re

import pytest

from scanloom.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
QUERIES = [
    "cluster_edges",
    "deviation_field",
    "region_severity",
    "streamed_scans",
    "attribute_lines",
    "bump_dent_candidates",
    "defect_clusters",
    "deviation_reason_counts",
    "many_scans",
    "region_area",
    "region_report_json",
    "verdict",
]


def _plans(spark):
    """The plans that ran in this session, by id of execution, checkpoints and micro-batches included."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return {found.apply(i).executionId(): found.apply(i).physicalPlanDescription() for i in range(found.size())}


@pytest.mark.parametrize("name", QUERIES)
def test_no_job_broadcasts_the_cell_index(spark, name):
    before = max(_plans(spark), default=-1)
    catalog.queries()[name](spark, DATA).write.format("noop").mode("overwrite").save()
    joins = [x for i, plan in _plans(spark).items() if i > before for x in re.findall(r"\) (\w+Join)(?: \[[^\n]*)?\nLeft keys[^\n]*__cx", plan)]
    assert joins and set(joins) == {"SortMergeJoin"}
