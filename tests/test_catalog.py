"""Every query beside its SQL form on the smallest tables, and plan checks."""

import os

import pytest

from locigrid.plans.catalog import load_all

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
CATALOG = load_all()
# Too small at this scale to return rows; checked on the next scale by tools/compare.py.
MAY_BE_EMPTY = {
    "two_level_counts", "foreign_contigs", "unique_mappings", "single_row_groups", "clusters_per_limit",
}
SLOW = {"inclusion_ensemble", "contamination_ensemble", "rbf_classes"}


@pytest.fixture(scope="module")
def con():
    import compare

    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", [n for n in CATALOG if n not in SLOW])
def test_query_agrees(spark, con, name):
    import compare

    found = compare.differences(name, CATALOG[name], spark, con, SF_DIR)
    if name in MAY_BE_EMPTY:
        found = [f for f in found if f != "no rows"]
    assert found == []


def test_ensemble_finds_the_injected_contigs(spark):
    found = {r["contig"] for r in CATALOG["contamination_ensemble"].run(spark, SF_DIR).collect()}
    injected = [c for c in found if c.startswith("contamination_")]
    assert len(injected) >= 3 and len(found) <= 40


PLANNED = [
    "value_grid", "densified_grid", "benchmark_heat_map", "holdout_replicates", "injected_replicates",
    "mean_depth_of_windows", "group_shares", "inclusion_benchmark", "imputed_within_bins",
]


@pytest.mark.parametrize("name", PLANNED)
def test_no_pairwise_join(spark, name):
    df = CATALOG[name].run(spark, SF_DIR)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    df = CATALOG["evidence_filter"].run(spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_extendedprice" not in plan
    plan = CATALOG["membership_filter"].run(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "In(o_orderpriority" in plan


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150
