"""Every registered query of the library against its SQL, and what the registry promises."""

import subprocess
import sys
from pathlib import Path

import pytest
from oracle import connect, difference

from gaugeline.plans import registry

REPO = Path(__file__).parent.parent
#: Nested loops are right only beside a single row, or one row for each stretch of a ranked order (64).
ONE_ROW = {"agg_wall_budget", "met_nab", "rst_family_threshold", "fus_soft", "fus_soft_three_arms", "rst_attribution", "rst_seed_rule", "cal_best_f1"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, sf, con, name):
    assert difference(registry.QUERIES[name](spark, sf), con, registry.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES) - {"ml_oof_trees"}))
def test_has_rows_and_repeats(spark, sf, name):
    first = registry.QUERIES[name](spark, sf)
    rows = sorted(map(str, first.collect()))
    assert rows and rows == sorted(map(str, registry.QUERIES[name](spark, sf).collect()))


def test_no_cross_joins(spark, sf):
    for name, q in registry.QUERIES.items():
        if name.startswith(("str_", "ml_", "cal_mixture")):
            continue
        plan = q(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
        if name not in ONE_ROW:
            assert "BroadcastNestedLoopJoin" not in plan, name


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = registry.QUERIES["src_projection"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in plan
    assert "l_extendedprice" not in plan


def test_imports_without_a_session_or_the_optional_parts(tmp_path):
    for p in ("gaugeline", "__spark_entry__.py"):
        (tmp_path / p).symlink_to(REPO / p) if p.endswith(".py") else None
    import shutil

    shutil.copytree(REPO / "gaugeline", tmp_path / "gaugeline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
