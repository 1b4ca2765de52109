"""Every query of the library with its DuckDB counterpart."""

from __future__ import annotations

from gaugeline.plans import decision_queries, detect_queries, feature_queries, flow_queries, io_queries, localise_queries, model_queries, other_queries, report_queries, sequence_queries
from gaugeline.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "decision_queries", "detect_queries", "feature_queries", "flagship", "flow_queries", "io_queries", "localise_queries", "model_queries", "other_queries", "report_queries", "sequence_queries"]


def flagship(spark, sf_dir):
    return QUERIES["det_flagship"](spark, sf_dir)
