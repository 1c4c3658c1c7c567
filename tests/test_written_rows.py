"""Metrics read their rows from where they were written."""

import pytest

from cropledger.plans import model_queries as mq

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("query", [mq.error_stats, mq.abs_error_percentiles, mq.regression_metrics])
def test_metrics_read_test_rows_that_are_written(spark, query):
    assert "lag(" not in plan(query(spark, SF))
