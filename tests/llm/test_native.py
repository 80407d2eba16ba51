"""The native operators' plans hold no Python."""

import pytest

from folio.llm.queries import QUERIES


@pytest.mark.parametrize("name", ["op1_url_filters", "op3_secret_scan", "op7_decontamination"])
def test_no_python_in_the_plan(spark, name):
    text = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text and "CartesianProduct" not in text
