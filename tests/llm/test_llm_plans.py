"""Properties of the plans of the training-data queries."""

import os
import re

import pytest

from tellgrid.llm import queries
from tellgrid.llm import tokens

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are missing")


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_no_product_joins(spark, name):
    if name in ("p8_ids", "p9_containers") and not os.path.exists(os.path.join(tokens.FOLDER, tokens.VOCABULARY)):
        pytest.skip("public vocabulary files are missing")
    shown = physical(queries.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in shown and "BroadcastNestedLoopJoin" not in shown


def test_documents_are_read_where_they_lie(spark):
    """Stuffed pages need two columns and one shuffle of keys; matching values against a small list shuffles nothing but the result."""
    shown = physical(queries.p10_found(spark, FOLDER))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in shown and len(re.findall(r"\bExchange\b", shown)) == 1


def test_local_bounds_before_the_shuffle(spark):
    assert "WindowGroupLimit" in physical(queries.p5_found(spark, FOLDER))


def test_terms_are_summed_before_they_are_routed(spark):
    shown = physical(queries.p7_gram_runs(spark, FOLDER))
    assert "partial_sum" in shown and "ReadSchema: struct<n:int,ngram:string>" in shown
