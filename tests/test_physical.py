"""Properties of the physical plans: what must be pushed down is, and nothing is a cross or nested-loop join."""

import os

import pytest
from pyspark.sql import functions as F

from tellgrid import registry
from tellgrid.operators import groups
from tellgrid.plans import corpus as texts
from tellgrid.plans.tables import delivered
from tellgrid.session import load

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are missing")


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_no_product_joins(spark, name):
    shown = physical(registry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in shown and "BroadcastNestedLoopJoin" not in shown


def test_substring_is_pushed_down(spark):
    rows = load(spark, FOLDER, "forms").filter(F.col("n").contains("gal")).select("entry_id")
    shown = physical(rows)
    assert "StringContains(n,gal)" in shown
    assert "ReadSchema: struct<entry_id:string,n:string>" in shown  # two columns of six are read


def test_group_limit_before_the_shuffle(spark):
    rows = groups.top_per_group(load(spark, FOLDER, "forms"), ["entry_id"], [F.col("icount").desc_nulls_last(), F.col("id")], 3)
    assert "WindowGroupLimit" in physical(rows)


def test_topk_is_one_operator(spark):
    corpus = delivered(spark, FOLDER)
    page = corpus["collocations"].orderBy(F.col("count").desc_nulls_last(), "ngram").offset(10).limit(10)
    assert "TakeOrderedAndProject" in physical(page)


def test_lemma_lookup_reads_its_columns(spark):
    shown = physical(texts.lines_with_lemma(delivered(spark, FOLDER), "tuk").select("text_id", "line_id", "transliteration"))
    assert "EqualTo(lemma,tuk)" in shown
