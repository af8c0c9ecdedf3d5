"""Plans have the shape they are written for."""

import contextlib
import io
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def plan(spark, name):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        entry.queries()[name](spark, DATA).explain("formatted")
    return out.getvalue()


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(spark, "filter_exact")
    assert "EqualTo(tribunal,TJSC)" in p and "EqualTo(classe,APCIV)" in p and "text" not in p.split("ReadSchema")[1].split("\n")[0] and "Exchange" not in p


def test_top_k_is_not_a_sort(spark):
    for name in ("search_rank_or", "page_by_date", "hash_sample"):
        p = plan(spark, name)
        assert "TakeOrderedAndProject" in p and "rangepartitioning" not in p


def test_ranks_are_cut_before_the_shuffle(spark):
    p = plan(spark, "byte_budget")
    assert p.count("WindowGroupLimit (") >= 2


def test_no_cartesian_product_and_no_row_udf(spark):
    for name in ("citations_links", "graph_degrees", "section_spans", "coverage_groups", "required_fields", "numbers_checked"):
        p = plan(spark, name)
        assert "CartesianProduct" not in p and "BatchEvalPython" not in p and "ArrowEvalPython" not in p
