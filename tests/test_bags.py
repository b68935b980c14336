"""Atoms that give a part of their columns are read without removing repeated facts first."""

import os

import pytest

from corollary.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_a_star_removes_repeats_once(spark):
    plan = QUERIES["cq_star2"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") <= 2  # the star's and the answer's
