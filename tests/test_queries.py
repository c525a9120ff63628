"""Every query of the core has a stable schema, and equals its oracle where SQL can state it."""

import re

import oracle
import pytest

import __spark_entry__ as entry
from textilla.plans import analytic_queries, core_queries, packed_queries, store_queries

ADDS = [packed_queries.add, core_queries.add, analytic_queries.add, store_queries.add]
ORACLE = {k: v for a in ADDS for k, v in a.oracle.items()}
QUERIES = {k: v for a in ADDS for k, v in a.queries.items()}
SLOW = {"m8_cross_validation", "m11_word_vectors"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, data, name):
    oracle.same(QUERIES[name](spark, data), oracle.connect(data), ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - SLOW))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns and df.limit(5).collect() is not None


def test_entry(spark):
    assert set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
    assert all(re.match(r"[a-z]+\d*", q) for q in entry.queries())
