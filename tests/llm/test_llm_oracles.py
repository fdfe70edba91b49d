"""Queries that SQL can express against their SQL."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from parity import canon, connect  # noqa: E402

from tsprobe.llm.queries import ORACLES, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", ORACLES)
def test_oracle(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    said = connect(sf_dir).sql(ORACLES[name])
    names = sorted(found.columns)
    assert names == sorted(said.columns)
    a = sorted(tuple(canon(r[c]) for c in names) for r in found.collect())
    b = sorted(tuple(canon(r[said.columns.index(c)]) for c in names) for r in said.fetchall())
    assert a == b
