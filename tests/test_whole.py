"""Queries take all parts, lines, wells and chains: against their SQL on a larger sample."""

import os

import duckdb
import pytest

from tracerage import plans

from .test_oracles import TABLES, norm

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="sample tables aren't there")

#: Queries that have more rows on this sample than any bound on ids would leave.
WHOLE = ["b19_helium_diagnostics", "b25_grid_gaps", "d03_inverse_gaussian", "d08b_gamma_quantiles", "d09_curves", "d13_distribution_checks", "e10b_convolve_basis", "e15_mix", "j04_split_rhat", "j05_ess"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key", WHOLE)
def test_all_ids_take_part(spark, duck, key):
    df = plans.QUERIES[key](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    found = duck.sql(plans.ORACLES[key])
    names = [d[0] for d in found.description]
    assert mine == sorted(tuple(norm(r[names.index(c)]) for c in columns) for r in found.fetchall())
