"""Queries that moved more rows, or kept more of them in one task, than their results need."""

import os

import pytest

from tracerage import plans
from tracerage.operators import posterior as po
from tracerage.operators import summaries as su
from tracerage.sources import fixtures as fx

DATA = "/root/testdata/sf0.001"
sampled = pytest.mark.skipif(not os.path.isdir(DATA), reason="sample tables aren't there")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@sampled
def test_b16b_numbers_the_rows_of_its_wells_only(spark):
    every, few = fx.observations(spark, DATA), fx.observations(spark, DATA, [1, 3])
    assert sorted(few.collect()) == sorted(every.where("well in (1, 3)").collect()) != []
    assert "SortMergeJoin" not in plan(few)


@sampled
def test_h19b_and_h16b_make_their_rows_once(spark, monkeypatch):
    names, stored = [], su.stored
    monkeypatch.setattr(su, "stored", lambda df, name: names.append(name) or stored(df, name))
    plans.QUERIES["h19b_experiment_check"](spark, DATA)
    plans.QUERIES["h16b_annual_trends"](spark, DATA)
    assert {"predicted", "annual"} <= set(names)


def test_f07_densities_are_summed_in_their_row(spark):
    priors = spark.createDataFrame([("q", "normal", 2.0, 1.5, 0.0, 9.0), ("d", "uniform", None, None, 0.0, 4.0)], "param string, prior string, mean double, std double, cal_lo double, cal_hi double")
    draws = spark.createDataFrame([(i, float(i), None if i == 3 else i / 2, 1.0) for i in range(12)] + [(99, None, None, 1.0)], "step long, q double, d double, t double")
    got = po.log_prior_wide(draws, priors, ["q", "d", "t"])
    want = po.log_prior(draws.unpivot(["step"], ["q", "d", "t"], "param", "value"), priors, ["step"])
    text = lambda df: sorted((r.step, str(r.log_prior and round(r.log_prior, 9))) for r in df.collect())
    assert text(got) == text(want)
    assert "hashpartitioning" not in plan(got) and "SortMergeJoin" not in plan(want)


def test_h34_medians_go_to_the_draws(spark):
    rows = [(c, i, float(i * i % 17), float(i % 5)) for c in "ab" for i in range(40)]
    got = su.representative_draw(spark.createDataFrame(rows, "case_id string, step long, q double, d double"), ["case_id"], ["q", "d"], ["step"])
    assert "BroadcastHashJoin" in plan(got) and "SortMergeJoin" not in plan(got)
    assert got.count() == 2


@sampled
def test_dates_of_draws_keep_their_tasks(spark):
    assert "REPARTITION_BY_NUM" in plan(fx.draws_wide(spark, DATA))
