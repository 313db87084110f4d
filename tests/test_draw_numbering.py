"""Steps of the sample's draws: right, and numbered without a whole chain in one task."""

import datetime
import random

from pyspark.sql import functions as F

from tracerage.operators import order, summaries
from tracerage.sources import fixtures as fx
from tracerage.sources import io


def test_steps_are_numbered_within_dates(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice("AN"), rng.choice([1, 2]), datetime.date(2000, 1, 1 + rng.randrange(6)), k, k % 7, 1, float(k), 0.1, 0.2, 9.0 + k, "O") for k in range(300)]
    names = "l_returnflag string, l_linenumber int, l_shipdate date, l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_tax double, l_extendedprice double, l_linestatus string"
    spark.createDataFrame(rows, names).repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = fx.draws_wide(spark, str(tmp_path))
    want = {}
    for r in sorted(rows, key=lambda r: (r[2], r[3])):
        want.setdefault((r[0], r[1]), []).append(r[6])
    assert sorted((r.case_id, r.chain, r.step, r.q) for r in got.collect()) == sorted((*k, i, q) for k, qs in want.items() for i, q in enumerate(qs, 1))
    numbering = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "row_number()" in line and "Window" in line]
    assert numbering and all("l_shipdate" in line.split("specifiedwindowframe")[-1].split("], [")[1] for line in numbering)


def test_steps_are_compared_over_ranges(spark):
    rows = [(c, i, (i // 3) % 5) for c in "ab" for i in range(200)]
    got = order.step_changes(spark.createDataFrame(rows, "chain string, step long, v long").repartition(5), ["chain"], "step", ["v"])
    assert sorted((r.chain, r.step, r.accepted) for r in got.collect()) == [(c, i, i % 3 == 0 if i else None) for c in "ab" for i in range(200)]
    windows = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "row_number()" in line and "Window" in line]
    assert windows and all("__slot" in line.split("specifiedwindowframe")[-1].split("], [")[1] for line in windows)


def tasks_of(df):
    return df.select(F.spark_partition_id().alias("p")).groupBy("p").count().orderBy(F.desc("count")).collect()


def test_tasks_grow_with_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(io, "TASK_ROWS", 40, raising=False)
    rows = [(None if k % 7 == 0 else "A", k % 2 + 1, None if k % 5 == 0 else datetime.date(2000, 1, 1) + datetime.timedelta(k % 97), k, 1, 1, float(k), 0.1, 0.2, 1.0, "O") for k in range(800)]
    names = "l_returnflag string, l_linenumber int, l_shipdate date, l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_tax double, l_extendedprice double, l_linestatus string"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    draws = fx.draws_wide(spark, str(tmp_path))
    want = {}
    for r in sorted(rows, key=lambda r: (r[2] is not None, r[2], r[3]) if r[2] else (False, datetime.date.min, r[3])):
        want.setdefault((r[0], r[1]), []).append(r[6])
    assert {(r.case_id, r.chain, r.step, r.q) for r in draws.collect()} == {(*k, i, q) for k, qs in want.items() for i, q in enumerate(qs, 1)}
    # 800 rows are 20 tasks, not the session's four; of those a hash leaves some empty.
    dealt = tasks_of(draws)
    assert len(dealt) > 8 and dealt[0]["count"] < 400
    for out in (order.ranked(draws, ["case_id"], ["chain", "step"]), order.running(draws, ["case_id"], ["chain", "step"], {"most": ("q", "max")}), order.step_changes(draws, ["case_id", "chain"], "step", ["q"])):
        assert out.count() == 800 and len(tasks_of(out)) > 8
    places = sorted((r.case_id or "", r["rank"]) for r in order.ranked(draws, ["case_id"], ["chain", "step"]).collect())
    assert places == sorted((c, i) for c, n in (("", 115), ("A", 685)) for i in range(1, n + 1))


def test_data_of_chosen_draws_stay_where_they_are(spark):
    fits = spark.range(4000).selectExpr("'a' as case_id", "id as step", "1.0D as observed", "0.5D as error", "id * 1.0D as modeled")
    draw = fits.groupBy("case_id").agg(F.max("step").alias("step"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")
    try:
        out = summaries.representative_residuals(draw, fits, ["case_id"], ["step"])
        assert out._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") < 2  # the totals' join alone
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [(r.step, r.residual, r.objective_total) for r in out.collect()] == [(3999, -3998.0, 7996.0**2)]
