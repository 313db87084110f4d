"""Rounded numbers at ties: the same whatever the order of a sum."""

from pyspark.sql import functions as F

from tracerage.plans import q_forward


def test_a_tie_of_the_mean_tax_goes_up_in_any_order(spark, tmp_path):
    # The mean of each part is a tie exactly (1.7375); sums of doubles come to either side of it.
    cents = [(7 * i) % 9 for i in range(32)]
    cents[-1] += 118 - sum(cents)
    rows = [(part, 1.0, 0.01 * cents[(i * step + part) % 32]) for part in range(40) for step in (2 * part + 1,) for i in range(32)]
    spark.createDataFrame(rows, "l_partkey long, l_quantity double, l_tax double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = q_forward.pars(spark, str(tmp_path)).agg(F.min("b"), F.max("b"), F.count("*")).first()
    assert tuple(got) == (1.738, 1.738, 40)


def test_a_number_just_under_a_tie_goes_down(spark, tmp_path):
    # 2 + 30.0625 / 5 is 8.0125 in decimals, but the double and 1000 times it are below the tie.
    spark.createDataFrame([(1, q, 0.0) for q in [30.0] * 15 + [31.0]], "l_partkey long, l_quantity double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert q_forward.pars(spark, str(tmp_path)).first()["a"] == 8.012
