"""Scores of the band are aggregated without sorting every cell."""

from pyspark.sql import functions as F

from checks import registry
from girthline.operators import alignment as J


def test_best_first_orders_like_score_and_joint(spark):
    scores = (-1.0, 0.8500000238418579, 0.8500000834465027, 1.0, 1.2000000476837158, 1.5, float("nan"))
    rows = spark.createDataFrame([(s, j) for s in scores for j in (None, -(2 ** 31), -5, 0, 7, 2 ** 31 - 1)], "s double, j int")
    key = J.best_first(F.col("s"), F.col("j"))
    plain = rows.orderBy(F.struct(-F.col("s"), "j")).collect()
    assert [str(r) for r in rows.orderBy(key).collect()] == [str(r) for r in plain]
    assert rows.select(key).distinct().count() == rows.count()


def test_cells_are_not_sorted(spark, tmp_path):
    spark.range(60).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    rows = registry.queries()["joint_band_scores"](spark, str(tmp_path))
    assert "SortAggregate" not in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 58
