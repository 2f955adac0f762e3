"""Lines whose run dates allow no growth rate."""

import os

import pytest
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_line_without_interval_asks_for_review(spark):
    from girthline.plans import chain
    from girthline.sources import tables as T

    dims = T.lines(spark, FOLDER).withColumn("run1_date", F.col("run2_date"))
    sides = [f(spark, FOLDER, run) for f in (T.features, T.joints) for run in (1, 2)]
    done = chain.assess_lines(*sides, dims)
    codes = {r.code for r in done.findings.select("code").distinct().collect()}
    assert {"ERF_EXCEEDS_1", "INTERVAL_NOT_POSITIVE"} <= codes and done.predictions.count() == 0
    assert {r.exit_code for r in chain.verdicts(done).collect()} == {1}
