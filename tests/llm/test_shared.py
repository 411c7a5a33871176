"""The join that a hot key can't skew."""

import pytest
from pyspark.sql import functions as F

from framelode.llm.shared import HEAVY_ROWS, attach


@pytest.mark.parametrize(("copies", "broadcasts"), [(HEAVY_ROWS, 0), (HEAVY_ROWS + 1, 1)])
def test_attach_broadcasts_frequent_keys_only(spark, copies, broadcasts):
    """Before, it kept a broadcast of the keys whatever their rows, and small facts were a second one."""
    rows = spark.range(2000).select(F.col("id").alias("row"), F.when(F.col("id") < copies, F.lit(-1)).when(F.col("id") % 10 > 0, F.col("id")).cast("long").alias("key"))
    rows = rows.repartition(4)
    facts = rows.where("key % 2 <> 0").groupBy("key").agg(F.count("*").alias("n"), F.max("row").alias("last")).withColumn("size", F.col("n"))
    out = attach(rows, facts, "key", "n", "row")
    found = sorted(map(tuple, out.collect()))
    assert out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("BroadcastHashJoin") == broadcasts
    assert out.columns == ["row", "key", "last", "size"]
    for row, key, last, size in found:
        assert key == (-1 if row < copies else row if row % 10 else None)
        assert (last, size) == ((copies - 1, copies) if key == -1 else (row, 1) if key is not None and row % 2 else (None, None))
    assert [r[0] for r in found] == list(range(2000))
