"""Reading, comparing and exporting the state of streaming queries from their checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_state(spark: SparkSession, checkpoint: str, operator: int = 0, batch: int | None = None, variable: str | None = None) -> DataFrame:
    """Keys and values of a stateful operator; of a state variable for keyed programs."""
    reader = spark.read.format("statestore").option("operatorId", operator)
    if batch is not None:
        reader = reader.option("batchId", batch)
    if variable is not None:
        reader = reader.option("stateVarName", variable)
    return reader.load(checkpoint)


def state_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys whose value differs: (key, before, after, change), change being added, removed or changed."""
    a = before.groupBy("key").agg(F.first("value").alias("before"))
    b = after.groupBy("key").agg(F.first("value").alias("after"))
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), "key", "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return both.select("key", "before", "after", change.alias("change")).filter(F.col("change").isNotNull())


def export_state(spark: SparkSession, checkpoint: str, path: str, operator: int = 0) -> None:
    """State as Parquet, keys and values flattened."""
    read_state(spark, checkpoint, operator).select("key.*", "value.*").write.mode("overwrite").parquet(path)
