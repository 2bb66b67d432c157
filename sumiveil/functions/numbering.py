"""Dense numbers over large sets without one task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sumiveil.session import settle


def dense_numbers(df: DataFrame, group: list[str], order: list[str], into: str = "n", first: int = 1) -> DataFrame:
    """``df`` with a number from ``first`` on within ``group`` by ``order``, without gaps.

    Rows are dealt out by ranges of group and order, whose bounds Spark samples from the rows, so they
    are even whatever the values; they are numbered within a range and shifted by the ranges before.
    Only a count per range and group meets in one place.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # settled: which range a row is in must not change between its number and its shift
    dealt = settle(df.repartitionByRange(ranges, *group, *order).withColumn("_p", F.spark_partition_id()))
    own = Window.partitionBy(*group, "_p").orderBy(*order)
    before = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*group, "_p").count().withColumn("_s", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    out = dealt.withColumn("_o", F.row_number().over(own)).join(counts, [*group, "_p"])
    return out.withColumn(into, (F.col("_o") + F.col("_s") + (first - 1)).cast("long")).drop("_p", "_o", "_s")


def with_row(df: DataFrame, name: str = "row") -> DataFrame:
    """``df``, settled, with a number of each row that stays the same; for joins that may not trust the caller's ids."""
    return settle(df.withColumn(name, F.monotonically_increasing_id()))


def nulls_last(column: str) -> Column:
    """A value to order by: that of the column, nulls after all others."""
    return F.struct(F.col(column).isNull().alias("none"), F.col(column).alias("value"))
