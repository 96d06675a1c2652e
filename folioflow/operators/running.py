"""Running values over the rows of a key in order, for keys with any number of rows.

A window over a key sorts all of its rows in one task. Here the rows of a key are dealt into stretches
of places, each with its own window; only one row a stretch meets in the window over the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.plans.stages import staged

#: Places of one stretch.
STRETCH = 256


def sum_before(rows: DataFrame, key: str, place: str, value: str, name: str, stretch: int = STRETCH) -> DataFrame:
    """rows with name: the sum of value over the rows of the key at smaller places. Places are whole numbers, once a key."""
    rows = rows.withColumn("stretch", F.floor(F.col(place) / stretch))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(key, "stretch").agg(F.sum(value).alias("of"))
    sums = sums.select(key, "stretch", F.coalesce(F.sum("of").over(before.partitionBy(key).orderBy("stretch")), F.lit(0)).alias("ahead"))
    within = F.coalesce(F.sum(value).over(before.partitionBy(key, "stretch").orderBy(place)), F.lit(0))
    return rows.withColumn(name, within).join(sums, [key, "stretch"]).withColumn(name, F.col(name) + F.col("ahead")).drop("stretch", "ahead")


def most_before(rows: DataFrame, key: str, place: str, value: Column, name: str, stretch: int = STRETCH) -> DataFrame:
    """rows with name: the largest value that isn't null among the rows of the key at smaller places; null where there is none. Places are whole numbers, once a key."""
    rows = rows.withColumn("value", value).withColumn("stretch", F.floor(F.col(place) / stretch))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    most = rows.groupBy(key, "stretch").agg(F.max("value").alias("of"))
    most = most.select(key, "stretch", F.max("of").over(before.partitionBy(key).orderBy("stretch")).alias("ahead"))
    within = F.max("value").over(before.partitionBy(key, "stretch").orderBy(place))
    return rows.withColumn(name, within).join(most, [key, "stretch"]).withColumn(name, F.greatest(name, "ahead")).drop("stretch", "ahead", "value")


def last_so_far(rows: DataFrame, key: str, place: str, order: list[str], event: Column, name: str, stretch: int = STRETCH) -> DataFrame:
    """rows with name: the last event that isn't null among the rows of the key up to this one, ordered by place and then by order."""
    rows = staged(rows.withColumn("event", event).withColumn("stretch", F.floor(F.col(place) / stretch)))
    up_to = Window.rowsBetween(Window.unboundedPreceding, 0)
    at = F.struct(place, *order, F.col("event").alias("event"))
    ends = rows.groupBy(key, "stretch").agg(F.max(F.when(F.col("event").isNotNull(), at))["event"].alias("end"))
    before = up_to.partitionBy(key).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(key, "stretch", F.last("end", ignorenulls=True).over(before).alias("ahead"))
    within = F.last("event", ignorenulls=True).over(up_to.partitionBy(key, "stretch").orderBy(place, *order))
    return rows.withColumn(name, within).join(ends, [key, "stretch"]).withColumn(name, F.coalesce(name, "ahead")).drop("stretch", "ahead", "event")
