"""Running values by group in the order of a whole number, without a group in one task.

The order's range is cut into stretches of equal width, about ROWS rows each if it is evenly filled; windows run by group
and stretch, and what earlier stretches hand on comes from a table of a row for each group and stretch. The result is that
of a window over the whole group, however the rows are spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Rows of all groups in a stretch.
ROWS = 1_000_000


def stretch(df: DataFrame, order: str, rows: int = ROWS) -> Column:
    """The number of a row's stretch, rising with the order; null orders come first. Other types than whole numbers are one stretch."""
    if not isinstance(df.schema[order].dataType, IntegralType):
        return F.lit(0).cast("long")
    found = df.agg(F.min(order).alias("low"), F.max(order).alias("high"), F.count("*").alias("n")).first()
    if found["low"] is None:
        return F.lit(0).cast("long")
    width = max(1, -(-(found["high"] - found["low"] + 1) // max(1, found["n"] // rows)))
    return F.coalesce(F.floor((F.col(order).cast("decimal(20,0)") - F.lit(found["low"])) / F.lit(width)).cast("long"), F.lit(-1).cast("long"))


def _handed_on(df: DataFrame, value: Column, over) -> DataFrame:
    """df with _handed: over(values of the earlier stretches' aggregate), for rows with _by and _stretch."""
    held = df.groupBy("_by", "_stretch").agg(value.alias("_value"))
    w = Window.partitionBy("_by").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(F.col("_by").alias("_by2"), F.col("_stretch").alias("_stretch2"), over("_value").over(w).alias("_handed"))
    return df.join(held, F.col("_by").eqNullSafe(F.col("_by2")) & (F.col("_stretch") == F.col("_stretch2")), "left")


def _marked(df: DataFrame, by: Column, order: str, rows: int) -> DataFrame:
    return df.withColumns({"_by": by, "_stretch": stretch(df, order, rows)})


def _plain(df: DataFrame) -> DataFrame:
    return df.drop("_by", "_stretch", "_by2", "_stretch2", "_handed")


def numbered(df: DataFrame, by: Column, order: list[str], name: str, rows: int = ROWS) -> DataFrame:
    """df with a running number from 1 in each group."""
    marked = _handed_on(_marked(df, by, order[0], rows), F.count("*"), F.sum)
    n = F.row_number().over(Window.partitionBy("_by", "_stretch").orderBy(*order))
    return _plain(marked.withColumn(name, (n + F.coalesce("_handed", F.lit(0))).cast("int")))


def filled(df: DataFrame, by: Column, order: str, value: Column, name: str, rows: int = ROWS) -> DataFrame:
    """df with the last value so far in each group that isn't null."""
    marked = _marked(df.withColumn("_filled", value), by, order, rows)
    last = F.max_by("_filled", F.when(F.col("_filled").isNotNull(), F.struct(order)))  # a struct, as a null order counts too
    marked = _handed_on(marked, last, lambda c: F.last(c, ignorenulls=True))
    w = Window.partitionBy("_by", "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return _plain(marked.withColumn(name, F.coalesce(F.last("_filled", ignorenulls=True).over(w), F.col("_handed")))).drop("_filled")


def summed_before(df: DataFrame, by: Column, order: str, value: Column, name: str, rows: int = ROWS) -> DataFrame:
    """df with the sum of the value over the group's earlier rows, 0 for the first."""
    marked = _handed_on(_marked(df, by, order, rows), F.sum(value), F.sum)
    w = Window.partitionBy("_by", "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return _plain(marked.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)) + F.coalesce("_handed", F.lit(0))))
