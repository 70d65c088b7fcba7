"""Order-dependent steps over groups of any size.

A window over a whole group puts a busy board into one task. Here a group is cut into ranges of its integer order column;
each range is windowed alone, and a small table with one row per range carries what must cross the cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a range of the order column; a range holds at most that many rows where the column is unique in its group.
RANGE = 4096


def _cut(df: DataFrame, keys: list[str], order: str, width: int, ranges: str | None = None) -> DataFrame:
    """``df`` with ``_part``, the row's group and range in one value: all steps share one partitioning, and null keys are equal."""
    at = F.col(ranges) if ranges else F.floor(F.col(order) / width)
    return df.withColumn("_part", F.struct(*keys, at.cast("bigint").alias("_range")))


def _before(keys: list[str]):
    return Window.partitionBy(*(F.col(f"_part.{k}") for k in keys)).orderBy("_part._range").rowsBetween(Window.unboundedPreceding, -1)


def _groups(keys: list[str]):
    return Window.partitionBy(*(F.col(f"_part.{k}") for k in keys)).orderBy("_part._range")


def position(df: DataFrame, keys: list[str], order: str, out: str = "position", width: int = RANGE) -> DataFrame:
    """``df`` with each row's place in its group from 1, by ``order`` (an integer, unique within the group).

    Rows are numbered inside their range, and the numbers of rows in the ranges before are added. Null order values come first.
    """
    cut = _cut(df, keys, order, width)
    ranges = cut.groupBy("_part").agg(F.count("*").alias("_n"))
    ranges = ranges.select("_part", F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0)).alias("_before"))
    numbered = cut.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    return numbered.join(ranges, "_part").select(*df.columns, (F.col("_own") + F.col("_before")).cast("bigint").alias(out))


def previous(df: DataFrame, keys: list[str], order: str, value: list[str], prefix: str = "prev_", width: int = RANGE) -> DataFrame:
    """``df`` with the columns ``value`` of the row before in its group, by ``order``; null for a group's first row.

    Inside a range by a window; the first row of a range takes the last row of the nearest range before that has any.
    """
    cut = _cut(df, keys, order, width).withColumn("_v", F.struct(*value))
    last = cut.groupBy("_part").agg(F.max_by("_v", order).alias("_last"))
    last = last.select("_part", F.lag("_last").over(_groups(keys)).alias("_carried"))
    rows = cut.withColumn("_p", F.lag("_v").over(Window.partitionBy("_part").orderBy(order)))
    joined = rows.join(last, "_part").withColumn("_p", F.coalesce("_p", "_carried"))
    return joined.select(*df.columns, *(F.col("_p")[v].alias(prefix + v) for v in value))


def running_maxima(df: DataFrame, keys: list[str], order: str, values: dict[str, Column], inclusive: bool = False, width: int = RANGE, ranges: str | None = None) -> DataFrame:
    """``df`` with, by name, the greatest of each of the ``values`` in the rows before in its group (and in its own row, if inclusive); nulls are passed over.

    With a struct that starts with the order column this is the last value. Ranges of the order column carry their greatest values on; a column
    ``ranges`` that comes before ``order`` in the order of rows (a turn, of which ``order`` is the place) may be the range itself. One window and one join serve all values.
    """
    cut = _cut(df, keys, order, width, ranges).withColumns({f"_v_{n}": v for n, v in values.items()})
    carried = cut.groupBy("_part").agg(*(F.max(f"_v_{n}").alias(f"_m_{n}") for n in values)).select("_part", *(F.max(f"_m_{n}").over(_before(keys)).alias(f"_c_{n}") for n in values))
    within = Window.partitionBy("_part").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    rows = cut.withColumns({f"_w_{n}": F.max(f"_v_{n}").over(within) for n in values})
    return rows.join(carried, "_part").select(*df.columns, *(F.greatest(f"_w_{n}", f"_c_{n}").alias(n) for n in values))


def running_max(df: DataFrame, keys: list[str], order: str, value: Column, out: str, inclusive: bool = False, width: int = RANGE) -> DataFrame:
    """``df`` with the greatest ``value`` of the rows before, as :func:`running_maxima`."""
    return running_maxima(df, keys, order, {out: value}, inclusive, width)
