"""Places of rows inside large groups."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from sieveline.session import written


def numbered(rows: DataFrame, group, blocks, order, name: str = "n") -> DataFrame:
    """Add ``name``, the place (from 0) of a row in its group by ``blocks`` and then ``order``.

    ``blocks`` are columns that come first in the order and cut a group into pieces of a bounded size. A row's place is its
    place in its piece and the sizes of the pieces before; so a group that holds most of all rows is spread over tasks, and
    only the sizes, a row a piece, meet in one place. Rows are written once, as sizes and places read them both.
    """
    held, before = written(rows, "numbered"), "_before"
    earlier = Window.partitionBy(*group).orderBy(*blocks).rowsBetween(Window.unboundedPreceding, -1)
    sizes = held.groupBy(*group, *blocks).count().select(
        *group, *blocks, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias(before))
    inside = F.row_number().over(Window.partitionBy(*group, *blocks).orderBy(*order))
    return held.withColumn(name, inside).join(sizes, [*group, *blocks]).withColumn(
        name, (F.col(name) + F.col(before) - 1).cast("long")).drop(before)


def block_of(number: Column, size: int = 4096) -> Column:
    """The piece of a number that counts up; unknown numbers come first."""
    return F.coalesce(F.floor(number / size), F.lit(-1)).cast("long")
