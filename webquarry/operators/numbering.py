"""Numbers within groups without a window over a group: range partitions and prefix sums of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import stored


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``: their number from 1 within ``group``, by ``order``.

    All groups are sorted by one range partitioning, in which a large group has many tasks.  A row's number is its place in the
    partition plus the rows that earlier partitions have of its group; what is summed by windows is a row for each
    partition and group.  ``order`` must tell rows of a group apart, or equal ones get either number; nulls come first and
    are a group of their own.
    """
    sorted_ = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    placed = stored(sorted_.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    parts = placed.groupBy(*group, part.alias("_part")).agg(F.min(row).alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shift = parts.select(*[F.col(c).alias(f"_of_{c}") for c in group], F.col("_part").alias("_of_part"), (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    met = placed.withColumn("_part", part)
    same = met["_part"] == shift["_of_part"]
    for c in group:
        same &= met[c].eqNullSafe(shift[f"_of_{c}"])
    return met.join(shift, same).withColumn(name, (row + F.col("_shift")).cast("int")).select(*rows.columns, name)
