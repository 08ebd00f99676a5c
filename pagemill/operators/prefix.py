"""Running sums over groups of any size: no task reads a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.sources.shared import written


def prefix_sums(rows: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """Adds, for each name in `sums`, the sum of its column over the rows of the group up to and with this one.

    Rows are dealt into `parts` ranges of (group, order), as many as shuffles have by default. A range is summed by
    itself, and what the ranges before it hold of the same group is added: one row a range, and a row for each group
    that begins in it. A group is any combination of values, nulls among them; without columns all rows are one. Rows of
    equal group and order share a range and follow each other in no given order. Nulls count 0, and an empty table
    stays empty. Columns of rows keep their names; a sum takes the place of a column of its name.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key, place = F.struct(*([F.col(c) for c in group] or [F.lit(0).alias("all")])), [f"\norder {k}" for k in range(len(order))]
    keyed = rows.withColumns({"\ngroup": key} | dict(zip(place, order, strict=True)) | {f"\nvalue {n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()})
    ranged = written(keyed.repartitionByRange(parts, "\ngroup", *place).withColumn("\npart", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("\ngroup", "\npart").agg(*[F.sum(f"\nvalue {n}").alias(f"\ntotal {n}") for n in sums])
    before = Window.partitionBy("\ngroup").orderBy("\npart").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("\ngroup", "\npart", *[F.coalesce(F.sum(f"\ntotal {n}").over(before), F.lit(0)).alias(f"\nbefore {n}") for n in sums])
    within = Window.partitionBy("\ngroup", "\npart").orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)
    found = ranged.withColumns({f"\nvalue {n}": F.sum(f"\nvalue {n}").over(within) for n in sums}).hint("merge").join(written(offsets, "offsets"), ["\ngroup", "\npart"])
    kept = [F.col(c) for c in rows.columns if c not in sums]
    return found.select(*kept, *[(F.col(f"\nvalue {n}") + F.col(f"\nbefore {n}")).alias(n) for n in sums])
