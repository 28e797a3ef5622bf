"""Places of rows in an order without a window over a whole table or group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fixpoint import settle


def positions(df: DataFrame, order: list, name: str, group: list[str] | None = None, sums: dict[str, str] | None = None) -> DataFrame:
    """df with the place of each row, from 1 on, in the given order inside its group (the whole table without one).

    order: columns or expressions, after which rows that tie are interchangeable. sums: new column -> column, running sums
    over the rows before, this one not included. Rows are sorted over ranges of (group, order), so a group of any size is dealt
    over many tasks; places are those in the range plus the counts of the group's earlier ranges, a small table.
    """
    group, sums = group or [], sums or {}
    keys = [F.col(f"`{g}`") if isinstance(g, str) else g for g in [*group, *order]]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    kept = settle(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id().cast("long")))
    run = Window.partitionBy(*group, "_part").orderBy("_at")
    inside = kept.withColumn("_n", F.row_number().over(run).cast("long"))
    for new, column in sums.items():
        inside = inside.withColumn(new, F.coalesce(F.sum(column).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    totals = kept.groupBy(*group, "_part").agg(F.count("*").alias("_c"), *[F.sum(c).alias(f"_s_{new}") for new, c in sums.items()])
    before = Window.partitionBy(*group or [F.lit(0)]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    totals = totals.select(*group, "_part", earlier("_c").alias("_b"), *[earlier(f"_s_{new}").alias(f"_b_{new}") for new in sums])
    on = F.col("l._part") == F.col("r._part")
    for g in group:
        on = on & F.col(f"l.`{g}`").eqNullSafe(F.col(f"r.`{g}`"))
    joined = inside.alias("l").join(totals.alias("r"), on)
    return joined.select(*[F.col(f"l.`{c}`") for c in df.columns], (F.col("l._n") + F.col("r._b")).alias(name), *[(F.col(f"l.{new}") + F.col(f"r._b_{new}")).alias(new) for new in sums])
