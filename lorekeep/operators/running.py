"""Running totals and row numbers over an order, without one task holding a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.session import cut_lineage


def running_total(
    df: DataFrame,
    value: Column,
    order: Sequence[str],
    group: Sequence[str] = (),
    out: str = "running",
    slices: int | None = None,
) -> DataFrame:
    """Add the running sum of ``value`` within ``group`` by ``order`` (which must be unique within the group).

    Only the keys (group, order) and the value are numbered; they are range-partitioned by (group, order), so a group that holds
    most rows is spread over many slices, and the slices are checkpointed, because their bounds are sampled and must not move. The
    sum of the earlier slices, one row per (group, slice), is then added to a window inside each slice. The totals
    meet the rows in one join on the keys; no other column is in the numbering or the checkpoint. Keys may be null.
    """
    count = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = list(dict.fromkeys([*group, *order]))
    alias = {name: f"__key_{name}" for name in names}
    by, within = [alias[name] for name in group], [alias[name] for name in order]
    keys = [*by, "__slice"]
    light = df.select(*[F.col(name).alias(alias[name]) for name in names], value.alias("__value"))
    ranged = light.repartitionByRange(count, *by, *within)
    ranged = cut_lineage(ranged.withColumn("__slice", F.spark_partition_id()))
    earlier = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys)
        .agg(F.sum("__value").alias("__sum"))
        .withColumn("__before", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)))
        .select("__before", *[F.col(name).alias(f"__of{name}") for name in keys])
    )
    same = [F.col(name).eqNullSafe(F.col(f"__of{name}")) for name in keys]
    inside = (
        Window.partitionBy(*keys).orderBy(*within).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    total = F.col("__before") + F.sum("__value").over(inside)
    totals = ranged.join(offsets, same).select(*alias.values(), total.alias(out))
    back = [F.col(name).eqNullSafe(F.col(alias[name])) for name in names]
    return df.drop(out).join(totals, back).select(*[name for name in df.columns if name != out], out)


def with_batch(
    df: DataFrame, order: Sequence[str], group: Sequence[str] = (), size: int = 100, out: str = "batch"
) -> DataFrame:
    """Number consecutive groups of ``size`` rows, from 0, within each group."""
    numbered = running_total(df, F.lit(1).cast("bigint"), order, group, "__position")
    return numbered.withColumn(out, F.floor((F.col("__position") - 1) / size)).drop("__position")
