"""Distributed positions: ``row_number`` without a single-task window.

``row_number() over (partition by few_keys order by x)`` sends a whole group to one task; with a
handful of groups (splits, domains, one global order) that is one task per group at any scale.
``ordinal`` instead range-partitions on (group, order), numbers rows inside each range, and adds
the sizes of the earlier ranges. The range layout comes from sampling, so the ranged data is
written once to the session's checkpoint folder (``materialize``) before counting; all later
steps read the same layout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .joins import materialize

_LOCAL_BITS = 33  # monotonically_increasing_id = partition_id << 33 | row_in_partition


def ordinal(df: DataFrame, order_cols: Sequence[Column | str], partition_cols: Sequence[str] = (),
            name: str = "pos", num_partitions: int | None = None) -> DataFrame:
    """Add a 0-based BIGINT position ``name`` ordered by ``order_cols`` inside ``partition_cols``.

    Ties get distinct, arbitrary positions (as ``row_number`` does); callers pass a unique
    order key when positions must be reproducible.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in partition_cols] + [F.col(c) if isinstance(c, str) else c for c in order_cols]
    ranged = materialize(df.repartitionByRange(n, *keys)
                         .sortWithinPartitions(*keys)
                         .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = (ranged.withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS))
                .withColumn("_local", F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))))
    # one row per (range partition, group): at most partitions + groups rows
    stats = ranged.groupBy("_pid", *partition_cols).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_local").alias("_first"))
    w = Window.partitionBy(*partition_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    # stats is tiny for few groups; AQE broadcasts it from its measured size
    out = ranged.join(stats.drop("_n"), ["_pid", *partition_cols])
    return (out.withColumn(name, (F.col("_before") + F.col("_local") - F.col("_first")).cast("bigint"))
               .drop("_mid", "_pid", "_local", "_first", "_before"))


def running_total(df: DataFrame, order_cols: Sequence[Column | str], partition_cols: Sequence[str] = (),
                  weight: str = "w", name: str = "before", num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = sum of ``weight`` over strictly earlier rows (by ``order_cols``) in the group.

    Same range-partition + checkpoint layout as ``ordinal``; meant for pre-aggregated input
    (for example value counts), where order keys are distinct and ranges stay balanced.
    """
    spark = df.sparkSession
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in partition_cols] + order
    ranged = materialize(df.repartitionByRange(n, *keys).withColumn("_pid", F.spark_partition_id()))
    w_local = (Window.partitionBy("_pid", *partition_cols).orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, -1))
    ranged = ranged.withColumn("_local", F.coalesce(F.sum(weight).over(w_local), F.lit(0)))
    stats = ranged.groupBy("_pid", *partition_cols).agg(F.sum(weight).alias("_n"))
    w = Window.partitionBy(*partition_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    out = ranged.join(stats, ["_pid", *partition_cols])
    return out.withColumn(name, F.col("_before") + F.col("_local")).drop("_pid", "_local", "_before")
