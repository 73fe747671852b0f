"""Parallel numbering of a totally ordered DataFrame."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from hostwarden.session import shared_dir

_PLACE_BITS = 33


def global_positions(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add ``name``: the position of every row, from 0, in the order of ``order``.

    The rows are range-partitioned, so a key that holds most of them is spread
    over many tasks, unlike ``row_number`` over a partition of that key.
    """
    placed = _placed(rows, order)
    starts = _starts(placed, F.lit(1))
    inside = F.col("_place") - F.shiftleft(F.col("_part"), _PLACE_BITS)
    others = [c for c in rows.columns if c != name]
    return placed.join(F.broadcast(starts), "_part").select(*others, (F.col("_start") + inside).alias(name))


def global_running_count(rows: DataFrame, order: list[str], counted: str, name: str) -> DataFrame:
    """Add ``name``: how many rows before this one, in the order of ``order``, have ``counted`` set."""
    placed = _placed(rows, order)
    flag = F.col(counted).cast("bigint")
    starts = _starts(placed, flag)
    # One window partition is one range partition, so none is larger than its share.
    earlier = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(flag).over(earlier), F.lit(0))
    counted_rows = placed.withColumn("_inside", inside).join(F.broadcast(starts), "_part")
    return counted_rows.select(*rows.columns, (F.col("_start") + F.col("_inside")).alias(name))


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows in range partitions, with partition number and place.

    They are checkpointed because partition totals and places must come from one
    and the same layout, also after a lost executor.
    """
    shared_dir(rows.sparkSession)
    # The range bounds are sampled from the rows, so they are needed twice.
    kept = rows.persist(StorageLevel.MEMORY_AND_DISK)
    placed = (
        kept.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
        .checkpoint()
    )
    kept.unpersist()
    return placed.withColumn("_part", F.shiftright("_place", _PLACE_BITS))


def _starts(placed: DataFrame, amount: Column) -> DataFrame:
    """Total of ``amount`` before each partition: one row per partition, so its broadcast is safe."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(F.sum(amount).alias("_total"))
    return totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))


def in_chunks(numbered: DataFrame, size: int, context: int) -> DataFrame:
    """Numbered rows cut into chunks of ``size`` positions (``chunk``, ``own``).

    The last ``context`` rows of a chunk also come to the next one, where they are
    not ``own``.
    """
    size = max(size, context)
    home = F.expr(f"position div {size}")
    places = F.when(F.col("position") % size >= size - context, F.array(home, home + 1)).otherwise(F.array(home))
    return numbered.withColumn("chunk", F.explode(places)).withColumn("own", F.col("chunk") == home)
