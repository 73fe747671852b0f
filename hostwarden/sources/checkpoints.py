"""Incremental reads: checkpoint predicate, batch limit, checkpoint advance."""

from __future__ import annotations

from decimal import Decimal

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hostwarden.sources.registry import source_table

CHANNEL_KEY = ["source_type", "channel"]
#: Record ids count on each host by themselves, so a store with several hosts needs all three.
HOST_KEY = ["source_host", *CHANNEL_KEY]
GROUP_LIMIT = 1000
#: Bins that the record ids of a channel are counted in at once.
BINS = 1 << 16


def load_checkpoints(raw: DataFrame) -> DataFrame:
    """``(key, value)`` text pairs -> checkpoints.

    The key is ``source:channel``, split at the first colon. Values that are no
    whole number or are negative are dropped.
    """
    value = F.expr("try_cast(value AS BIGINT)")
    return (
        raw.select(
            F.substring_index("key", ":", 1).alias("source_type"),
            F.expr("substring(key, instr(key, ':') + 1)").alias("channel"),
            value.alias("last_record_id"),
        )
        .filter(F.col("last_record_id") >= 0)
    )


def read_checkpoint_json(spark: SparkSession, path: str) -> DataFrame:
    """Checkpoints of a JSON state file; a file that is no JSON object yields none."""
    text = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "MAP<STRING, STRING>")
    return load_checkpoints(text.select(F.explode(entries).alias("key", "value")))


def save_checkpoint_json(checkpoints: DataFrame) -> DataFrame:
    """The state-file form: one ``(key, value)`` row per channel."""
    return checkpoints.select(
        F.concat_ws(":", *CHANNEL_KEY).alias("key"), F.col("last_record_id").alias("value")
    )


def _key_of(checkpoints: DataFrame) -> list[str]:
    return HOST_KEY if "source_host" in checkpoints.columns else CHANNEL_KEY


def after_checkpoint(events: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Events with a record id above their checkpoint, by channel or, if the checkpoints name hosts, by host and channel.

    A channel without checkpoint, or with checkpoint 0, is read whole. Documents
    marked ``is_bad`` have no record id to compare and stay for the reject table.
    Checkpoints of one host have one row per channel of the registry and are broadcast.
    With hosts their number has no bound, so both sides are shuffled on the key, unless
    Spark finds the checkpoints small; a busy host's events are split as a skewed join.
    """
    unreadable = F.col("is_bad") if "is_bad" in events.columns else F.lit(False)
    key = _key_of(checkpoints)
    last = F.coalesce("last_record_id", F.lit(0))
    checked = F.when(last < 0, F.raise_error(F.lit("last_record_id cannot be negative"))).otherwise(last)
    side = checkpoints.select(*key, "last_record_id")
    return (
        events.join(F.broadcast(side) if key == CHANNEL_KEY else side, key, "left")
        .filter(unreadable | (checked == 0) | (F.col("record_id") > checked))
        .drop("last_record_id")
    )


def next_batch(events: DataFrame, batch_size: int = 100) -> DataFrame:
    """The ``batch_size`` lowest record ids of each channel.

    Equal record ids, as of two hosts, stay together, so that a checkpoint after the
    batch passes none of them; then a batch is larger. Documents marked ``is_bad``
    have no record id to order by: they do not count and all stay.

    A channel may hold most of the table. Up to ``GROUP_LIMIT`` rows Spark prunes
    each input partition before the shuffle by itself (``WindowGroupLimit``); above it
    the last record id of each channel is found by counting, and no event is moved.
    """
    if batch_size <= 0:
        raise ValueError("batch_size must be greater than zero")
    if "is_bad" in events.columns:
        counted = next_batch(events.filter(~F.col("is_bad")).drop("is_bad"), batch_size)
        return counted.withColumn("is_bad", F.lit(False)).unionByName(events.filter("is_bad"))
    if batch_size > GROUP_LIMIT:
        last = events.sparkSession.createDataFrame(_last_ids(events, batch_size), "_source STRING, _channel STRING, _last BIGINT")
        return (
            events.join(F.broadcast(last), _same_channel())
            .filter(F.col("record_id").isNull() | (F.col("record_id") <= F.col("_last")))
            .drop("_source", "_channel", "_last")
        )
    return _lowest(events, CHANNEL_KEY, batch_size)


def _same_channel() -> Column:
    return F.col("source_type").eqNullSafe(F.col("_source")) & F.col("channel").eqNullSafe(F.col("_channel"))


def _last_ids(events: DataFrame, count: int) -> list[tuple[str | None, str | None, int | None]]:
    """Source, channel and the ``count``-th lowest record id, the highest where there are fewer: one row per channel.

    Missing ids come first; where they fill the batch the last id is None. The ids between
    the lowest and the highest are counted in ``BINS`` bins, then those of the bin that holds the
    place looked for, until a bin is a single id: four rounds at most for any 64-bit numbers.
    """
    spark = events.sparkSession
    rows = events.select(*CHANNEL_KEY, "record_id").persist(StorageLevel.MEMORY_AND_DISK)
    found, searched = [], {}
    ids = (F.count("*").alias("all"), F.count("record_id").alias("known"), F.min("record_id").alias("low"), F.max("record_id").alias("high"))
    for row in rows.groupBy(*CHANNEL_KEY).agg(*ids).collect():
        place = count - (row["all"] - row["known"])
        if place <= 0 or place >= row["known"]:
            found.append((row["source_type"], row["channel"], row["high"] if place > 0 else None))
        else:
            searched[row["source_type"], row["channel"]] = (row["low"], row["high"], place)
    while searched:
        widths = {key: -(-(high - low + 1) // BINS) for key, (low, high, _) in searched.items()}
        bounds = spark.createDataFrame(
            [(*key, low, high, place, Decimal(widths[key])) for key, (low, high, place) in searched.items()],
            "_source STRING, _channel STRING, low BIGINT, high BIGINT, place BIGINT, width DECIMAL(20, 0)",
        )
        number = F.expr("(CAST(record_id AS DECIMAL(20, 0)) - CAST(low AS DECIMAL(20, 0))) div width").alias("bin")
        inside = rows.join(F.broadcast(bounds), _same_channel()).filter("record_id BETWEEN low AND high")
        counted = inside.groupBy("_source", "_channel", "place", number).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("_source", "_channel").orderBy("bin"))
        holding = counted.withColumn("upto", upto).filter("upto >= place AND upto - n < place").collect()
        for row in holding:
            key = (row["_source"], row["_channel"])
            low, high, place = searched.pop(key)
            low += row["bin"] * widths[key]
            high = min(high, low + widths[key] - 1)
            if low == high:
                found.append((*key, low))
            else:
                searched[key] = (low, high, place - (row["upto"] - row["n"]))
    rows.unpersist()
    return found


def _lowest(events: DataFrame, key: list[str], count: int) -> DataFrame:
    order = Window.partitionBy(*key).orderBy("record_id")
    return (
        events.withColumn("_place", F.rank().over(order))
        .filter(F.col("_place") <= count)
        .drop("_place")
    )


def advance_checkpoints(checkpoints: DataFrame, processed: DataFrame) -> DataFrame:
    """Highest record id per key of the checkpoints, never below the stored one."""
    key = _key_of(checkpoints)
    seen = processed.groupBy(*key).agg(F.max("record_id").alias("_seen"))
    return checkpoints.join(seen, key, "full_outer").select(
        *key,
        F.greatest(
            F.coalesce("last_record_id", F.lit(0)), F.coalesce("_seen", F.lit(0))
        ).alias("last_record_id"),
    )


def with_source(events: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """Channel -> source lookup; events of channels that are not enabled drop out."""
    sources = source_table(events.sparkSession, names).select("source_type", "channel", "ordinal")
    return events.join(F.broadcast(sources), "channel", "inner")
