"""Joins that stay fit where one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARK = "__tessera_mark"


def split_join(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined by ``keys`` with ``groups``, an aggregate of their own keys, so that a hot key can be split.

    An aggregate is partitioned by its key already. Joined as it is, its side has no exchange, and adaptive execution splits skewed
    partitions only between two exchanges, so all rows of a hot key would meet in one task. A hash of the keys joins
    beside them here: both sides are exchanged for it, the aggregate once more in its reduced form, and the skew rule applies to
    ``rows``. Keys that are null match nothing, as in any join.
    """
    mark = F.xxhash64(*keys)
    return rows.withColumn(_MARK, mark).join(groups.withColumn(_MARK, mark), [*keys, _MARK], how).drop(_MARK)


def pair_up(rows: DataFrame, sizes: DataFrame, keys: list[str], by: str, columns: list[str], size: int = 256) -> DataFrame:
    """All pairs of rows of one group, once each: ``keys``, ``columns`` and the other row's as ``<column>_2``, with ``by`` < ``<by>_2``.

    ``sizes`` has each group's number of rows as "m". A group is cut into ceil(m / size) blocks by the hash of ``by``, and a row goes to each pair of
    blocks that holds its own, so no task compares more than two blocks of a group, however large that is, and no group is capped.
    """
    blocks = sizes.select(*keys, F.ceil(F.col("m") / size).cast("int").alias("_blocks"))
    placed = split_join(rows.select(*keys, *columns), blocks, keys)
    placed = placed.withColumn("_own", F.when(F.col("_blocks") > 1, F.pmod(F.xxhash64(by), F.col("_blocks")).cast("int")).otherwise(0))
    placed = placed.withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    placed = placed.select(*keys, *columns, "_own", F.least("_own", "_at").alias("_low"), F.greatest("_own", "_at").alias("_high"))
    other = placed.select(*keys, "_low", "_high", F.col("_own").alias("_own_2"), *[F.col(c).alias(f"{c}_2") for c in columns])
    met = placed.join(other, [*keys, "_low", "_high"]).where((F.col("_low") == F.col("_high")) | (F.col("_own") != F.col("_own_2")))
    return met.where(F.col(by) < F.col(f"{by}_2")).select(*keys, *columns, *[f"{c}_2" for c in columns])
