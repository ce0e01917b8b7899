"""Problem 3: the N highest-scoring items of every group, under a total order of ties.

The rows of a group lie in any number of partitions. In each partition the N best rows of a group are
kept before anything is shuffled, and are then ranked by group and partition: the score of the N-th is a lower
bound of the group's N-th best score overall. The greatest of these bounds is joined to the kept rows of its group; rows
below it cannot be among the winners and are dropped. Only the survivors of a group meet and are ranked.

The bounds are broadcast while few, by count; beyond that the join is by group and one of ``SALTS``
salts, so that not even the kept rows of a group meet before they are filtered. At most
(partitions x N) rows of a group are kept, however large it is.

Ties: of equal scores the smaller item comes first. NULL groups belong to no group and are
dropped; a NULL score ranks below every other. An item repeated within a group is ranked once per row,
so aggregate first where that is not wanted. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from entlink.session import BROADCAST_ROWS, stored

SALTS = 32


def top_n(rows: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """(group, item, score, rank) for rank 1..n of each group."""
    order = [F.desc_nulls_last("s"), F.asc("i")]
    ranked = _survivors(stored(_kept(rows, group, item, score, n)), n).withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    return ranked.where(F.col("rank") <= n).select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "rank")


def _kept(rows: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """(g, i, s, part, r): the n best rows of each group in each partition, in the partition's order."""
    rows = rows.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).alias("s")).where("g is not null").withColumn("part", F.spark_partition_id())
    own = Window.partitionBy("g", "part").orderBy(F.desc_nulls_last("s"), F.asc("i"))
    return rows.withColumn("r", F.row_number().over(own)).where(F.col("r") <= n)  # Spark limits the ranks before it shuffles


def _survivors(kept: DataFrame, n: int) -> DataFrame:
    """The kept rows that reach the greatest bound of their group."""
    bounds = kept.where((F.col("r") == n) & F.col("s").isNotNull()).groupBy(F.col("g").alias("b")).agg(F.max("s").alias("bound"))
    if bounds.count() <= BROADCAST_ROWS:
        joined = kept.join(F.broadcast(bounds), F.col("g") == F.col("b"), "left")
    else:
        salted = bounds.withColumn("bsalt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = kept.withColumn("salt", F.pmod("part", F.lit(SALTS))).join(salted, (F.col("g") == F.col("b")) & (F.col("salt") == F.col("bsalt")), "left")
    return joined.where("bound is null or s >= bound").select("g", "i", "s")
