"""Problem 6: per-key results although a few keys hold most records.

``select_ranks`` finds the values at given ranks of every key exactly and never brings the values of
a key together. Each round counts, per key, the values of the interval that still holds the rank in
``BUCKETS`` equal buckets; the counts are mergeable, so they are added up before and after the
shuffle. The bucket that contains the rank, narrowed to the least and greatest value seen in it, is
the next interval; a rank is resolved when these are equal. Values outside all open intervals of their key are left out of the
next round, so each round reads a fraction of the one before.

The open intervals (one row per key and rank) are broadcast only while few, by count; otherwise they
are joined by shuffling, with the keys that hold more than one thousandth of the rows spread over
``SALTS`` partitions.

NULL keys and NULL values are left out. Ties need no rule: equal values are one value. Ranks beyond
a key's number of values give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entlink.session import BROADCAST_ROWS, checkpointed, once, stored

BUCKETS = 64
SALTS = 64
#: A key is hot if it holds at least one of so many rows; so there are no more hot keys than this.
HOT = 1000


def _bucket(value: Column, low: Column, high: Column) -> Column:
    """Number of the equal bucket of [low, high] that holds value; low and high never share one."""
    place = F.floor((value - low).cast("double") * F.lit(float(BUCKETS)) / (high - low).cast("double"))
    return F.least(place, F.lit(BUCKETS - 1)).cast("int")


def _open_values(values: DataFrame, state: DataFrame, rows: int, hot: DataFrame, how: str = "inner") -> DataFrame:
    """The values of each key joined to the key's open intervals; any salt will do, as hot keys' intervals go to all."""
    inside = (F.col("k") == F.col("key")) & F.col("v").between(F.col("low"), F.col("high"))
    state = state.withColumnRenamed("k", "key")
    if rows <= BROADCAST_ROWS:
        return values.join(F.broadcast(state), inside, how)
    marked = F.broadcast(hot.select(F.col("k").alias("hot")))  # at most HOT rows
    salted = values.join(marked, F.col("k") == F.col("hot"), "left").withColumn("salt", F.when(F.col("hot").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0).cast("bigint")))
    all_salts = F.when(F.col("hot").isNotNull(), F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    spread = state.join(marked, F.col("key") == F.col("hot"), "left").withColumn("ksalt", F.explode(all_salts)).drop("hot")
    return salted.drop("hot").join(spread, inside & (F.col("salt") == F.col("ksalt")), how).drop("salt", "ksalt")


def select_ranks(values: DataFrame, key: str, value: str, ranks: Column) -> DataFrame:
    """(key, rank, value): the values at ``ranks`` (an array of BIGINT over the column ``n``, the key's row count; 1 is the least).

    ``value`` must be an integer type; a key whose range does not fit BIGINT raises an error.
    """
    rows = values.select(F.col(key).alias("k"), F.col(value).cast("bigint").alias("v")).where("k is not null and v is not null")
    return _ranks(checkpointed(rows), ranks)[0].select(F.col("k").alias(key), "rank", F.col("v").alias(value))


def _ranks(rows: DataFrame, ranks: Column) -> tuple[DataFrame, DataFrame]:
    """(k, rank, v) of ``rows``(k, v), and the hot keys."""
    state = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    everything = rows.count()
    hot = checkpointed(state.where(F.col("n") * HOT >= everything).select("k")) if everything else state.select("k")
    state = state.select("k", "low", "high", F.explode(ranks).alias("rank"), "n").where("rank between 1 and n").withColumn("below", F.lit(0).cast("bigint")).drop("n")
    done, first = None, True
    while True:
        state = checkpointed(state)
        over = state.where("low = high").select("k", "rank", F.col("low").alias("v"))
        done = over if done is None else done.unionByName(over)
        state = state.where("low < high")
        left = state.count()
        if not left:
            return done, hot
        if not first:  # from now on only what lies in an open interval
            rows = checkpointed(_open_values(rows, state, left, hot, "left_semi"))
        first = False
        counted = (
            _open_values(rows, state, left, hot)
            .groupBy("k", "rank", "below", _bucket(F.col("v"), F.col("low"), F.col("high")).alias("b"))
            .agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        )
        w = Window.partitionBy("k", "rank").orderBy("b")  # at most BUCKETS rows
        upto = counted.withColumn("upto", F.col("below") + F.sum("c").over(w))
        state = upto.where("rank <= upto and rank > upto - c").select("k", "low", "high", "rank", (F.col("upto") - F.col("c")).alias("below"))


def quantiles(values: DataFrame, key: str, value: str, probabilities: list[float]) -> DataFrame:
    """(key, rank, value): exact per-key quantiles by the nearest-rank definition."""
    wanted = F.array_distinct(F.array(*[F.greatest(F.ceil(F.col("n") * F.lit(p)), F.lit(1)).cast("bigint") for p in probabilities]))
    return select_ranks(values, key, value, wanted)


def link_frequencies(entity_links: DataFrame) -> DataFrame:
    """(entity_id, src, freq) summed over all records of an entity; records without entity do not count."""
    records = once(entity_links.select("record_id", "entity_id", "links"), "record_id").where("entity_id is not null")
    links = records.select("entity_id", F.inline("links")).where("src is not null")
    return links.groupBy("entity_id", "src").agg(F.coalesce(F.sum(F.col("freq").cast("bigint")), F.lit(0)).alias("freq"))


def top_source(frequencies: DataFrame) -> DataFrame:
    """(entity_id, src, freq): the page with the greatest freq of each entity, the smaller page of equal ones.

    The greatest frequency of each entity is its last rank; of the rows that have it the smallest page is
    taken, by an aggregation that combines before it shuffles. Any BIGINT frequency will do.
    """
    rows = stored(frequencies.select(F.col("entity_id").alias("k"), F.col("freq").cast("bigint").alias("v"), "src").where("k is not null and v is not null"))
    best, hot = _ranks(rows.select("k", "v"), F.array(F.col("n")))
    best = checkpointed(best.select("k", F.col("v").alias("low"), F.col("v").alias("high")))
    reached = _open_values(rows, best, best.count(), hot)
    return reached.groupBy(F.col("k").alias("entity_id")).agg(F.min("src").alias("src"), F.max("v").alias("freq"))
