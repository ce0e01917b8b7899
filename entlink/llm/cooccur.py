"""Problem 2: items that appear together, counted by an external sort of packed pair codes.

The two 32-bit ids of a pair are packed into one 64-bit code. Every task turns records into codes in
bounded blocks, sorts each block and passes it on as (code, run length). The runs are partitioned by
code and sorted; Spark's sorter spills sorted runs to disk and merges them. A last
pass over the sorted codes adds up run lengths. Then the odds ratio with a continuity correction of
one half, and the lift, follow from the counts of the single items.

Pairs below ``min_count`` are not wanted, so items below ``min_count`` cannot be in one: they are
left out of the codes beforehand where the list of the other items is small enough for every task
(its size is checked); else all codes are made. Both ways give the same rows.

A record of more than ``LONG`` items is cut into pieces, and each pair of pieces is a task's work of its own; its list of
items must fit into a task, its pairs need not.

An item counts once per record. NULL and empty lists are no records here; NULL items are ignored;
a record of one item makes no pair. Repeated record rows must be removed first (``session.once``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entlink.session import maybe_broadcast, stored

#: Codes in one block.
BLOCK = 2_000_000
#: Most items of a record whose pairs are made in one piece; longer ones are cut into pieces of so many.
LONG = 1_000
#: Most items that are sent to every task (4 bytes each).
PRUNE_ITEMS = 1_000_000


def _codes(values: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Codes of all pairs of every record, in blocks; ``values`` ascend within a record."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    for m in np.unique(sizes[sizes > 1]):
        m = int(m)
        rows = np.flatnonzero(sizes == m)
        a, b = np.triu_indices(m, 1)
        step = max(1, BLOCK // len(a))
        for k in range(0, len(rows), step):
            items = values[starts[rows[k : k + step], None] + np.arange(m)]
            yield ((items[:, a] << 32) | (items[:, b] & 0xFFFFFFFF)).ravel()


def _across(low: np.ndarray, high: np.ndarray) -> Iterator[np.ndarray]:
    """Codes of all pairs of an item of one piece with an item of a later piece of the same record."""
    if len(low) and len(high):
        step = max(1, BLOCK // len(high))
        for k in range(0, len(low), step):
            yield ((low[k : k + step, None] << 32) | (high[None, :] & 0xFFFFFFFF)).ravel()


def _pieces(lists: DataFrame) -> DataFrame:
    """(l, m): short records with m NULL; of long ones every piece, with m NULL, and every pair of pieces."""
    short = lists.where(F.size("l") <= LONG).select("l", F.lit(None).cast("array<bigint>").alias("m"))
    long = lists.where(F.size("l") > LONG).withColumn("k", F.ceil(F.size("l") / LONG).cast("int"))
    both = F.expr("flatten(transform(sequence(0, k - 1), i -> transform(sequence(i, k - 1), j -> struct(i, j))))")
    cut = lambda at: F.slice("l", F.col(at) * LONG + 1, F.lit(LONG))
    pairs = long.select("l", F.explode(both).alias("p")).select("l", F.col("p.i").alias("i"), F.col("p.j").alias("j"))
    spread = pairs.select(cut("i").alias("l"), F.when(F.col("i") < F.col("j"), cut("j")).alias("m")).repartition(F.xxhash64("l", "m"))
    return short.unionByName(spread)


def _runs(code: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Run-length count of ascending codes."""
    new = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    if count is None:
        return code[new], np.diff(new, append=len(code))
    return code[new], np.add.reduceat(count, new)


def pair_counts(lists: DataFrame, keep: np.ndarray | None) -> DataFrame:
    """(src_a, src_b, n_ab) with src_a < src_b of every pair of ``keep`` (None: of all items); ``lists``(l) hold distinct items, ascending."""
    wanted = None if keep is None else lists.sparkSession.sparkContext.broadcast(np.sort(keep))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def run() -> pa.RecordBatch:
            code, count = _runs(np.sort(np.concatenate(held)))
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(count.astype(np.int64))], names=["code", "n"])

        def kept(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            values = column.flatten().to_numpy()
            sizes = column.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            if wanted is not None:
                pool = wanted.value
                at = np.minimum(np.searchsorted(pool, values), max(0, len(pool) - 1))
                ok = pool[at] == values if len(pool) else np.zeros(len(values), bool)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                values, sizes = values[ok], np.bincount(owner[ok], minlength=len(sizes))
            return values, sizes

        def blocks(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            values, sizes = kept(batch.column(0))
            second, others = kept(batch.column(1))
            own = np.asarray(batch.column(1).is_null())
            yield from _codes(values[np.repeat(own, sizes)], sizes[own])
            low, high = np.cumsum(sizes) - sizes, np.cumsum(others) - others
            for k in np.flatnonzero(~own):
                yield from _across(values[low[k] : low[k] + sizes[k]], second[high[k] : high[k] + others[k]])

        for batch in batches:
            for block in blocks(batch):
                held.append(block)
                n += len(block)
                if n >= BLOCK:
                    yield run()
                    held, n = [], 0
        if n:
            yield run()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, count = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(code: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
            low = (code & 0xFFFFFFFF).astype(np.uint32).view(np.int32)
            return pa.RecordBatch.from_arrays([pa.array((code >> 32).astype(np.int32)), pa.array(low), pa.array(count)], names=["src_a", "src_b", "n_ab"])

        for batch in batches:
            if not batch.num_rows:
                continue
            code, count = np.concatenate((code, batch.column(0).to_numpy())), np.concatenate((count, batch.column(1).to_numpy()))
            code, count = _runs(code, count)
            if len(code) > 1:
                yield out(code[:-1], count[:-1])
            code, count = code[-1:], count[-1:]
        if len(code):
            yield out(code, count)

    runs = _pieces(lists).mapInArrow(emit, "code bigint, n bigint")
    return runs.repartition("code").sortWithinPartitions("code").mapInArrow(add_up, "src_a int, src_b int, n_ab bigint")


def cooccurrence(records: DataFrame, items: str, min_count: int = 1, min_share: float = 0.0) -> DataFrame:
    """(src_a, src_b, n_ab, n_a, n_b, n_records, lift, odds_ratio) of the pairs with n_ab >= min_count and >= min_share of the records."""
    ascending = F.array_sort(F.array_distinct(F.array_compact(F.col(items)))).cast("array<bigint>")
    lists = stored(records.where(F.size(items) > 0).select(ascending.alias("l")).where("size(l) > 0"))
    n = lists.count()
    least = max(min_count, min_share * n, 1)
    single = lists.select(F.explode("l").alias("item")).groupBy("item").agg(F.count("*").alias("n_item")).where(F.col("n_item") >= least)
    single = stored(single)
    known = single.count() if least > 1 else PRUNE_ITEMS + 1
    keep = None
    if known <= PRUNE_ITEMS:
        keep = single.select("item").toPandas()["item"].to_numpy(np.int64)  # at most PRUNE_ITEMS ids
    pairs = pair_counts(lists.where("size(l) > 1"), keep).where(F.col("n_ab") >= least)
    a = maybe_broadcast(single.select(F.col("item").cast("int").alias("src_a"), F.col("n_item").alias("n_a")), known)
    b = maybe_broadcast(single.select(F.col("item").cast("int").alias("src_b"), F.col("n_item").alias("n_b")), known)
    n11, total = F.col("n_ab"), F.lit(n)
    n10, n01 = F.col("n_a") - n11, F.col("n_b") - n11
    lift = n11.cast("double") * total / (F.col("n_a").cast("double") * F.col("n_b"))  # 64-bit products are too small for billions of records
    odds = (n11 + 0.5) * (total - n11 - n10 - n01 + 0.5) / ((n10 + 0.5) * (n01 + 0.5))
    return (
        pairs.join(a, "src_a").join(b, "src_b")
        .select("src_a", "src_b", "n_ab", "n_a", "n_b", total.cast("bigint").alias("n_records"), lift.alias("lift"), odds.alias("odds_ratio"))
    )
