"""Problem 4: the most frequent items of a column with bounded memory.

Pass 1: every partition keeps a space-saving summary of at most ``counters`` items. An Arrow batch
is counted exactly and folded in: an item new to the summary takes the summary's floor as its
error, and of too many items those of the largest counts stay; the largest count that was dropped
becomes the floor. So for every item, kept or not, true weight <= count and
true weight >= count - error, and the floor is at most weight / counters. The
summaries are merged in a tree, where an item missing on one side takes that side's floor.
The total is added up beside them. Pass 2 counts the surviving candidates, at most ``counters``, exactly.

NULL items are no items but count in the total; NULL and negative weights are zero. Ties at the cut
of a summary are broken by the item's text; they do not matter for items above the threshold while
``counters`` > 1 / threshold. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entlink.session import BROADCAST_ROWS, stored

_SUMMARY = "node bigint, item string, count bigint, error bigint, floor bigint, total bigint"


def _cut(summary: pd.DataFrame, floor: int, counters: int) -> tuple[pd.DataFrame, int]:
    if len(summary) <= counters:
        return summary, floor
    summary = summary.sort_values(["count", "item"], ascending=[False, True], kind="stable")
    return summary.iloc[:counters], max(floor, int(summary["count"].iloc[counters]))


def merge(a: pd.DataFrame, floor_a: int, b: pd.DataFrame, floor_b: int, counters: int) -> tuple[pd.DataFrame, int]:
    """Two summaries (item, count, error) as one that bounds the sum of both streams."""
    if not len(a) and not floor_a:
        return _cut(b, floor_b, counters)
    if not len(b) and not floor_b:
        return _cut(a, floor_a, counters)
    both = a.merge(b, on="item", how="outer", suffixes=("_a", "_b"))
    out = pd.DataFrame(
        {
            "item": both["item"],
            "count": (both["count_a"].fillna(floor_a) + both["count_b"].fillna(floor_b)).astype("int64"),
            "error": (both["error_a"].fillna(floor_a) + both["error_b"].fillna(floor_b)).astype("int64"),
        }
    )
    return _cut(out, floor_a + floor_b, counters)


def _rows(node: int, summary: pd.DataFrame, floor: int, total: int) -> pd.DataFrame:
    out = pd.DataFrame({"node": node, "item": summary["item"], "count": summary["count"], "error": summary["error"]})
    mark = pd.DataFrame({"node": [node], "item": [None], "count": [0], "error": [0]})
    out = pd.concat([mark, out], ignore_index=True) if len(out) else mark
    return out.assign(floor=floor, total=[total] + [0] * (len(out) - 1))


_EMPTY = pd.DataFrame({"item": pd.Series([], dtype=object), "count": pd.Series([], dtype="int64"), "error": pd.Series([], dtype="int64")})


def space_saving(rows: DataFrame, item: str, weight: str | None, counters: int) -> DataFrame:
    """(item, count, error, floor, total): one summary of the whole column; the row with a NULL item bears the totals.

    ``total`` on that row is the weight of all rows, NULL items included. At most counters + 1 rows.
    """
    w = F.lit(1) if weight is None else F.greatest(F.coalesce(F.col(weight), F.lit(0)), F.lit(0))
    rows = rows.select(F.col(item).cast("string").alias("item"), w.cast("bigint").alias("weight"), F.spark_partition_id().alias("node"))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary, floor, total, node = _EMPTY, 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(2)[0].as_py()
            exact = pa.Table.from_batches([batch]).group_by("item").aggregate([("weight", "sum")]).to_pandas()
            exact = exact.rename(columns={"weight_sum": "count"})
            total += int(exact["count"].sum())
            exact = exact[exact["item"].notna() & (exact["count"] > 0)][["item", "count"]].assign(error=0)
            summary, floor = merge(summary, floor, exact, 0, counters)
        if total:
            yield pa.RecordBatch.from_pandas(_rows(node, summary, floor, total), schema=schema, preserve_index=False)

    schema = pa.schema([("node", pa.int64()), ("item", pa.string()), ("count", pa.int64()), ("error", pa.int64()), ("floor", pa.int64()), ("total", pa.int64())])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        summary, floor, total = _EMPTY, 0, 0
        for _, part in pdf.groupby("node", sort=True):
            total += int(part["total"].sum())
            items = part[part["item"].notna()][["item", "count", "error"]]
            summary, floor = merge(summary, floor, items, int(part["floor"].iloc[0]), counters)
        return _rows(int(pdf["parent"].iloc[0]), summary, floor, total)

    level = rows.mapInArrow(summarise, _SUMMARY)
    for fan in (1024, 32, 1):
        level = level.withColumn("parent", F.pmod("node", F.lit(fan))).groupBy("parent").applyInPandas(fold, _SUMMARY)
    return level.drop("node")


def frequent_items(rows: DataFrame, item: str, weight: str | None, share: float, counters: int | None = None) -> DataFrame:
    """(item, weight, count, error, total) of the items with at least ``share`` of all weight.

    ``weight`` is exact from the second pass; ``count`` and ``error`` are those of the summary, which is made once and stored.
    ``rows`` is read twice, so hand over a frame that is cheap to read. Up to ``BROADCAST_ROWS`` candidates (counted) go to
    every task; more are joined to rows that were added up by item before, so no hot item gathers.
    """
    counters = counters or max(1000, int(10 / share))
    summary = stored(space_saving(rows, item, weight, counters))
    mark = summary.where("item is null").head()
    total = F.lit(mark["total"] if mark else 0).cast("bigint")  # the summary adds up all weight exactly
    candidates = summary.where("item is not null").select(F.col("item").alias("candidate"), "count", "error")
    w = F.lit(1) if weight is None else F.greatest(F.coalesce(F.col(weight), F.lit(0)), F.lit(0))
    rows = rows.select(F.col(item).cast("string").alias("item"), w.cast("bigint").alias("weight"))
    if candidates.count() <= BROADCAST_ROWS:
        candidates = F.broadcast(candidates)
    else:
        rows = rows.groupBy("item").agg(F.sum("weight").alias("weight"))
    exact = (
        rows.join(candidates, F.col("item") == F.col("candidate"))
        .groupBy("candidate")
        .agg(F.sum("weight").alias("weight"), F.max("count").alias("count"), F.max("error").alias("error"))
    )
    heavy = exact.withColumn("total", total).where((F.col("weight") > 0) & (F.col("weight") >= F.lit(share) * F.col("total")))
    return heavy.select(F.col("candidate").alias("item"), "weight", "count", "error", "total")
