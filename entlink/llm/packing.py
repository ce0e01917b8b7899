"""Problem 8: filling containers of fixed capacity with items of varying length.

First-fit decreasing in randomised groups: every item goes to a group by a hash of its key and size, so groups are of
similar make-up, independent, and the same for any layout of the input; the number of groups grows with the items, the size of a group
does not. Within a group the first container with enough room is found by descending a tournament
tree over the free room of the containers, one comparison a level.

An item larger than the capacity is the only one that is cut: into full containers and one rest,
which is packed like any other item. Items of size zero or NULL go into no container. Repeated
rows are items of their own; they are counted before the shuffle and spread over the groups, ``TOGETHER`` to each. An empty table gives no container.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items in a group, about. Larger groups leave less room unused and take longer in one task.
GROUP_ITEMS = 4096
#: Most repeated rows of one key and size that go to one group together.
TOGETHER = 64


class FirstFit:
    """Containers of one capacity; a tournament tree holds the most free room below each node."""

    def __init__(self, capacity: int, items: int):
        self.leaves = 1 << max(1, math.ceil(math.log2(max(items, 2))))
        self.room = [capacity] * (2 * self.leaves)
        self.used = 0

    def place(self, size: int) -> int:
        """The first container with room for ``size``."""
        room, k = self.room, 1
        while k < self.leaves:
            k *= 2
            if room[k] < size:
                k += 1
        room[k] -= size
        container = k - self.leaves
        self.used = max(self.used, container + 1)
        k //= 2
        while k:
            left, right = room[2 * k], room[2 * k + 1]
            best = left if left >= right else right
            if room[k] == best:
                break
            room[k] = best
            k //= 2
        return container

    def unused(self, container: int) -> int:
        return self.room[self.leaves + container]


def pack(sizes: DataFrame, key: str, size: str, capacity: int, n_items: int, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(container_id, items, used, unused) with items = [(item, part, size)] of each container.

    ``part`` numbers the pieces of an item that was cut, 0 for all others. The shuffles carry key
    and size only. ``n_items`` is the number of items, about; it sets the number of groups.
    """
    kind = sizes.schema[key].dataType.simpleString()
    rows = sizes.select(F.col(key).alias("item"), F.col(size).cast("bigint").alias("size")).where("size > 0")
    groups = max(1, math.ceil(n_items / group_items))
    rows = rows.groupBy("item", "size").agg(F.count("*").alias("n"))
    rows = rows.withColumn("again", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / TOGETHER))))
    rows = rows.withColumn("n", F.least(F.col("n") - F.col("again") * TOGETHER, F.lit(TOGETHER)))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("item", "size", "again"), F.lit(groups)))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        grp = int(pdf["grp"].iloc[0])
        pdf = pdf.sort_values(["size", "item"], ascending=[False, True], kind="stable")
        pdf = pdf.loc[pdf.index.repeat(pdf["n"])]
        full: list[tuple] = []
        pieces: list[tuple] = []
        for item, n in zip(pdf["item"].tolist(), pdf["size"].tolist()):
            item = None if item is None or item != item else item
            for part in range(n // capacity):
                full.append((item, part, capacity))
            if n % capacity:
                pieces.append((item, n // capacity, n % capacity))
        pieces.sort(key=lambda p: -p[2])
        tree = FirstFit(capacity, len(pieces))
        bins: list[list[tuple]] = []
        for piece in pieces:
            k = tree.place(piece[2])
            if k == len(bins):
                bins.append([])
            bins[k].append(piece)
        unused = [tree.unused(k) for k in range(len(bins))] + [0] * len(full)
        bins += [[piece] for piece in full]
        return pd.DataFrame(
            {
                "container_id": [(grp << 32) + k for k in range(len(bins))],
                "items": [[{"item": i, "part": p, "size": n} for i, p, n in b] for b in bins],
                "used": [capacity - u for u in unused],
                "unused": unused,
            }
        )

    out = f"container_id bigint, items array<struct<item:{kind},part:int,size:bigint>>, used bigint, unused bigint"
    return rows.groupBy("grp").applyInPandas(fill, out)
