"""Problem 5: how often every distinct term occurs, and in how many records, by heavy-light aggregation.

Heavy terms (those that may hold at least ``heavy_share`` of all rows) are found with a space-saving
summary, so there are at most 2 / ``heavy_share`` of them. Their codes go to every task, which adds them
up exactly in local counter arrays, one slot per term and record; only the filled slots are
shuffled. All other terms are shuffled once on the term itself: none of them can be large enough to
hold a task up. The two count tables are disjoint and are put together by a union.

NULL terms are dropped, NULL weights are zero, a NULL record is no record. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entlink.llm.frequent import space_saving
from entlink.session import stored

#: Filled counter slots a task keeps before it passes them on.
SLOTS = 500_000


def heavy_terms(rows: DataFrame, term: str, heavy_share: float) -> list[str]:
    """At most 2 / heavy_share terms that hold all terms of at least ``heavy_share`` of the rows."""
    summary = stored(space_saving(rows, term, None, max(2, round(2 / heavy_share))))
    mark = summary.where("item is null").head()
    least = heavy_share * (mark["total"] if mark else 0)
    return sorted(r["item"] for r in summary.where(F.col("item").isNotNull() & (F.col("count") >= least)).select("item").collect())  # bounded: see above


def term_counts(rows: DataFrame, term: str, record: str, weights: list[str], heavy_share: float | None = None) -> DataFrame:
    """(term, <weights summed>, n_records) of every distinct term; n_records counts distinct values of ``record``.

    ``heavy_share`` is by default a quarter of a shuffle partition's share, so a term that is not heavy cannot
    hold up a task at any number of partitions. ``rows`` is read three times; hand over a frame that is cheap to read.
    """
    heavy_share = heavy_share or 1 / (4 * max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    kind = rows.schema[record].dataType.simpleString()
    if kind not in ("int", "bigint"):
        raise TypeError("the record column must be INT or BIGINT")
    names = [f"w{k}" for k in range(len(weights))]
    rows = rows.select(
        F.col(term).alias("term"),
        F.col(record).cast("bigint").alias("rec"),
        *[F.coalesce(F.col(w), F.lit(0)).cast("bigint").alias(n) for w, n in zip(weights, names)],
    ).where("term is not null")
    heavy = heavy_terms(rows, "term", heavy_share)
    sums = [F.sum(n).alias(n) for n in names]

    def per_term(per_record: DataFrame) -> DataFrame:
        return per_record.groupBy("term").agg(*sums, F.count("rec").alias("n_records"))

    listed = F.broadcast(rows.sparkSession.createDataFrame([(t,) for t in heavy], "term string"))  # at most 2 / heavy_share terms
    light = per_term(rows.join(listed, "term", "left_anti").repartition("term").groupBy("term", "rec").agg(*sums))
    if heavy:
        spread = np.array(heavy, dtype=object)

        def count_local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = pa.array(heavy, pa.string())
            codes, records, nulls, values, filled = [], [], [], [], 0

            def reduced() -> tuple[np.ndarray, ...]:
                code, rec, null = np.concatenate(codes), np.concatenate(records), np.concatenate(nulls)
                order = np.lexsort((rec, null, code))
                code, rec, null = code[order], rec[order], null[order]
                new = np.concatenate(([True], (code[1:] != code[:-1]) | (rec[1:] != rec[:-1]) | (null[1:] != null[:-1])))
                slot = np.cumsum(new) - 1
                counters = [np.zeros(int(slot[-1]) + 1, np.int64) for _ in names]
                for k, counter in enumerate(counters):
                    np.add.at(counter, slot, np.concatenate([v[k] for v in values])[order])
                return code[new], rec[new], null[new], counters

            def batch_of(code, rec, null, counters) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [pa.array(spread[code], pa.string()), pa.array(rec, mask=null), *map(pa.array, counters)], names=["term", "rec", *names]
                )

            for batch in batches:
                code = pc.index_in(batch.column(0), value_set=known).to_numpy(zero_copy_only=False)
                rec = batch.column(1)
                codes.append(code.astype(np.int64))
                nulls.append(np.asarray(rec.is_null()))
                records.append(rec.fill_null(0).to_numpy())
                values.append([batch.column(2 + k).to_numpy() for k in range(len(names))])
                filled += len(code)
                if filled >= 2 * SLOTS:
                    code, rec, null, counters = reduced()
                    if len(code) >= SLOTS:
                        yield batch_of(code, rec, null, counters)
                        codes, records, nulls, values, filled = [], [], [], [], 0
                    else:
                        codes, records, nulls, values, filled = [code], [rec], [null], [counters], len(code)
            if filled:
                yield batch_of(*reduced())

        schema = "term string, rec bigint" + "".join(f", {n} bigint" for n in names)
        local = rows.join(listed, "term", "left_semi").mapInArrow(count_local, schema)
        light = light.unionByName(per_term(local.groupBy("term", "rec").agg(*sums)))
    return light.select(F.col("term").alias(term), *[F.col(n).alias(w) for n, w in zip(names, weights)], "n_records")


def marked(counts: DataFrame, total: str, records: DataFrame, record: str, rare_below: int, common_share: float) -> DataFrame:
    """``counts`` with ``is_rare`` (total below ``rare_below``) and ``is_common`` (in at least ``common_share`` of all records)."""
    everything = records.agg(F.count_distinct(record).alias("__all"))
    return (
        counts.crossJoin(F.broadcast(everything))  # one row
        .withColumn("is_rare", F.col(total) < rare_below)
        .withColumn("is_common", F.col("n_records") >= F.lit(common_share) * F.col("__all"))
        .drop("__all")
    )
