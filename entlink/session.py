"""Session helpers shared by all operators: table access, record identity, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Frames of at most this many rows may be broadcast once their row count is known.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` in at least as many partitions as there are cores: a small table of one file is parted by ``key``, any other stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def mention_key(c: Column | str) -> Column:
    """Lower case, each run of blank, tab or no-break space as one blank, none at either end."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.lower(c), "[ \\t\\u00A0]+", " "))


def once(df: DataFrame, key: str) -> DataFrame:
    """Every record one time: rows that repeat ``key`` are repeated deliveries of one record.

    Rows with a NULL key cannot be told to be deliveries of the same record, so they are only
    merged when all their columns are equal. Select the columns you need before calling this:
    one shuffle on the key carries exactly those.
    """
    rest = [c for c in df.columns if c != key]
    if not any(_has_map(df.schema[c].dataType) for c in rest) and rest:
        same = F.when(F.col(key).isNull(), F.xxhash64(*rest)).otherwise(F.lit(0))
    elif rest:
        same = F.when(F.col(key).isNull(), F.xxhash64(*[_hashable(df.schema[c]) for c in rest])).otherwise(F.lit(0))
    else:
        return df.dropDuplicates([key])
    tag = "__same"
    while tag in df.columns:
        tag += "_"
    return df.withColumn(tag, same).dropDuplicates([key, tag]).drop(tag)


def _has_map(t: T.DataType) -> bool:
    return "map<" in t.simpleString()


def _hashable(field: T.StructField) -> Column:
    return F.to_json(F.col(field.name)) if _has_map(field.dataType) else F.col(field.name)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset (tests on one machine) a temporary folder is used.
    """
    sc = spark.sparkContext
    where = sc._jsc.sc().getCheckpointDir()
    if where.isDefined():
        return where.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="entlink-checkpoint-")
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_stored: dict[str, list] = {}


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back: no lineage, known size, columns and filters pushed down.

    The file goes with the driver's JVM, or before with :func:`release`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)
    _stored.setdefault(sc.applicationId, []).append(at)
    return spark.read.parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes every stored frame of the session; frames that read them cannot be used after it."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for at in _stored.pop(spark.sparkContext.applicationId, []):
        at.getFileSystem(conf).delete(at, True)


def renewed(df: DataFrame) -> DataFrame:
    """``df`` with columns of a new identity, to be combined with another frame of the same origin."""
    return df.select([F.col(c).alias(c) for c in df.columns])


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has few rows; otherwise Spark joins by shuffling."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def env_path(name: str, default: str) -> str:
    """A path parameter from the environment."""
    return os.environ.get(name, default)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of the session's executors."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="entlink-code-")) / "entlink.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
