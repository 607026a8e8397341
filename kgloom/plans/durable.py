"""Where intermediate results go when lineage is cut.

Everything that has to outlive an executor is written below the folder that
``spark.checkpoint.dir`` names; a folder of our own is made only when the
setting is absent, as in local tests.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, also set as the checkpoint folder.

    Without the setting a folder is made on this machine, which only serves a
    local master; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if not sc.getCheckpointDir():
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="kgloom-"))
    return sc.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df``: same rows, no lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back with its own schema."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


PART_BYTES = 1 << 20
_UNKNOWN = 1 << 55


def parts(df: DataFrame, part_bytes: int = PART_BYTES) -> int:
    """How many parts of so many bytes the files have that ``df`` reads; 0 where that isn't known."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return -(-size // part_bytes) if size < _UNKNOWN else 0


def more_parts(df: DataFrame, part_bytes: int = PART_BYTES, most: int | None = None) -> int | None:
    """The number of ``parts`` where it is more than the session's shuffle partitions, else None.

    ``most`` bounds it up to eight times that volume: with 200 at most a
    shuffle's writer holds no rows.
    """
    n = parts(df, part_bytes)
    if most:
        n = max(min(n, most), n // 8)
    return n if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def by_key(df: DataFrame, *keys: str | Column, part_bytes: int = PART_BYTES, most: int | None = None) -> DataFrame:
    """``df`` with equal keys together, in a part for each MB of its files; as it is where the session has as many partitions.

    So what a task holds doesn't grow with the table, whatever that number.
    """
    n = more_parts(df, part_bytes, most)
    return df.repartition(n, *keys) if n else df


BROADCAST_ROWS = 4_000_000


def without(df: DataFrame, key: Column, gone: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` without the rows whose ``key`` is in the one column of ``gone``.

    ``gone`` is checkpointed and counted: up to ``broadcast_rows`` ids (8 bytes
    each) it is broadcast, so that ``df`` doesn't move; beyond, both sides are
    shuffled by the id. Rows with a null key stay.
    """
    gone = cut(gone.toDF("_gone"))
    if gone.count() <= broadcast_rows:
        gone = F.broadcast(gone)
    return df.join(gone, key == F.col("_gone"), "left_anti")
