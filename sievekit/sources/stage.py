"""S8 checkpoint_stage: persist a stage's output and continue from it.

The stage is written as parquet into the shared checkpoint folder
(``spark.checkpoint.dir``), which cuts the lineage: a lost executor later
re-reads the files instead of re-running the scans and shuffles before it.
With ``key`` the table is bucketed on it, so the re-read scan reports
HashPartitioning(key, buckets) and every later aggregate or join on that key
runs without an exchange (plain ``checkpoint()`` loses the partitioning under
AQE).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import shared_path


def path_exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def move_file_into(spark, folder: str, to: str, name: str) -> None:
    """Moves the one part file of ``folder`` to ``to/name`` in one step."""
    new = spark._jvm.org.apache.hadoop.fs.Path
    fs = new(to).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(new(to))
    part = next(f.getPath() for f in fs.listStatus(new(folder)) if f.getPath().getName().startswith("part-"))
    if not fs.rename(part, new(f"{to}/{name}")):
        raise RuntimeError(f"{to}/{name} could not be written")


def drop_path(spark, path: str) -> None:
    """Deletes a written stage whose readers are done."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def checkpoint_stage(df: DataFrame, name: str = "stage", key: str | None = None,
                     buckets: int | None = None, prepartitioned: bool = False) -> DataFrame:
    """``prepartitioned``: ``df`` is already hash-partitioned by ``key`` into
    ``buckets`` partitions (e.g. the output of a join on it), so each task
    holds one bucket and no extra shuffle is added before the write."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex[:10]}"
    path = shared_path(spark, table)
    if key is None:
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one shuffle by key (unless already done): each task writes one bucket
    src = df if prepartitioned else df.repartition(n, key)
    src.write.mode("overwrite").bucketBy(n, key).option("path", path).saveAsTable(table)
    return spark.table(table)
