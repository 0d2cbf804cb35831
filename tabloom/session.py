"""Session settings, table access, the shared scratch folder and checked broadcasts."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

BROADCAST_ROWS = 200_000


def local_session(cpus: int = 8, partitions: int | None = None, memory: str = "12g") -> SparkSession:
    """Session for tests and the bench; a cluster job brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tabloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on: UTC, and parquet timestamps read as instants."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        path = tempfile.mkdtemp(prefix="tabloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, label: str) -> str:
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    This cuts the lineage, so a lost executor costs a re-read only; and unlike an RDD checkpoint the
    copy is columnar: later readers get column pruning, filter pushdown and true sizes.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Like :func:`materialize`, in one file for each of ``buckets`` hashes of ``key``: what groups or joins by the key reads it without a shuffle."""
    spark = df.sparkSession
    path, name = scratch_path(spark, "table"), f"tabloom_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.scratch, out.listed = path, name
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that :func:`materialize` wrote; what reads them must have been written itself.

    The driver is asked to collect garbage, too: shuffle files of finished jobs stay on the executors' disks until their plans are.
    """
    tables = [t for t in tables if isinstance(t, DataFrame)]
    paths = [t.scratch for t in tables if "scratch" in vars(t)]
    if paths:
        spark = tables[0].sparkSession
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for name in [t.listed for t in tables if "listed" in vars(t)]:
            spark.sql(f"drop table if exists {name}")
        for path in paths:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        gc.collect()
        jvm.System.gc()


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the data, so that the join is a shuffle.

    Spark broadcasts by the compressed size of files and shuffles; the rows take many times that in the driver's memory.
    """
    return df.hint("merge")


def dealt(df: DataFrame, rows: int, *cols: str, rows_per_task: int = 250_000) -> DataFrame:
    """``df``, about ``rows`` rows, dealt by ``cols`` to as many tasks as hold ``rows_per_task`` rows each, so that more rows are more tasks and not larger ones.

    Spark sizes tasks by compressed bytes; rows that compress well take many times that in a task's memory.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // rows_per_task)), *cols)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint if, and only if, a count proves that ``df`` has at most ``max_rows`` rows.

    Beyond that the join is left to Catalyst and AQE (sort-merge with skew handling).
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
