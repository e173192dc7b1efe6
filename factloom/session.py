"""A session with the settings the engine wants; existing sessions are used as they are."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "factloom", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()


_MADE: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder of this program in the one that driver and executors share (spark.checkpoint.dir).

    Only in local mode a temporary one is used when the setting is missing.  The program's
    folder is removed when it ends.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_factloom_shared", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = spark._factloom_shared = "file://" + tempfile.mkdtemp(prefix="factloom-")
    top = f"{at.rstrip('/')}/engine-{spark.sparkContext.applicationId}"
    if top not in _MADE:
        _MADE[top] = spark
        atexit.register(_end, top)
    return top


def _end(top: str) -> None:
    try:
        remove(_MADE.pop(top), top)
    except Exception:  # the session has ended; its folder goes with the checkpoint folder
        return


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path in the file system of the machines (one that driver and executors share), None for any other store."""
    fs, p = _fs(spark, path)
    return p.toUri().getPath() if fs.getUri().getScheme() == "file" else None


def empty_files(spark: SparkSession, folder: str) -> list[str]:
    """The files without content of a folder, from its listing, which passes over folders by itself."""
    fs, p = _fs(spark, folder)
    files, out = fs.listFiles(p, False), []
    while files.hasNext():
        f = files.next()
        if f.getLen() == 0 and not f.getPath().getName().startswith(("_", ".")):
            out.append(f.getPath().toString())
    return out


def write_file(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file in any store that Spark writes."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def read_file(spark: SparkSession, path: str) -> bytes:
    """A small file of any store that Spark reads."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: what is made once is used several times."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: str, name: str = "id") -> DataFrame:
    """Adds a dense number from 0 in the given order, which must be total.

    Rows are sorted by range; numbers run within each range, and the sums of the ranges before are added.
    """
    rows = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a range
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return rows.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + within - 1).cast("long")).drop("_part", "_before")
