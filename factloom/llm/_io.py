"""Shared storage for intermediate tables, and bounded id filters."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    In local mode without that setting a temporary folder is set; a cluster
    without it is an error, as a machine's own folder is invisible to the others.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = getattr(spark, "_factloom_dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.sparkContext.setCheckpointDir(at)
        spark._factloom_dir = at
    top = f"{at.rstrip('/')}/factloom-{spark.sparkContext.applicationId}"
    if top not in _MADE:
        _MADE[top] = spark
        atexit.register(_remove, top)
    return top


def _remove(top: str) -> None:
    spark = _MADE.pop(top, None)
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended; its folder goes with the checkpoint folder
        return


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to shared storage and read it back: lineage ends here."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores behind it until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def one_each(rows: DataFrame, repeated: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with one row of each of the ``repeated`` keys; only those rows are shuffled whole."""
    single = rows.join(repeated, keys, "left_anti")
    return single.unionByName(rows.join(repeated, keys, "left_semi").dropDuplicates(keys))


SEGMENTS = 8


def bits_for(keys: int) -> int:
    """Bits of a bitmap for so many keys: sixteen each, 1 to 64 MB in all."""
    return min(1 << 29, max(1 << 23, 1 << (16 * keys).bit_length()))


class IdFilter:
    """Membership of 64-bit keys in a bitmap of fixed size, without false negatives.

    The bitmap has ``bits`` bits (see ``bits_for``), so broadcasting it is bounded.  A full
    bitmap only lets more rows through; callers stay exact.
    """

    def __init__(self, keys: DataFrame, column: str, bits: int | None = None):
        spark, bits = keys.sparkSession, bits or bits_for(keys.count())
        each = bits // SEGMENTS
        h = F.xxhash64(column)
        marks = keys.select(F.pmod(h, F.lit(SEGMENTS)).cast("int").alias("seg"), F.pmod(F.shiftrightunsigned(h, 6), F.lit(each)).cast("int").alias("pos"))

        def fill(batches):
            held: dict[int, np.ndarray] = {}
            for b in batches:
                seg, pos = b.column(0).to_numpy(), b.column(1).to_numpy()
                for s in np.unique(seg).tolist():
                    held.setdefault(s, np.zeros(each, dtype=bool))[pos[seg == s]] = True
            for s, bit in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(bit).tobytes()], pa.binary())], names=["seg", "bits"])

        rows = marks.groupBy("seg", "pos").agg(F.lit(1)).select("seg", "pos").repartition(SEGMENTS, "seg").mapInArrow(fill, "seg int, bits binary").collect()
        whole = np.zeros((SEGMENTS, each // 8), dtype=np.uint8)
        for r in rows:
            whole[r["seg"]] = np.frombuffer(r["bits"], dtype=np.uint8)
        self.each, self.shared = each, spark.sparkContext.broadcast(whole.tobytes())

    def test(self, hashes: np.ndarray) -> np.ndarray:
        """hashes: Spark's xxhash64 of the keys, as int64."""
        bits = np.frombuffer(self.shared.value, dtype=np.uint8)
        h = hashes.astype(np.int64)
        seg = h % SEGMENTS
        pos = (h.view(np.uint64) >> np.uint64(6)).view(np.int64) % self.each
        at = seg * (self.each // 8) + (pos >> 3)
        return (bits[at] >> (7 - (pos & 7)).astype(np.uint8)) & 1 > 0
