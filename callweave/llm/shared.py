"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: A side of more bytes than this is never broadcast.
BROADCAST_BYTES = 32_000_000


def by_value(name: str) -> None:
    """Ship the functions of module ``name`` inside the task, so that executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none: beside the warehouse, or on one machine its temporary folder."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return "file:///tmp/checkpoints/callweave"
    if not spark.sparkContext.getConf().contains("spark.sql.warehouse.dir"):
        raise ValueError("set spark.checkpoint.dir to a folder that the executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut: checkpointed in the shared folder, so that a lost executor costs nothing but a reread."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))
    out = df.checkpoint(True)
    del df
    released(spark)
    return out


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what has just been cut off: it does so as the driver collects its garbage, else perhaps not for half an hour."""
    spark._jvm.System.gc()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: for wide intermediate results of which later steps read a few columns."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/callweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    LEFT.append(path)
    del df
    released(spark)
    return spark.read.schema(schema).parquet(path)


#: What :func:`written` has written in this process.
LEFT: list[str] = []


def sweep(spark: SparkSession) -> None:
    """Delete the intermediate tables of this process. For the end of a job: results that have not been stored yet still read them."""
    while LEFT:
        path = spark._jvm.org.apache.hadoop.fs.Path(LEFT.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bytes_of(df: DataFrame) -> int:
    """About how many bytes the rows of ``df`` take in a hash table, strings and arrays counted by their lengths."""
    size = F.lit(32)
    for field in df.schema.fields:
        kind = field.dataType
        if isinstance(kind, T.StringType | T.BinaryType):
            size = size + F.coalesce(F.octet_length(field.name), F.lit(0)) + 16
        elif isinstance(kind, T.ArrayType):
            size = size + 8 * F.greatest(F.size(field.name), F.lit(0)) + 32
        else:
            size = size + 8
    return df.agg(F.sum(size.cast("long"))).first()[0] or 0


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast only if its bytes are few; ``df`` must be cheap to read."""
    return F.broadcast(df) if bytes_of(df) <= BROADCAST_BYTES else df


def slices(batches: Iterable, rows: int = 256) -> Iterator:
    """Arrow batches cut into few rows each, without a copy: texts become Python objects a few at a time.

    Workers outlive their tasks, so what they no longer use goes back to the system at the end.
    """
    import ctypes

    import pyarrow as pa

    batch = None
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)
    del batch
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop the columns that an operator is about to add; its own columns win over an input's of the same name."""
    return df.drop(*[c for c in df.columns if c in set(names)])


def gapless(df: DataFrame, key: str, out: str, order: list[str], buckets: int = 256) -> DataFrame:
    """Number the rows of each ``key`` from 0 without gaps, though one key may hold most rows.

    Rows are dealt by key and a hash of ``order``; each bucket is numbered by itself and
    shifted by the rows of the buckets before it, so no task sees a whole key.
    """
    b = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = b.groupBy(F.col(key).alias("_k"), F.col("_b").alias("_kb")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_k").orderBy("_kb").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("_k", "_kb", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    own = Window.partitionBy(key, "_b").orderBy(*order)
    numbered = b.withColumn("_i", F.row_number().over(own))
    same = F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_kb"))
    return numbered.join(shifts, same, "left").withColumn(out, (F.col("_i") - 1 + F.col("_shift")).cast("long")).drop("_b", "_k", "_kb", "_i", "_shift")


by_value(__name__)
