"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]
_SHIPPED: set[str] = set()
#: settings that hold whole texts by the thousand at once: Spark's default, and ours, set where the default still holds
BATCHES = {
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m"),
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "4096"),
    "spark.sql.parquet.columnarReaderBatchSize": ("4096", "1024"),
}
#: bytes of a row group of stored rows, which the writer holds in memory
ROW_GROUP = 16 << 20
#: numbers of 64 bits in the sieve of sifted()
SLOTS = 1 << 18


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever these run, and keep batches of long texts small.

    The code goes to the executors as a zip, once for each application, whatever the driver's PYTHONPATH says.
    """
    for name, (default, ours) in BATCHES.items():
        if spark.conf.get(name) == default:
            spark.conf.set(name, ours)
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="veilwork_")  # the driver serves the file from here until it ends
    atexit.register(shutil.rmtree, folder, True)
    target = Path(folder) / "veilwork_src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((ROOT / "veilwork").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    before = list(sys.path)
    sc.addPyFile(str(target))
    sys.path[:] = before
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the shared checkpoint folder that the session names.

    Where none is named, a local master takes a temporary folder, as driver and executors are one process there; any
    other master raises, since its executors would not see a folder of the driver's machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            base = known.get()
        elif spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            base = tempfile.mkdtemp(prefix="veilwork_ck_")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends, and lost executors cost no recomputation.

    The folder is deleted when the session's JVM ends, as the lazy result that reads it may be run at any time before.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sifted(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in column `key` of ids, rows whose key is not there): keeps long rows out of a shuffle.

    The sieve is a table of at most SLOTS numbers of 64 bits, one bit for each hash, which is broadcast; its size does not
    grow with ids. If they are many, more rows pass as possible, in the end all; none that is there is ever missed.
    """
    h = F.xxhash64(key)
    slot, bit = F.pmod(h, F.lit(SLOTS)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(64)).cast("int")
    bits = ids.select(slot.alias("_slot"), bit.alias("_bit")).groupBy("_slot").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    marked = df.withColumns({"_own": slot, "_at": bit}).join(F.broadcast(stored(bits)), F.col("_own") == F.col("_slot"), "left")
    maybe = F.coalesce(F.bit_get("_bits", F.col("_at")) == 1, F.lit(False))
    return marked.where(maybe).select(*df.columns), marked.where(~maybe).select(*df.columns)


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not in ids, null ones included; only those that may be there are shuffled."""
    maybe, never = sifted(df, ids, key)
    return never.unionByName(maybe.join(ids.select(key).distinct(), key, "left_anti").select(*df.columns))
