"""Text blocks from tables, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import BENCHMARK, SAMPLES
from ..functions.spans import CLOSE, OPEN

#: bytes of a table for each core, by its statistics, up to which it is dealt anew
SHARE = 32 << 20


def from_table(df: DataFrame, key: str = "doc_id", text: str = "text", part: str = "text") -> DataFrame:
    """One block for each line that is not blank: document_part, block_id, paragraph_index, text. Gaps in the index stay."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= cores * SHARE:  # a small table's few files are dealt to all cores
        df = df.select(key, text).repartition(cores)
    lines = F.split(F.translate(F.col(text), OPEN + CLOSE, ""), "\n", -1)
    return df.select(F.lit(part).alias("document_part"), F.col(key).cast("string").alias("document"), F.posexplode(lines).alias("paragraph_index", "text")).where(F.trim("text") != "").select("document_part", "document", F.concat("document", F.lit("#p"), F.col("paragraph_index")).alias("block_id"), "paragraph_index", "text")


def fixtures(spark: SparkSession, samples: bool = True) -> DataFrame:
    """The blocks of the controlled benchmark, and samples of the types that tables lack."""
    rows = [("benchmark", "benchmark", f"benchmark#p{k}", k, b[0]) for k, b in enumerate(BENCHMARK, 1)]
    if samples:
        rows += [("samples", "samples", f"samples#p{k}", k, t) for k, t in enumerate(SAMPLES, 1)]
    return spark.createDataFrame(rows, "document_part string, document string, block_id string, paragraph_index int, text string")


def reassembled(blocks: DataFrame) -> DataFrame:
    """The blocks of each document joined by line ends, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("paragraph_index", "text")))
    return blocks.groupBy("document").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))
