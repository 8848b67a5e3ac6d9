"""Detection on a stream: stateless, as all of a block's spans are found and resolved in its own row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import policy, resolve
from ..plans import engine


def stream_records(documents: DataFrame, key: str = "doc_id", text: str = "text", company_scope: str = "protect") -> DataFrame:
    """Records with their policy for a stream (or table) of documents; identities and first-wins replacements need the whole corpus."""
    lines = documents.select(F.lit("text").alias("document_part"), F.col(key).cast("string").alias("document"), F.posexplode(F.split(text, "\n", -1)).alias("paragraph_index", "text"))
    blocks = lines.where(F.trim("text") != "").withColumn("block_id", F.concat("document", F.lit("#p"), F.col("paragraph_index")))
    return policy.with_policy(resolve.records(engine.spans(blocks)), company_scope)


def write_records(documents: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the records of everything that has come to Parquet, once; a restart goes on from the checkpoint."""
    rows = stream_records(documents)
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
