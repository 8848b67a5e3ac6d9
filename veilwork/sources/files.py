"""JSON lines in and out: decisions, gold spans, block manifests, review queues and audit logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks as K
from ..functions.constants import ACTIONS
from ..operators import policy

DECISIONS = "record_id string, source_hash string, action string, new_type string, new_start_offset int, new_end_offset int, identity_id string, note string"
GOLD = "pii_type string, document_part string, block_id string, start_offset int, end_offset int, source_kind string, media_name string, bounding_box array<int>"
MANIFEST = "source_hash string, document_part string, block_id string, text string, annotations array<string>, review_status string"


def _hadoop(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def present(spark: SparkSession, path: str) -> bool:
    """Whether a path exists and holds any byte."""
    at, system = _hadoop(spark, path)
    return system.exists(at) and system.getContentSummary(at).getLength() > 0


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a JSON lines file or folder with `line`, their order; no rows where it is missing.

    Blank lines are skipped, unknown fields too; a line that is no JSON stops the query.
    """
    if not present(spark, path):
        return spark.createDataFrame([], schema + ", line struct<file:string,at:bigint,n:bigint>")
    rows = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n")).alias("line"))
    rows = rows.where(F.trim("value") != "").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x"), "line")
    return rows.select("x.*", "line")


def decisions(spark: SparkSession, path: str, source_hash: str | None = None) -> DataFrame:
    """Checked review decisions, the last of each record."""
    return policy.latest(policy.checked(read_jsonl(spark, path, DECISIONS), source_hash))


def gold(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, GOLD).drop("line")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, MANIFEST).drop("line")


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object in a line, nulls and characters beyond ASCII kept; a folder of parts, written by all tasks."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def private(records: DataFrame) -> DataFrame:
    """Records whole, as JSON: originals, evidence and places. For private folders alone."""
    return records.select("record_id", F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("json"))


def fingerprint(seed: bytes) -> Column:
    return F.substring(K.hmac(seed, F.concat_ws("|", "pii_type", "normalized_text")), 1, 20)


def sanitized(records: DataFrame, seed: bytes) -> DataFrame:
    """Records without originals: a keyed fingerprint stands for them, and evidence keeps its sources."""
    return records.select("record_id", "pii_type", "document_part", "block_id", "start_offset", "end_offset", "final_confidence", "review_status", "policy_action", "identity_id", "replacement_value", F.transform("evidence", lambda x: x["source"]).alias("sources"), fingerprint(seed).alias("original_fingerprint"))


def write_audit_logs(records: DataFrame, private_path: str, sanitized_path: str, seed: bytes) -> None:
    write_jsonl(records, private_path)
    write_jsonl(sanitized(records, seed), sanitized_path)


def queue(records: DataFrame, source_hash: str) -> DataFrame:
    """Records that wait for a decision, with the source they belong to and the actions that may be taken."""
    return records.where("policy_action = 'REVIEW'").withColumns({"source_hash": F.lit(source_hash), "allowed_actions": F.array(*[F.lit(a) for a in sorted(ACTIONS)])})


def mapping(records: DataFrame) -> DataFrame:
    return records.select("record_id", "pii_type", F.col("original_text").alias("original"), F.col("replacement_value").alias("replacement"), "identity_id")


def write_manifest(blocks: DataFrame, source_hash: str, path: str) -> bool:
    """Blocks to be annotated, written only where nothing stands yet; whether they were."""
    if present(blocks.sparkSession, path):
        return False
    write_jsonl(blocks.select(F.lit(source_hash).alias("source_hash"), "document_part", "block_id", "text", F.array().cast("array<string>").alias("annotations"), F.lit("UNREVIEWED").alias("review_status")), path)
    return True


def write_decisions(old: DataFrame, new: DataFrame, source_hash: str, path: str) -> None:
    """old overruled by new, by record id; old is read before it is overwritten, so they may share a path only if old is cached or stored."""
    write_jsonl(policy.upserted(old, new, source_hash).drop("line").orderBy("record_id"), path)
