"""Registered queries of the engine's own operators, each beside its SQL.

Blocks are the lines of `documents`; queries named `fixture_*` and `eval_*` read the fixture blocks, which hold the types
that the tables lack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles as O
from .functions import checks as K
from .functions import constants as C
from .functions import spans as S
from .operators import detect, evaluate, policy, pseudonyms, redact, resolve
from .plans import engine
from .sources import blocks as B

SEED = O.SEED
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.from_table(_table(spark, sf_dir, "documents"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_blocks(spark, sf_dir)


def _records(spark: SparkSession, sf_dir: str, scope: str = "protect") -> DataFrame:
    return engine.records(_blocks(spark, sf_dir), scope)


def _valued(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    return pseudonyms.with_value(_records(spark, sf_dir), SEED, mode)


def _run(spark: SparkSession, sf_dir: str) -> engine.Result:
    return engine.run(_blocks(spark, sf_dir), SEED)


# sources ---------------------------------------------------------------------------------------------------------


@_query(f"WITH {O.TEXT_BLOCKS} SELECT block_id, paragraph_index, text FROM text_blocks")
def blocks_from_documents(spark, sf_dir):
    return _text_blocks(spark, sf_dir).select("block_id", "paragraph_index", "text")


@_query(f"WITH {O.TEXT_BLOCKS} SELECT count(DISTINCT document) AS n_documents, count(*) AS n_blocks, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM text_blocks")
def corpus_inventory(spark, sf_dir):
    return _text_blocks(spark, sf_dir).agg(F.countDistinct("document").alias("n_documents"), F.count("*").alias("n_blocks"), F.sum(F.char_length("text")).alias("n_chars"))


@_query("SELECT doc_id, sha256(text) AS source_hash FROM documents")
def document_fingerprints(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("source_hash"))


@_query(f"WITH {O.TEXT_BLOCKS} SELECT document, string_agg(text, chr(10) ORDER BY paragraph_index) AS text FROM text_blocks GROUP BY document")
def reassemble_documents(spark, sf_dir):
    return B.reassembled(_text_blocks(spark, sf_dir))


# detection -------------------------------------------------------------------------------------------------------

_BY_NAME = dict(zip([d[0] for d in O._D], detect.RECOGNIZERS, strict=True))


def _detector(name: str) -> None:
    @_query(O.detect(name), f"detect_{name}")
    def one(spark, sf_dir):
        return detect.detections(_blocks(spark, sf_dir), [_BY_NAME[name]]).drop("det_ord")


for _name in _BY_NAME:
    _detector(_name)


@_query(O.FOUND + " SELECT * EXCLUDE (ord) FROM found")
def detect_all(spark, sf_dir):
    return detect.detections(_blocks(spark, sf_dir)).drop("det_ord")


@_query(O.FOUND + " SELECT left(sha256(block_id || '|' || pii_type || '|' || start_offset || '|' || end_offset || '|' || trim(regexp_replace(lower(value), '\\s+', ' ', 'g'))), 20) AS record_id, score AS final_confidence, recognizer FROM found")
def detect_records_projected(spark, sf_dir):
    rows = detect.detections(_blocks(spark, sf_dir))
    return rows.select(F.substring(F.sha2(F.concat_ws("|", "block_id", "pii_type", "start_offset", "end_offset", S.normalized(F.col("value"))), 256), 1, 20).alias("record_id"), F.col("score").alias("final_confidence"), "recognizer")


@_query(f"WITH {O.BLOCKS}, {O._found('runs', '[0-9]{2,}', 'true')} SELECT block_id, s AS start_offset, v AS value FROM runs WHERE {O._near(35, 35, C.NOT_A_NUMBER)}")
def context_window_filter(spark, sf_dir):
    rows = _blocks(spark, sf_dir).select("block_id", S.folded(F.col("text")).alias("low"), F.explode(S.find_all(F.col("text"), "[0-9]{2,}")).alias("x"))
    return rows.where(S.has_any(S.around(F.col("low"), F.col("x.s"), F.col("x.e"), 35, 35), C.NOT_A_NUMBER)).select("block_id", F.col("x.s").alias("start_offset"), F.col("x.v").alias("value"))


# resolution ------------------------------------------------------------------------------------------------------


def _merged(spark, sf_dir):
    rows = detect.detected(_blocks(spark, sf_dir)).select("block_id", F.explode(resolve.merged(F.col("found"))).alias("x"))
    return rows.select("block_id", "x.*")


@_query(O.MERGED + " SELECT block_id, pii_type, start_offset, end_offset, n_evidence, sources FROM merged")
def merge_evidence(spark, sf_dir):
    return _merged(spark, sf_dir).select("block_id", "pii_type", F.col("s").alias("start_offset"), F.col("e").alias("end_offset"), F.size("evidence").cast("long").alias("n_evidence"), F.array_join(F.transform("evidence", lambda x: x["source"]), ",").alias("sources"))


@_query(O.MERGED + " SELECT block_id, pii_type, start_offset, round(final_confidence, 6) AS final_confidence, review_status FROM merged")
def score_confidence(spark, sf_dir):
    return _merged(spark, sf_dir).select("block_id", "pii_type", F.col("s").alias("start_offset"), F.round("confidence", 6).alias("final_confidence"), F.col("status").alias("review_status"))


_COLUMNS = ["record_id", "document_part", "block_id", "pii_type", "start_offset", "end_offset", "original_text", "normalized_text", "review_status"]


@_query(O.RESOLVED + f" SELECT {', '.join(_COLUMNS)}, round(final_confidence, 6) AS final_confidence FROM recs")
def resolve_overlaps(spark, sf_dir):
    return _records(spark, sf_dir).select(*_COLUMNS, F.round("final_confidence", 6).alias("final_confidence"))


def _count(name: str, column: str, alias: str) -> None:
    @_query(O.LINKED + f" SELECT {column} AS {alias}, count(*) AS n FROM linked GROUP BY 1", name)
    def count(spark, sf_dir):
        return _records(spark, sf_dir).groupBy(F.col(column).alias(alias)).agg(F.count("*").alias("n"))


_count("entities_by_type", "pii_type", "pii_type")
_count("entities_by_status", "review_status", "review_status")
_count("entities_by_policy", "policy_action", "policy_action")


@_query(O.RESOLVED + " SELECT source, count(*) AS n FROM (SELECT unnest(string_split(sources, ',')) AS source FROM recs) GROUP BY 1")
def evidence_by_source(spark, sf_dir):
    return _records(spark, sf_dir).select(F.explode("evidence").alias("x")).groupBy("x.source").agg(F.count("*").alias("n"))


@_query(O.RESOLVED + " SELECT CASE WHEN final_confidence >= 0.85 THEN 'high' WHEN final_confidence >= 0.60 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM recs GROUP BY 1")
def confidence_bands(spark, sf_dir):
    band = F.when(F.col("final_confidence") >= 0.85, "high").when(F.col("final_confidence") >= 0.60, "medium").otherwise("low")
    return _records(spark, sf_dir).groupBy(band.alias("band")).agg(F.count("*").alias("n"))


_SUMMARY = {"records": "true", "redacted": "policy_action = 'REDACT'", "protected": "policy_action = 'PROTECT'", "pending": "policy_action = 'REVIEW'", "auto_approved": "review_status = 'AUTO_APPROVED'", "needs_review": "review_status = 'NEEDS_REVIEW'", "low_confidence": "review_status = 'LOW_CONFIDENCE'"}


@_query(O.LINKED + f" SELECT {', '.join(f'count(*) FILTER ({v}) AS {k}' for k, v in _SUMMARY.items())}, count(*) FILTER (policy_action = 'REVIEW') = 0 AS release_ready FROM linked")
def summary_report(spark, sf_dir):
    return _records(spark, sf_dir).agg(*[F.count_if(F.expr(v)).alias(k) for k, v in _SUMMARY.items()], (F.count_if(F.expr("policy_action = 'REVIEW'")) == 0).alias("release_ready"))


@_query(O.LINKED + " SELECT section, pii_type, metric, value FROM (SELECT 'TYPE' AS section, pii_type, policy_action AS metric, count(*) AS value FROM linked GROUP BY ALL UNION ALL SELECT 'TOTAL', 'ALL', policy_action, count(*) FROM linked GROUP BY ALL)")
def release_validation_long(spark, sf_dir):
    rows = _records(spark, sf_dir).groupingSets([["pii_type", "policy_action"], ["policy_action"]], "pii_type", "policy_action").agg(F.grouping("pii_type").alias("g"), F.count("*").alias("value"))
    return rows.select(F.when(F.col("g") == 1, "TOTAL").otherwise("TYPE").alias("section"), F.when(F.col("g") == 1, "ALL").otherwise(F.col("pii_type")).alias("pii_type"), F.col("policy_action").alias("metric"), "value")


# policy, review, identity ----------------------------------------------------------------------------------------


def _policy(scope: str) -> None:
    @_query(O.RESOLVED + f" SELECT record_id, pii_type, {O.policy(scope)} AS policy_action FROM recs", f"policy_{scope}")
    def one(spark, sf_dir):
        return _records(spark, sf_dir, scope).select("record_id", "pii_type", "policy_action")


for _scope in ("protect", "review", "redact"):
    _policy(_scope)


@_query(O.LINKED + " SELECT record_id, pii_type, identity_id FROM linked")
def identity_linking(spark, sf_dir):
    return _records(spark, sf_dir).select("record_id", "pii_type", "identity_id")


@_query(O.LINKED + " SELECT record_id FROM linked WHERE policy_action = 'REDACT'")
def redact_set(spark, sf_dir):
    return _records(spark, sf_dir).where("policy_action = 'REDACT'").select("record_id")


@_query(O.LINKED + " SELECT record_id FROM linked WHERE review_status IN ('AUTO_APPROVED', 'APPROVED')")
def approved_records(spark, sf_dir):
    return _records(spark, sf_dir).where(F.col("review_status").isin("AUTO_APPROVED", "APPROVED")).select("record_id")


@_query(O.LINKED + f" SELECT record_id, block_id, pii_type, original_text, identity_id, '{','.join(C.ACTIONS)}' AS allowed_actions FROM linked WHERE policy_action = 'REVIEW'")
def review_queue(spark, sf_dir):
    return _records(spark, sf_dir).where("policy_action = 'REVIEW'").select("record_id", "block_id", "pii_type", "original_text", "identity_id", F.lit(",".join(C.ACTIONS)).alias("allowed_actions"))


@_query(O.LINKED + " SELECT record_id, pii_type, original_text, round(final_confidence, 3) AS confidence, '' AS decision, '' AS note FROM linked WHERE pii_type IN ('EMAIL', 'IPV4', 'PHONE')")
def review_grid(spark, sf_dir):
    return _records(spark, sf_dir).where(F.col("pii_type").isin("EMAIL", "IPV4", "PHONE")).select("record_id", "pii_type", "original_text", F.round("final_confidence", 3).alias("confidence"), F.lit("").alias("decision"), F.lit("").alias("note"))


@_query(O.LINKED + f" SELECT record_id, CASE WHEN pii_type IN {O._CORP} THEN 'PROTECT' ELSE 'REDACT' END AS action FROM linked WHERE policy_action = 'REVIEW'")
def privacy_first_finalize(spark, sf_dir):
    return policy.privacy_first(_records(spark, sf_dir))


#: made-up decisions over the records: the action follows the first hex digit of the id, a second line overrules some
_ACTS = ("APPROVE", "REDACT", "PROTECT", "IGNORE", "REJECT_AS_NON_PII", "RETYPE", "CLEAR_MEDIA", "UNLINK_IDENTITY")
_DECISIONS = f"decisions AS (SELECT record_id, ([{', '.join(O.q(a) for a in _ACTS)}])[CAST('0x' || left(record_id, 1) AS INTEGER) % 8 + 1] AS action, 'PERSON' AS new_type, 1 AS line FROM recs WHERE substr(record_id, 2, 1) < '8' UNION ALL SELECT record_id, 'PROTECT', NULL, 2 FROM recs WHERE substr(record_id, 3, 1) < '4')"


def _decisions(records: DataFrame) -> DataFrame:
    first = records.where(F.substring("record_id", 2, 1) < "8").select("record_id", F.element_at(F.array(*[F.lit(a) for a in _ACTS]), (F.conv(F.substring("record_id", 1, 1), 16, 10).cast("int") % 8 + 1)).alias("action"), F.lit("PERSON").alias("new_type"), F.lit(1).alias("line"))
    second = records.where(F.substring("record_id", 3, 1) < "4").select("record_id", F.lit("PROTECT").alias("action"), F.lit(None).cast("string").alias("new_type"), F.lit(2).alias("line"))
    return first.unionByName(second).withColumn("identity_id", F.lit(None).cast("string"))


_LATEST = _DECISIONS + ", last AS (SELECT record_id, arg_max(action, line) AS action, arg_max(coalesce(new_type, '-'), line) AS new_type FROM decisions GROUP BY record_id)"


@_query(O.RESOLVED + f", {_LATEST} SELECT record_id, action FROM last")
def latest_decision(spark, sf_dir):
    return policy.latest(_decisions(_plain(spark, sf_dir))).select("record_id", "action")


def _plain(spark, sf_dir):
    return resolve.records(engine.spans(_blocks(spark, sf_dir)))


@_query(O.RESOLVED + f""", {_LATEST} SELECT record_id, CASE WHEN action = 'RETYPE' AND new_type <> '-' THEN new_type ELSE pii_type END AS pii_type,
  CASE WHEN action IN ('APPROVE', 'REDACT', 'PROTECT', 'UNLINK_IDENTITY', 'CLEAR_MEDIA') OR (action = 'RETYPE' AND new_type <> '-') THEN 'APPROVED' WHEN action IN ('IGNORE', 'REJECT_AS_NON_PII') THEN 'REJECTED' ELSE review_status END AS review_status,
  CASE WHEN action = 'REDACT' THEN 'REDACT' WHEN action = 'PROTECT' THEN 'PROTECT' WHEN action IN ('IGNORE', 'CLEAR_MEDIA') THEN 'IGNORE' END AS policy_action FROM recs LEFT JOIN last USING (record_id)""")
def apply_review_decisions(spark, sf_dir):
    rows = _plain(spark, sf_dir)
    return policy.decided(rows, _decisions(rows)).select("record_id", "pii_type", "review_status", "policy_action")


@_query(O.RESOLVED + f""", {_DECISIONS} SELECT record_id, arg_max(action, line + n * 10) AS action FROM (SELECT record_id, action, line, 0 AS n FROM decisions UNION ALL SELECT record_id, 'APPROVE', 3, 1 FROM recs WHERE left(record_id, 1) < '8') GROUP BY record_id""")
def upsert_decisions(spark, sf_dir):
    rows = _plain(spark, sf_dir)
    old = _decisions(rows).select("record_id", "action", "line")
    new = rows.select("record_id", F.when(F.substring("record_id", 1, 1) < "8", "APPROVE").otherwise(" ").alias("action"), F.lit(3).alias("line"))
    return policy.upserted(old, new).select("record_id", "action")


# scalars ---------------------------------------------------------------------------------------------------------

_CARDS = "SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 AS VARCHAR), 16, '4') AS v, lpad(CAST(o_orderkey * 104729 % 1000000000000 AS VARCHAR), 12, '2') AS w FROM orders"


def _cards(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.lpad((F.col("o_orderkey") * 7919).cast("string"), 16, "4").alias("v"), F.lpad((F.col("o_orderkey") * 104729 % 1000000000000).cast("string"), 12, "2").alias("w"))


@_query(f"SELECT o_orderkey, {O.luhn('v')} AS valid FROM ({_CARDS})")
def luhn_check(spark, sf_dir):
    return _cards(spark, sf_dir).select("o_orderkey", K.luhn(F.col("v")).alias("valid"))


@_query(f"SELECT o_orderkey, {O.verhoeff('w')} AS valid FROM ({_CARDS})")
def verhoeff_check(spark, sf_dir):
    return _cards(spark, sf_dir).select("o_orderkey", K.verhoeff(F.col("w")).alias("valid"))


@_query(O.RESOLVED + f" SELECT record_id, left({O.hmac(chr(39) + 'F|' + chr(39) + ' || pii_type || ' + chr(39) + '|' + chr(39) + ' || normalized_text')}, 20) AS fingerprint FROM recs")
def hmac_fingerprint(spark, sf_dir):
    return _plain(spark, sf_dir).select("record_id", F.substring(K.hmac(SEED, F.concat_ws("|", F.lit("F"), "pii_type", "normalized_text")), 1, 20).alias("fingerprint"))


@_query(O.PROFILE + " SELECT record_id, idx AS index FROM profiled")
def pseudonym_index(spark, sf_dir):
    return pseudonyms.with_index(_records(spark, sf_dir), SEED).select("record_id", "index")


@_query(O.PROFILE + " SELECT record_id, given, surname, stem, descriptor, num AS number FROM profiled")
def pseudonym_profile(spark, sf_dir):
    return pseudonyms.with_profile(_records(spark, sf_dir), SEED).select("record_id", "given", "surname", "stem", "descriptor", "number")


def _mode(name: str, mode: str) -> None:
    @_query(O.valued(mode) + " SELECT record_id, value FROM valued", name)
    def one(spark, sf_dir):
        return _valued(spark, sf_dir, mode).select("record_id", "value")


for _n, _m in (("mask_full", "mask"), ("mask_partial", "partial"), ("mask_synthetic", "synthetic")):
    _mode(_n, _m)


@_query(O.PROFILE + f" SELECT record_id, {O._CARD} AS card FROM profiled WHERE pii_type = 'CREDIT_CARD'")
def synthetic_card(spark, sf_dir):
    return pseudonyms.with_index(_records(spark, sf_dir), SEED).where("pii_type = 'CREDIT_CARD'").select("record_id", pseudonyms.card().alias("card"))


@_query(O.PROFILE + f" SELECT record_id, {O._DATE} AS birthday FROM profiled WHERE pii_type = 'DOB'")
def synthetic_dob(spark, sf_dir):
    return pseudonyms.with_index(_records(spark, sf_dir), SEED).where("pii_type = 'DOB'").select("record_id", pseudonyms.birthday().alias("birthday"))


_BOX = "SELECT l_orderkey, l_linenumber, l_linenumber AS x1, l_partkey % 7 AS y1, l_linenumber + l_suppkey % 5 AS x2, l_partkey % 7 + l_orderkey % 4 AS y2, 3 AS u1, 2 AS v1, 6 AS u2, 5 AS v2 FROM lineitem"


@_query(f"SELECT l_orderkey, l_linenumber, round(coalesce(CASE WHEN a + b - i > 0 THEN CAST(i AS DOUBLE) / (a + b - i) END, 0.0), 9) AS iou FROM (SELECT *, greatest(0, x2 - x1) * greatest(0, y2 - y1) AS a, 9 AS b, greatest(0, least(x2, u2) - greatest(x1, u1)) * greatest(0, least(y2, v2) - greatest(y1, v1)) AS i FROM ({_BOX}))")
def bbox_iou(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.struct(F.col("l_linenumber").alias("x1"), (F.col("l_partkey") % 7).alias("y1"), (F.col("l_linenumber") + F.col("l_suppkey") % 5).alias("x2"), (F.col("l_partkey") % 7 + F.col("l_orderkey") % 4).alias("y2")).alias("a"), F.struct(*[F.lit(v).alias(k) for k, v in (("x1", 3), ("y1", 2), ("x2", 6), ("y2", 5))]).alias("b"))
    return rows.select("l_orderkey", "l_linenumber", F.round(K.iou(F.col("a"), F.col("b")), 9).alias("iou"))


@_query(r"SELECT page_id, CASE WHEN lower(n) LIKE '%.docx' THEN n ELSE n || '.docx' END AS filename FROM (SELECT page_id, trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '._') AS n FROM pages)")
def safe_filename(spark, sf_dir):
    name = F.btrim(F.regexp_replace("url", "[^A-Za-z0-9._-]+", "_"), F.lit("._"))
    return _table(spark, sf_dir, "pages").select("page_id", F.when(F.lower(name).endswith(".docx"), name).otherwise(F.concat(name, F.lit(".docx"))).alias("filename"))


@_query("SELECT conv_id, turn, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS normalized FROM conversations")
def normalize_text(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", S.normalized(F.col("text")).alias("normalized"))


# redaction and checks --------------------------------------------------------------------------------------------


@_query(O.REPLACED + " SELECT record_id, replacement_value FROM replaced")
def replacement_first_wins(spark, sf_dir):
    return _run(spark, sf_dir).records.select("record_id", "replacement_value")


@_query(O.REPLACED + " SELECT record_id, pii_type, original_text, replacement_value, identity_id FROM replaced WHERE replacement_value IS NOT NULL")
def assign_replacements(spark, sf_dir):
    return _run(spark, sf_dir).records.where("replacement_value IS NOT NULL").select("record_id", "pii_type", "original_text", "replacement_value", "identity_id")


@_query(O.REPLACED + " SELECT record_id, pii_type, original_text, replacement_value, identity_id FROM replaced")
def entity_mapping(spark, sf_dir):
    return _run(spark, sf_dir).records.select("record_id", "pii_type", "original_text", "replacement_value", "identity_id")


@_query(O.REPLACED + f" SELECT record_id, pii_type, block_id, start_offset, end_offset, policy_action, replacement_value, left({O.hmac(chr(39) + 'F|' + chr(39) + ' || pii_type || ' + chr(39) + '|' + chr(39) + ' || normalized_text')}, 20) AS original_fingerprint FROM replaced")
def audit_log_sanitized(spark, sf_dir):
    rows = _run(spark, sf_dir).records
    return rows.select("record_id", "pii_type", "block_id", "start_offset", "end_offset", "policy_action", "replacement_value", F.substring(K.hmac(SEED, F.concat_ws("|", F.lit("F"), "pii_type", "normalized_text")), 1, 20).alias("original_fingerprint"))


@_query(O.REDACTED + " SELECT block_id, redacted FROM redacted")
def redact_text(spark, sf_dir):
    return _run(spark, sf_dir).redacted.select("block_id", "redacted")


@_query()
def global_repeat_redaction(spark, sf_dir):
    r = _run(spark, sf_dir)
    return redact.repeats_redacted(r.redacted, r.records).select("block_id", "redacted")


@_query(O.REDACTED + " SELECT record_id, r.block_id FROM replaced r JOIN redacted d USING (block_id) WHERE replacement_value IS NOT NULL AND NOT contains(redacted, replacement_value)")
def qa_application_failures(spark, sf_dir):
    r = _run(spark, sf_dir)
    return redact.application_failures(r.redacted, r.records)


@_query(O.REDACTED + ", written AS (SELECT block_id, redacted FROM redacted), " + O.RESIDUAL + " SELECT * FROM residual")
def qa_residual_scan(spark, sf_dir):
    r = _run(spark, sf_dir)
    return redact.residuals(r.redacted, r.records)


@_query(O.REPLACED + ", written AS (SELECT block_id, text AS redacted FROM blocks), " + O.RESIDUAL + " SELECT * FROM residual")
def qa_residuals_of_source(spark, sf_dir):
    """The scan over blocks in which nothing was replaced, so that every approved original is a residual."""
    r = _run(spark, sf_dir)
    return redact.residuals(r.blocks.withColumn("redacted", F.col("text")), r.records)


@_query(O.REDACTED + ", written AS (SELECT block_id, redacted FROM redacted), " + O.RESIDUAL + """, counts AS (SELECT (SELECT count(*) FROM replaced WHERE policy_action = 'REVIEW') AS unresolved, (SELECT count(*) FROM replaced r JOIN redacted d USING (block_id) WHERE replacement_value IS NOT NULL AND NOT contains(redacted, replacement_value)) AS not_applied, (SELECT count(*) FROM residual) AS left_over)
SELECT unresolved, not_applied, CASE WHEN unresolved = 0 THEN left_over END AS residuals, unresolved = 0 AS final, unresolved = 0 AND not_applied = 0 AND left_over = 0 AS passed FROM counts""")
def release_gate(spark, sf_dir):
    return redact.gate(_run(spark, sf_dir))


@_query(O.REDACTED + " SELECT document, string_agg(x.text, chr(10) ORDER BY paragraph_index) <> string_agg(redacted, chr(10) ORDER BY paragraph_index) AS changed FROM redacted x JOIN blocks USING (block_id) GROUP BY document")
def changed_documents(spark, sf_dir):
    joined = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("paragraph_index", c))), lambda x: x[c])
    return _run(spark, sf_dir).redacted.groupBy("document").agg((joined("text") != joined("redacted")).alias("changed"))


_TAGS = ("p", "a", "div", "h1", "li", "table", "tr", "td")


@_query("SELECT tag, CAST(sum(n) AS BIGINT) AS n FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS tag, len(regexp_extract_all(lower(html), '<{t}[ >]')) AS n FROM pages" for t in _TAGS) + ") GROUP BY tag")
def structure_signature(spark, sf_dir):
    low = F.lower("html")
    counts = F.array(*[F.struct(F.lit(t).alias("tag"), F.regexp_count(low, F.lit(f"<{t}[ >]")).alias("n")) for t in _TAGS])
    return _table(spark, sf_dir, "pages").select(F.explode(counts).alias("x")).groupBy("x.tag").agg(F.sum("x.n").alias("n"))


@_query("SELECT page_id, replace(replace(url, 'utm_source=feed', 'utm_source=x'), 'example.net', 'example.test') AS redacted_url FROM pages")
def redact_urls(spark, sf_dir):
    return redact.scrubbed_urls(_table(spark, sf_dir, "pages"), [("utm_source=feed", "utm_source=x"), ("example.net", "example.test")]).select("page_id", "redacted_url")


@_query(O.RESOLVED + ", runs AS (SELECT block_id, i AS run, i * 16 AS rs, least(i * 16 + 16, length(text)) AS re FROM blocks, range(0, 1 + (length(text) - 1) // 16) AS r(i)) SELECT record_id, CAST(run AS INTEGER) AS run, CAST(greatest(start_offset, rs) AS INTEGER) AS start_offset, CAST(least(end_offset, re) AS INTEGER) AS end_offset FROM recs JOIN runs USING (block_id) WHERE start_offset < re AND end_offset > rs")
def span_run_overlap(spark, sf_dir):
    n = F.floor((F.char_length("text") - 1) / 16).cast("int")
    runs = _blocks(spark, sf_dir).select("block_id", F.explode(F.sequence(F.lit(0), n)).alias("run"), F.char_length("text").alias("_n")).select("block_id", "run", (F.col("run") * 16).alias("rs"), F.least(F.col("run") * 16 + 16, "_n").alias("re"))
    rows = _plain(spark, sf_dir).join(runs, "block_id").where("start_offset < re AND end_offset > rs")
    return rows.select("record_id", "run", F.greatest("start_offset", "rs").alias("start_offset"), F.least("end_offset", "re").alias("end_offset"))


# fixture blocks --------------------------------------------------------------------------------------------------


def _fixture_run(spark: SparkSession) -> engine.Result:
    return engine.run(B.fixtures(spark), SEED)


@_query(O.on_fixtures(O.FOUND) + " SELECT * EXCLUDE (ord) FROM found")
def fixture_detections(spark, sf_dir):
    return detect.detections(B.fixtures(spark)).drop("det_ord")


@_query(O.on_fixtures(O.LINKED) + " SELECT record_id, pii_type, original_text, policy_action, identity_id, round(final_confidence, 6) AS final_confidence FROM linked")
def fixture_records(spark, sf_dir):
    return engine.records(B.fixtures(spark)).select("record_id", "pii_type", "original_text", "policy_action", "identity_id", F.round("final_confidence", 6).alias("final_confidence"))


def _fixture_mode(name: str, mode: str) -> None:
    @_query(O.on_fixtures(O.valued(mode)) + " SELECT record_id, value FROM valued", name)
    def one(spark, sf_dir):
        return pseudonyms.with_value(engine.records(B.fixtures(spark)), SEED, mode).select("record_id", "value")


for _n, _m in (("fixture_mask", "mask"), ("fixture_partial", "partial"), ("fixture_synthetic", "synthetic")):
    _fixture_mode(_n, _m)


@_query(O.on_fixtures(O.REDACTED) + " SELECT block_id, redacted FROM redacted")
def fixture_redaction(spark, sf_dir):
    return _fixture_run(spark).redacted.select("block_id", "redacted")


@_query(O.on_fixtures(O.REPLACED) + ", written AS (SELECT block_id, text AS redacted FROM blocks), " + O.RESIDUAL + " SELECT * FROM residual")
def fixture_residuals(spark, sf_dir):
    r = _fixture_run(spark)
    return redact.residuals(r.blocks.withColumn("redacted", F.col("text")), r.records)


# evaluation on the controlled benchmark --------------------------------------------------------------------------


def _predictions(spark):
    return resolve.records(engine.spans(B.fixtures(spark, samples=False)))


_PRED = O.on_fixtures(O.RESOLVED) + f", {O.GOLD}, pred AS (SELECT * FROM recs WHERE document_part = 'benchmark'), keys AS (SELECT pii_type, document_part, block_id, start_offset, end_offset, count(*) FILTER (p) AS n_pred, count(*) FILTER (NOT p) AS n_gold FROM (SELECT pii_type, document_part, block_id, start_offset, end_offset, true AS p FROM pred UNION ALL SELECT *, false FROM gold) GROUP BY ALL), matches AS (SELECT *, least(n_pred, n_gold) AS tp FROM keys)"
_PRF = "tp, fp, fn, CASE WHEN tp + fp <> 0 THEN CAST(tp AS DOUBLE) / (tp + fp) END AS precision, CASE WHEN tp + fn <> 0 THEN CAST(tp AS DOUBLE) / (tp + fn) END AS recall"
_F1 = "*, CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall) END AS f1"


@_query(_PRED + " SELECT pii_type, block_id, start_offset, end_offset FROM matches WHERE tp > 0")
def eval_strict_matches(spark, sf_dir):
    return evaluate.strict(_predictions(spark), evaluate.gold(spark)).where("tp > 0").select("pii_type", "block_id", "start_offset", "end_offset")


@_query(_PRED + " SELECT p.block_id, p.pii_type, p.start_offset AS pred_s, g.start_offset AS gold_s FROM pred p JOIN gold g USING (pii_type, block_id) WHERE least(p.end_offset, g.end_offset) - greatest(p.start_offset, g.start_offset) >= 0.5 * least(p.end_offset - p.start_offset, g.end_offset - g.start_offset)")
def eval_relaxed_matches(spark, sf_dir):
    return evaluate.relaxed(_predictions(spark), evaluate.gold(spark)).select("block_id", "pii_type", "pred_s", "gold_s")


@_query(_PRED + f" SELECT {_F1} FROM (SELECT pii_type, {_PRF} FROM (SELECT pii_type, CAST(coalesce(sum(tp), 0) AS BIGINT) AS tp, CAST(coalesce(sum(n_pred - tp), 0) AS BIGINT) AS fp, CAST(coalesce(sum(n_gold - tp), 0) AS BIGINT) AS fn FROM (SELECT unnest([{', '.join(O.q(t) for t in C.TYPES)}]) AS pii_type) LEFT JOIN matches USING (pii_type) GROUP BY 1))")
def eval_per_type(spark, sf_dir):
    return evaluate.per_type(evaluate.strict(_predictions(spark), evaluate.gold(spark)))


@_query(_PRED + f" SELECT {_F1} FROM (SELECT {_PRF} FROM (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(n_pred - tp) AS BIGINT) AS fp, CAST(sum(n_gold - tp) AS BIGINT) AS fn FROM matches))")
def eval_micro(spark, sf_dir):
    return evaluate.micro(evaluate.strict(_predictions(spark), evaluate.gold(spark)))


@_query(_PRED + " SELECT source, count(*) AS n FROM (SELECT unnest(string_split(sources, ',')) AS source FROM pred JOIN matches USING (pii_type, block_id, start_offset, end_offset) WHERE tp > 0) GROUP BY 1")
def detector_contribution(spark, sf_dir):
    p = _predictions(spark)
    hit = evaluate.strict(p, evaluate.gold(spark)).where("tp > 0").select(*evaluate.KEY)
    return p.join(hit, evaluate.KEY, "left_semi").select(F.explode("evidence").alias("x")).groupBy("x.source").agg(F.count("*").alias("n"))


_BANDS = "CASE WHEN final_confidence >= 0.85 THEN 'high' WHEN final_confidence >= 0.60 THEN 'medium' ELSE 'low' END"
_MARKED = "marked AS (SELECT p.*, m.tp > 0 AS matched FROM pred p JOIN matches m USING (pii_type, document_part, block_id, start_offset, end_offset))"


@_query(_PRED + f", {_MARKED}, n AS (SELECT (SELECT count(*) FROM pred p JOIN gold g USING (pii_type, block_id) WHERE least(p.end_offset, g.end_offset) - greatest(p.start_offset, g.start_offset) >= 0.5 * least(p.end_offset - p.start_offset, g.end_offset - g.start_offset)) AS tp, (SELECT count(*) FROM pred) AS np, (SELECT count(*) FROM gold) AS ng) SELECT {_F1.replace('*', 'r.*', 1)}, (SELECT CAST(count(*) FILTER (matched AND review_status = 'AUTO_APPROVED') AS DOUBLE) / nullif(count(*) FILTER (review_status = 'AUTO_APPROVED'), 0) FROM marked) AS automatic_precision, (SELECT CAST(count(*) FILTER (review_status IN ('NEEDS_REVIEW', 'LOW_CONFIDENCE')) AS DOUBLE) / nullif(count(*), 0) FROM pred) AS review_workload, CAST(NULL AS DOUBLE) AS image_coverage FROM (SELECT {_PRF} FROM (SELECT tp, np - tp AS fp, ng - tp AS fn FROM n)) r")
def eval_overall(spark, sf_dir):
    return evaluate.overall(_predictions(spark), evaluate.gold(spark))


@_query(_PRED + f", {_MARKED} SELECT band, coalesce(predictions, 0) AS predictions, coalesce(tp, 0) AS tp, CASE WHEN predictions > 0 THEN CAST(tp AS DOUBLE) / predictions END AS precision FROM (VALUES ('high'), ('medium'), ('low')) AS b(band) LEFT JOIN (SELECT {_BANDS} AS band, count(*) AS predictions, count(*) FILTER (matched) AS tp FROM marked GROUP BY 1) USING (band)")
def eval_confidence_bands(spark, sf_dir):
    return evaluate.bands(_predictions(spark), evaluate.gold(spark))


@_query(O.RESOLVED + f", {_LATEST} SELECT action, count(*) AS n FROM last JOIN recs USING (record_id) GROUP BY 1")
def eval_human_actions(spark, sf_dir):
    rows = _plain(spark, sf_dir)
    return evaluate.human_actions(policy.decided(rows, _decisions(rows)))


#: made-up boxes of one image for each order: one predicted, one in gold
_PRED_BOX, _GOLD_BOX = ("o_orderkey % 7", "o_orderkey % 5", "o_orderkey % 7 + 10", "o_orderkey % 5 + 8"), ("o_custkey % 6", "o_custkey % 4", "o_custkey % 6 + 9", "o_custkey % 4 + 9")


@_query(f"SELECT media_name, round(i / (a + b - i), 9) AS iou FROM (SELECT 'image' || o_orderkey AS media_name, CAST(greatest(0, least({_PRED_BOX[2]}, {_GOLD_BOX[2]}) - greatest({_PRED_BOX[0]}, {_GOLD_BOX[0]})) * greatest(0, least({_PRED_BOX[3]}, {_GOLD_BOX[3]}) - greatest({_PRED_BOX[1]}, {_GOLD_BOX[1]})) AS DOUBLE) AS i, 80 AS a, 81 AS b FROM orders) WHERE i / (a + b - i) >= 0.5")
def eval_image_matches(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    boxes = lambda xs: o.select(F.lit("QR_CODE").alias("pii_type"), F.concat(F.lit("image"), "o_orderkey").alias("media_name"), F.array(*[F.expr(x).cast("int") for x in xs]).alias("bounding_box"))
    return evaluate.images(boxes(_PRED_BOX), boxes(_GOLD_BOX)).select("media_name", F.round("iou", 9).alias("iou"))


@_query(_PRED + ", marks AS (SELECT block_id IN (SELECT block_id FROM pred) AS p, block_id IN (SELECT block_id FROM gold) AS g FROM blocks WHERE document_part = 'benchmark') SELECT *, CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn) AS accuracy FROM (SELECT count(*) FILTER (p AND g) AS tp, count(*) FILTER (NOT p AND NOT g) AS tn, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (NOT p AND g) AS fn FROM marks)")
def block_classification(spark, sf_dir):
    return evaluate.by_block(B.fixtures(spark, samples=False), _predictions(spark), evaluate.gold(spark))


@_query(_PRED + ", cp AS (SELECT DISTINCT block_id, unnest(range(start_offset, end_offset)) AS pos FROM pred), cg AS (SELECT DISTINCT block_id, unnest(range(start_offset, end_offset)) AS pos FROM gold), n AS (SELECT (SELECT count(*) FROM cp JOIN cg USING (block_id, pos)) AS tp, (SELECT count(*) FROM cp) AS np, (SELECT count(*) FROM cg) AS ng, (SELECT CAST(sum(length(text)) AS BIGINT) FROM blocks WHERE document_part = 'benchmark') AS total) SELECT tp, np - tp AS fp, ng - tp AS fn, total - np - ng + tp AS tn, CAST(total - np - ng + 2 * tp AS DOUBLE) / total AS accuracy FROM n")
def character_accuracy(spark, sf_dir):
    return evaluate.by_character(B.fixtures(spark, samples=False), _predictions(spark), evaluate.gold(spark))


@_query(_PRED + " SELECT block_id, pii_type, start_offset, end_offset, review_status FROM pred")
def benchmark_fixtures(spark, sf_dir):
    return _predictions(spark).select("block_id", "pii_type", "start_offset", "end_offset", "review_status")
