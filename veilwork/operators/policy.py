"""Policy, identity links and review decisions over the record table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import ACTIONS, CORPORATE, CORPORATE_LINKS, PERSONAL_LINKS
from ..functions.spans import normalized


def with_policy(records: DataFrame, company_scope: str = "protect") -> DataFrame:
    """policy_action of every record that no decision has locked."""
    if company_scope not in ("protect", "review", "redact"):
        raise ValueError(f"unknown scope {company_scope}")
    locked = F.col("policy_locked") if "policy_locked" in records.columns else F.lit(False)
    action = F.when(F.col("review_status") == "REJECTED", "IGNORE")
    if company_scope != "redact":
        action = action.when(F.col("pii_type").isin(*CORPORATE), company_scope.upper())
    action = action.when(F.col("review_status").isin("NEEDS_REVIEW", "LOW_CONFIDENCE"), "REVIEW").otherwise("REDACT")
    if "policy_action" in records.columns:
        action = F.when(locked, F.col("policy_action")).otherwise(action)
    return records.withColumn("policy_action", action)


def _hashed(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, 12))


def with_identity(records: DataFrame) -> DataFrame:
    """identity_id: one person (then one company) in a block lends its id to the block's other records; an id that a decision
    gave stays, but for anchors and for personal records beside one person."""
    given = F.col("identity_id") if "identity_id" in records.columns else F.lit(None).cast("string")
    block = Window.partitionBy("block_id")
    person, org = _hashed("person-", F.col("normalized_text")), _hashed("org-", F.col("normalized_text"))
    anchors = lambda t: F.sum(F.when(F.col("pii_type") == t, 1).otherwise(0)).over(block)
    only = lambda t, x: F.when(anchors(t) == 1, F.max(F.when(F.col("pii_type") == t, x)).over(block))
    typed = F.concat_ws("|", "pii_type", "normalized_text")
    personal, corporate = F.col("pii_type").isin(*PERSONAL_LINKS), F.col("pii_type").isin(*CORPORATE_LINKS)
    own = F.when(F.col("pii_type").isin(*CORPORATE), _hashed("org-", typed)).otherwise(_hashed("entity-", typed))
    linked = F.coalesce(F.when(personal, only("PERSON", person)), given, F.when(corporate, only("COMPANY", org)), own)
    return records.withColumn("identity_id", F.when(F.col("pii_type") == "PERSON", person).when(F.col("pii_type") == "COMPANY", org).otherwise(linked))


def latest(decisions: DataFrame) -> DataFrame:
    """The last decision of each record, by `line`."""
    by = Window.partitionBy("record_id").orderBy(F.desc("line"))
    return decisions.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def checked(decisions: DataFrame, source_hash: str | None = None) -> DataFrame:
    """Decisions as they are; a wrong action or source stops the query."""
    ok = F.col("action").isin(*ACTIONS)
    out = decisions.where(F.assert_true(ok, "unknown review action").isNull())
    return out if source_hash is None else out.where(F.assert_true(F.col("source_hash") == source_hash, "decision for another source").isNull())


_OPTIONAL = {"new_type": "string", "identity_id": "string", "note": "string", "new_start_offset": "int", "new_end_offset": "int"}
PRIVACY_FIRST = "Privacy-first finalization:"


def decided(records: DataFrame, decisions: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Records with the last decision on each applied, and the columns decision, policy_action, policy_locked, identity_id.

    Each decision adds evidence of score 1.0, of source POLICY if its note starts with PRIVACY_FIRST, else HUMAN_REVIEW; the
    confidence stays. RETYPE without a type and LINK_IDENTITY without an id change nothing else. ADJUST_SPAN stops the query
    where its offsets are missing or wrong; with blocks, the text is cut anew. Columns that decisions lack are null.
    """
    more = [(F.col(c) if c in decisions.columns else F.lit(None)).cast(t).alias(f"_{c}") for c, t in _OPTIONAL.items()]
    rows = records.join(latest(decisions).select("record_id", F.col("action").alias("decision"), *more), "record_id", "left")
    a, s, e = F.col("decision"), F.col("_new_start_offset"), F.col("_new_end_offset")
    moved, typed, linked = F.coalesce(a == "ADJUST_SPAN", F.lit(False)), (a == "RETYPE") & F.col("_new_type").isNotNull(), (a == "LINK_IDENTITY") & F.col("_identity_id").isNotNull()
    out = {}
    if blocks is not None:
        text = blocks.select(F.col("block_id").alias("_block"), F.col("text").alias("_text"))
        rows = rows.join(text, (F.col("block_id") == F.col("_block")) & moved, "left")
        cut = F.substring("_text", s + 1, e - s)
        known = moved & F.col("_text").isNotNull()
        out = {"original_text": F.when(known, cut).otherwise(F.col("original_text")), "normalized_text": F.when(known, normalized(cut)).otherwise(F.col("normalized_text"))}
        fits = F.coalesce(e <= F.char_length("_text"), F.lit(True))
    else:
        fits = F.lit(True)
    right = F.coalesce((s >= 0) & (s < e) & fits, F.lit(False))
    place = lambda new, old: F.when(~moved, F.col(old)).when(right, new).otherwise(F.raise_error(F.lit("ADJUST_SPAN: offsets are missing or wrong")).cast("int"))
    status = F.when(a.isin("APPROVE", "REDACT", "PROTECT", "ADJUST_SPAN", "UNLINK_IDENTITY", "FORCE_MEDIA_REPLACEMENT", "CLEAR_MEDIA") | typed | linked, "APPROVED").when(a.isin("IGNORE", "REJECT_AS_NON_PII"), "REJECTED").otherwise(F.col("review_status"))
    action = F.when(a.isin("REDACT", "FORCE_MEDIA_REPLACEMENT"), "REDACT").when(a == "PROTECT", "PROTECT").when(a.isin("IGNORE", "CLEAR_MEDIA"), "IGNORE")
    by_policy = F.coalesce(F.col("_note").startswith(PRIVACY_FIRST), F.lit(False))
    said = F.struct(F.when(by_policy, "POLICY").otherwise("HUMAN_REVIEW").alias("source"), F.concat(F.when(by_policy, "policy_").otherwise("human_"), F.lower(a)).alias("name"), F.lit(1.0).alias("score"))
    out |= {"evidence": F.when(a.isNotNull(), F.concat("evidence", F.array(said))).otherwise(F.col("evidence")), "review_status": status, "policy_action": action, "policy_locked": action.isNotNull(), "pii_type": F.when(typed, F.col("_new_type")).otherwise(F.col("pii_type")), "identity_id": F.when(linked, F.col("_identity_id")), "start_offset": place(s, "start_offset"), "end_offset": place(e, "end_offset")}
    return rows.withColumns(out).drop("_block", "_text", *[f"_{c}" for c in _OPTIONAL])


def upserted(old: DataFrame, new: DataFrame, source_hash: str | None = None) -> DataFrame:
    """Decisions of old replaced by those of new with the same record; blank ones change nothing.

    With source_hash, decisions of old about another source go, and all that stay carry it.
    """
    if source_hash is not None:
        old, new = old.where(F.col("source_hash") == source_hash), new.withColumn("source_hash", F.lit(source_hash))
    both = old.withColumn("_new", F.lit(0)).unionByName(new.where(F.trim("action") != "").withColumn("_new", F.lit(1)))
    by = Window.partitionBy("record_id").orderBy(F.desc("_new"), F.desc("line"))
    return both.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n", "_new")


def privacy_first(records: DataFrame) -> DataFrame:
    """Decisions that close every pending record: corporate ones are protected, the rest redacted."""
    pending = records.where("policy_action = 'REVIEW'")
    return pending.select("record_id", F.when(F.col("pii_type").isin(*CORPORATE), "PROTECT").otherwise("REDACT").alias("action"))


def finalized(queue: DataFrame) -> DataFrame:
    """Decisions that close a review queue with its source_hash, identity_id and a note; a queue of several sources, or of an unnamed one, stops the query."""
    named = F.coalesce(F.trim("source_hash"), F.lit(""))
    one = queue.agg(F.min(named).alias("_low"), F.max(named).alias("_high")).where(F.assert_true((F.col("_low") == F.col("_high")) & (F.col("_low") != ""), "the queue's source hashes are missing or differ").isNull())
    keep = F.col("pii_type").isin(*CORPORATE)
    note = F.concat(F.lit(PRIVACY_FIRST + " "), F.when(keep, "the corporate fact stays").otherwise("personal data is redacted"))
    return queue.join(F.broadcast(one.select("_low")), named == F.col("_low")).select("record_id", "source_hash", F.when(keep, "PROTECT").otherwise("REDACT").alias("action"), "identity_id", note.alias("note"))
