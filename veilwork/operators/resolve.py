"""Evidence merge, confidence and overlap resolution inside a block's row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.spans import normalized, overlap

MERGED = "array<struct<pii_type:string,s:int,e:int,v:string,evidence:array<struct<source:string,name:string,score:double>>,confidence:double,status:string,det_ord:int>>"


def merged(found: Column, auto: float = C.AUTO, review: float = C.REVIEW) -> Column:
    """Spans of one type and place become one: evidence in order, 0.08 for each further source, at most 0.99."""
    keys = F.array_distinct(F.transform(found, lambda x: F.struct(x["pii_type"].alias("t"), x["s"].alias("s"), x["e"].alias("e"))))

    def one(k: Column, i: Column) -> Column:
        own = F.filter(found, lambda x: (x["pii_type"] == k["t"]) & (x["s"] == k["s"]) & (x["e"] == k["e"]))
        evidence = F.transform(own, lambda x: F.struct(x["source"].alias("source"), x["name"].alias("name"), x["score"].alias("score")))
        sources = F.size(F.array_distinct(F.transform(own, lambda x: x["source"])))
        score = F.least(F.lit(0.99), F.array_max(F.transform(own, lambda x: x["score"])) + F.lit(0.08) * (sources - 1))
        status = F.when(score >= auto, "AUTO_APPROVED").when(score >= review, "NEEDS_REVIEW").otherwise("LOW_CONFIDENCE")
        return F.struct(k["t"].alias("pii_type"), k["s"].alias("s"), k["e"].alias("e"), F.get(own, F.lit(0))["v"].alias("v"), evidence.alias("evidence"), score.alias("confidence"), status.alias("status"), i.alias("det_ord"))

    return F.transform(keys, one).cast(MERGED)


def resolved(spans: Column) -> Column:
    """Spans kept greedily: by confidence, type priority, length, then place and order; an address takes what it contains."""
    weight = F.create_map(*[F.lit(x) for kv in C.PRIORITY.items() for x in kv])
    keyed = F.transform(spans, lambda x: F.struct((-x["confidence"]).alias("k1"), (-F.element_at(weight, x["pii_type"])).alias("k2"), (x["s"] - x["e"]).alias("k3"), x["s"].alias("k4"), x["det_ord"].alias("k5"), x.alias("x")))
    order = F.transform(F.array_sort(keyed), lambda k: k["x"])

    def step(kept: Column, x: Column) -> Column:
        clash = F.filter(kept, lambda y: overlap(x, y))
        takes = (x["pii_type"] == "ADDRESS") & (x["confidence"] >= 0.85) & F.forall(clash, lambda y: (x["s"] <= y["s"]) & (x["e"] >= y["e"]))
        return F.when(F.size(clash) == 0, F.concat(kept, F.array(x))).when(takes, F.concat(F.filter(kept, lambda y: ~overlap(x, y)), F.array(x))).otherwise(kept)

    return F.aggregate(order, F.array().cast(MERGED), step)


def records(blocks: DataFrame) -> DataFrame:
    """One row per span of blocks with `spans`: the fact table of all later stages."""
    rows = blocks.select("document_part", "document", "block_id", F.explode("spans").alias("x"))
    rows = rows.select("document_part", "document", "block_id", "x.pii_type", F.col("x.s").alias("start_offset"), F.col("x.e").alias("end_offset"), F.col("x.v").alias("original_text"), normalized(F.col("x.v")).alias("normalized_text"), "x.evidence", F.col("x.confidence").alias("final_confidence"), F.col("x.status").alias("review_status"), "x.det_ord")
    return rows.withColumn("record_id", F.substring(F.sha2(F.concat_ws("|", "block_id", "pii_type", "start_offset", "end_offset", "normalized_text"), 256), 1, 20))
