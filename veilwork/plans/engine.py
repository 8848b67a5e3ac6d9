"""The whole run: blocks to spans, records, replacements and rewritten text, as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions.constants import AUTO, REVIEW
from ..operators import policy, pseudonyms, redact, resolve
from ..operators.detect import detected


@dataclass(frozen=True)
class Result:
    blocks: DataFrame
    records: DataFrame
    redacted: DataFrame


def spans(blocks: DataFrame, auto: float = AUTO, review: float = REVIEW) -> DataFrame:
    """Blocks with `spans`, detected, merged and resolved in one narrow stage."""
    rows = S.held(detected(blocks).withColumn("spans", resolve.merged(F.col("found"), auto, review)).drop("found"), "spans")
    return S.held(rows.withColumn("spans", F.when(F.size("spans") > 1, resolve.resolved(F.col("spans"))).otherwise(F.col("spans"))), "spans")


def records(blocks: DataFrame, company_scope: str = "protect", decisions: DataFrame | None = None, auto: float = AUTO, review: float = REVIEW) -> DataFrame:
    rows = resolve.records(spans(blocks, auto, review))
    if decisions is not None:
        rows = policy.decided(rows, decisions, blocks)
    return policy.with_identity(policy.with_policy(rows, company_scope))


def run(blocks: DataFrame, seed: bytes, mode: str = "synthetic", company_scope: str = "protect", decisions: DataFrame | None = None, auto: float = AUTO, review: float = REVIEW) -> Result:
    """A run with a secret seed; without one there is no default."""
    if not seed:
        raise RuntimeError("a seed is needed")
    rows = pseudonyms.with_replacement(records(blocks, company_scope, decisions, auto, review), seed, mode)
    return Result(blocks, rows, redact.redacted(blocks, rows))
