"""Reports of a run: small tables gathered on the driver and written as JSON, CSV and Markdown, and a bundle of files."""

from __future__ import annotations

import csv
import json
import zipfile
from collections.abc import Iterable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import REQUIRED
from ..operators import evaluate


def _counts(rows: DataFrame, column: str) -> dict[str, int]:
    return {r[0]: r[1] for r in rows.groupBy(column).count().orderBy(column).collect()}


def summary(records: DataFrame, source_hash: str, output_hash: str | None, seed_fingerprint: str, media_total: int = 0, media_replaced: int = 0, output_path: str | None = None) -> dict:
    """Counts of a run by type, status, policy and source of evidence, and whether nothing waits for review."""
    source = lambda s: F.exists("evidence", lambda x: x["source"] == s)
    action, status = F.col("policy_action"), F.col("review_status")
    one = {
        "total_candidates": F.count("*"),
        "automatically_replaced": F.count_if((status == "AUTO_APPROVED") & (action == "REDACT")),
        "redacted_entities": F.count_if(action == "REDACT"),
        "protected_entities": F.count_if(action == "PROTECT"),
        "ignored_entities": F.count_if(action == "IGNORE"),
        "policy_review_required": F.count_if(action == "REVIEW"),
        "review_approved": F.count_if(source("HUMAN_REVIEW")),
        "policy_finalized": F.count_if(source("POLICY")),
        "review_rejected": F.count_if(status == "REJECTED"),
        "manual_review_required": F.count_if(action == "REVIEW"),
        "confidence_review_flags": F.count_if(status == "NEEDS_REVIEW"),
        "low_confidence_inspection": F.count_if(status == "LOW_CONFIDENCE"),
    }
    out = records.agg(*[v.alias(k) for k, v in one.items()]).first().asDict()
    by = {"entities_by_type": _counts(records, "pii_type"), "entities_by_status": _counts(records, "review_status"), "entities_by_policy": _counts(records, "policy_action"), "evidence_by_source": _counts(records.select(F.explode("evidence.source").alias("source")), "source")}
    head = {"source_sha256": source_hash, "output_sha256": output_hash, "output_path": output_path, "seed_fingerprint": seed_fingerprint}
    return head | out | by | {"media_total": media_total, "media_replaced": media_replaced, "release_ready": out["policy_review_required"] == 0}


def write_json(value: dict, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def _table(head: Sequence[str], rows: Iterable[Sequence]) -> list[str]:
    line = lambda x: "| " + " | ".join(map(str, x)) + " |"
    return ["", line(head), line(["---"] + ["---:"] * (len(head) - 1)), *map(line, rows), ""]


def number(value: float | None) -> str:
    """Four decimals, N/A for None."""
    return "N/A" if value is None else f"{value:.4f}"


def tracker(s: dict) -> str:
    """A summary as Markdown, without originals and mappings."""
    single = [f"- {k.replace('_', ' ').capitalize()}: `{v}`" for k, v in s.items() if not isinstance(v, (dict, list)) and k != "output_path"]
    types = s["entities_by_type"]
    out = ["# Redaction tracker", "", *single, "", "## Required types", *_table(["Type", "Count"], [(label, types.get(k, 0)) for k, label in REQUIRED.items()])]
    for title, rows in (("Further types", [(k, v) for k, v in types.items() if k not in REQUIRED]), ("Policy", s["entities_by_policy"].items()), ("Evidence by source", s["evidence_by_source"].items())):
        out += [f"## {title}", *_table([title, "Count"], rows)] if rows else []
    return "\n".join(out) + "\n"


def release_report(records: DataFrame) -> dict:
    """What can be said without gold spans: counts, and whether nothing waits for review."""
    by = {k: _counts(records, c) for k, c in (("status_counts", "review_status"), ("policy_counts", "policy_action"), ("type_counts", "pii_type"))}
    waiting = by["policy_counts"].get("REVIEW", 0)
    return {"status": "RELEASE_VALIDATION", "total_candidates": sum(by["type_counts"].values()), "unresolved_count": waiting, "release_gate_passed": waiting == 0} | by


def full_report(records: DataFrame, truth: DataFrame, blocks: DataFrame | None = None) -> dict:
    """All measures against gold spans; those of blocks and characters need the manifest's blocks."""
    first = lambda df: df.first().asDict()
    out = {
        "status": "COMPLETE",
        "rows": [r.asDict() for r in evaluate.per_type(evaluate.strict(records, truth)).collect()],
        "overall": first(evaluate.overall(records, truth)),
        "micro": first(evaluate.micro(evaluate.strict(records, truth))),
        "confidence_bands": {r.band: r.asDict() for r in evaluate.bands(records, truth).collect()},
        "detector_source_contribution": _counts(evaluate.marked(records, truth).where("matched").select(F.explode("evidence.source").alias("source")), "source"),
        "human_review_actions": {r.action: r.n for r in evaluate.human_actions(records).collect()},
    }
    if blocks is not None:
        out |= {"block_classification": first(evaluate.by_block(blocks, records, truth)), "character_accuracy": first(evaluate.by_character(blocks, records, truth))}
    return out


def report(records: DataFrame, truth: DataFrame, blocks: DataFrame | None = None) -> dict:
    """full_report, or release_report where there are no gold spans."""
    return release_report(records) if truth.isEmpty() else full_report(records, truth, blocks)


def long_rows(r: dict) -> tuple[list[str], list[dict]]:
    """(columns, rows) of the CSV of a report: counts by section, or measures by type."""
    if r["status"] == "RELEASE_VALIDATION":
        rows = [("release", "ALL", k, str(r[k]).lower()) for k in ("total_candidates", "unresolved_count", "release_gate_passed")]
        rows += [("release", "ALL", k, r[k]) for k in ("source_sha256", "output_sha256", "media_total", "media_replaced") if k in r]
        rows += [(section, "ALL", k.lower(), v) for section, name in (("decision_status", "status_counts"), ("policy_action", "policy_counts")) for k, v in r[name].items()]
        rows += [("candidate_type", k, "candidate_count", r["type_counts"].get(k, 0)) for k in REQUIRED]
        rows += [("additional_candidate_type", k, "candidate_count", v) for k, v in r["type_counts"].items() if k not in REQUIRED]
        names = ["section", "pii_type", "metric", "value"]
        return [*names, "notes"], [dict(zip(names, x, strict=True)) | {"notes": ""} for x in rows]
    names = ["unit", "pii_type", "support", "tp", "tn", "fp", "fn", "accuracy", "precision", "recall", "f1"]
    rows = [{"unit": "exact entity/span", "support": x["tp"] + x["fn"]} | x for x in r["rows"]]
    if (b := r.get("block_classification")) is not None:
        rows.append({"unit": "text block", "pii_type": "ANY_PII", "support": b["tp"] + b["tn"] + b["fp"] + b["fn"]} | b)
    return names, [{k: x.get(k, "") for k in names} for x in rows]


def write_evaluation(r: dict, markdown: str | Path, table: str | Path, title: str = "Evaluation report") -> None:
    """A report as Markdown and CSV."""
    names, rows = long_rows(r)
    for path in (markdown, table):
        Path(path).parent.mkdir(parents=True, exist_ok=True)
    with Path(table).open("w", encoding="utf-8", newline="") as f:
        w = csv.DictWriter(f, names)
        w.writeheader()
        w.writerows(rows)
    out = [f"# {title}", ""]
    if r["status"] == "RELEASE_VALIDATION":
        out += [f"Review gate: **{'PASS' if r['release_gate_passed'] else 'FAIL'}**", "", "No gold spans are at hand, so no accuracy is claimed.", *_table(names[:4], [[x[k] for k in names[:4]] for x in rows])]
    else:
        some = ["pii_type", "tp", "fp", "fn", "precision", "recall", "f1"]
        show = lambda x, k: number(x[k]) if k in ("precision", "recall", "f1", "accuracy") or isinstance(x[k], float) else x[k]
        out += _table(some, [[show(x, k) for k in some] for x in r["rows"]])
        for name in ("micro", "overall", "block_classification", "character_accuracy"):
            if name in r:
                out += [f"## {name.replace('_', ' ').capitalize()}", *_table(["Measure", "Value"], [(k, show(r[name], k)) for k in r[name]])]
        out += ["## Confidence bands", *_table(["band", "predictions", "tp", "precision"], [(b, x["predictions"], x["tp"], number(x["precision"])) for b, x in r["confidence_bands"].items()])]
        for name in ("detector_source_contribution", "human_review_actions"):
            out += [f"## {name.replace('_', ' ').capitalize()}", "", json.dumps(r[name], sort_keys=True), ""]
    Path(markdown).write_text("\n".join(out) + "\n", encoding="utf-8")


def bundle(files: Iterable[str | Path], target: str | Path) -> list[str]:
    """A ZIP of those files that exist, by their names; the caller leaves private ones out."""
    there = [Path(f) for f in files if Path(f).is_file()]
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in there:
            z.write(f, f.name)
    return [f.name for f in there]
