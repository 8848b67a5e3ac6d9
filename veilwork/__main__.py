"""Command line: python -m veilwork --config config.toml COMMAND."""

from __future__ import annotations

import argparse
import hashlib
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.checks import seed_fingerprint
from .operators import evaluate, policy, redact
from .plans import engine
from .plans.settings import Settings, load
from .sources import blocks as B
from .sources import docx, files, reports

#: exit codes: a draft that waits for review, failed checks, a benchmark that misses a type
DRAFT, FAILED, MISSED = 2, 3, 4


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veilwork", description="Find personal data in DOCX packages and replace it")
    p.add_argument("--config", default="config.toml")
    c = p.add_subparsers(dest="command", required=True)
    for name, text in (("inspect", "count what the input holds"), ("detect", "detect and write a draft"), ("redact", "apply detections and decisions"), ("run-all", "the whole run"), ("benchmark", "measure the controlled benchmark")):
        c.add_parser(name, help=text)
    c.add_parser("verify", help="check a package").add_argument("path", nargs="?")
    c.add_parser("review", help="the queue of pending records").add_argument("action", choices=["export", "apply", "finalize"])
    return p


def _write(packages: DataFrame, target: Path) -> None:
    """The one package of a run as a file."""
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(packages.select("content").first()[0])


def run(spark: SparkSession, s: Settings) -> dict:
    """One package from detection to reports; the keys of the result are those the commands print."""
    source_hash = hashlib.sha256(s.input.read_bytes()).hexdigest()
    packages = spark.read.format("binaryFile").load(str(s.input)).select(F.col("path").alias("document"), "content")
    blocks = docx.blocks(packages).cache()
    private = s.private_dir
    files.write_manifest(blocks, source_hash, str(private / "annotation_manifest.private.jsonl"))
    said = str(private / "review_decisions.jsonl")
    decisions = files.decisions(spark, said, source_hash) if files.present(spark, said) else None
    done = engine.run(blocks, s.seed, s.mode, s.company_scope, decisions, s.high_threshold, s.medium_threshold)
    records = done.records.cache()
    files.write_jsonl(files.queue(records, source_hash), str(private / "review_queue.jsonl"))
    files.write_audit_logs(records, str(private / "pii_detection_log.private.jsonl"), str(s.reports_dir / "pii_detection_log.sanitized.jsonl"), s.seed)
    files.write_jsonl(files.mapping(records), str(private / "entity_mapping.private.jsonl"))
    waiting = records.where("policy_action = 'REVIEW'").count()
    target = s.draft_output if waiting else s.final_output
    written = docx.redacted(packages, records).cache()
    _write(written, target)
    errors = list(filter(None, [docx.problems(target.read_bytes(), whole=True)]))
    errors += [f"structure changed: {r.kind}" for r in docx.structure_changes(packages, written).collect()]
    out_blocks = docx.blocks(written).withColumnRenamed("text", "redacted")
    if missed := redact.application_failures(out_blocks, records).count():
        errors.append(f"replacements not applied: {missed}")
    if not waiting and (left := redact.residuals(out_blocks, records).count()):
        errors.append(f"originals left over: {left}")
    summary = reports.summary(records, source_hash, hashlib.sha256(target.read_bytes()).hexdigest(), seed_fingerprint(s.seed), output_path=str(target)) | {"qa_errors": errors}
    reports.write_json(summary, s.reports_dir / "summary_report.json")
    (s.reports_dir / "redaction_tracker.md").write_text(reports.tracker(summary), encoding="utf-8")
    truth = files.gold(spark, str(private / "gold_annotations.jsonl"))
    report = reports.report(records, truth, blocks) | {k: summary[k] for k in ("source_sha256", "output_sha256", "media_total", "media_replaced")}
    reports.write_evaluation(report, s.reports_dir / "qa_report.md", s.reports_dir / "release_validation.csv", "Release report")
    out = {"output_path": str(target), "release_ready": not waiting, "record_count": records.count(), "unresolved_count": waiting, "qa_errors": errors}
    for df in (blocks, records, written):
        df.unpersist()
    return out


def finalize(spark: SparkSession, s: Settings) -> int:
    """Decisions that close the queue of the last run, written beside those there were; their number."""
    said, queue = str(s.private_dir / "review_decisions.jsonl"), files.read_jsonl(spark, str(s.private_dir / "review_queue.jsonl"), "record_id string, source_hash string, pii_type string, identity_id string")
    rows = policy.finalized(queue).collect()
    if rows:
        kind = files.DECISIONS + ", line struct<file:string,at:bigint,n:bigint>"
        new = spark.createDataFrame([(r.record_id, r.source_hash, r.action, None, None, None, r.identity_id, r.note, None) for r in rows], kind)
        old = spark.createDataFrame(files.read_jsonl(spark, said, files.DECISIONS).collect(), kind)  # read whole before it is written over
        files.write_decisions(old, new, rows[0].source_hash, said)
    return len(rows)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    s = load(args.config)
    if args.command == "verify":
        path = Path(args.path) if args.path else s.final_output if s.final_output.exists() else s.draft_output
        bad = docx.problems(path.read_bytes(), whole=True) if path.exists() else "no such file"
        print(json.dumps({"path": str(path.resolve()), "sha256": hashlib.sha256(path.read_bytes()).hexdigest() if path.exists() else None, "errors": [bad] if bad else []}, indent=2))
        return 1 if bad else 0
    spark = spark or SparkSession.builder.getOrCreate()
    if args.command == "benchmark":
        found = engine.records(B.fixtures(spark, samples=False), s.company_scope, None, s.high_threshold, s.medium_threshold).cache()
        report = reports.full_report(found, evaluate.gold(spark), B.fixtures(spark, samples=False))
        reports.write_evaluation(report, s.reports_dir / "benchmark" / "required_types_evaluation.md", s.reports_dir / "benchmark" / "required_types_evaluation.csv", "Benchmark")
        every = all(r["tp"] > 0 for r in report["rows"] if r["pii_type"] in reports.REQUIRED)
        print(json.dumps({"all_required_types_detected": every, "micro": report["micro"]}, indent=2))
        return 0 if every else MISSED
    if args.command == "inspect":
        packages = spark.read.format("binaryFile").load(str(s.input)).select(F.col("path").alias("document"), "content")
        print(json.dumps(docx.inventory(packages).first().asDict() | {"text_blocks": docx.blocks(packages).count()}, indent=2))
        return 0
    if args.command == "review" and args.action == "export":
        path = s.private_dir / "review_queue.jsonl"
        print(json.dumps({"review_queue": str(path), "items": files.read_jsonl(spark, str(path), "record_id string").count()}, indent=2))
        return 0
    result = run(spark, s)
    if args.command == "review" and args.action == "finalize":
        n = finalize(spark, s)
        result = {"finalized_review_items": n} | (run(spark, s) if n else result)
    print(json.dumps(result, indent=2))
    return FAILED if result["qa_errors"] else 0 if result["release_ready"] else DRAFT


if __name__ == "__main__":
    sys.exit(main())
