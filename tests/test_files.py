"""JSON lines, settings, workspaces, reports, relationship targets and the command line."""

import csv
import hashlib
import hmac
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from veilwork import __main__ as cli
from veilwork.functions import checks
from veilwork.operators import evaluate, policy
from veilwork.plans import engine, settings
from veilwork.sources import blocks as B
from veilwork.sources import docx, files, reports

from test_sources import package, run


def test_jsonl_of_decisions(spark, tmp_path):
    path = tmp_path / "d.jsonl"
    assert files.decisions(spark, str(path)).count() == 0
    rows = [{"record_id": "a", "source_hash": "s", "action": "APPROVE"}, {"record_id": "b", "source_hash": "s", "action": "IGNORE", "note": "é"}, {"record_id": "a", "source_hash": "s", "action": "REDACT"}]
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows[:2]) + "\n\n  \n" + json.dumps(rows[2]) + "\n", encoding="utf-8")
    assert {r.record_id: r.action for r in files.decisions(spark, str(path), "s").collect()} == {"a": "REDACT", "b": "IGNORE"}
    for bad in ('{"record_id": "c", "source_hash": "other", "action": "REDACT"}', '{"record_id": "c", "source_hash": "s", "action": "SHRED"}', "no json"):
        path.write_text(bad + "\n")
        with pytest.raises(Exception):  # noqa: B017
            files.decisions(spark, str(path), "s").collect()


def test_upsert_leaves_decisions_of_another_source_out(spark, tmp_path):
    old = spark.createDataFrame([("a", "s", "APPROVE", 1), ("b", "t", "APPROVE", 2)], "record_id string, source_hash string, action string, line int")
    new = spark.createDataFrame([("a", "REDACT", 1), ("c", " ", 2)], "record_id string, action string, line int")
    assert [(r.record_id, r.source_hash, r.action) for r in policy.upserted(old, new, "s").collect()] == [("a", "s", "REDACT")]
    queue = spark.createDataFrame([("a", "s", "COMPANY", "i"), ("b", "s", "PERSON", None)], "record_id string, source_hash string, pii_type string, identity_id string")
    assert {r.record_id: (r.action, r.note.startswith(policy.PRIVACY_FIRST)) for r in policy.finalized(queue).collect()} == {"a": ("PROTECT", True), "b": ("REDACT", True)}
    for bad in (queue.withColumn("source_hash", F.col("record_id")), queue.withColumn("source_hash", F.lit(None).cast("string"))):
        with pytest.raises(Exception):  # noqa: B017
            policy.finalized(bad).collect()


def test_sinks(spark, tmp_path):
    records = engine.run(B.fixtures(spark), b"k").records.cache()
    files.write_audit_logs(records, str(tmp_path / "private"), str(tmp_path / "open"), b"k")
    there = spark.read.json(str(tmp_path / "private"))
    assert there.count() == records.count() and {"original_text", "evidence"} <= set(there.columns)
    shown = spark.read.json(str(tmp_path / "open"))
    assert "original_text" not in shown.columns and "normalized_text" not in shown.columns
    r = records.select("record_id", "pii_type", "normalized_text").first()
    assert shown.where(F.col("record_id") == r.record_id).first().original_fingerprint == hmac.new(b"k", f"{r.pii_type}|{r.normalized_text}".encode(), "sha256").hexdigest()[:20]
    q = files.queue(records, "s")
    assert q.count() == records.where("policy_action = 'REVIEW'").count() and q.first().allowed_actions == sorted(q.first().allowed_actions)
    assert json.loads(files.private(records).first().json)["original_text"]
    blocks = B.fixtures(spark)
    assert files.write_manifest(blocks, "s", str(tmp_path / "m")) and not files.write_manifest(blocks.limit(1), "s", str(tmp_path / "m"))
    assert files.manifest(spark, str(tmp_path / "m")).count() == blocks.count()
    assert files.mapping(records).columns == ["record_id", "pii_type", "original", "replacement", "identity_id"]
    records.unpersist()


def test_settings_and_workspace(tmp_path, monkeypatch):
    (tmp_path / "c.toml").write_text('[paths]\ninput = "in.docx"\nfinal_output = "/x/out.docx"\ndraft_output = "d.docx"\nprivate_dir = "p"\nreports_dir = "r"\n[redaction]\nhigh_threshold = 0.9\nseed_env = "OWN_SEED"\n')
    s = settings.load(tmp_path / "c.toml")
    assert (s.input, str(s.final_output), s.high_threshold, s.medium_threshold, s.company_scope, s.strict_release) == (tmp_path / "in.docx", "/x/out.docx", 0.9, 0.6, "protect", True)
    monkeypatch.delenv("OWN_SEED", raising=False)
    with pytest.raises(RuntimeError):
        s.seed  # noqa: B018
    monkeypatch.setenv("OWN_SEED", "é")
    assert s.seed == "é".encode()
    payload = package(run("x"))
    run_id, w = settings.workspace(tmp_path, "../a b?.docx", payload, "k", mode="mask")
    assert settings.workspace(tmp_path, "a b?.docx", payload, "k", mode="mask")[0] == run_id != settings.workspace(tmp_path, "a", payload, "k")[0]
    assert w.input.read_bytes() == payload and w.input.name == "a_b_.docx" and w.seed == b"k" and w.mode == "mask"
    with pytest.raises(ValueError):
        settings.workspace(tmp_path, "a", b"no package", "k")


def test_hmac_of_long_and_short_keys(spark):
    for key in (b"k", b"x" * 64, b"y" * 65, b"z" * 200):
        got = spark.range(1).select(checks.hmac(key, F.lit("message")).alias("h")).first().h
        assert got == hmac.new(key, b"message", "sha256").hexdigest()
    assert checks.seed_fingerprint(b"s") == hashlib.sha256(b"s").hexdigest()[:16]
    assert [r[0] for r in spark.createDataFrame([(0.5,), (None,), (1234.0,)], "v double").select(checks.formatted(F.col("v"))).collect()] == ["0.5000", "N/A", "1234.0000"]


def test_only_personal_types_take_a_persons_identity(spark):
    text = "Name: John Smith, SSN 219-09-9999, host 10.0.0.1, mail a@b.org"
    blocks = spark.createDataFrame([("p", "d", "b", 0, text)], "document_part string, document string, block_id string, paragraph_index int, text string")
    got = {r.pii_type: r.identity_id for r in engine.records(blocks).collect()}
    assert got["PERSON"] == got["EMAIL"] and got["SSN"].startswith("entity-") and got["IPV4"].startswith("entity-")


def test_reports(spark, tmp_path):
    records, truth = engine.records(B.fixtures(spark, samples=False)), evaluate.gold(spark)
    r = reports.full_report(records, truth, B.fixtures(spark, samples=False))
    assert r["overall"]["tp"] == 9 and 0 < r["overall"]["automatic_precision"] <= 1 and r["block_classification"]["tp"] == 9
    reports.write_evaluation(r, tmp_path / "e.md", tmp_path / "e.csv")
    rows = [*csv.DictReader((tmp_path / "e.csv").open())]
    assert rows[-1]["pii_type"] == "ANY_PII" and "## Confidence bands" in (tmp_path / "e.md").read_text()
    none = reports.report(records, truth.limit(0))
    reports.write_evaluation(none, tmp_path / "n.md", tmp_path / "n.csv")
    assert none["status"] == "RELEASE_VALIDATION" and {x["section"] for x in csv.DictReader((tmp_path / "n.csv").open())} >= {"release", "policy_action", "candidate_type"}
    s = reports.summary(records, "h", None, "f")
    reports.write_json(s, tmp_path / "s.json")
    assert json.loads((tmp_path / "s.json").read_text()) == s and "Full names" in reports.tracker(s)
    assert s["total_candidates"] == records.count() == sum(s["entities_by_type"].values())
    assert reports.bundle([tmp_path / "s.json", tmp_path / "none"], tmp_path / "b.zip") == ["s.json"] == zipfile.ZipFile(tmp_path / "b.zip").namelist()


def test_boxes_of_images_match_greedily(spark):
    schema = "record_id string, pii_type string, document_part string, block_id string, start_offset int, end_offset int, review_status string, source_kind string, media_name string, bounding_box array<int>"
    p = spark.createDataFrame([("1", "QR_CODE", "m", "m", 0, 1, "AUTO_APPROVED", "image", "m", [0, 0, 10, 10]), ("2", "QR_CODE", "m", "m", 0, 1, "NEEDS_REVIEW", "image", "m", [0, 0, 10, 4]), ("3", "QR_CODE", "n", "n", 0, 1, "AUTO_APPROVED", "image", "n", None)], schema)
    g = spark.createDataFrame([("QR_CODE", "m", "m", 5, 6, "image", "m", [0, 0, 10, 8]), ("QR_CODE", "o", "o", 5, 6, "image", "o", [0, 0, 1, 1])], "pii_type string, document_part string, block_id string, start_offset int, end_offset int, source_kind string, media_name string, bounding_box array<int>")
    got = evaluate.images(p, g).collect()
    assert len(got) == 1 and got[0].iou >= 0.5
    r = evaluate.overall(p, g).first()
    assert (r.tp, r.fp, r.fn, r.review_workload, r.image_coverage) == (1, 2, 1, pytest.approx(1 / 3), 1.0)


def test_external_targets_and_whole_checks():
    rels = b'<Relationships><Relationship Id="1" Target="mailto:JOHN@x.org?a=1&amp;b" TargetMode="External"/><Relationship Id="2" Target="john@x.org.xml"/></Relationships>'
    c = package(run("x"), **{"word/_rels/document.xml.rels": rels})
    out = docx.rewritten(c, {}, None, {"john@x.org": 'a&"b', "john": "no"})
    got = zipfile.ZipFile(__import__("io").BytesIO(out)).read("word/_rels/document.xml.rels")
    assert b'Target="mailto:a&amp;&quot;b?a=1&amp;b"' in got and b'Target="john@x.org.xml"' in got
    assert docx.problems(out) is None
    assert docx.problems(package("<w:p>"), whole=True).startswith("cannot be read again") and docx.problems(package("<w:p>")) is None
    at = c.index(b"PNG")
    assert docx.problems(c[:at] + b"XXX" + c[at + 3 :], whole=True) == "corrupt part word/media/image1.png"


def test_table_contexts():
    cell = lambda t: f"<w:tc>{run(t)}</w:tc>"
    body = run("out") + "<w:tbl><w:tr>" + cell("a" * 130) + cell(" ") + "".join(cell(f"c{k}") for k in range(9)) + "</w:tr></w:tbl><w:tc>" + run("alone") + "</w:tc>"
    xml = f'<w:document xmlns:w="{docx.W}"><w:body>{body}</w:body></w:document>'.encode()
    row = " | ".join(["a" * 120, *[f"c{k}" for k in range(7)]])
    assert docx.table_contexts(xml) == ["", *[row] * 11, "table-cell"]


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("PII_REDACTION_SEED", "k")
    (tmp_path / "in.docx").write_bytes(package(run("Email: a@b.org") + run("Call 022 4567 8901, telephone") + run("Nothing")))
    (tmp_path / "c.toml").write_text('[paths]\ninput = "in.docx"\nfinal_output = "o/final.docx"\ndraft_output = "o/draft.docx"\nprivate_dir = "p"\nreports_dir = "r"\n')
    at = ["--config", str(tmp_path / "c.toml")]
    call = lambda *a: (cli.main([*at, *a], spark), json.loads(capsys.readouterr().out))
    code, out = call("run-all")
    assert code == cli.DRAFT and out["unresolved_count"] >= 1 and out["qa_errors"] == [] and out["output_path"].endswith("draft.docx")
    assert call("review", "export")[1]["items"] == out["unresolved_count"]
    code, out = call("review", "finalize")
    assert code == 0 and out["finalized_review_items"] >= 1 and out["release_ready"]
    code, out = call("verify")
    assert code == 0 and out["errors"] == [] and out["path"].endswith("final.docx")
    assert all("a@b.org" not in b[3] for b in docx.blocks_of((tmp_path / "o" / "final.docx").read_bytes()))
    assert json.loads((tmp_path / "r" / "summary_report.json").read_text())["release_ready"]
    assert call("inspect")[1]["text_blocks"] >= 3
    assert call("benchmark")[0] == 0
