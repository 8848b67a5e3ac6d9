"""Review decisions, images of packages and the structure check."""

import zlib

import pytest

from veilwork.operators import policy
from veilwork.sources import docx, media

from test_sources import PNG, package, run

FORM = "record_id string, action string, new_type string, identity_id string, note string, new_start_offset int, new_end_offset int, line int"


RECORD = "record_id string, block_id string, pii_type string, start_offset int, end_offset int, original_text string, normalized_text string, evidence array<struct<source:string,name:string,score:double>>, final_confidence double, review_status string"


def _decided(spark, decisions):
    """Rows by record id, where each decision (record id, action, ...) meets the same made-up record."""
    names = dict.fromkeys(d[0] for d in decisions)
    rows = [(n, n, "EMAIL", 5, 20, "ann@example.com", "ann@example.com", [("PATTERN", "email", 0.95)], 0.95, "AUTO_APPROVED") for n in names]
    blocks = spark.createDataFrame([(n, "Mail ann@example.com now") for n in names], "block_id string, text string")
    found = policy.decided(spark.createDataFrame(rows, RECORD), spark.createDataFrame([(*d, k) for k, d in enumerate(decisions)], FORM), blocks)
    return {r.record_id: r for r in policy.with_identity(policy.with_policy(found)).collect()}


def test_every_action(spark):
    plain = (None, None, None, None, None)
    seen = _decided(spark, [*[(a, a, *plain) for a in ("APPROVE", "PROTECT", "CLEAR_MEDIA", "REJECT_AS_NON_PII", "RETYPE")], ("p", "PROTECT", None, None, f"{policy.PRIVACY_FIRST} keep", None, None), ("l", "LINK_IDENTITY", None, "person-x", None, None, None), ("n", "LINK_IDENTITY", *plain), ("t", "APPROVE", *plain), ("t", "RETYPE", "PERSON", None, None, None, None), ("m", "ADJUST_SPAN", None, None, None, 5, 8)])
    assert {a: (r.review_status, r.policy_action) for a, r in seen.items() if len(a) > 1} == {"APPROVE": ("APPROVED", "REDACT"), "PROTECT": ("APPROVED", "PROTECT"), "CLEAR_MEDIA": ("APPROVED", "IGNORE"), "REJECT_AS_NON_PII": ("REJECTED", "IGNORE"), "RETYPE": ("AUTO_APPROVED", "REDACT")}
    assert [tuple(x) for x in seen["APPROVE"].evidence] == [("PATTERN", "email", 0.95), ("HUMAN_REVIEW", "human_approve", 1.0)]
    assert tuple(seen["p"].evidence[-1]) == ("POLICY", "policy_protect", 1.0)
    assert seen["l"].identity_id == "person-x" and seen["n"].review_status == "AUTO_APPROVED" and seen["n"].identity_id.startswith("entity-")
    assert (seen["t"].pii_type, len(seen["t"].evidence)) == ("PERSON", 2)
    r = seen["m"]
    assert (r.original_text, r.normalized_text, r.start_offset, r.end_offset, r.review_status) == ("ann", "ann", 5, 8, "APPROVED")


@pytest.mark.parametrize(("s", "e"), [(None, None), (8, 5), (0, 1000)])
def test_wrong_spans_are_refused(spark, s, e):
    with pytest.raises(Exception, match="ADJUST_SPAN"):
        _decided(spark, [("m", "ADJUST_SPAN", None, None, None, s, e)])


def _reader():
    def one(raw: bytes) -> tuple[str, str]:
        if raw.endswith(b"id"):
            return "Government of India\nmail ann@example.com", ""
        if raw.endswith(b"qr"):
            return "", "https://example.com"
        if raw.endswith(b"bad"):
            raise ValueError
        return ("Acme Widgets", "") if raw.endswith(b"logo") else ("", "")

    return one


def _packages(spark):
    extra = {f"word/media/{n}.png": PNG + n.encode() for n in ("id", "qr", "bad", "logo")} | {"word/media/none.png": b"no image"}
    return spark.createDataFrame([("d", bytearray(package(run("x"), **extra)))], "document string, content binary")


def test_images_are_found_and_replaced(spark):
    packages = _packages(spark)
    images = media.read(packages, _reader())
    rows = policy.with_policy(media.records(images))
    got = rows.collect()
    weak = ("QR_CODE", "undecoded-qr-like-media", 0.55, "REJECTED", "image")
    assert {(r.media_name[11:-4], r.pii_type, r.original_text, round(r.final_confidence, 2), r.review_status, r.source_kind) for r in got} == {("id", "EMAIL", "ann@example.com", 0.99, "AUTO_APPROVED", "ocr_text"), ("id", "BIOMETRIC", "identity-document-media", 0.98, "AUTO_APPROVED", "image"), ("qr", "QR_CODE", "https://example.com", 0.98, "AUTO_APPROVED", "image"), ("logo", "COMPANY", "Acme Widgets", 0.85, "AUTO_APPROVED", "image"), *[(n, *weak) for n in ("id", "bad", "logo", "image1")]}
    listed = media.inventory(images)
    found = {r.media_name[11:-4]: r for r in listed.collect()}
    assert {n for n, r in found.items() if r.replaced} == {"id", "qr"} and not found["none"].readable and len(found) == 6
    assert found["id"].identity_terms == ["government of india"]
    listed = spark.createDataFrame(list(found.values()), listed.schema)
    rows = spark.createDataFrame(got, rows.schema)
    chosen = media.to_replace(listed, rows)
    assert {r.media_name[11:-4] for r in chosen.collect()} == {"id", "qr"}
    assert media.to_replace(listed, rows.selectExpr("*", "'CLEAR_MEDIA' AS decision"), replace_all=True).count() == 0
    empty = spark.createDataFrame([], "document string, block_id string, start_offset int, end_offset int, replacement_value string")
    after = docx.redacted(packages, empty, chosen)
    old, new = ({r.media_name: r.source_sha256 for r in media.read(p).collect()} for p in (packages, after))
    assert {n[11:-4] for n in old if old[n] != new[n]} == {"id", "qr"}
    assert docx.structure_changes(packages, after).count() == 0 and {r.kind: r.n for r in docx.structure(after).collect()}["p"] == 2


def test_a_placeholder_is_a_whole_png():
    raw = media.placeholder("word/media/a.png", 10, 300)
    assert docx.image_size(raw) == (64, 300)
    at, data = 8, b""
    while at < len(raw):
        n, kind = int.from_bytes(raw[at : at + 4]), raw[at + 4 : at + 8]
        assert zlib.crc32(raw[at + 4 : at + 8 + n]) == int.from_bytes(raw[at + 8 + n : at + 12 + n])
        data += raw[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    plain = zlib.decompress(data)
    assert len(plain) == 300 * 65 and set(plain) == {0, 1}
