"""Images of packages: what a reader finds in them, which are sensitive, and what is put in their place.

The reader (text recognition and code decoding) is the caller's, as Spark has none; it runs on the executors.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions.constants import AUTO, IDENTITY_TERMS
from ..operators import detect, resolve
from .docx import image_size

Reader = Callable[[bytes], tuple[str, str]]
STRUCTURED = [r for r in detect.RECOGNIZERS if r.source != "NER"]
#: fixed values: the hex digits as five rows of three pixels
GLYPHS = {"0": "75557", "1": "26227", "2": "71747", "3": "71717", "4": "55711", "5": "74717", "6": "74757", "7": "71111", "8": "75757", "9": "75717", "A": "75755", "B": "65656", "C": "74447", "D": "65556", "E": "74747", "F": "74744"}


def nothing(raw: bytes) -> tuple[str, str]:
    """The reader where none is at hand: no text, no code."""
    return "", ""


def read(packages: DataFrame, reader: Reader = nothing) -> DataFrame:
    """(document, media_name, source_sha256, readable, width, height, ocr_text, qr_value) of each image; where the reader
    fails, an image has no text and no code."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in parts:
            rows = []
            for d, c in zip(f["document"], f["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(c)) as z:
                    for n in z.namelist():
                        if n.startswith("word/media/"):
                            raw = z.read(n)
                            size = image_size(raw)
                            try:
                                text, code = reader(raw) if size else ("", "")
                            except Exception:  # noqa: BLE001 - a reader's own errors must not stop the run
                                text, code = "", ""
                            rows.append((d, n, hashlib.sha256(raw).hexdigest(), size is not None, *(size or (0, 0)), text.strip(), code))
            yield pd.DataFrame(rows, columns=["document", "media_name", "source_sha256", "readable", "width", "height", "ocr_text", "qr_value"])

    return packages.mapInPandas(run, "document string, media_name string, source_sha256 string, readable boolean, width int, height int, ocr_text string, qr_value string")


def _searched(images: DataFrame) -> DataFrame:
    rows = images.where("readable").withColumns({"document_part": F.col("media_name"), "block_id": F.concat("document", F.lit("!media:"), "media_name"), "text": F.coalesce("ocr_text", F.lit(""))})
    low = S.folded(F.col("text"))
    terms = F.filter(F.array(*[F.when(low.contains(t), F.lit(t)) for t in IDENTITY_TERMS]), lambda x: x.isNotNull())
    return detect.detected(rows, STRUCTURED).withColumn("identity_terms", terms)


def _image(kind: str, value: Column, score: float, source: str, name: str) -> Column:
    status = "AUTO_APPROVED" if score >= AUTO else "REJECTED"
    evidence = F.array(F.struct(F.lit(source).alias("source"), F.lit(name).alias("name"), F.lit(score).alias("score")))
    return F.struct(F.lit(kind).alias("pii_type"), F.lit(0).alias("s"), F.char_length(value).alias("e"), value.alias("v"), evidence.alias("evidence"), F.lit(score).alias("confidence"), F.lit(status).alias("status"), F.lit(-1).alias("det_ord"))


def records(images: DataFrame) -> DataFrame:
    """Records of the images in the engine's form, with media_name and source_kind (ocr_text or image).

    Values in recognised text come from the structured detectors, each with further evidence of the recognition (0.55).
    The image itself is BIOMETRIC where a term of an identity document stands in its text, else COMPANY where it has text;
    a decoded code is QR_CODE; a small square without one is a rejected candidate.
    """
    text, code = F.col("text"), F.coalesce("qr_value", F.lit(""))
    square = (F.col("width") <= 400) & (F.col("height") <= 400) & (F.abs(F.col("width") - F.col("height")) <= 0.35 * F.greatest("width", "height"))
    first = F.when(F.size("identity_terms") > 0, _image("BIOMETRIC", F.lit("identity-document-media"), 0.98, "OCR", "identity_document")).when(text != "", _image("COMPANY", F.substring(text, 1, 160), 0.85, "OCR", "organisation_text"))
    second = F.when(code != "", _image("QR_CODE", code, 0.98, "QR_DETECTOR", "decoded_code")).when(square, _image("QR_CODE", F.lit("undecoded-qr-like-media"), 0.55, "QR_DETECTOR", "square_geometry"))
    seen = F.transform("found", lambda x: F.struct(x["pii_type"].alias("pii_type"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), F.lit(0.55).alias("score"), F.lit("OCR").alias("source"), F.lit("text_recognition").alias("name")))
    both = S.held(_searched(images).withColumn("found", F.concat("found", seen.cast(detect.FOUND))), "found")
    spans = F.concat(resolve.merged(F.col("found")), F.array_compact(F.array(first, second)).cast(resolve.MERGED))
    rows = resolve.records(S.held(both.withColumn("spans", spans), "spans"))
    return rows.withColumns({"media_name": F.col("document_part"), "source_kind": F.when(F.col("det_ord") < 0, "image").otherwise("ocr_text")})


def inventory(images: DataFrame, replace_all: bool = False) -> DataFrame:
    """Each image with its size, hash, what was found and whether it is to be replaced; an image that is none is not."""
    rows = _searched(images).select("document", "media_name", F.col("identity_terms").alias("_terms"), (F.size("found") > 0).alias("_values"))
    code = F.coalesce(F.col("qr_value") != "", F.lit(False))
    sensitive = F.coalesce((F.size("_terms") > 0) | F.col("_values"), F.lit(False)) | code
    return images.join(rows, ["document", "media_name"], "left").select("document", "media_name", "readable", "width", "height", "source_sha256", F.coalesce(F.char_length("ocr_text"), F.lit(0)).alias("ocr_characters"), code.alias("qr_decoded"), F.coalesce("_terms", F.array().cast("array<string>")).alias("identity_terms"), sensitive.alias("sensitive_evidence"), (F.col("readable") & (F.lit(replace_all) | sensitive)).alias("replaced"))


def to_replace(found: DataFrame, media_records: DataFrame, replace_all: bool = False) -> DataFrame:
    """Rows of an inventory to be replaced: those with a record to redact, or all; none that a decision clears.

    media_records are records of images after policy; `decision` is used if it is there.
    """
    cleared = F.coalesce(F.col("decision").isin("IGNORE", "CLEAR_MEDIA"), F.lit(False)) if "decision" in media_records.columns else F.lit(False)
    marks = media_records.groupBy("document", "media_name").agg(F.bool_or(F.col("policy_action") == "REDACT").alias("_redact"), F.bool_or(cleared).alias("_cleared"))
    rows = found.where("replaced").join(marks, ["document", "media_name"], "left")
    return rows.where(~F.coalesce("_cleared", F.lit(False)) & (F.lit(replace_all) | F.coalesce("_redact", F.lit(False)))).drop("_redact", "_cleared")


def placeholder(name: str, width: int, height: int) -> bytes:
    """A grey PNG of at least 64 x 40 that shows the first ten hex digits of the name's hash."""
    w, h = max(int(width), 64), max(int(height), 40)
    label = hashlib.sha256(name.encode()).hexdigest()[:10].upper()
    left, top = (w - 4 * len(label)) // 2, (h - 5) // 2
    packer = zlib.compressobj()
    body = []
    for y in range(h):
        row = bytearray(w)
        if 0 <= y - top < 5:
            for k, c in enumerate(label):
                for x in range(3):
                    row[left + 4 * k + x] = int(GLYPHS[c][y - top]) >> (2 - x) & 1
        body.append(packer.compress(b"\0" + row))
    body.append(packer.flush())

    def chunk(kind: bytes, data: bytes) -> bytes:
        return len(data).to_bytes(4) + kind + data + zlib.crc32(kind + data).to_bytes(4)

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", w.to_bytes(4) + h.to_bytes(4) + b"\x08\x03\0\0\0") + chunk(b"PLTE", bytes.fromhex("e6e8eb37414f")) + chunk(b"IDAT", b"".join(body)) + chunk(b"IEND", b"")
