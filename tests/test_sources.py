"""DOCX packages and streams."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from veilwork.plans import engine
from veilwork.sources import blocks as B
from veilwork.sources import docx
from veilwork.streaming.detect import stream_records, write_records

PNG = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (80).to_bytes(4) + (64).to_bytes(4)


def package(body: str, **extra: bytes) -> bytes:
    xml = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{docx.W}" xmlns:x="u"><w:body>{body}</w:body></w:document>'
    parts = {"[Content_Types].xml": b'<Types><Override PartName="/docProps/custom.xml" ContentType="c"/></Types>', "_rels/.rels": b"<Relationships/>", "word/document.xml": xml.encode(), "docProps/core.xml": b"<c:p><dc:creator>Jo</dc:creator></c:p>", "docProps/custom.xml": b"<x/>", "word/media/image1.png": PNG, "word/header1.xml": xml.replace("x=", "y=").encode()} | extra
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, c in parts.items():
            z.writestr(n, c)
    return out.getvalue()


def run(*texts: str) -> str:
    return "<w:p>" + "".join(f'<w:r w:rsidR="00A1"><w:t xml:space="preserve">{t}</w:t></w:r>' for t in texts) + "</w:p>"


def test_blocks_keep_gaps_and_join_runs():
    c = package(run("Tom &amp; ", "Ann") + run(" ") + run("é😀") + "<w:tbl><w:tc>" + run("cell") + "</w:tc></w:tbl>")
    assert [b[1:] for b in docx.blocks_of(c) if b[0] == "word/document.xml"] == [("word/document.xml#p0", 0, "Tom & Ann"), ("word/document.xml#p2", 2, "é😀"), ("word/document.xml#p3", 3, "cell")]
    assert docx.blocks_of(package("<w:p><w:broken>")) == []


def test_spans_across_runs_and_metadata():
    c = package(run("Mail john.", "smith@ex", "ample.com, &lt;ok&gt;") + run("next"))
    out = docx.rewritten(c, {"word/document.xml#p0": [(5, 27, "a<b@x.test")]})
    assert docx.blocks_of(out)[0][3] != "" and [b[3] for b in docx.blocks_of(out) if b[0] == "word/document.xml"] == ["Mail a<b@x.test, <ok>", "next"]
    with zipfile.ZipFile(io.BytesIO(out)) as z:
        assert "docProps/custom.xml" not in z.namelist() and b"Jo" not in z.read("docProps/core.xml") and b"rsid" not in z.read("word/document.xml") and b"custom" not in z.read("[Content_Types].xml")
        assert z.read("word/media/image1.png") == PNG
    with pytest.raises(KeyError):
        docx.rewritten(c, {}, {"word/media/none.png": b""})


def test_uploads_are_checked():
    assert docx.problems(package(run("x"))) is None
    assert docx.problems(b"no") == "not a package"
    assert docx.problems(package(run("x"), **{"../evil": b""})) == "unsafe path"


def test_a_folder_of_packages_end_to_end(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"d{k}.docx").write_bytes(package(run(f"Email: a{k}@", "example.com") + run("Client IP: 8.8.8.8")))
    files = docx.files(spark, str(tmp_path))
    inv = docx.inventory(files).collect()
    assert len(inv) == 3 and all(r.problem is None and r.text_parts == 2 and r.media == 1 for r in inv)
    assert [(r.width, r.height, r.small_square) for r in docx.media(files).limit(1).collect()] == [(80, 64, True)]
    result = engine.run(docx.blocks(files), b"seed")
    for r in docx.redacted(files, result.records).collect():
        text = " ".join(b[3] for b in docx.blocks_of(r.content))
        assert "example.test" in text and "198.51.100." in text and "8.8.8.8" not in text and "example.com" not in text


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, b[4]) for k, b in enumerate(B.fixtures(spark).collect())]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    write_records(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    key = ["record_id", "policy_action", F.round("final_confidence", 6)]
    assert sorted(spark.read.parquet(str(tmp_path / "out")).select(*key).collect()) == sorted(stream_records(table).select(*key).collect())
