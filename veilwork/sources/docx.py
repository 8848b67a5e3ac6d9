"""DOCX packages as rows: blocks, inventory, media, checks, and rewritten packages; standard library only.

A package is one row of Spark's binaryFile source and is handled whole in one task; LIMITS bound its size.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from xml.parsers import expat
from xml.sax.saxutils import escape, unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
LIMITS = {"bytes": 100 << 20, "parts": 5000, "expanded": 300 << 20}
REQUIRED = ("[Content_Types].xml", "_rels/.rels", "word/document.xml")
_TEXT_PARTS = ("word/header", "word/footer", "word/footnotes", "word/endnotes", "word/comments")


def is_text_part(name: str) -> bool:
    return name == "word/document.xml" or (name.startswith(_TEXT_PARTS) and name.endswith(".xml"))


def paragraphs(xml: bytes) -> list[list[tuple[int, int, str]]]:
    """Text nodes of every paragraph in document order, as (first byte, end byte, text); a nested paragraph's nodes belong
    to those around it, too. Bad XML gives none."""
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True
    out: list[list] = []
    open_: list[int] = []
    node: list = []

    def start(name: str, attributes: dict) -> None:
        if name == f"{W} p":
            open_.append(len(out))
            out.append([])
        elif name == f"{W} t":
            node[:] = [xml.index(b">", parser.CurrentByteIndex) + 1, ""]

    def data(text: str) -> None:
        if node:
            node[1] += text

    def end(name: str) -> None:
        if name == f"{W} p":
            open_.pop()
        elif name == f"{W} t" and node:
            for p in open_:
                out[p].append((node[0], parser.CurrentByteIndex, node[1]))
            node.clear()

    parser.StartElementHandler, parser.CharacterDataHandler, parser.EndElementHandler = start, data, end
    try:
        parser.Parse(xml, True)
    except (expat.ExpatError, ValueError):
        return []
    return out


def table_contexts(xml: bytes, cells: int = 8, width: int = 120) -> list[str]:
    """For every paragraph, the row of the innermost table cell around it: its first non-empty cells, each cut, " | " between.

    Empty outside tables, "table-cell" in a cell without a row.
    """
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True
    stack: list[tuple[str, list | None]] = []  # (tag, the row's cells or the cell's pieces of text)
    out: list[list | str] = []
    node = [False]

    def start(name: str, attributes: dict) -> None:
        space, _, tag = name.rpartition(" ")
        tag = tag if space == W else ""
        if tag == "p":
            inside = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "tc"), None)
            rows = [x for t, x in stack[: inside or 0] if t == "tr"]
            out.append("" if inside is None else rows[-1] if rows else "table-cell")
        held: list | None = [] if tag in ("tr", "tc") else None
        if tag == "tc" and stack and stack[-1][0] == "tr":
            stack[-1][1].append(held)
        stack.append((tag, held))
        node[0] = tag == "t"

    def data(text: str) -> None:
        if node[0]:
            for tag, held in stack:
                if tag == "tc":
                    held.append(text)

    def end(name: str) -> None:
        node[0] = False
        stack.pop()

    parser.StartElementHandler, parser.CharacterDataHandler, parser.EndElementHandler = start, data, end
    try:
        parser.Parse(xml, True)
    except expat.ExpatError:
        return []
    shown = lambda row: " | ".join([v[:width] for c in row if (v := "".join(c).strip())][:cells])
    return [x if isinstance(x, str) else shown(x) for x in out]


def blocks_of(content: bytes) -> list[tuple[str, str, int, str]]:
    """(part, block id, paragraph index, text) in order of part names; blank paragraphs leave gaps in the index."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        found = []
        for part in sorted(filter(is_text_part, z.namelist())):
            for k, nodes in enumerate(paragraphs(z.read(part))):
                if (text := "".join(n[2] for n in nodes)).strip():
                    found.append((part, f"{part}#p{k}", k, text))
        return found


def problems(content: bytes, whole: bool = False) -> str | None:
    """The first reason to refuse an upload, or None; with `whole`, every part is read, against its checksum, and parsed."""
    if len(content) > LIMITS["bytes"]:
        return "too large"
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            parts = z.infolist()
    except zipfile.BadZipFile:
        return "not a package"
    names = {p.filename for p in parts}
    if len(parts) > LIMITS["parts"]:
        return "too many parts"
    if not {"[Content_Types].xml", "word/document.xml"} <= names:
        return "parts are missing"
    if sum(p.file_size for p in parts) > LIMITS["expanded"]:
        return "expands too far"
    if any(p.flag_bits & 1 for p in parts):
        return "encrypted"
    if any(n.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", n) for n in names):
        return "unsafe path"
    if whole:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            try:
                if bad := z.testzip():
                    return f"corrupt part {bad}"
                for n in names:
                    if n.endswith((".xml", ".rels")):
                        part = n
                        expat.ParserCreate().Parse(z.read(n), True)
            except zipfile.BadZipFile as e:
                return f"corrupt package: {e}"
            except expat.ExpatError as e:
                return f"cannot be read again: {part}: {e}"
    return None


def retargeted(xml: bytes, values: dict[str, str]) -> bytes:
    """A relationships part in which the external targets have every original replaced, the longest first, case aside."""
    known = {k.lower(): v for k, v in values.items() if k and v}
    if not known:
        return xml
    pattern = re.compile("|".join(map(re.escape, sorted(known, key=lambda k: (-len(k), k)))), re.IGNORECASE)
    quoted = {'"': "&quot;"}

    def element(m: re.Match) -> bytes:
        if not re.search(rb'\bTargetMode\s*=\s*(["\'])External\1', m[0]):
            return m[0]

        def target(t: re.Match) -> bytes:
            plain = unescape(t[3].decode(), {"&quot;": '"', "&apos;": "'"})
            new = pattern.sub(lambda x: known.get(x.group().lower(), x.group()), plain)
            return t[0] if new == plain else t[1] + b'"' + escape(new, quoted).encode() + b'"'

        return re.sub(rb'(\bTarget\s*=\s*)(["\'])(.*?)\2', target, m[0], flags=re.DOTALL)

    return re.sub(rb"<(?:\w+:)?Relationship\b[^>]*>", element, xml)


def scrubbed(name: str, xml: bytes) -> bytes | None:
    """A part without author names and custom properties; None to leave it out."""
    if name == "docProps/custom.xml":
        return None
    if name in ("docProps/core.xml", "docProps/app.xml"):
        return re.sub(rb"(<(?:\w+:)?(creator|lastModifiedBy|Company|Manager)(?:\s[^>]*)?>)[^<]*", rb"\1", xml)
    if name == "[Content_Types].xml":
        return re.sub(rb'<Override\b[^>]*PartName="/docProps/custom\.xml"[^>]*/>', b"", xml)
    if name == "_rels/.rels":
        return re.sub(rb'<Relationship\b[^>]*Target="/?docProps/custom\.xml"[^>]*/>', b"", xml)
    if name.startswith("word/") and name.endswith(".xml"):
        return re.sub(rb'\s(?:\w+:)?rsid\w*="[^"]*"', b"", xml)
    return xml


def rewritten_part(xml: bytes, spans: dict[int, list[tuple[int, int, str]]]) -> bytes:
    """xml with spans (start, end, value) of its paragraphs replaced: the value goes into the first run it touches, runs
    between are emptied, the last keeps its tail. Only text bytes change."""
    edits: dict[int, tuple[int, str]] = {}
    for k, nodes in reversed(list(enumerate(paragraphs(xml)))):  # inner paragraphs come later and go first
        at = 0
        todo = sorted(spans.get(k, []))
        for first, end, text in nodes:
            low, high, out, cursor = at, at + len(text), "", at
            for s, e, value in todo:
                if s < high and e > low:
                    out += text[cursor - low : max(s, low) - low] + (value if s >= low else "")
                    cursor = min(e, high)
            if cursor > low or out:
                edits.setdefault(first, (end, out + text[cursor - low :]))
            at = high
    parts, at = [], 0
    for first in sorted(edits):
        end, text = edits[first]
        parts += [xml[at:first], escape(text).encode()]
        at = end
    return b"".join([*parts, xml[at:]])


def rewritten(content: bytes, spans: dict[str, list[tuple[int, int, str]]], media: dict[str, bytes] | None = None, values: dict[str, str] | None = None) -> bytes:
    """The package with spans by block id replaced, media swapped, originals in external targets replaced by `values`, and
    metadata scrubbed; other entries as they were."""
    by_part: dict[str, dict[int, list]] = {}
    for block, some in spans.items():
        part, _, k = block.rpartition("#p")
        by_part.setdefault(part, {})[int(k)] = some
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as to:
        if missing := set(media or ()) - set(z.namelist()):
            raise KeyError(f"no such media: {sorted(missing)}")
        for info in z.infolist():
            raw = (media or {}).get(info.filename, z.read(info.filename))
            if info.filename in by_part:
                raw = rewritten_part(raw, by_part[info.filename])
            raw = scrubbed(info.filename, raw)
            if raw is not None and info.filename.endswith(".rels"):
                raw = retargeted(raw, values or {})
            if raw is not None:
                to.writestr(info.filename, raw)
    return out.getvalue()


def image_size(raw: bytes) -> tuple[int, int] | None:
    """Width and height from a PNG, GIF or JPEG header."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and len(raw) >= 24:
        return int.from_bytes(raw[16:20]), int.from_bytes(raw[20:24])
    if raw[:4] == b"GIF8" and len(raw) >= 10:
        return int.from_bytes(raw[6:8], "little"), int.from_bytes(raw[8:10], "little")
    at = 2
    while raw[:2] == b"\xff\xd8" and at + 9 < len(raw) and raw[at] == 0xFF:
        if 0xC0 <= raw[at + 1] <= 0xCF and raw[at + 1] not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(raw[at + 7 : at + 9]), int.from_bytes(raw[at + 5 : at + 7])
        at += 2 + int.from_bytes(raw[at + 2 : at + 4])
    return None


def files(spark: SparkSession, path: str) -> DataFrame:
    """(document, content) of every .docx under a path."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return rows.select(F.col("path").alias("document"), "content")


def blocks(packages: DataFrame) -> DataFrame:
    """Blocks of the engine's form; block ids are unique by document."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in parts:
            rows = [(part, d, f"{d}!{b}", k, t) for d, c in zip(f["document"], f["content"], strict=True) for part, b, k, t in blocks_of(c)]
            yield pd.DataFrame(rows, columns=["document_part", "document", "block_id", "paragraph_index", "text"])

    return packages.mapInPandas(run, "document_part string, document string, block_id string, paragraph_index int, text string")


def contexts(packages: DataFrame) -> DataFrame:
    """(document, block_id, table_context) of the blocks that stand in tables."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in parts:
            rows = []
            for d, c in zip(f["document"], f["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(c)) as z:
                    known = {part: table_contexts(z.read(part)) for part in filter(is_text_part, z.namelist())}
                rows += [(d, f"{d}!{b}", known[part][k]) for part, b, k, _ in blocks_of(c) if known[part][k]]
            yield pd.DataFrame(rows, columns=["document", "block_id", "table_context"])

    return packages.mapInPandas(run, "document string, block_id string, table_context string")


def inventory(packages: DataFrame) -> DataFrame:
    """(document, source_hash, parts, text_parts, media, problem) of each package."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in parts:
            rows = []
            for d, c in zip(f["document"], f["content"], strict=True):
                bad = problems(c)
                names = [] if bad else zipfile.ZipFile(io.BytesIO(c)).namelist()
                rows.append((d, hashlib.sha256(c).hexdigest(), len(names), sum(map(is_text_part, names)), sum(n.startswith("word/media/") for n in names), bad))
            yield pd.DataFrame(rows, columns=["document", "source_hash", "parts", "text_parts", "media", "problem"])

    return packages.mapInPandas(run, "document string, source_hash string, parts int, text_parts int, media int, problem string")


def media(packages: DataFrame) -> DataFrame:
    """(document, media_name, source_sha256, readable, width, height, small_square) of each image; small squares may be codes."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in parts:
            rows = []
            for d, c in zip(f["document"], f["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(c)) as z:
                    for n in z.namelist():
                        if n.startswith("word/media/"):
                            raw = z.read(n)
                            w, h = image_size(raw) or (None, None)
                            square = w is not None and w <= 400 and h <= 400 and abs(w - h) <= 0.35 * max(w, h)
                            rows.append((d, n, hashlib.sha256(raw).hexdigest(), w is not None, w, h, square))
            yield pd.DataFrame(rows, columns=["document", "media_name", "source_sha256", "readable", "width", "height", "small_square"])

    return packages.mapInPandas(run, "document string, media_name string, source_sha256 string, readable boolean, width int, height int, small_square boolean")


def redacted(packages: DataFrame, records: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(document, content) with every replacement of the records written into its package, and each image of `images`
    (document, media_name, width, height) replaced by a placeholder."""
    spans = records.where("replacement_value IS NOT NULL AND NOT contains(block_id, '!media:')").groupBy("document").agg(F.collect_list(F.struct("block_id", "start_offset", "end_offset", "replacement_value")).alias("spans"))
    # in external targets, the last replacement of an original counts, those of images included; none without originals
    known = records if "original_text" in records.columns else records.withColumn("original_text", F.lit(None).cast("string"))
    last = known.where("original_text IS NOT NULL").where("replacement_value IS NOT NULL").groupBy("document", "original_text").agg(F.max_by("replacement_value", F.struct("block_id", "start_offset")).alias("v"))
    rows = packages.join(spans, "document", "left").join(last.groupBy("document").agg(F.map_from_entries(F.collect_list(F.struct("original_text", "v"))).alias("values")), "document", "left")
    if images is None:
        rows = rows.withColumn("images", F.lit(None).cast("array<struct<media_name:string,width:int,height:int>>"))
    else:
        rows = rows.join(images.groupBy("document").agg(F.collect_list(F.struct("media_name", "width", "height")).alias("images")), "document", "left")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .media import placeholder

        for f in parts:
            out = []
            for d, c, some, swaps, values in zip(f["document"], f["content"], f["spans"], f["images"], f["values"], strict=True):
                by: dict[str, list] = {}
                for x in some if some is not None else ():
                    by.setdefault(x["block_id"].removeprefix(f"{d}!"), []).append((x["start_offset"], x["end_offset"], x["replacement_value"]))
                out.append(rewritten(c, by, {x["media_name"]: placeholder(x["media_name"], x["width"], x["height"]) for x in (swaps if swaps is not None else ())}, dict(values or {})))
            yield pd.DataFrame({"document": f["document"], "content": out})

    return rows.mapInPandas(run, "document string, content binary")


KINDS = ("p", "tbl", "tr", "tc", "sectPr", "drawing", "hdr", "ftr")


def structure(packages: DataFrame) -> DataFrame:
    """(document, kind, n): elements of each kind in a package's parts; redaction must leave these counts as they are."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in parts:
            rows = []
            for d, c in zip(f["document"], f["content"], strict=True):
                n = dict.fromkeys(KINDS, 0)

                def start(name: str, attributes: dict, n: dict = n) -> None:
                    space, _, kind = name.rpartition(" ")
                    if space == W and kind in n:
                        n[kind] += 1

                with zipfile.ZipFile(io.BytesIO(c)) as z:
                    for part in z.namelist():
                        if part.startswith("word/") and part.endswith(".xml"):
                            parser = expat.ParserCreate(namespace_separator=" ")
                            parser.StartElementHandler = start
                            try:
                                parser.Parse(z.read(part), True)
                            except expat.ExpatError:
                                continue
                rows += [(d, k, v) for k, v in n.items()]
            yield pd.DataFrame(rows, columns=["document", "kind", "n"])

    return packages.mapInPandas(run, "document string, kind string, n long")


def structure_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(document, kind, n_before, n_after) where the counts of two sets of packages differ."""
    old, new = (structure(p).withColumnRenamed("n", c) for p, c in ((before, "n_before"), (after, "n_after")))
    return old.join(new, ["document", "kind"], "full").where(~F.col("n_before").eqNullSafe(F.col("n_after")))
