"""GIF media columns: LZW code streams, palettes, disposal and transparency, timed frames, colour histograms."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import common

WIDTH, TALLEST, DELAY_CS, BINS = 64, 65_535, 10, 8
#: samples, or bytes of media, that are packed or decoded together
GROUP = 1 << 17
#: codes that are decoded together, but for a table that is never cleared
CODES = 1 << 18
GREYS = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


def _widths(least: int) -> np.ndarray:
    """Bits of the i-th code after a clear code, until the table is full."""
    i = np.arange(4097 - (1 << least))
    free = (1 << least) + 2 + np.maximum(i - 1, 0)
    return np.minimum(12, np.maximum(least + 1, np.floor(np.log2(free)).astype(np.int64) + 1))


WIDTHS = {k: _widths(k) for k in range(2, 9)}
STOPS = {k: np.append(0, np.cumsum(v)) for k, v in WIDTHS.items()}


def _phrases(data: bytes, child: list[int]) -> Iterator[np.ndarray]:
    """Codes of the greedy longest matches, a clear code whenever the table is full.

    child[run << 8 | byte] is the code of that longer run, times 256, or 0; it is all 0 before and after.
    """
    keys: list[int] = []  # the run of each match and the byte after it, which is the table's new entry
    put, run, free = keys.append, data[0] << 8, 258 << 8
    for b in data[1:]:
        key = run + b
        run = child[key]
        if not run:
            put(key)
            child[key] = free
            free += 256
            run = b << 8
            if free == 4096 << 8:
                for key in keys:
                    child[key] = 0
                put(256 << 8)
                yield np.array(keys, np.uint32) >> 8
                keys.clear()
                free = 258 << 8
    for key in keys:
        child[key] = 0
    put(run)
    yield np.array(keys, np.uint32) >> 8


def _packed(streams: list[list[np.ndarray]]) -> list[bytes]:
    """Codes of whole streams as bytes, the lowest bits first."""
    codes = np.concatenate([x for s in streams for x in s])
    ends = np.cumsum([sum(map(len, s)) for s in streams])
    n = np.diff(ends, prepend=0)
    clear = np.flatnonzero(codes == 256)
    since = np.arange(len(codes)) - np.repeat(clear, np.diff(clear, append=len(codes))) - 1
    again = np.setdiff1d(clear, ends - n)
    since[again] = since[again - 1] + 1  # a clear code is as wide as if the table went on; a stream's first is -1
    width = WIDTHS[8][np.maximum(since, 0)]
    stop = np.cumsum(width)
    bits = np.diff(stop[ends - 1], prepend=0)
    sizes = bits + 7 >> 3
    starts = np.cumsum(sizes) - sizes
    at = stop - width + np.repeat(8 * starts - stop[ends - 1] + bits, n)
    value, byte = codes << (at & 7).astype(np.uint32), at >> 3
    low, middle, high = np.zeros((3, int(sizes.sum()) + 2), np.uint8)  # codes have 9 bits at least: no two begin in one byte
    low[byte], middle[byte + 1], high[byte + 2] = value & 255, value >> 8 & 255, value >> 16
    whole = (low | middle | high).tobytes()
    return [whole[a : a + k] for a, k in zip(starts.tolist(), sizes.tolist(), strict=True)]


def lzw_encode_all(parts: Iterable[bytes]) -> Iterator[bytes]:
    """8-bit samples to GIF code streams; the codes of small parts are packed together."""
    child, group, size, first, last = [0] * (4096 << 8), [], 0, np.array([256], np.uint32), np.array([257], np.uint32)
    for data in parts:
        if group and size + len(data) > GROUP:
            yield from _packed(group)
            group, size = [], 0
        group.append([first, *(_phrases(data, child) if data else ()), last])
        size += len(data)
    if group:
        yield from _packed(group)


def lzw_encode(data: bytes) -> bytes:
    """8-bit samples to a GIF code stream: greedy longest match, a clear code whenever the table is full."""
    return next(lzw_encode_all([data]))


def _codes(streams: list[bytes], least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code, codes since the clear code before it, stream) in the streams' order, clear and end codes left out.

    All of a table's codes come at once, those of one stream's tables one after another.
    """
    clear, plan, stops = 1 << least, WIDTHS[least], STOPS[least]
    masks = ((1 << plan) - 1).astype(np.uint32)
    sizes = np.array([len(s) for s in streams])
    raw = np.frombuffer(b"".join([s + b"\0\0\0\0" for s in streams]), np.uint8).astype(np.uint32)
    words = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    stop = 8 * (np.cumsum(sizes + 4) - 4)
    at, which, done = stop - 8 * sizes, np.arange(len(streams)), np.zeros(len(streams), np.int64)
    found, held = [], 0
    while len(which):
        fresh = done == 0
        while (again := fresh & (at + least + 1 <= stop) & (words[at >> 3] >> (at & 7).astype(np.uint32) & np.uint32(2 * clear - 1) == clear)).any():
            at = at + again * (least + 1)
        n = np.where(fresh, np.searchsorted(stops, stop - at, "right") - 1, np.minimum((stop - at) // 12, len(plan)))
        own, i = np.repeat(np.arange(len(which)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pos, mask = stops[i], masks[i]
        if not fresh.all():  # a full table goes on
            pos, mask = np.where(fresh[own], pos, 12 * i), np.where(fresh[own], mask, np.uint32(4095))
        pos = pos + at[own]
        code = words[pos >> 3] >> (pos & 7).astype(np.uint32) & mask
        special = np.flatnonzero(code >> np.uint32(1) == clear >> 1)
        of, k = np.unique(own[special], return_index=True)
        kept, used, cleared, on = n.copy(), n.copy(), np.zeros(len(which), bool), n == len(plan)
        kept[of], cleared[of], on[of] = i[special[k]], code[special[k]] == clear, False
        used[cleared] = kept[cleared] + 1
        keep = i < kept[own]
        found.append((code[keep].astype(np.int64), i[keep] + done[own[keep]], which[own[keep]]))
        held += len(found[-1][0])
        at = at + np.where(fresh, stops[used], 12 * used)
        done = np.where(cleared, 0, done + n)
        go = cleared | on
        which, at, stop, done = which[go], at[go], stop[go], done[go]
        if not len(which) or held >= CODES and not done.any():
            code, since, of = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(of, kind="stable") if len(found) > 1 else slice(None)
            yield code[order], since[order], of[order]
            found, held = [], 0


def _resolved(code: np.ndarray, since: np.ndarray, clear: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(samples of each code, its last sample, the code it repeats and lengthens or -1)."""
    own, literal = np.arange(len(code)), code < clear
    parent = np.where(literal, own - 1, own - since + code - clear - 2)
    root, deep = np.where(literal, own, parent), (~literal).astype(np.int64)
    while (more := deep[root]).any():
        deep += more
        root = root[root]
    last = code.astype(np.uint8)[root][parent + 1]  # the first sample of the code after the repeated one; a literal itself
    parent[literal] = -1
    return deep + 1, last, parent


def lzw_decode_all(streams: list[bytes], least: int, limits: list[int]) -> list[np.ndarray]:
    """The samples of GIF code streams, at most limits; deferred clear codes are allowed, a stream broken before raises ValueError.

    An entry of the table repeats an earlier code and lengthens it by the sample that followed that code. So all codes are
    resolved at once: their last samples are written, then those before the last, and so on.
    """
    if least not in WIDTHS:
        raise ValueError("code size out of range")
    clear, left = 1 << least, np.array(limits, np.int64)
    out: list[list[np.ndarray]] = [[] for _ in streams]
    for code, since, which in _codes(streams, least):
        bad = np.flatnonzero(code - clear - 2 >= since)
        broken = np.unique(which[bad])
        if len(bad):
            low = np.full(len(streams), len(code))
            np.minimum.at(low, which[bad], bad)
            keep = np.arange(len(code)) < low[which]
            code, since, which = code[keep], since[keep], which[keep]
        for last_try in (False, True):
            size, last, parent = _resolved(code, since, clear)
            stop = np.cumsum(size)
            ends = np.append(0, stop)[np.searchsorted(which, np.arange(len(streams)), "right")]
            starts = np.append(0, ends[:-1])
            keep = stop - size - starts[which] < left[which]
            if last_try or keep.all():
                break
            code, since, which = code[keep], since[keep], which[keep]
        samples, place = np.empty(int(ends[-1]), np.uint8), stop - 1
        samples[place] = last
        on = np.flatnonzero(parent >= 0)
        link, place = parent[on], place[on] - 1
        while len(link):
            samples[place] = last[link]
            link = parent[link]
            on = link >= 0
            link, place = link[on], place[on] - 1
        for k in np.unique(which).tolist():
            out[k].append(samples[starts[k] : ends[k]][: left[k]])
            left[k] -= len(out[k][-1])
        if (left[broken] > 0).any():
            raise ValueError("code beyond the table")
    return [x[0] if len(x) == 1 else np.concatenate([np.zeros(0, np.uint8), *x]) for x in out]


def lzw_decode(stream: bytes, least: int, limit: int) -> bytes:
    """The samples of a GIF code stream, at most limit; deferred clear codes are allowed, a broken stream raises ValueError."""
    return lzw_decode_all([stream], least, [limit])[0].tobytes()


@dataclass
class Frame:
    start_ms: int
    delay_ms: int
    disposal: int
    height: int  # of the image block itself
    rgba: np.ndarray  # height x width x 4, as shown


@dataclass
class Image:
    x: int
    y: int
    w: int
    h: int
    interlaced: bool
    palette: bytes
    least: int
    stream: bytes
    disposal: int
    delay_ms: int
    clear: int | None  # the transparent sample
    samples: np.ndarray | None = None  # once decoded


def _blocks(media: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := media[at]:
        parts.append(media[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def _screen(media: bytes) -> tuple[int, int]:
    if media[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    return int.from_bytes(media[6:8], "little"), int.from_bytes(media[8:10], "little")


def _palette(media: bytes, at: int, flags: int) -> tuple[bytes, int]:
    n = 6 << (flags & 7)
    if at + n > len(media):
        raise ValueError("palette cut short")
    return bytes(media[at : at + n]), at + n


def images(media: bytes) -> Iterator[Image]:
    """The image blocks of a GIF, still encoded, with the settings that hold for them."""
    _screen(media)
    flags, at, shared = media[10], 13, None
    if flags & 128:
        shared, at = _palette(media, at, flags)
    disposal, delay, clear = 0, 0, None
    while at < len(media) and media[at] != 0x3B:
        kind, at = media[at], at + 1
        if kind == 0x21:
            label = media[at]
            body, at = _blocks(media, at + 1)
            if label == 0xF9:
                disposal, delay, clear = body[0] >> 2 & 7, 10 * int.from_bytes(body[1:3], "little"), body[3] if body[0] & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("unknown block")
        x, y, w, h = (int.from_bytes(media[at + k : at + k + 2], "little") for k in (0, 2, 4, 6))
        local, at = media[at + 8], at + 9
        palette = shared
        if local & 128:
            palette, at = _palette(media, at, local)
        if palette is None:
            raise ValueError("no palette")
        least = media[at]
        stream, at = _blocks(media, at + 1)
        yield Image(x, y, w, h, bool(local & 64), palette, least, stream, disposal, delay, clear)
        disposal, delay, clear = 0, 0, None


@lru_cache(64)
def _colours(palette: bytes) -> np.ndarray:
    """RGBA of each sample as one number; samples beyond the palette are its last colour."""
    n = len(palette) // 3
    rgba = np.full((256, 4), 255, np.uint8)
    rgba[:, :3] = np.frombuffer(palette, np.uint8).reshape(n, 3)[np.minimum(np.arange(256), n - 1)]
    return rgba.view(np.uint32)[:, 0]


def _shown(screen: tuple[int, int], found: Iterable[Image]) -> Iterator[Frame]:
    width, height = screen
    canvas, clock = np.zeros((height, width), np.uint32), 0
    for im in found:
        samples = im.samples
        if samples is None:
            (samples,) = lzw_decode_all([im.stream], im.least, [im.w * im.h])
        if len(samples) < im.w * im.h:
            raise ValueError("too few samples")
        index = samples.reshape(im.h, im.w)
        if im.interlaced:
            order = np.concatenate([np.arange(s, im.h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
            index = index[np.argsort(order, kind="stable")]
        before = canvas.copy() if im.disposal == 3 else None
        box = canvas[im.y : im.y + im.h, im.x : im.x + im.w]
        index = index[: box.shape[0], : box.shape[1]]
        np.copyto(box, _colours(im.palette)[index], where=True if im.clear is None else index != im.clear)
        yield Frame(clock, im.delay_ms, im.disposal, im.h, canvas.copy().view(np.uint8).reshape(height, width, 4))
        clock += im.delay_ms
        if im.disposal == 2:
            box[:] = 0
        elif im.disposal == 3:
            canvas = before


def frames(media: bytes) -> Iterator[Frame]:
    """Frames as shown: palettes applied, interlace undone, transparent samples left as they are, disposals obeyed."""
    yield from _shown(_screen(media), images(media))


def frames_of(media: Iterable[bytes | None]) -> Iterator[Iterator[Frame]]:
    """frames() of each value; the streams of small ones are decoded together. A broken value raises once its own are read."""

    def decoded(group: list[tuple[bytes, list[Image]]]) -> Iterator[Iterator[Frame]]:
        every = [im for _, found in group for im in found]
        try:
            for least in {im.least for im in every}:
                some = [im for im in every if im.least == least]
                for im, samples in zip(some, lzw_decode_all([im.stream for im in some], least, [im.w * im.h for im in some]), strict=True):
                    im.samples = samples
        except ValueError:
            for im in every:  # which one is broken shows when they are decoded one by one
                im.samples = None
        for raw, found in group:
            yield _shown(_screen(raw), found)

    group, size = [], 0
    for raw in media:
        found = None
        if raw is not None and len(raw) <= GROUP:
            try:
                found = list(images(raw))
            except (ValueError, IndexError):
                pass
        own = sum(im.w * im.h for im in found or ())
        if found is None or size + own > GROUP:
            yield from decoded(group)
            group, size = [], 0
        if found is None:
            yield frames(raw)
        else:
            group.append((raw, found))
            size += own
    yield from decoded(group)


def encode_all(payloads: list[bytes], width: int = WIDTH, tallest: int = TALLEST, delay_cs: int = DELAY_CS) -> Iterator[bytes]:
    """Whole rows of 8-bit samples as grey GIFs; one frame for each `tallest` rows, all padded rows excluded."""
    shapes = [(len(x) // width, min(len(x) // width, tallest)) for x in payloads]
    streams = lzw_encode_all(x[low * width : min(rows, low + tall) * width] for x, (rows, tall) in zip(payloads, shapes, strict=True) for low in range(0, rows, tall))
    for rows, tall in shapes:
        out = [b"GIF89a", width.to_bytes(2, "little"), tall.to_bytes(2, "little"), b"\xf7\0\0", GREYS]
        for low in range(0, rows, tall):
            high = min(rows, low + tall)
            out += [b"\x21\xf9\x04\x04", delay_cs.to_bytes(2, "little"), b"\0\0", b"\x2c\0\0\0\0", width.to_bytes(2, "little"), (high - low).to_bytes(2, "little"), b"\0\x08"]
            stream = next(streams)
            for k in range(0, len(stream), 255):
                part = stream[k : k + 255]
                out += [bytes([len(part)]), part]
            out.append(b"\0")
        yield b"".join([*out, b"\x3b"])


def encode(samples: bytes, width: int = WIDTH, tallest: int = TALLEST, delay_cs: int = DELAY_CS) -> bytes:
    """Whole rows of 8-bit samples as a grey GIF; one frame for each `tallest` rows, all padded rows excluded."""
    return next(encode_all([samples], width, tallest, delay_cs))


def histogram(f: Frame) -> list[list[int]]:
    """BINS counts of each of red, green and blue over the samples that are not transparent."""
    seen = f.rgba[f.rgba[..., 3] > 0]
    return [np.bincount(seen[:, c] >> 5, minlength=BINS).tolist() for c in range(3)]


def _fields(df: DataFrame, drop: set[str]) -> list[str]:
    return [f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema if x.name not in drop]


def store_texts(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Each row with its text as a GIF in column `media`: UTF-8 bytes, filled with 0 to a positive multiple of 64.

    Null counts as empty; n_bytes is the unfilled length. Other columns stay, but for text and clashing names. Repeated rows
    are rows like others, and equal texts give equal media; an empty table gives no rows. A text is encoded whole, however
    long: 65,535 rows of samples a frame, as many frames as it takes.
    """
    common.ship(docs.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in parts:
            raw = [x.encode() if isinstance(x, str) else b"" for x in f.pop(text)]
            f["n_bytes"] = [len(x) for x in raw]
            f[media] = list(encode_all([x + bytes(-len(x) % 64 if x else 64) for x in raw]))
            yield f

    kept = docs.select(*[c for c in docs.columns if c not in ("n_bytes", media)])
    return kept.mapInPandas(run, ", ".join([*_fields(kept, {text}), "n_bytes long", f"`{media}` binary"]))


def frame_rows(df: DataFrame, media: str = "media") -> DataFrame:
    """One row per frame: frame, start_ms, delay_ms, width, height, hist_r, hist_g, hist_b, frame_sha256 beside the other columns.

    A null or unreadable media value gives one row whose frame columns are null.
    """
    common.ship(df.sparkSession)
    own = ["frame", "start_ms", "delay_ms", "width", "height", "hist_r", "hist_g", "hist_b", "frame_sha256"]
    kept = df.select(*[c for c in df.columns if c not in own])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in parts:
            for row, shown in zip(f.drop(columns=media).to_dict("records"), frames_of(f[media]), strict=True):
                try:
                    found = [(k, x.start_ms, x.delay_ms, x.rgba.shape[1], x.rgba.shape[0], *histogram(x), hashlib.sha256(x.rgba.tobytes()).hexdigest()) for k, x in enumerate(shown)]
                except (ValueError, IndexError, TypeError):
                    found = []
                yield pd.DataFrame([row | dict(zip(own, x, strict=True)) for x in found or [(None,) * len(own)]], columns=[*row, *own])

    return kept.mapInPandas(run, ", ".join([*_fields(kept, {media}), "frame int, start_ms long, delay_ms long, width int, height int, hist_r array<long>, hist_g array<long>, hist_b array<long>, frame_sha256 string"]))


def media_digest(df: DataFrame, media: str = "media") -> DataFrame:
    """Each row with what is read back from its stored GIF: payload and media sizes and digests, and a feature string."""
    common.ship(df.sparkSession)
    own = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [x.split()[0] for x in own.split(", ")]
    kept = df.select(*[c for c in df.columns if c not in names])

    def digest(raw: bytes, shown: Iterator[Frame]) -> tuple:
        whole, size, tail, n, ms, counts = hashlib.sha256(), 0, b"", 0, 0, np.zeros(BINS, np.int64)
        for f in shown:
            # the payload is written top to bottom over frames; a shorter last frame covers the upper rows only
            part = f.rgba[: f.height, :, 0].tobytes()
            whole.update(part)
            size, tail, n, ms = size + len(part), part[-64:], n + 1, ms + f.delay_ms
            counts += np.bincount(np.frombuffer(part, np.uint8) >> 5, minlength=BINS)
        return size, whole.hexdigest(), zlib.crc32(tail), len(raw), hashlib.sha256(raw).hexdigest(), f"frames={n};ms={ms};hist=" + ",".join(map(str, counts.tolist()))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in parts:
            raw = [bytes(x) for x in f.pop(media)]
            got = [digest(x, shown) for x, shown in zip(raw, frames_of(raw), strict=True)]
            for k, c in enumerate(names):
                f[c] = [x[k] for x in got]
            yield f

    return kept.mapInPandas(run, ", ".join([*_fields(kept, {media}), own]))

