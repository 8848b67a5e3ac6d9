"""Packing of token pieces into sequences by minimum bin slack."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, text as T
from .bpe import exact, ids_of

SIZE, END = 1024, 2
#: bytes of text whose pieces are held before they are sent on
BATCH = 1 << 20


def minimum_bin_slack(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: copies}) of bins that hold all pieces counted.

    Each bin starts with the longest piece left. Bitset dynamic programming over the lengths still available, each at
    most as often as there are pieces, tells every reachable sum; the fullest combination is taken, longer pieces first
    among equals, and removed as often as the counts allow. Each pattern uses up some length's count for one multiple, so
    there are at most sum(size / length) patterns, about 7,500 for 1024, however many pieces there are.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    plans = []
    while left:
        top = max(left)
        room, mask = size - top, (1 << (size - top + 1)) - 1
        reach, trail = 1, []
        if room:
            for length in sorted(left):
                most = min(left[length] - (length == top), room // length)
                if most <= 0:
                    continue
                trail.append((length, most, reach))
                step = 1
                while most:  # copies in powers of two
                    take = min(step, most)
                    reach |= reach << (take * length) & mask
                    most -= take
                    step *= 2
        total, bin_ = reach.bit_length() - 1, {top: 1}
        for length, most, before in reversed(trail):  # longest first
            n = min(most, total // length)
            while not before >> (total - n * length) & 1:
                n -= 1
            if n:
                bin_[length] = bin_.get(length, 0) + n
                total -= n * length
        times = min(left[k] // n for k, n in bin_.items())
        plans.append((times, bin_))
        for k, n in bin_.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return plans


def cut(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones, the first shorter where n is no multiple."""
    if n <= size:
        return [(0, n)]
    first = n % size or size
    return [(0, first), *[(k, size) for k in range(first, n, size)]]


def _slots(plans: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, copies in a bin, first bin, place of the first copy) by rank."""
    out: dict[int, list] = {}
    used: dict[int, int] = {}
    base = 0
    for times, bin_ in plans:
        place = 0
        for length in sorted(bin_, reverse=True):
            n = bin_[length]
            out.setdefault(length, []).append((used.get(length, 0), n, base, place))
            used[length] = used.get(length, 0) + n * times
            place += n * length
        base += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    Texts (null: empty) become ids and one end id. Only the counts by length, at most `size` numbers, are planned on the
    driver; ranks within a length come from counts by partition. Empty texts are pieces of one id; an empty table gives no
    rows; repeated rows and null keys are packed like others; further columns are dropped.
    """
    spark = docs.sparkSession
    common.ship(spark)

    fits = exact(vocabulary)
    kind = docs.schema[key].dataType.simpleString()

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part = ids_of(vocabulary, fits), TaskContext.get().partitionId()
        ranks = np.zeros(size + 1, np.int64)
        mark = np.uint32(end)
        for b in batches:
            for low, high, _, _ in T.chunks(b.column(1), BATCH):
                rows = []
                for row in range(low, high):
                    raw = np.append(ids.encode(b.column(1)[row].as_py() or ""), mark)
                    data = memoryview(raw).cast("B")
                    for piece, (start, length) in enumerate(cut(len(raw), size)):
                        rows.append((row, piece, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), ranks[length]))
                        ranks[length] += 1
                a = np.array(rows, np.int64).reshape(-1, 6)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(a[:, 0])), pa.array(a[:, 1].astype(np.int32)), *[pa.array(a[:, k]) for k in (2, 3, 4)], pa.array(np.full(len(a), part, np.int64)), pa.array(a[:, 5])], names=[key, "piece", "start", "length", "ids_crc32", "part", "rank"])

    pieces = common.stored(docs.select(key, text).mapInArrow(tokenise, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, part long, rank long"))
    counts = common.stored(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    totals = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    slots = _slots(minimum_bin_slack(totals, size))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    # one row for each partition and length grows with the corpus, so it is not broadcast
    ranked = pieces.join(shift.hint("merge"), ["part", "length"])

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in parts:
            rank, length = (f["rank"] + f["shift"]).to_numpy(), f["length"].to_numpy()
            seq, offset = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
            for k in np.unique(length):
                own = np.flatnonzero(length == k)
                row = slots[int(k)]
                hit = row[np.searchsorted(row[:, 0], rank[own], "right") - 1]
                q = rank[own] - hit[:, 0]
                seq[own] = hit[:, 2] + q // hit[:, 1]
                offset[own] = hit[:, 3] + q % hit[:, 1] * k
            yield f.drop(columns=["part", "rank", "shift"]).assign(sequence_id=seq, offset=offset)

    return ranked.select(key, "piece", "start", "length", "ids_crc32", "part", "rank", "shift").mapInPandas(place, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
