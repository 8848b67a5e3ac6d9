"""Cross-entropy difference of two matched bigram models over one vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, text as T

#: weight of the pair's share in a probability
BLEND = 0.7
#: bytes of text in a block, whose n-grams are counted before they are sent; n-grams in a bucket, on average at most
BLOCK, BUCKET = 4 << 20, 1 << 20
_BEGIN, _WORD, _PAIR = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F), np.uint64(0xD6E8FEB86659FD93)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, the text last, in batches of about BLOCK bytes of text; a text is never split."""
    held, size = [], 0
    for b in batches:
        for low, high, _, at in T.chunks(b.column(b.num_columns - 1)):
            held.append(b.slice(low, high - low))
            size += int(at[-1])
            if size >= BLOCK:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _hashes(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the row of every word of a block."""
    found, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for low, _, data, at in T.chunks(b.column(b.num_columns - 1)):
        data = T.LOWER[data]
        start, end, row = T.words(data, at, T.NOT_SPACE)
        found.append(T.hashes(data, start, end))
        rows.append(row + low)
    return np.concatenate(found), np.concatenate(rows)


class _Grams:
    """The n-grams of a block: words (the start of a text last) and pairs, with the place of each in the sorted order of all keys."""

    def __init__(self, b: pa.RecordBatch) -> None:
        h, self.row = _hashes(b)
        word, self.word = np.unique(h, return_inverse=True)
        begin = len(word)
        self.before = np.empty(len(h), np.int64)
        if len(h):
            self.before[0], self.before[1:] = begin, np.where(self.row[1:] == self.row[:-1], self.word[:-1], begin)
        pair, self.pair, n = np.unique(self.before * (begin + 1) + self.word, return_inverse=True, return_counts=True)
        word = np.append(word, _BEGIN)
        keys = np.concatenate([T.mix(word ^ _WORD), T.mix(word[pair // (begin + 1)] * _PAIR + word[pair % (begin + 1)])])
        order = np.argsort(keys, kind="stable")
        self.keys, self.place = keys[order], np.empty(len(keys), np.int64)
        self.place[order] = np.arange(len(keys))
        self.n = np.concatenate([np.bincount(self.word, minlength=begin + 1), n])[order]
        self.of = np.concatenate([np.bincount(self.before, minlength=begin + 1), np.zeros(len(n), np.int64)])[order]
        self.words = begin + 1


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each value of the first column, which is sorted."""
    held: list[tuple] = []
    for b in batches:
        for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if held and held[0][0] != r[0]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def score(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, target_loss, background_loss and score (their difference per token; less is nearer the target).

    Words are runs without white space, A-Z lower-cased. Both models are bigram models of one form over one vocabulary, every
    word of docs and target; the background is counted over every document. Null and empty texts have n_tokens 0 and losses
    0.0; repeated rows count as often as they stand; null keys are rows like others; an empty table gives no rows, an empty
    target a model in which all words are alike; other columns are dropped, whatever their names.

    P(word | previous) is BLEND times the share of the pair among those that begin with the previous word, and the rest
    times (count of the word + 1) / (words in all + different words in all); only the latter where a model never saw the
    previous word. Counts are kept in no driver and no broadcast. A task counts the n-grams of a block of texts and sends
    them, sorted by 64-bit hash, to buckets by range of the hash; a bucket sums them over all blocks and answers each
    block; the answers and the texts of a block meet again in one task. A frequent n-gram has one entry for each block,
    not for each text. The number of buckets grows with the input. Only the number of words, and of different ones, is
    gathered. Two n-grams with one hash would be counted as one.
    """
    spark = docs.sparkSession
    common.ship(spark)
    base = docs.select(key, text)

    def distinct(near: bool):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _blocks(batches):
                h, n = np.unique(_hashes(b)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n * near), pa.array(n * (not near))], names=["h", "near", "far"])

        return run

    seen = target.select(text).mapInArrow(distinct(True), "h long, near long, far long").union(docs.select(text).mapInArrow(distinct(False), "h long, near long, far long"))
    sums = seen.groupBy("h").agg(F.sum("near").alias("near"), F.sum("far").alias("far")).agg(F.count("*"), F.sum("near"), F.sum("far")).first()
    different, totals = sums[0], (sums[1] or 0, sums[2] or 0)
    buckets = max(16, 2 * sum(totals) // BUCKET + 1)
    limits = np.array([((k << 64) // buckets) for k in range(1, buckets)], np.uint64)

    def asked(near: bool):  # noqa: ANN202
        names = ["bucket", "block", "texts", "data"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for k, b in enumerate(_blocks(batches)):
                block = -1 if near else (TaskContext.get().partitionId() << 32) + k
                g = _Grams(b)
                cut = [0, *np.searchsorted(g.keys, limits).tolist(), len(g.keys)]
                some = [i for i in range(buckets) if cut[i] < cut[i + 1]]
                data = [T.packed(np.diff(g.keys[cut[i] : cut[i + 1]], prepend=np.uint64(0)), g.n[cut[i] : cut[i + 1]], g.of[cut[i] : cut[i + 1]]) for i in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([block] * len(some), pa.int64()), pa.array([False] * len(some)), pa.array(data, pa.binary())], names=names)
                if not near:
                    out = pa.BufferOutputStream()
                    with pa.ipc.new_stream(out, b.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 9))) as w:
                        w.write_batch(b)
                    yield pa.RecordBatch.from_arrays([pa.array([(block * 7919 + (block >> 32)) % buckets], pa.int32()), pa.array([block], pa.int64()), pa.array([True]), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=names)

        return run

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(block: int, bucket: int, data: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([data], pa.binary())], names=["block", "bucket", "data"])

        def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                kept.extend(row(r["block"], -1, r["data"]) for r in b.to_pylist() if r["texts"])
                yield b.filter(pa.compute.invert(b.column(2)))

        kept: list[pa.RecordBatch] = []
        for run in _runs(passed(batches)):
            yield from kept
            kept.clear()
            blocks, parts = [r[1] for r in run], [T.unpacked(r[3], 3) for r in run]
            ends = np.cumsum([p.shape[1] for p in parts])
            known, at = np.unique(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), return_inverse=True)
            near = np.repeat(np.array(blocks) < 0, [p.shape[1] for p in parts])
            out = []
            for side in (near, ~near):
                for c in (1, 2):
                    total = np.zeros(len(known), np.int64)
                    np.add.at(total, at[side], np.concatenate([p[c] for p in parts]).astype(np.int64)[side])
                    out.append(total)
            for block, end, p in zip(blocks, ends, parts, strict=True):
                if block >= 0:
                    yield row(block, run[0][0], T.packed(*[t[at[end - p.shape[1] : end]] for t in out]))
        yield from kept

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches):
            [b] = pa.ipc.open_stream(run[0][2])
            g, rows = _Grams(b), b.num_rows
            counts = np.concatenate([T.unpacked(r[2], 4) for r in run[1:]], axis=1).astype(np.float64)
            word, pair = g.place[: g.words], g.place[g.words :]
            n, losses = np.bincount(g.row, minlength=rows), []
            for (c, of), total in zip((counts[:2], counts[2:]), totals, strict=True):
                one = (c[word][g.word] + 1) / max(1, total + different)
                begun = of[word][g.before]
                two = np.divide(c[pair][g.pair], begun, out=np.zeros_like(one), where=begun > 0)
                p = np.where(begun > 0, BLEND * two + (1 - BLEND) * one, one)
                losses.append(np.bincount(g.row, -np.log(p), minlength=rows) / np.maximum(1, n))
            a, z = losses
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(a), pa.array(z), pa.array(a - z)], names=[key, "n_tokens", "target_loss", "background_loss", "score"])

    schema = "bucket int, block long, texts boolean, data binary"
    requests = target.select(text).mapInArrow(asked(True), schema).union(base.mapInArrow(asked(False), schema))
    answers = requests.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(answered, "block long, bucket int, data binary")
    return answers.repartition("block").sortWithinPartitions("block", "bucket").mapInArrow(scored, f"`{key}` {base.schema[key].dataType.simpleString()}, n_tokens long, target_loss double, background_loss double, score double")
