"""Removal of passages that stand in an earlier document, by automata of recurring phrases."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, text as T

WINDOW = 50
#: words of passages in one automaton, about; documents that meet it in one task
SHARD_WORDS, SHARD_DOCS = 60_000, 400


def _anchors(h: np.ndarray, row: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window, by its first word's place: the least of its anchors; and these places."""
    _, place = T.runs(h, row, window)
    if not len(place):
        return np.zeros(0, np.uint64), place
    grams, at = T.runs(h, row, anchor)
    whole = np.full(len(h), np.iinfo(np.uint64).max, np.uint64)
    whole[at] = grams
    n, span, least = window - anchor + 1, 1, whole
    while 2 * span <= n:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    return np.minimum(least[place], least[place + n - span]), place


def _index(b: pa.RecordBatch, column: int = 1) -> Iterator[tuple]:
    for low, high, data, at in T.chunks(b.column(column)):
        start, end, row = T.words(data, at, T.NOT_SPACE)
        yield low, high, data, start, end, row, T.hashes(data, start, end)


def _list(values: pa.Array, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), values)


def anchors(docs: DataFrame, key: str, text: str, window: int, anchor: int) -> DataFrame:
    """(anchor, key) for every run of windows with one least anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, _, _, _, _, row, h in _index(b):
                least, place = _anchors(h, row, window, anchor)
                of = row[place]
                new = np.ones(len(least), bool)
                new[1:] = (least[1:] != least[:-1]) | (of[1:] != of[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(least[new].view(np.int64)), b.column(0).take(pa.array(low + of[new]))], names=["anchor", key])

    return common.stored(docs.select(key, text).mapInArrow(run, f"anchor long, `{key}` {docs.schema[key].dataType.simpleString()}"))


def windows(docs: DataFrame, hits: DataFrame, key: str, text: str, window: int, anchor: int, keep: bool) -> DataFrame:
    """Stored rows: the columns of docs, _uid, _n (words), _sha (of all words), _hashes and _places of windows whose anchor recurs.

    Unless keep is set, the text stays only where there are such windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _uid = TaskContext.get().partitionId() << 40
        for b in batches:
            names = b.schema.names
            for low, high, _, _, _, row, h in _index(b, names.index(text)):
                n_words = np.bincount(row, minlength=high - low)
                least, place = _anchors(h, row, window, anchor)
                whole, _ = T.runs(h, row, window)
                known = b.column("_anchors")[low:high]
                size = pc.fill_null(pc.list_value_length(known), 0).to_numpy().astype(np.int64)
                want = known.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                # an anchor counts for its own row only: the row is mixed into both
                tag = lambda a, r: T.mix(a + r.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                have = np.sort(tag(want, np.repeat(np.arange(high - low), size)))
                of = row[place]
                asked = tag(least, of)
                k = np.minimum(np.searchsorted(have, asked), max(0, len(have) - 1))
                ok = have[k] == asked if len(have) else np.zeros(len(least), bool)
                n = np.bincount(of[ok], minlength=high - low)
                first = np.cumsum(n_words) - n_words
                columns = {c: b.column(c)[low:high] for c in names if c != "_anchors"}
                texts = columns[text].to_pylist()
                sha = [hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for t in texts]
                if not keep:
                    columns[text] = pa.array([t if m else None for t, m in zip(texts, n > 0, strict=True)], pa.string())
                columns |= {"_uid": pa.array(_uid + np.arange(high - low)), "_n": pa.array(n_words.astype(np.int64)), "_sha": pa.array(sha, pa.string()), "_hashes": _list(pa.array(whole[ok].view(np.int64)), n), "_places": _list(pa.array((place[ok] - first[of[ok]]).astype(np.int32)), n)}
                yield pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])
                _uid += high - low

    # rows without a recurring anchor need no shuffle
    maybe, never = common.sifted(docs, hits, key)
    joined = maybe.join(hits, key, "left").select(*docs.columns, "_anchors").unionByName(never.withColumn("_anchors", F.lit(None).cast("array<long>")))
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in docs.schema)
    return common.stored(joined.mapInArrow(run, schema + ", _uid long, _n long, _sha string, _hashes array<long>, _places array<int>"))


def _runs(places: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Windows at these sorted places, merged where one starts at the next word: (first word, end word)."""
    cut = np.flatnonzero(np.diff(places) != 1)
    first, last = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(places) - 1]])
    return [(int(places[a]), int(places[z]) + window) for a, z in zip(first, last, strict=True)]


class Automaton:
    """Recurring passages of some documents, found by their whole blocks in other documents' words."""

    def __init__(self, window: int, block: int) -> None:
        import ahocorasick

        self.window, self.block, self.made = window, block, False
        self.find, self.passages, self.blocks = ahocorasick.Automaton(), [], []

    def add(self, source: int, words: list[str]) -> None:
        self.passages.append((source, words))
        for at in range(0, len(words) - self.block + 1, self.block):
            phrase = " " + " ".join(words[at : at + self.block]) + " "
            known = self.find.get(phrase, None)
            if known is None:
                known = len(self.blocks)
                self.blocks.append([])
                self.find.add_word(phrase, known)
            self.blocks[known].append((len(self.passages) - 1, at))

    def locate(self, key: int, words: list[str]) -> list[tuple[int, int]]:
        """Runs of at least a window of words that stand in a passage of a document with a smaller key."""
        if not self.blocks:
            return []
        if not self.made:
            self.find.make_automaton()
            self.made = True
        line = " " + " ".join(words) + " "
        place = {}
        at = 0
        for k, w in enumerate(words):
            place[at] = k
            at += len(w) + 1
        seen: dict[tuple[int, int], int] = {}  # (passage, diagonal) -> end of what is known to match or not to
        out = set()
        for end, block in self.find.iter(line):
            for p, offset in self.blocks[block]:
                source, passage = self.passages[p]
                if source >= key:
                    continue
                # the phrase ends with the blank after its last word
                last = place.get(end, len(words))
                first = last - self.block
                diagonal = first - offset
                if seen.get((p, diagonal), -1) >= last:
                    continue
                low, high = first, last
                while low > 0 and low - diagonal > 0 and words[low - 1] == passage[low - 1 - diagonal]:
                    low -= 1
                while high < len(words) and high - diagonal < len(passage) and words[high] == passage[high - diagonal]:
                    high += 1
                seen[p, diagonal] = high
                if high - low >= self.window:
                    out.add((low, high))
        return _merged(sorted(out))


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in runs:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def split(text: str) -> list[str]:
    """Words [^\\x20\\x09-\\x0D]+ of a text."""
    return [w.decode() for w in text.encode().split()]


def covered(docs: DataFrame, key: str, text: str, window: int, keep: bool) -> DataFrame:
    """The stored rows of windows(), with _starts and _ends (null for none) of the runs of words to remove."""
    spark = docs.sparkSession
    common.ship(spark)
    # the least run of half a window is its anchor; of blocks of that length, any window of a passage holds a whole one
    anchor = block = window // 2
    id_ = F.col(key)
    # 1. anchors that stand in two documents; rows without key neither give nor lose words
    every = anchors(docs.where(id_.isNotNull()), key, text, window, anchor)
    again = every.groupBy("anchor").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).where("lo < hi").select("anchor")
    hits = common.stored(every.join(again, "anchor").groupBy(key).agg(F.collect_set("anchor").alias("_anchors")))
    held = windows(docs, hits, key, text, window, anchor, keep)
    # 2. windows confirmed to recur, the first document of each, and one place there
    rows = held.where(id_.isNotNull() & (F.size("_hashes") > 0)).select("_uid", id_.alias("_key"), F.explode(F.arrays_zip("_hashes", "_places")).alias("w")).select("_uid", "_key", F.col("w._hashes").alias("h"), F.col("w._places").alias("place"))
    first = rows.groupBy("h").agg(F.min("_key").alias("source"), F.max("_key").alias("last"), F.min(F.struct("_key", "_uid", "place")).alias("at")).where("source < last")
    first = common.stored(first.select("h", "source", "at._uid", "at.place"))
    own = first.groupBy("_uid", "source").agg(F.array_sort(F.collect_list("place")).alias("own"))
    routes = rows.join(first.select("h", "source"), "h").where("_key > source").select("_uid", "_key", "source").distinct()
    # 3. shards by source; the readers of a hot one are salted, its passages repeated
    shards = first.count() // SHARD_WORDS + 1
    shard = F.pmod(F.xxhash64("source"), F.lit(shards)).alias("shard")
    asked = common.stored(routes.select("_uid", "_key", shard).distinct())
    salts = asked.groupBy("shard").agg((F.count("*") / SHARD_DOCS + 1).cast("int").alias("salts"))
    texts = held.where(F.size("_hashes") > 0).select("_uid", F.col(text).alias("text"))
    passages = own.select("_uid", "own", F.col("source").alias("_key"), shard).join(salts, "shard").join(texts, "_uid").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "_uid", "_key", "own", "text")
    readers = asked.join(salts, "shard").join(texts, "_uid").select("shard", F.pmod(F.xxhash64("_uid"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "_uid", "_key", F.lit(None).cast("array<int>").alias("own"), "text")
    dealt = passages.unionByName(readers).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind", "_uid")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, automaton = None, None
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for k in range(b.num_rows):
                r = {c: b.column(c)[k].as_py() for c in ("shard", "salt", "kind", "_uid", "_key", "own", "text")}
                if now != (r["shard"], r["salt"]):
                    now, automaton = (r["shard"], r["salt"]), Automaton(window, block)
                words = split(r["text"])
                if r["kind"] == 0:
                    for s, e in _runs(np.array(r["own"]), window):
                        automaton.add(r["_key"], words[s:e])
                elif runs := automaton.locate(r["_key"], words):
                    out[0].append(r["_uid"])
                    out[1].append([s for s, _ in runs])
                    out[2].append([e for _, e in runs])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *[pa.array(x, pa.list_(pa.int32())) for x in out[1:]]], names=["_uid", "_starts", "_ends"])

    runs = dealt.mapInArrow(stream, "_uid long, _starts array<int>, _ends array<int>").groupBy("_uid").agg(F.flatten(F.collect_list("_starts")).alias("_starts"), F.flatten(F.collect_list("_ends")).alias("_ends"))
    return held.drop("_hashes", "_places").join(runs, "_uid", "left")


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """Each row with n_words, n_removed and kept_sha256; with keep_text, the kept words too, joined by one space.

    A word goes if a window of `window` words covers it whose words also start in a row with a smaller key; the input
    decides, not what is left. Text in which nothing recurs stays as it is, white space included. Null or empty texts,
    texts of fewer words and rows without key lose nothing; rows with one key do not take words from each other, even if
    they repeat. Keys may be of any type with an order. An empty table gives no rows. Columns named like the new ones are
    replaced.
    """
    own = ["n_words", "n_removed", "kept_sha256"]
    base = docs.drop(*own) if keep_text else docs.select(key, text)
    found = covered(base, key, text, window, keep_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [c for c in b.schema.names if c not in ("_uid", "_n", "_sha", "_starts", "_ends") and (keep_text or c != text)]
            sha, gone, texts = b.column("_sha").to_pylist(), np.zeros(b.num_rows, np.int64), {}
            for k in np.flatnonzero(b.column("_starts").is_valid().to_numpy(zero_copy_only=False)):
                words = b.column(text)[k].as_py().encode().split()
                runs = _merged(sorted(zip(b.column("_starts")[k].as_py(), b.column("_ends")[k].as_py(), strict=True)))
                at, kept = 0, []
                for s, e in runs:
                    kept += words[at:s]
                    at, gone[k] = e, gone[k] + e - s
                line = b" ".join(kept + words[at:])
                sha[k] = hashlib.sha256(line).hexdigest()
                texts[k] = line.decode()
            columns = {c: b.column(c) for c in names}
            if keep_text:
                columns[text] = pa.array([texts.get(k, t) for k, t in enumerate(columns[text].to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([*columns.values(), b.column("_n"), pa.array(gone), pa.array(sha, pa.string())], names=[*names, *own])

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in base.schema if keep_text or x.name != text)
    return found.mapInArrow(run, schema + ", n_words long, n_removed long, kept_sha256 string")
