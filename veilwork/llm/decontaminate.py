"""Benchmark decontamination over a distributed positional inverted index.

The index holds every word of the training texts: each row has the posting lists of some documents, so that a phrase is
found where its documents lie and no posting is shuffled. It is stored once and answers any benchmark, which comes in blocks
of bounded size. Frequencies over the whole corpus tell the rarest term of each phrase, whose offset-adjusted list is
intersected with the next rarest, and so on. Words are told apart by 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, text as T

WINDOW, SPAN, NEAR_TERMS, BLOCK_BYTES = 10, 20, 3, 2 << 20
#: words between two documents of a row, and of their key: term << _SHIFT | place
_GAP, _SHIFT = 64, 36


@dataclass
class Asked:
    """One block of the benchmark: its terms, its distinct phrases, and the items of each."""

    terms: np.ndarray  # sorted word hashes; a term's number is its place
    phrase: np.ndarray  # phrases x window, term numbers, -1 after a short item's end
    item_at: np.ndarray  # offsets into item, by phrase
    item: np.ndarray
    ids: list[str]  # item ids as strings, sorted
    item_terms: list[np.ndarray]


def _asked(rows: list[tuple[str, str]], window: int) -> Asked:
    ids = sorted({r[0] for r in rows})
    number = {x: k for k, x in enumerate(ids)}
    of = np.array([number[r[0]] for r in rows], np.int64)
    data, at = T.buffers(pa.array([r[1] for r in rows], pa.string()))
    data = T.LOWER[data]
    start, end, row = T.words(data, at, T.LETTERS)
    terms, code = np.unique(T.hashes(data, start, end), return_inverse=True)
    n = np.bincount(row, minlength=len(rows))
    first = np.flatnonzero(np.arange(len(code)) + window <= (np.cumsum(n))[row]) if len(code) else np.zeros(0, np.int64)
    whole = code[first[:, None] + np.arange(window)] if len(first) else np.zeros((0, window), np.int64)
    short = np.flatnonzero((n > 0) & (n < window))
    rest = np.full((len(short), window), -1, np.int64)
    for k, r in enumerate(short):
        rest[k, : n[r]] = code[(np.cumsum(n) - n)[r] :][: n[r]]
    phrase, which = np.unique(np.concatenate([whole, rest]).astype(np.int32), axis=0, return_inverse=True)
    pairs = np.unique(which.ravel() * max(1, len(ids)) + of[np.concatenate([row[first], short])]) if len(which) else np.zeros(0, np.int64)
    item_at = np.searchsorted(pairs // max(1, len(ids)), np.arange(len(phrase) + 1))
    own = np.unique(of[row] * max(1, len(terms)) + code) if len(code) else np.zeros(0, np.int64)
    cut = np.searchsorted(own // max(1, len(terms)), np.arange(len(ids) + 1))
    return Asked(terms, phrase, item_at, pairs % max(1, len(ids)), ids, [own[a:b] % max(1, len(terms)) for a, b in zip(cut, cut[1:], strict=False)])


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW, size: int = BLOCK_BYTES) -> Iterator[Asked]:
    """The benchmark in blocks of about `size` bytes of text, by hash of the item; the rows of one item stand in one block."""
    known = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).where(F.col("i").isNotNull() & F.col("t").isNotNull())
    n = known.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0] // size + 1
    for k in range(n):
        rows = known.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k).distinct().orderBy("i", "t").collect()
        if rows:
            yield _asked([tuple(r) for r in rows], window)


def index(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Stored rows (chunk, keys, n_words, terms, places) of the posting lists of all words of some documents each.

    chunk is a number of its own for each row; keys and n_words are by document. terms packs the sorted word hashes (as
    differences) and the lengths of their lists, places the lists one after another: the places of a term in all
    documents of the row, which lie _GAP words apart.
    """
    common.ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for b in batches:
            for low, high, data, at in T.chunks(b.column(1)):
                data = T.LOWER[data]
                start, end, row = T.words(data, at, T.LETTERS)
                n = np.bincount(row, minlength=high - low)
                h = T.hashes(data, start, end)
                order = np.argsort(h, kind="stable")  # places stay in order
                terms, many = np.unique(h[order], return_counts=True)
                place = (np.arange(len(h)) + row * _GAP)[order]
                packed = [T.packed(np.diff(terms, prepend=np.uint64(0)), many.astype(np.int64)), T.packed(place.astype(np.int64))]
                one = [0, high - low]
                keys = pa.ListArray.from_arrays(pa.array(one, pa.int32()), pa.concat_arrays([b.column(0)[low:high]]))
                words = pa.ListArray.from_arrays(pa.array(one, pa.int32()), pa.array(n.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), keys, words, *[pa.array([x], pa.binary()) for x in packed]], names=["chunk", "keys", "n_words", "terms", "places"])
                chunk += 1

    return common.stored(docs.select(key, text).mapInArrow(run, f"chunk long, keys array<{kind}>, n_words array<long>, terms binary, places binary"))


def _hits(terms: bytes, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the asked terms that a row holds: their numbers, the lengths and the starts of their lists."""
    packed = T.unpacked(terms, 2)
    own, many = np.cumsum(packed[0], dtype=np.uint64), packed[1].astype(np.int64)
    if not len(own) or not len(known):
        return (np.zeros(0, np.int64),) * 3
    code = np.minimum(np.searchsorted(known, own), len(known) - 1)
    hit = np.flatnonzero(known[code] == own)
    return code[hit], many[hit], (np.cumsum(many) - many)[hit]


def frequencies(stored: DataFrame, asked: Asked) -> np.ndarray:
    """How often each asked term stands in the corpus; tasks add up, and send the terms that they met."""
    sent = stored.sparkSession.sparkContext.broadcast(asked.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        total = np.zeros(len(known), np.int64)
        for b in batches:
            for x in b.column(0):
                code, many, _ = _hits(x.as_py(), known)
                total[code] += many
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["term", "n"])

    got = stored.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(asked.terms), np.int64)
    out[got["term"].to_numpy()] = got["n"].to_numpy()
    return out


class Postings:
    """The posting lists of a row for the asked terms, as one sorted array of keys."""

    def __init__(self, n_words: np.ndarray, terms: bytes, places: bytes, known: np.ndarray) -> None:
        self.n_words, self.base = n_words, np.cumsum(n_words + _GAP) - n_words - _GAP
        code, many, first = _hits(terms, known)
        at = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        self.keys = np.repeat(code, many) << _SHIFT | (T.unpacked(places, 1)[0].astype(np.int64)[at] if len(at) else at)

    def of(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.keys, term << _SHIFT), np.searchsorted(self.keys, term + 1 << _SHIFT)

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        want = term << _SHIFT | place
        k = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return self.keys[k] == want

    def expand(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, place) of every posting of each query's term."""
        low, high = self.of(term)
        n = np.maximum(0, high - low)
        query = np.repeat(np.arange(len(term)), n)
        at = np.repeat(low, n) + np.arange(len(query)) - np.repeat(np.cumsum(n) - n, n)
        return query, self.keys[at] & (1 << _SHIFT) - 1

    def phrases(self, phrase: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of every exact occurrence; order has each phrase's word places, rarest first."""
        if not len(self.keys) or not len(phrase):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rank = np.take_along_axis(phrase, order, 1).astype(np.int64)
        p, start = self.expand(rank[:, 0])
        start = start - order[p, 0]
        keep = start >= 0
        p, start = p[keep], start[keep]
        for k in range(1, phrase.shape[1]):
            if not len(p):
                break
            keep = (rank[p, k] < 0) | self.has(np.maximum(rank[p, k], 0), start + order[p, k])
            p, start = p[keep], start[keep]
        return p, start

    def near(self, rare: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """(item, place) where an item's rarest term has its other rare terms at most span words away."""
        if not len(self.keys) or not len(rare):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rare, some = rare.astype(np.int64), np.flatnonzero(rare[:, 0] >= 0)
        q, place = self.expand(rare[some, 0])
        q = some[q]
        for k in range(1, rare.shape[1]):
            term = np.maximum(rare[q, k], 0)
            j = np.minimum(np.searchsorted(self.keys, term << _SHIFT | np.maximum(0, place - span)), len(self.keys) - 1)
            keep = (rare[q, k] < 0) | (self.keys[j] >= (term << _SHIFT | np.maximum(0, place - span))) & (self.keys[j] <= (term << _SHIFT | place + span))
            q, place = q[keep], place[keep]
        return q, place


def search(stored: DataFrame, asked: Asked, counts: np.ndarray, span: int = SPAN) -> DataFrame:
    """(chunk, at, starts, ends, items, near) of each document, the at-th of its row, that holds a phrase or the rare terms of an item.

    starts and ends are the merged runs of hit words, items those matched exactly, near those by proximity: NEAR_TERMS of an
    item's terms that the corpus has, the rarest (all, if the item has fewer), at most span words from the rarest.
    """
    weight = np.append(counts, np.iinfo(np.int64).max)  # -1 takes the last: places after a short item's end come last
    order = np.argsort(weight[asked.phrase], 1, kind="stable").astype(np.int8)
    rare = np.full((len(asked.ids), NEAR_TERMS), -1, np.int32)
    for k, t in enumerate(asked.item_terms):
        some = t[counts[t] > 0]
        some = some[np.argsort(counts[some], kind="stable")][:NEAR_TERMS]
        if len(some) >= min(NEAR_TERMS, len(t)):
            rare[k, : len(some)] = some
    sent = stored.sparkSession.sparkContext.broadcast((asked.terms, asked.phrase, order, (asked.phrase >= 0).sum(1), asked.item_at, asked.item, asked.ids, rare))

    def group(doc: np.ndarray, value: np.ndarray, n: int, many: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (doc, value) sorted; counts by doc, and the values."""
        both = np.unique(doc * max(1, many) + value)
        return np.bincount(both // max(1, many), minlength=n), both % max(1, many)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, phrase, order, length, item_at, item, ids, rare = sent.value
        names = pa.array(ids, pa.string())
        for b in batches:
            for r in range(b.num_rows):
                n_words = b.column("n_words")[r].values.to_numpy()
                at, n = Postings(n_words, b.column("terms")[r].as_py(), b.column("places")[r].as_py(), terms), len(n_words)
                p, start = at.phrases(phrase, order)
                doc = np.searchsorted(at.base, start, "right") - 1
                reps = np.diff(item_at)[p]
                found = item[np.repeat(item_at[p], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)] if len(p) else np.zeros(0, np.int64)
                per, items = group(np.repeat(doc, reps), found, n, len(ids))
                q, place = at.near(rare, span)
                per_near, near = group(np.searchsorted(at.base, place, "right") - 1, q, n, len(ids))
                # merge hit runs: sort by start, a run opens where no earlier one reaches
                by = np.argsort(start, kind="stable")
                s, e, d = start[by], (start + length[p])[by], doc[by]
                reach = np.maximum.accumulate(e) if len(e) else e
                new = np.append(True, s[1:] > reach[:-1]) if len(s) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(s)) - 1 if len(first) else first
                runs = np.bincount(d[first], minlength=n)
                base = at.base[d[first]]
                some = np.flatnonzero((per > 0) | (per_near > 0))
                lists = lambda v, k: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(k)]).astype(np.int32)), v)
                whole = lambda v: pa.array(v.astype(np.int32))
                columns = [lists(whole(s[first] - base), runs), lists(whole(reach[last] - base), runs), lists(names.take(pa.array(items)), per), lists(names.take(pa.array(near)), per_near)]
                chunk = np.full(len(some), b.column("chunk")[r].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(chunk), whole(some), *[c.take(pa.array(some)) for c in columns]], names=["chunk", "at", "starts", "ends", "items", "near"])

    return stored.select("chunk", "n_words", "terms", "places").mapInArrow(run, "chunk long, at int, starts array<int>, ends array<int>, items array<string>, near array<string>")


_FOUND = "chunk long, at int, starts array<int>, ends array<int>, items array<string>, near array<string>"


def match(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", window: int = WINDOW) -> DataFrame:
    """Each document with key, n_words, n_hit, n_items, items_sha256, contaminated, n_near, items and hit runs (starts, ends).

    The index of docs is stored once; each block of the benchmark is answered from it, and the finds of a document are
    joined by its place there. Null or empty texts have no words; benchmark rows with a null id or text ask nothing; the
    rows of one item id are one item; repeated documents and null keys are rows like others; other columns are dropped,
    whatever their names. An empty table gives no rows, an empty benchmark no finds.
    """
    stored = index(docs, key, text)
    found = docs.sparkSession.createDataFrame([], _FOUND)
    for asked in blocks(benchmark, item, text, window):
        found = found.unionByName(search(stored, asked, frequencies(stored, asked)))
    found = common.stored(found)
    flat = lambda c: F.flatten(F.collect_list(c))
    distinct = lambda c: F.array_sort(F.array_distinct(flat(c))).alias(c)
    found = found.groupBy("chunk", "at").agg(F.array_sort(F.arrays_zip(flat("starts").alias("s"), flat("ends").alias("e"))).alias("_runs"), distinct("items"), distinct("near"))
    kind = "array<struct<s:int,e:int>>"

    def step(a, x):  # noqa: ANN001, ANN202
        last = F.get(a, F.size(a) - 1)
        grown = F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when((F.size(a) > 0) & (x["s"] <= last["e"]), grown).otherwise(F.concat(a, F.array(x))).cast(kind)

    found = found.withColumn("_runs", F.aggregate(F.col("_runs").cast(kind), F.array().cast(kind), step))
    every = stored.select("chunk", F.posexplode(F.arrays_zip("keys", "n_words")).alias("at", "x")).select("chunk", "at", F.col("x.keys").alias("_key"), "x.n_words")
    rows = every.join(found, ["chunk", "at"], "left")
    none = lambda c, of: F.coalesce(c, F.array().cast(of))
    runs, items, near = none("_runs", kind), none("items", "array<string>"), none("near", "array<string>")
    hit = F.aggregate(runs, F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return rows.select(F.col("_key").alias(key), "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.size(runs) > 0).alias("contaminated"), F.size(near).cast("long").alias("n_near"), items.alias("items"), F.transform(runs, lambda x: x["s"]).alias("starts"), F.transform(runs, lambda x: x["e"]).alias("ends"))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that hold a benchmark passage; all columns stay.

    Rows without a key stay, and null and empty texts; where a key repeats, one contaminated row takes all of its rows
    along. An empty benchmark leaves all.
    """
    bad = common.stored(match(docs, benchmark, key, text).where("contaminated").select(key).distinct())
    return common.without(docs, bad, key)
