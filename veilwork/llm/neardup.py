"""Near-duplicate documents: SetSketch registers, bands of register values, joint likelihood, then full sets."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, text as T
from .components import components

WORDS, BANDS, ROWS, SIMILAR = 5, 32, 4, 75
REGISTERS = BANDS * ROWS
#: the sketch: base, rate and number of levels; levels fit 16 bits
BASE, RATE, LEVELS = 1.001, 20.0, (1 << 16) - 2
#: members and shingles of a block at most, about, and elements of a matrix, in the comparison of blocks
BLOCK, SHINGLES, COLUMNS = 512, 100_000, 4_096
#: an estimate below this is more than five standard errors from SIMILAR percent
ESTIMATE = 0.5
_rng = np.random.default_rng(20240501)
_A = _rng.integers(1 << 31, 1 << 32, REGISTERS, np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, REGISTERS, np.uint64).astype(np.uint32)


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted by row and hash, and the row of each; fewer words are one shingle."""
    data = T.LOWER[data]
    start, end, row = T.words(data, at, T.NOT_SPACE)
    h = T.hashes(data, start, end)
    runs, place = T.runs(h, row, WORDS)
    parts, rows = [runs], [row[place]]
    n = np.bincount(row, minlength=len(at) - 1)
    for k in range(1, WORDS):
        own = np.flatnonzero(n[row] == k)
        if len(own):
            short, place = T.runs(h[own], row[own], k, salt=k)
            parts.append(short)
            rows.append(row[own][place])
    h, row = np.concatenate(parts), np.concatenate(rows)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


def levels(least: np.ndarray) -> np.ndarray:
    """Register values of least 32-bit hashes: exponential variables in steps of BASE, truncated."""
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LEVELS + 1).astype(np.uint16)


def registers(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One sketch (REGISTERS 16-bit values) for each run of hashes that starts at `first`."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(first), REGISTERS), np.uint32)
    for k in range(REGISTERS):
        out[:, k] = np.minimum.reduceat(x * _A[k] + _B[k], first)
    return levels(out)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of ROWS registers."""
    return T.mix(sketch.reshape(len(sketch), BANDS, ROWS).view(np.uint64)[:, :, 0] + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_GRID = np.linspace(0, 1, 201)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs by joint maximum likelihood of how their registers compare, set sizes known."""
    a, b = a.astype(np.int32), b.astype(np.int32)
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.minimum(u / v, v / u) * _GRID
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    same = REGISTERS - more - less
    with np.errstate(divide="ignore", invalid="ignore"):
        like = sum(np.where(n > 0, n * np.log(np.maximum(q, 1e-300)), 0) for n, q in ((more, up), (less, down), (same, 1 - up - down)))
    return np.take_along_axis(j, like.argmax(1)[:, None], 1)[:, 0]


def _digests(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """128 bits of SHA-256 over each text's sorted shingles, as two rows of int64; 0 for an empty set. It names the set."""
    out, end = np.zeros((2, len(n)), np.int64), np.cumsum(n)
    for k in np.flatnonzero(n):
        out[:, k] = np.frombuffer(hashlib.sha256(h[end[k] - n[k] : end[k]].tobytes()).digest()[:16], np.int64)
    return out


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, s1, s2, sketch) of every row; s1 and s2 name the set, sketch is null for an empty one."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high, data, at in T.chunks(b.column(1)):
                h, row = shingles(data, at)
                n = np.bincount(row, minlength=high - low)
                own = np.flatnonzero(n)
                raw: list[bytes | None] = [None] * (high - low)
                if len(own):
                    for i, k in zip(own, registers(h, (np.cumsum(n) - n)[own]), strict=True):
                        raw[i] = k.tobytes()
                s = _digests(h, n)
                yield pa.RecordBatch.from_arrays([b.column(0)[low:high], pa.array(n.astype(np.int64)), pa.array(s[0]), pa.array(s[1]), pa.array(raw, pa.binary())], names=[key, "n", "s1", "s2", "sketch"])

    base = docs.select(key, text)
    return common.stored(base.mapInArrow(run, f"`{key}` {_kind(docs, key)}, n long, s1 long, s2 long, sketch binary"))


def _kind(df: DataFrame, key: str) -> str:
    return df.schema[key].dataType.simpleString()


def _bands(classes: DataFrame) -> DataFrame:
    """(band, id) rows of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = band_keys(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), BANDS)))], names=["band", "id"])

    return classes.select("id", "sketch").mapInArrow(run, f"band long, id {_kind(classes, 'id')}")


def candidates(ids: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Stored rows (id, s1, n, sketch, z) of the classes named, one for each; z is the text, compressed, from which sets are made again.

    A row whose text has another set than the class (its key repeats) is left out.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high, data, at in T.chunks(b.column("text")):
                c = b.slice(low, high - low)
                h, row = shingles(data, at)
                s = _digests(h, np.bincount(row, minlength=high - low))
                own = np.flatnonzero((s[0] == c.column("s1").to_numpy()) & (s[1] == c.column("s2").to_numpy()))
                z = [zlib.compress(data[at[k] : at[k + 1]].tobytes(), 1) for k in own]
                yield pa.RecordBatch.from_arrays([*[c.column(x).take(pa.array(own)) for x in ("id", "s1", "n", "sketch")], pa.array(z, pa.binary())], names=["id", "s1", "n", "sketch", "z"])

    wanted = classes.join(ids.distinct(), "id").select("id", "n", "sketch", "s1", "s2")
    maybe, _ = common.sifted(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), wanted, "id")
    full = maybe.join(wanted, "id")
    out = common.stored(full.select("id", "n", "sketch", "s1", "s2", "text").mapInArrow(packed, f"id {_kind(classes, 'id')}, s1 long, n long, sketch binary, z binary"))
    many = out.groupBy("id", "s1").agg(F.count("*").alias("m")).where("m > 1")
    if many.isEmpty():
        return out
    # rows that repeat with their key: one for each set
    one = out.join(many, ["id", "s1"], "left_semi").groupBy("id", "s1").agg(F.min(F.struct("n", "sketch", "z")).alias("x")).select("id", "s1", "x.*")
    return common.stored(out.join(many, ["id", "s1"], "left_anti").unionByName(one))


def confirm(pairs: DataFrame, full: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """Those pairs (a, b) whose full sets reach `similar` percent: set sizes and the estimate first, then every shingle.

    Only pairs that the estimate leaves are joined to texts. A hot a is a skewed join key, which Spark splits.
    """
    kind = _kind(full, "id")
    names = f"a {kind}, b {kind}"
    side = lambda c, *what: full.select(F.col("id").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in what])
    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * similar

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                regs = [np.frombuffer(b"".join(b.column(f"sketch_{c}").to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in "ab"]
                likely = estimate(*regs, *[b.column(f"n_{c}").to_numpy().astype(float) for c in "ab"]) >= ESTIMATE
                yield b.select(["a", "b"]).filter(pa.array(likely))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)

        def whole(z: bytes) -> np.ndarray:
            raw = np.frombuffer(zlib.decompress(z), np.uint8)
            return shingles(raw, np.array([0, len(raw)]))[0]

        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for k in range(b.num_rows):
                z = b.column("z_a")[k].as_py()
                if last[0] != z:
                    last = (z, whole(z))
                one, two = last[1], whole(b.column("z_b")[k].as_py())
                common_ = len(one) + len(two) - len(np.union1d(one, two))
                keep[k] = 100 * common_ >= similar * (len(one) + len(two) - common_)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    sketched = pairs.join(side("b", "n", "sketch"), "b").join(side("a", "n", "sketch"), "a").where(fits)
    likely = common.stored(sketched.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(guess, names))
    both = likely.join(side("b", "z"), "b").join(side("a", "z"), "a")
    return common.stored(both.select("a", "b", "z_a", "z_b").mapInArrow(check, names))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two short lists of sets, by products of 0/1 matrices over COLUMNS elements at a time."""
    parts = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (left, right)]
    rows = [np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (left, right)]
    both = np.intersect1d(*parts)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(both):
        return out
    at = []
    for k in range(2):
        place = np.minimum(np.searchsorted(both, parts[k]), len(both) - 1)
        hit = both[place] == parts[k]
        rows[k], place = rows[k][hit], place[hit]
        order = np.argsort(place, kind="stable")
        rows[k] = rows[k][order]
        at.append(place[order])
    for low in range(0, len(both), COLUMNS):
        m = []
        for k, n in enumerate((len(left), len(right))):
            s, e = np.searchsorted(at[k], (low, low + COLUMNS))
            m.append(np.zeros((n, min(COLUMNS, len(both) - low)), np.float32))
            m[k][rows[k][s:e], at[k][s:e] - low] = 1
        out += m[0] @ m[1].T
    return out


def across(members: DataFrame, full: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """Links (a, b) between different components of each band, one for any two components and block at most; a and b are the components.

    members has (band, id, s1, component, main, n, blocks, blocks_aside). Those outside a band's main component are dealt into
    blocks of at most about BLOCK members and SHINGLES shingles, and so are all members; every pair of such blocks is one
    piece of work, so that no band, however hot, meets in one task, and no pair of documents is a row.
    """
    cells = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    texts = members.join(full.select("id", "s1", "z"), ["id", "s1"])
    left = texts.where("component <> main").select("band", F.pmod(F.xxhash64("id"), F.col("blocks_aside")).cast("int").alias("i"), F.explode(cells("blocks")).alias("j"), F.lit(0).alias("side"), "component", "n", "z")
    right = texts.select("band", F.explode(cells("blocks_aside")).alias("i"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int").alias("j"), F.lit(1).alias("side"), "component", "n", "z")
    dealt = left.unionByName(right).repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "side")
    kind = _kind(members, "component")

    def links(rows: list[tuple]) -> list[tuple]:
        cut = sum(r[0] == 0 for r in rows)
        if not 0 < cut < len(rows):
            return []
        raw = [zlib.decompress(r[3]) for r in rows]
        h, row = shingles(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        sets = np.split(h, np.searchsorted(row, np.arange(1, len(rows))))
        meet = overlaps(sets[:cut], sets[cut:])
        n, number = np.array([len(x) for x in sets], np.float32), {}
        of = np.array([number.setdefault(r[1], len(number)) for r in rows])
        found = np.argwhere((100 * meet >= similar * (n[:cut, None] + n[None, cut:] - meet)) & (of[:cut, None] != of[None, cut:]))
        return list({(rows[i][1], rows[cut + j][1]) for i, j in found})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, found = None, [], []
        for b in batches:
            out = [b.column("component").type] * 2
            for r in zip(*[b.column(c).to_pylist() for c in ("band", "i", "j", "side", "component", "n", "z")], strict=True):
                if r[:3] != now:
                    found += links(rows)
                    now, rows = r[:3], []
                rows.append(r[3:])
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], out[k]) for k in (0, 1)], names=["a", "b"])
            found = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links(rows)], out[k]) for k in (0, 1)], names=["a", "b"])

    return common.stored(dealt.mapInArrow(run, f"a {kind}, b {kind}").distinct())


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's key with n_shingles, component_id (least key reachable by links) and kept (key = component_id).

    Equal sets, told by 128 bits of SHA-256 over all their shingles, are one class, found by aggregate. Classes whose
    sketches share a band are compared with the band's least member first, which makes most groups of copies whole; then,
    in bands that still hold several components, all members outside the main one are compared with all members, block by
    block: no pair of two components in a band goes untested, and pairs inside a component need no test. With 32 bands of
    4 registers a pair of similarity 0.75 shares no band with probability 5e-6. Shingles are told apart by 64-bit hash.

    Documents without words, and rows without key, are linked with nothing; the latter's component is null and kept is
    true. Keys may be of any type with an order. Rows with the same key are one document for links, whatever their texts.
    An empty table gives no rows. Other columns are dropped, whatever their names.
    """
    known = sketches(docs, key, text)
    named = known.where(F.col(key).isNotNull() & (F.col("n") > 0))
    classes = common.stored(named.groupBy("s1", "s2").agg(F.min(key).alias("id"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch")))
    docs = docs.select(key, text).where(F.col(key).isNotNull())
    bands = _bands(classes)
    buckets = bands.groupBy("band").agg(F.min("id").alias("least"), F.count("*").alias("size")).where("size > 1")
    live = common.stored(bands.join(buckets, "band").where("least <> id OR size > 2"))
    full = candidates(live.select(F.explode(F.array("id", "least")).alias("id")), classes, docs, key, text)
    edges = confirm(live.where("least <> id").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct(), full)
    # the sets of a key that repeats hang together
    odd = named.groupBy(key).agg(F.min("s1").alias("x"), F.max("s1").alias("y")).where("x <> y").select(key)
    same = named.join(odd, key, "left_semi").join(classes.select("s1", "s2", "id"), ["s1", "s2"]).select(F.col(key).alias("a"), F.col("id").alias("b"))
    linked = components(edges.unionByName(same))
    shared = live.where("size > 2").select("band", "id").join(linked.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = shared.groupBy("band").agg(F.min("component").alias("main"), F.max("component").alias("other")).where("main <> other").select("band", "main")
    rest = common.stored(shared.join(mixed, "band").join(full.select("id", "s1", "n"), "id"))
    blocks = lambda of: (F.greatest(F.count(of) / BLOCK, F.sum(of) / SHINGLES) + 1).cast("int")
    sizes = rest.groupBy("band").agg(blocks(F.col("n")).alias("blocks"), blocks(F.when(F.col("component") != F.col("main"), F.col("n"))).alias("blocks_aside"))
    again = components(across(rest.join(sizes, "band"), full)).select(F.col("node").alias("_c1"), F.col("component").alias("_c2"))
    of = classes.select("s1", "s2", "id").join(linked.withColumnRenamed("node", "id"), "id", "left").withColumn("_c1", F.coalesce("component", "id"))
    of = of.join(again, "_c1", "left").select("s1", "s2", F.coalesce("_c2", "_c1").alias("_c"))
    own = known.join(of, ["s1", "s2"], "left")
    label = F.when(F.col("n") > 0, F.col("_c")).otherwise(F.col(key))
    out = own.select(key, F.col("n").alias("n_shingles"), F.when(F.col(key).isNotNull(), label).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each group, that of its least key, and the rows without key; all columns stay.

    Where the least key itself repeats, the row with the least text (then the least of the other columns) stays; where
    any row of a key goes, all its rows go. Null and empty texts are groups of their own, a repeated key aside; an empty
    table gives no rows.
    """
    found = common.stored(groups(docs, key, text))
    gone = found.where("NOT kept").select(key).distinct()
    many = found.where(F.col("kept") & F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_m")).where("_m > 1").select(key)
    if many.isEmpty():
        return common.without(docs, gone, key)
    many = common.stored(many.join(gone, key, "left_anti"))
    maybe, _ = common.sifted(docs, many, key)
    one = maybe.join(many, key, "left_semi").groupBy(key).agg(F.min(F.struct(F.col(text).alias("_t"), F.struct(*docs.columns).alias("_r"))).alias("_x")).select("_x._r.*")
    return common.without(docs, gone.unionByName(many), key).unionByName(one.select(*docs.columns))
