"""URL filter: host and path rules, then a ratio of two smoothed variable-order character models."""

from __future__ import annotations

import itertools
import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import common

#: (verdict, rule); a rule is a host and a path
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
ORDER = 5
#: bytes of rows in a block, which is scored at once; n-grams that a task counts before it sends them on
BLOCK, COUNTED = 1 << 20, 1 << 18
#: characters in all of the URLs that a caller's own sample may have
SAMPLE_CHARS = 4_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOW = str.maketrans(_UPPER, _LOWER)


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rules(rules: Sequence[tuple[str, str]], h: Column, p: Column, value: int) -> Column:
    """The verdict (0) or text (1) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1])):
        on, slash, start = rule[1].partition("/")
        fits = ((h == on) | h.endswith("." + on)) & p.startswith(slash + start)
        out = F.when(fits, F.lit(rule[value])).otherwise(out)
    return out


class Markov:
    """Character model that blends orders 0 to ORDER - 1 by the Witten-Bell rule; below order 0, all characters are alike."""

    def __init__(self, texts: Sequence[str], order: int = ORDER) -> None:
        self.order, self.counts = order, defaultdict(lambda: defaultdict(int))
        for t in texts:
            t = "\x02" * (order - 1) + t + "\x03"
            for i in range(order - 1, len(t)):
                for k in range(order):
                    self.counts[t[i - k : i]][t[i]] += 1
        self.totals = {c: sum(x.values()) for c, x in self.counts.items()}

    @classmethod
    def of(cls, counts: dict[str, dict[str, int]], order: int = ORDER) -> Markov:
        """The model with these counts: context -> next character -> times."""
        out = cls((), order)
        out.counts, out.totals = counts, {c: sum(x.values()) for c, x in counts.items()}
        return out

    def prob(self, context: str, c: str) -> float:
        p = 1 / 512
        for k in range(len(context) + 1):
            seen = self.counts.get(context[len(context) - k :] if k else "")
            if seen is None:
                break
            kinds = len(seen)
            p = (seen.get(c, 0) + kinds * p) / (self.totals[context[len(context) - k :] if k else ""] + kinds)
        return p


def seen_part(url: str | None) -> str:
    """What the models read: the host, A-Z lower-cased, and all that follows; a URL without :// whole."""
    if not url or "://" not in url:
        return url or ""
    rest = url.split("://", 1)[1]
    end = min((k for c in "/?#" if (k := rest.find(c)) >= 0), default=len(rest))
    return rest[:end].translate(_LOW) + rest[end:]


def _sampled(urls: DataFrame, url: str, sample: int, size: int) -> list[str]:
    """Distinct URLs by least hash, at most `sample`, whole ones of at most `size` characters together (but the first in any case)."""
    some = urls.select(url).distinct().select(url, F.xxhash64(url).alias("_h"))
    least = some.select("_h", F.char_length(url).cast("long").alias("_n")).orderBy("_h").limit(sample).collect()
    total, last = 0, None
    for h, n in least:
        total += n
        if last is not None and total > size:
            break
        last = h
    return [] if last is None else [r[0] for r in some.where(F.col("_h") <= last).orderBy("_h", url).collect()]


def _grams(url: str | None) -> Iterator[str]:
    """Every character and the end of what the models read of a URL, each after its context of ORDER - 1 characters."""
    t = "\x02" * (ORDER - 1) + seen_part(url) + "\x03"
    return (t[i : i + ORDER] for i in range(len(t) - ORDER + 1))


def _ranked(urls: DataFrame, url: str) -> DataFrame:
    """url, _ruled and _place: distinct URLs and their place by hash among those of the verdict, from 0."""
    h = F.xxhash64(url)
    one = common.stored(urls.select(url, "_ruled").distinct().withColumns({"_h": h, "_slot": F.shiftright(h, 52)}))
    before = Window.partitionBy("_ruled").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = one.groupBy("_ruled", "_slot").count().select("_ruled", "_slot", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_ruled", "_slot").orderBy("_h", url))
    return one.withColumn("_within", within).join(F.broadcast(slots), ["_ruled", "_slot"]).select(url, "_ruled", (F.col("_before") + F.col("_within") - 1).alias("_place"))


def _counted(urls: DataFrame, url: str) -> DataFrame:
    """gram, good, bad: the n-grams of the URLs of each verdict, a row for each task and COUNTED of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = Counter(), Counter()

        def sent() -> pa.RecordBatch:
            grams = list(good | bad)
            out = pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array([good[g] for g in grams], pa.int64()), pa.array([bad[g] for g in grams], pa.int64())], names=["gram", "good", "bad"])
            good.clear()
            bad.clear()
            return out

        for b in batches:
            for x, verdict in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                (good if verdict == "allow" else bad).update(_grams(x))
                if len(good) + len(bad) >= COUNTED:
                    yield sent()
        yield sent()

    return urls.select(url, "_ruled").mapInArrow(run, "gram string, good long, bad long")


def _blocks(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.Table]:
    """The rows, in tables of about BLOCK bytes, the texts of column `at` counted twice; a row is never split."""
    held, size = [], 0
    for b in batches:
        low, each = 0, b.nbytes // max(1, b.num_rows) + 1
        for k, n in enumerate(pc.binary_length(b.column(at)).to_pylist()):
            size += (n or 0) + each
            if size >= BLOCK:
                yield pa.Table.from_batches([*held, b.slice(low, k + 1 - low)])
                held, size, low = [], 0, k + 1
        if low < b.num_rows:
            held.append(b.slice(low))
    if held:
        yield pa.Table.from_batches(held)


def _different(urls: list[str | None]) -> list[str]:
    """The different n-grams of a block's URLs, in order."""
    return sorted({g for x in urls for g in _grams(x)})


def _packed(rows: DataFrame, url: str) -> DataFrame:
    """block, i, gram, rows: for each block of rows the packed rows (i = -1) and its different n-grams, numbered in order."""
    at = rows.columns.index(url)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, t in enumerate(_blocks(batches, at)):
            grams = _different(t.column(at).to_pylist())
            out, n = pa.BufferOutputStream(), len(grams)
            with pa.ipc.new_stream(out, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(t)
            block = (TaskContext.get().partitionId() << 32) + k
            columns = [pa.array([block] * (n + 1), pa.int64()), pa.array(range(-1, n), pa.int32()), pa.array([None, *grams], pa.string()), pa.array([out.getvalue().to_pybytes(), *[None] * n], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "i", "gram", "rows"])

    return common.stored(rows.mapInArrow(run, "block long, i int, gram string, rows binary"))


def _ratios(counted: DataFrame, asked: DataFrame) -> DataFrame:
    """gram and ratio: the log ratio of the two models, for each n-gram asked for.

    All contexts of two characters and more that a probability needs end in the same two characters, so that n-grams go to
    tasks by these and are answered group by group; only the counts of two characters are gathered and broadcast.
    """
    pair = F.substring("gram", ORDER - 1, 2)
    short = counted.groupBy(pair.alias("pair")).agg(F.sum("good"), F.sum("bad")).collect()
    low = counted.sparkSession.sparkContext.broadcast([(p, g, b) for p, g, b in short])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = [defaultdict(lambda: defaultdict(int)) for _ in range(2)]
        for p, *n in low.value:
            for counts, m in zip(short, n, strict=True):
                if m:
                    counts[""][p[1]] += m
                    counts[p[0]][p[1]] += m
        base = [Markov.of(counts) for counts in short]
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        grams, out = [], []
        for last, group in itertools.groupby(rows, lambda r: r[0]):
            group, models = list(group), []
            for v, m in enumerate(base):
                own = defaultdict(lambda: defaultdict(int))
                for r in group:
                    if r[2 + v]:
                        for k in range(2, ORDER):
                            own[r[1][ORDER - 1 - k : -1]][r[1][-1]] += r[2 + v]
                models.append(Markov.of(own))
                for c in ("", last[1]):
                    if c in m.counts:
                        models[-1].counts[c], models[-1].totals[c] = m.counts[c], m.totals[c]
            for r in group:
                good, bad = (m.prob(r[1][:-1], r[1][-1]) for m in models)
                grams.append(r[1])
                out.append(math.log(good / bad))
            if len(grams) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(out, pa.float64())], names=["gram", "ratio"])
                grams, out = [], []
        if grams:
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(out, pa.float64())], names=["gram", "ratio"])

    every = counted.unionByName(asked.select("gram", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("bad")))
    sums = every.groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    context = F.substring("gram", ORDER - 2, 2)
    return common.stored(sums.select(context.alias("context"), "gram", "good", "bad").repartition("context").sortWithinPartitions("context").mapInArrow(run, "gram string, ratio double"))


def _scored(packed: DataFrame, ratios: DataFrame, schema: StructType, url: str) -> DataFrame:
    """The rows of all blocks with ratio: the mean log ratio per character, the end counted as one; of whole texts."""
    at = schema.names.index(url)

    def scored(rows: bytes, ratios: list[float]) -> Iterator[pa.RecordBatch]:
        t = pa.ipc.open_stream(rows).read_all()
        texts = t.column(at).to_pylist()
        known = dict(zip(_different(texts), ratios, strict=True))
        means = [sum(map(known.__getitem__, _grams(x))) / (len(seen_part(x)) + 1) for x in texts]
        yield from t.append_column("ratio", pa.array(means, pa.float64())).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, got = None, []
        for b in batches:
            i, ratio = b.column(1).to_numpy(), b.column(2)
            for low, high in itertools.pairwise([0, *np.flatnonzero(i < 0).tolist(), b.num_rows]):
                if low < high and i[low] < 0:
                    if rows is not None:
                        yield from scored(rows, got)
                    rows, got, low = b.column(3)[low].as_py(), [], low + 1
                got += ratio.slice(low, high - low).to_pylist()
        if rows is not None:
            yield from scored(rows, got)

    answers = packed.where("i >= 0").join(ratios, "gram").select("block", "i", "ratio", F.lit(None).cast("binary").alias("rows"))
    both = packed.where("i < 0").select("block", "i", F.lit(None).cast("double").alias("ratio"), "rows").unionByName(answers)
    out = StructType([StructField(f.name, f.dataType) for f in schema] + [StructField("ratio", DoubleType())])
    return both.repartition("block").sortWithinPartitions("block", "i").mapInArrow(run, out)


def _threshold(held: DataFrame) -> float:
    """The least of the points between ratios that follow each other with the least mean of the two error rates; 0 without both verdicts.

    Ratios are summed by range, so that the order of all is known from sums of at most 8,193 ranges and none is gathered.
    """
    n = held.agg(F.count_if(F.col("_ruled") == "allow"), F.count_if(F.col("_ruled") == "block")).first()
    if not all(n):
        return 0.0
    each = held.groupBy("ratio").agg(F.count_if(F.col("_ruled") == "allow").alias("good"), F.count_if(F.col("_ruled") == "block").alias("bad"))
    each = each.withColumn("range", F.greatest(F.lit(-4096), F.least(F.lit(4096), F.floor(F.col("ratio") * 256))).cast("int"))
    over = Window.partitionBy(F.lit(0)).orderBy("range")
    past, upto = over.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("range").orderBy("ratio")
    sums = each.groupBy("range").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"), F.min("ratio").alias("first"))
    sums = sums.select("range", F.coalesce(F.sum("g").over(past), F.lit(0)).alias("g"), F.coalesce(F.sum("b").over(past), F.lit(0)).alias("b"), F.lead("first").over(over).alias("then"))
    below = [F.sum(c).over(upto.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in ("good", "bad")]
    steps = each.select("range", "ratio", *below, F.lead("ratio").over(upto).alias("next")).join(F.broadcast(sums), "range")
    after = F.coalesce("next", "then", F.col("ratio") + 1e-3)
    middle = (F.col("ratio") + after) / 2
    at = F.when(middle > F.col("ratio"), middle).otherwise(after)
    wrong = ((F.col("good") + F.col("g")) * n[1] - (F.col("bad") + F.col("b")) * n[0]).alias("wrong")
    return steps.select(F.min(F.struct(wrong, at.alias("at"))).alias("best")).first().best.at


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, sample: int | None = None, url: str = "url", size: int = SAMPLE_CHARS) -> DataFrame:
    """Each row with host, path, rule, verdict and ratio (mean log ratio per character; accepted URLs are higher).

    Rules decide where one fits; elsewhere the verdict is allow if ratio >= the calibrated threshold. Both models count every
    distinct URL that a rule decides, but every fifth of each verdict by hash; the threshold has the least mean of the two
    error rates on all of these. A caller may ask for less: `sample` distinct URLs of each verdict at most, those with the
    least hash, as long as they have at most `size` characters together. Every URL is counted and scored whole. Null and
    empty URLs have an empty text, whose only character is the end; with no URLs to fit on, every ratio is 0 and the
    threshold 0. Repeated rows and null keys are rows like others; an empty table gives no rows; columns named like the new
    ones are replaced.

    Neither the models nor the URLs are kept in the driver or broadcast, but for counts of two characters. Rows go in blocks
    of about BLOCK bytes; a block asks for the log ratio of each of its different n-grams, and the answers meet its packed
    rows again in one task, all their columns included.
    """
    common.ship(pages.sparkSession)
    base = pages.drop("host", "path", "rule", "verdict", "ratio")
    h, p = host(F.col(url)), path(F.col(url))
    ruled = base.select(url, _rules(rules, h, p, 0).alias("_ruled")).where("_ruled in ('allow', 'block')")
    if sample is not None:
        some = [(x, v) for v in ("allow", "block") for x in _sampled(ruled.where(F.col("_ruled") == v), url, sample, size)]
        ruled = base.sparkSession.createDataFrame(some, ruled.schema)
    ranked = _ranked(ruled, url)
    packed, counted = _packed(base, url), common.stored(_counted(ranked.where("_place % 5 != 0"), url))
    ratios = _ratios(counted, packed.where("i >= 0"))
    held = ranked.where("_place % 5 = 0").select(url, "_ruled")
    at = _threshold(common.stored(_scored(_packed(held, url), ratios, held.schema, url).select("ratio", "_ruled")))
    out = _scored(packed, ratios, base.schema, url)
    verdict = F.coalesce(_rules(rules, h, p, 0), F.when(F.col("ratio") >= at, "allow").otherwise("block"))
    return out.select(*base.columns, h.alias("host"), p.alias("path"), _rules(rules, h, p, 1).alias("rule"), "ratio", verdict.alias("verdict"))
