"""Rewriting of block text, and checks of what was written."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: word runs of an original that are looked up at most; parts into which blocks are dealt for originals without any
RUNS, SALTS = 4, 64
#: the dotted and the dotless i, which patterns without case take for i
_DOTS = {0x130: "i", 0x131: "i"}


def redacted(blocks: DataFrame, records: DataFrame) -> DataFrame:
    """Blocks with `redacted`: every record with a replacement_value spliced in, left to right; others as they are."""
    spans = records.where("replacement_value IS NOT NULL").groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct(F.col("start_offset").alias("s"), F.col("end_offset").alias("e"), F.col("replacement_value").alias("r")))).alias("_spans"))
    joined = blocks.join(spans, "block_id", "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col("text")

    def step(a: Column, x: Column) -> Column:
        return F.struct(x["e"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, x["s"] - a["at"]), x["r"]).alias("out"))

    done = F.aggregate("_spans", start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text))))
    return joined.withColumn("redacted", F.coalesce(done, text)).drop("_spans")


def _edged(w: str) -> str:
    """The pattern of an original: its letters and digits at the ends are bounded by words."""
    return (r"(?<!\w)" if w[:1].isalnum() else "") + re.escape(w) + (r"(?!\w)" if w[-1:].isalnum() else "")


def _pieces(text: str, whole: bool) -> list[str]:
    """Runs of word characters, case folded; unless whole, without those at the ends of an original that may stand inside longer ones."""
    fold = lambda t: t.translate(_DOTS).casefold()
    return [fold(m.group()) for m in re.finditer(r"\w+", text) if whole or ((m.start() or text[0].isalnum()) and (m.end() < len(text) or text[-1].isalnum()))]


def repeats_redacted(blocks: DataFrame, records: DataFrame, most: int | None = None, column: str = "redacted") -> DataFrame:
    """Approved originals that stand elsewhere, word-bounded, case aside, longest first, replaced in every block.

    The dictionary is one row for each original and stays distributed: it is joined to the blocks by the first word runs
    of each original (RUNS at most), so that a block is searched for those alone that can stand in it. Originals without
    such a run are searched in every block. With `most`, the query stops beyond so many originals.
    """
    known = records.where("replacement_value IS NOT NULL AND original_text <> ''").groupBy(F.lower("original_text").alias("k")).agg(F.min_by("replacement_value", F.struct("block_id", "start_offset")).alias("r"))
    if most is not None and known.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} distinct originals")
    both = F.array(F.struct(F.col("k").alias("w"), "r", F.lit("").alias("own")), F.struct(F.col("r").alias("w"), "r", F.lit("own").alias("own")))
    entries = known.select(F.explode(both).alias("x")).select("x.*").where("w <> ''").distinct()
    names, kind = blocks.columns, blocks.schema["block_id"].dataType.simpleString()

    def anchored(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in parts:
            grams = [["\0".join(p[:RUNS])] if (p := _pieces(w, False)) else [f"\1{k}" for k in range(SALTS)] for w in f["w"]]
            yield f.assign(gram=grams).explode("gram")[["gram", "w", "r", "own"]]

    def grams(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in parts:
            ids, out = [], []
            for k, t in zip(f["block_id"], f[column], strict=True):
                p = _pieces(t or "", True)
                out += {"\0".join(p[i : i + n]) for n in range(1, RUNS + 1) for i in range(len(p) - n + 1)}
                out.append(f"\1{zlib.crc32((t or '').encode()) % SALTS}")
                ids += [k] * (len(out) - len(ids))
                if len(out) > 50_000:
                    yield pd.DataFrame({"block_id": ids, "gram": out})
                    ids, out = [], []
            yield pd.DataFrame({"block_id": pd.Series(ids, dtype=f["block_id"].dtype), "gram": pd.Series(out, dtype=object)})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(text: str, words: Sequence[Sequence[str]] | None) -> str:
            if text is None or words is None:
                return text
            own = {w.lower() for w, _, o in words if o}
            table = {w: r for w, r, o in words if not o}
            pattern = re.compile("|".join(map(_edged, sorted({*table, *own}, key=lambda w: (-len(w), w)))), re.IGNORECASE)

            def swap(m: re.Match) -> str:
                low = m.group().lower()
                return m.group() if low in own else table.get(low, m.group())

            return pattern.sub(swap, text)

        for f in parts:
            yield f.assign(**{column: [done(t, w) for t, w in zip(f[column], f["_words"], strict=True)]})[names]

    asked = blocks.select("block_id", column).mapInPandas(grams, f"block_id {kind}, gram string")
    hits = asked.join(entries.mapInPandas(anchored, "gram string, w string, r string, own string"), "gram")
    words = hits.groupBy(F.col("block_id").alias("_id")).agg(F.collect_set(F.array("w", "r", "own")).alias("_words"))
    return blocks.join(words, F.col("block_id").eqNullSafe(F.col("_id")), "left").drop("_id").mapInPandas(run, blocks.schema)


def application_failures(blocks: DataFrame, records: DataFrame) -> DataFrame:
    """Records whose replacement does not stand in the block that was written."""
    r = records.where("replacement_value IS NOT NULL").select("record_id", "block_id", "replacement_value")
    return r.join(blocks.select("block_id", "redacted"), "block_id").where(~F.contains("redacted", "replacement_value")).select("record_id", "block_id")


def residuals(blocks: DataFrame, records: DataFrame) -> DataFrame:
    """Originals of four characters or more that still stand, word-bounded, in their own block after replacements are taken out.

    Every replacement of the block is taken out, the longest first, case aside; every place of an original is judged.
    """
    approved = records.where("replacement_value IS NOT NULL")
    quoted = lambda c: F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    value = F.lower("replacement_value")
    longest = F.reverse(F.array_sort(F.collect_set(F.when(value != "", F.struct(F.char_length(value).alias("n"), value.alias("v"))))))
    known = approved.groupBy("block_id").agg(longest.alias("_known"))
    low = F.lower("redacted")
    rest = F.when(F.size("_known") > 0, F.regexp_replace(low, F.array_join(F.transform("_known", lambda x: quoted(x["v"])), "|"), F.lit("\n"))).otherwise(low)
    left = blocks.select("block_id", "redacted").join(known, "block_id").select("block_id", rest.alias("_rest"))
    r = approved.where(F.char_length(F.trim("original_text")) >= 4).join(left, "block_id")
    original = F.lower("original_text")
    edge = lambda c, pattern: F.when(c.rlike(r"^[\p{L}\p{N}]$"), F.lit(pattern)).otherwise(F.lit(""))
    bounded = F.concat(F.lit("(?U)"), edge(F.substring(original, 1, 1), r"(?<!\w)"), quoted(original), edge(F.right(original, F.lit(1)), r"(?!\w)"))
    return r.where(F.rlike("_rest", bounded)).select("record_id", "block_id", "original_text").distinct()


def gate(run) -> DataFrame:  # noqa: ANN001
    """One row: unresolved records, replacements not applied, residuals (null while records are unresolved), final (none
    unresolved: the output is no draft) and passed (final, and both checks found nothing)."""
    pending = run.records.agg(F.count_if(F.col("policy_action") == "REVIEW").alias("unresolved"))
    missed = application_failures(run.redacted, run.records).agg(F.count("*").alias("not_applied"))
    left = residuals(run.redacted, run.records).agg(F.count("*").alias("_left"))
    rows = pending.crossJoin(missed).crossJoin(left)  # one row each
    final = F.col("unresolved") == 0
    return rows.select("unresolved", "not_applied", F.when(final, F.col("_left")).alias("residuals"), final.alias("final"), (final & (F.col("not_applied") == 0) & (F.col("_left") == 0)).alias("passed"))


def scrubbed_urls(pages: DataFrame, originals: Sequence[tuple[str, str]], url: str = "url") -> DataFrame:
    """Pages whose url has each (original, replacement) replaced, the last entry of an original counting."""
    out = F.col(url)
    for a, b in dict(originals).items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return pages.withColumn("redacted_url", out)
