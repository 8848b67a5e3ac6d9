"""Places of matches in a text, as Column expressions; no Python runs on the rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: private-use marks; they are taken out of texts before matching
OPEN, CLOSE = "\ue000", "\ue001"
SPAN = "array<struct<s:int,e:int,v:string>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: a lambda's variable is not written out again at each use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def held(df: DataFrame, *columns: str) -> DataFrame:
    """df with these columns computed once: later stages cannot write their expressions out again."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.explode(F.array(F.struct(*columns))).alias("_held")).select(*rest, *[F.col("_held")[c].alias(c) for c in columns])


def find_all(text: Column, pattern: str, first: str | None = None) -> Column:
    """array<struct<s, e, v>> of all matches of a Java pattern, offsets in code points, e exclusive.

    Matches are marked, the text is split at the marks, and lengths are summed from left to right. `first` is a cheaper
    pattern without which the text holds no match.
    """
    marked = F.regexp_replace(text, F.lit(pattern), F.lit(f"{OPEN}$0{CLOSE}"))

    def step(a: Column, part: Column) -> Column:
        v = F.substring_index(part, CLOSE, 1)
        span = F.struct(a["at"].alias("s"), (a["at"] + F.char_length(v)).alias("e"), v.alias("v"))
        return F.struct((a["at"] + F.char_length(part) - 1).alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

    def fold(parts: Column) -> Column:
        start = F.struct(F.char_length(F.get(parts, F.lit(0))).alias("at"), F.array().cast(SPAN).alias("out"))
        return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), start, step, lambda a: a["out"])

    folded = bound(F.split(marked, OPEN, -1), fold)
    return F.when(text.rlike(first or pattern), folded).otherwise(F.array().cast(SPAN))


def folded(text: Column) -> Column:
    """Case folded as far as the corpora's languages need: the sharp s becomes two letters, which shifts what follows."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def around(low: Column, s: Column, e: Column, before: int, after: int) -> Column:
    """The part of folded text from s - before to e + after."""
    start = F.greatest(F.lit(0), s - before)
    return F.substring(low, start + 1, e + after - start)


def has_any(text: Column, terms: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | text.contains(t)
    return out


def overlap(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (a["e"] > b["s"])


def normalized(value: Column) -> Column:
    """Lower case, white space runs to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(value), r"\s+", " "))
