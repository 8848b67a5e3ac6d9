"""License scans by diagonal voting; DataFrame functions only on the whole path."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import bound

#: base phrases and their labels
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: wording of well-known public licences, and the label that a verified span gives
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-3.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
)
K, NEAR, COVER = 2, 3, 0.75
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: what stands between words of lower-cased texts
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of the whole text, A-Z lower-cased; none for null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), GAP), lambda w: w != "")


def _grams(w: Column) -> Column:
    """A k-gram for each word place, and one marker (place -1) for the row itself, so that rows without hits stay."""
    gram = lambda i: F.struct(i.alias("at"), F.xxhash64(*[F.get(w, i + k) for k in range(K)]).alias("hash"), *[F.get(w, i + k).alias(f"w{k}") for k in range(K)])
    marker = F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).cast("long").alias("hash"), *[F.lit("").alias(f"w{k}") for k in range(K)]))
    return F.concat(marker, F.when(F.size(w) >= K, F.transform(F.sequence(F.lit(0), F.size(w) - K), gram)).otherwise(F.slice(marker, 1, 0)))


def _chains(hits: Column, need: Column, cover: float) -> Column:
    """array<struct<n, start, end, low>>: chains of at least `cover` of the template, n places each, none overlapping.

    The hits are sorted. A hit goes on with the longest chain that ends before it in text and template, on a diagonal at
    most NEAR away; only hits at most need + NEAR words back can be such ends.
    """
    place = "array<struct<n:int,start:int,low:int,at:int,t_at:int>>"
    chain = "array<struct<n:int,start:int,end:int,low:int>>"

    def step(a: Column, x: Column) -> Column:
        diagonal = x["at"] - x["t_at"]
        fits = lambda p: (p["at"] < x["at"]) & (p["t_at"] < x["t_at"]) & (F.abs(diagonal - p["at"] + p["t_at"]) <= NEAR)
        best = F.array_max(F.filter(a["recent"], fits))

        def put(b: Column) -> Column:
            n, start, low = F.coalesce(b["n"], F.lit(0)) + 1, F.coalesce(b["start"], x["at"]), F.least(b["low"], diagonal)
            me = F.struct(n.alias("n"), start.alias("start"), low.alias("low"), x["at"].alias("at"), x["t_at"].alias("t_at"))
            recent = F.concat(F.filter(a["recent"], lambda p: p["at"] >= x["at"] - need - NEAR), F.array(me))
            out, last = a["found"], F.get(a["found"], F.size(a["found"]) - 1)
            more = F.array(F.struct(n.alias("n"), start.alias("start"), x["at"].alias("end"), low.alias("low")))
            found = F.when(n / need < cover, out).when(last.isNull() | (start > last["end"]), F.concat(out, more)).when(n > last["n"], F.concat(F.slice(out, F.lit(1), F.size(out) - 1), more)).otherwise(out)
            return F.struct(recent.cast(place).alias("recent"), found.cast(chain).alias("found"))

        return bound(best, put)

    return F.aggregate(hits, F.struct(F.array().cast(place).alias("recent"), F.array().cast(chain).alias("found")), step, lambda a: a["found"])


def scan(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, text: str = "text", cover: float = COVER) -> DataFrame:
    """Each row with n_words, n_base, first_word, last_word, base_labels, labels, score and spans, and without the text.

    All rolling word k-grams of every text are joined by hash to template positions (a fixed table, far under the
    broadcast limit) and their words compared, so that a hit is exact. Hits vote for the diagonal document place minus
    template place. A base phrase stands where all its k-grams vote for one diagonal. For longer templates, hits are
    chained in the order of both text and template, from one diagonal to another at most NEAR apart; a span is verified
    where a chain holds at least `cover` of the template's k-grams, each counted once. score
    is the best such share, 1.0 for any base phrase, 0.0 without spans. spans lists (label, first word, share) of every
    verified span, the longest chain of those that overlap. Null and empty texts have no words, no labels and score 0.0;
    repeated rows and null keys are rows like others; an empty table gives no rows; a long text is read whole, its hits
    alone being gathered in a row; columns of docs named like the new ones are replaced.
    """
    spark = docs.sparkSession
    rows, known = [(-1, -1, 0, "", True)], [*phrases, *templates]
    for t, (phrase, label) in enumerate(known):
        w = re.split(" ", phrase)
        rows += [(t, i, len(w) - K + 1, label, t < len(phrases)) for i in range(len(w) - K + 1)]
    grams = [("",) * K, *[tuple(p.split(" ")[i : i + K]) for p, _ in known for i in range(len(p.split(" ")) - K + 1)]]
    places = spark.createDataFrame([r + g for r, g in zip(rows, grams, strict=True)], "t int, t_at int, need int, label string, base boolean, " + ", ".join(f"t_w{k} string" for k in range(K)))
    places = places.withColumn("t_hash", F.when(F.col("t") < 0, F.lit(0).cast("long")).otherwise(F.xxhash64(*[f"t_w{k}" for k in range(K)])))
    own = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    others = [c for c in docs.columns if c not in (text, *own)]
    row = docs.select(F.struct(F.monotonically_increasing_id().alias("_row"), *others).alias("_r"), words(F.col(text)).alias("_w"))
    gram = row.select("_r", F.size("_w").alias("n_words"), F.explode(_grams(F.col("_w"))).alias("g")).select("_r", "n_words", "g.*")
    same = [F.col("hash") == F.col("t_hash"), *[F.col(f"w{k}") == F.col(f"t_w{k}") for k in range(K)]]
    hits = gram.join(F.broadcast(places), same)
    by = ["_r", "n_words", "t", "need", "label", "base", F.when(F.col("base"), F.col("at") - F.col("t_at")).alias("first")]
    span = hits.groupBy(*by).agg(F.count("*").alias("votes"), F.array_sort(F.collect_list(F.when(~F.col("base"), F.struct("at", "t_at")))).alias("hits"))
    chains = F.transform(_chains(F.col("hits"), F.col("need"), cover), lambda c: F.struct(F.col("label").alias("label"), c["low"].alias("first"), (c["n"] / F.col("need")).alias("share")))
    span = span.withColumn("chains", F.when(~F.col("base"), chains)).withColumn("share", F.when(F.col("base"), F.lit(1.0)).otherwise(F.array_max(F.transform("chains", lambda c: c["share"]))))
    found = (F.col("t") >= 0) & F.when(F.col("base"), F.col("votes") >= F.col("need")).otherwise(F.size("chains") > 0)
    base = found & F.col("base")
    out = span.groupBy("_r", "n_words").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first").cast("long"))).alias("first_word"),
        F.max(F.when(base, F.col("first").cast("long"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(found, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(found, F.col("share"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.flatten(F.collect_list(F.when(found & ~F.col("base"), F.col("chains"))))).alias("spans"),
    )
    return out.select(*[F.col("_r")[c].alias(c) for c in others], F.col("n_words").cast("long").alias("n_words"), *own[1:])
