"""Texts longer than what operators hold at once, odd keys, and one key with several texts, against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from veilwork.llm import bpe, decontaminate, gif, lm, neardup, packing, quality, queries, substrings, text, urls

from test_operators import contamination, key, near_groups, plain_score, removal


def prose(seed, n, kinds=5000):
    r = random.Random(seed)
    return " ".join(f"W{r.randrange(kinds)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    long = prose(1, 150_000)
    assert len(long) > text.CHUNK
    w = long.split()
    near = [*w[:70_000], "changed", *w[70_001:]]
    return [(1, prose(2, 300)), (2, long), (3, " ".join(near)), (4, prose(2, 300)), (5, " ".join(w[100:400])), (6, "x" * 700_000), (7, None), (8, "x" * 700_000 + " tail of it")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1.0, "clash") for r in rows], "doc_id long, text string, score double, near string").repartition(2)


def test_near_duplicates(docs, rows):
    want = near_groups(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.groups(docs).collect()} == want


def test_decontamination(spark, docs, rows):
    items = [(k, " ".join((rows[1][1]).split()[at : at + 40])) for k, at in enumerate(range(0, 149_000, 7_001))] + [(99, "x" * 700_000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert key(tuple(r)[:6] for r in decontaminate.match(docs, bench).collect()) == key(contamination(rows, items))


def test_substrings(docs, rows):
    assert key((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.removed(docs).collect()) == key(removal(rows))


def test_quality_and_scores(spark, docs, rows):
    model = quality.fit(docs, spark.createDataFrame([(k, k % 2) for k in range(9)], "doc_id long, quality int"))
    got = {r.doc_id: r.score for r in quality.classify(docs, model).collect()}
    assert all(abs(got[k] - plain_score(model, t)) < 1e-3 for k, t in rows if k != 8)
    one = {r.doc_id: r for r in lm.score(docs, docs.where("doc_id = 5").select("text")).collect()}
    assert {k: r.n_tokens for k, r in one.items()} == {k: len((t or "").split()) for k, t in rows}
    assert one[1].score == pytest.approx(one[4].score) and one[5].score < one[1].score


def test_tokens_media_and_packing(docs, rows):
    from tokenizers import Tokenizer

    few = docs.where("doc_id IN (2, 6, 7)").select("doc_id", "text")
    t = Tokenizer.from_file(queries.vocabulary())
    ids = {k: t.encode(x or "", add_special_tokens=False).ids for k, x in rows if k in (2, 7)}
    got = {r.doc_id: r.n_tokens for r in bpe.token_counts(few.where("doc_id <> 6"), queries.vocabulary()).collect()}
    assert got == {k: len(v) for k, v in ids.items()}
    pieces = defaultdict(list)
    for r in packing.pack(few.where("doc_id <> 6"), queries.vocabulary()).collect():
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32))
    for k, v in ids.items():
        v = np.array([*v, 2], "<u4")
        assert sorted(pieces[k]) == [(s, n, zlib.crc32(v[s : s + n].tobytes())) for s, n in packing.cut(len(v))]
    for r in gif.media_digest(gif.store_texts(few)).collect():
        raw = (dict(rows)[r.doc_id] or "").encode()
        assert r.n_bytes == len(raw) and r.payload_bytes == max(64, -(-len(raw) // 64) * 64)


def test_string_keys_and_one_key_with_two_texts(spark, rows):
    some = [(f"k{k}", t) for k, t in rows[:5]] + [("k1", prose(3, 80)), ("k4", prose(2, 300)), ("k0", rows[0][1]), (None, rows[0][1]), ("k9", "")]
    docs = spark.createDataFrame(some, "doc_id string, text string")
    assert key((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.removed(docs).collect()) == key(removal(some))
    items = [(1, prose(3, 12)), (2, rows[0][1])]
    bench = spark.createDataFrame(items, "item_id int, text string")
    assert key(tuple(r)[:6] for r in decontaminate.match(docs, bench).collect()) == key(contamination(some, items))
    assert {r.doc_id for r in neardup.first_of_each(docs).collect()} == {"k0", "k2", "k5", "k9", None}
    assert Counter(r.doc_id for r in lm.score(docs, bench).collect()) == Counter(k for k, _ in some)
    assert Counter(r.doc_id for r in packing.pack(docs, queries.vocabulary()).where("start = 0").collect()) == Counter(k for k, _ in some)


def test_null_keys_and_urls_with_clashing_columns(spark):
    pages = spark.createDataFrame([(None, "http://a.com/x", "clash", 1), (None, None, "clash", 2), ("p", "http://b.net/es/", "clash", 3), ("p", "http://c.org/" + "y" * 5000, "clash", 4)], "page_id string, url string, host string, ratio int")
    got = urls.judge(pages).collect()
    assert len(got) == 4 and sorted((r.host, r.verdict) for r in got if r.rule) == [("a.com", "allow"), ("b.net", "block")]
