"""The pipeline's stages, each on its own input."""

import corpus_pipeline as P


def test_stages_and_run(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "near_dedup", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]
    kept = docs
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, kept, d)
        assert out.columns == docs.columns, name
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert ids and ids <= {r.doc_id for r in kept.select("doc_id").collect()}
        kept = spark.createDataFrame(out.collect(), docs.schema)
    rows = P.run(spark, d).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in kept.collect()}
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 1024


def test_stages_match_brute_force(spark):
    import hashlib
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    from test_operators import contamination, near_groups, plain_score, removal
    from veilwork.llm import quality, queries

    d = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{d}/documents.parquet")
    labels, items = spark.read.parquet(f"{d}/labels.parquet"), [(str(r.item_id), r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    first = table.orderBy("doc_id").limit(150).collect()
    rows = [tuple(r) for r in first] + [(10**6 + k, *tuple(r)[1:]) for k, r in enumerate(first[:12])]  # exact copies
    rows += [(2 * 10**6 + k, " ".join(r.text.split()[:-1]) + " other", *tuple(r)[2:]) for k, r in enumerate(first[20:30]) if r.text]  # near ones
    rows += [(3 * 10**6 + k, r.text + " and " + " ".join(first[k].text.split()[:80]), *tuple(r)[2:]) for k, r in enumerate(first[40:60]) if r.text and first[k].text]  # shared passages
    rows += [(4 * 10**6 + k, f"{first[k].text} {items[k][1]}", *tuple(first[k])[2:]) for k in range(5) if first[k].text]  # benchmark passages
    rows += [(5 * 10**6, None, "en", "web", 0), (5 * 10**6 + 1, "", "en", "web", 0)]
    docs = spark.createDataFrame(rows, table.schema).repartition(3)
    text = lambda df: {r.doc_id: r.text for r in df.collect()}
    texts = {r[0]: r[1] for r in rows}

    model = quality.fit(docs, labels)
    good = text(P.quality_classifier(spark, docs, d))
    scores = {r[0]: plain_score(model, r[1]) for r in rows}
    assert all((k in good) == (x >= 0.3) for k, x in scores.items() if abs(x - 0.3) > 1e-3) and 50 < len(good) < len(rows)
    one = P.near_dedup(spark, docs, d)
    group = near_groups([r[:2] for r in rows])
    want = {k: t for k, t, *_ in rows if group[k][1] == k}
    assert text(one) == want and len(want) < len(rows) - 10
    less = P.substring_dedup(spark, docs, d).collect()
    gone = {k: (n, sha) for k, _, n, sha in removal([r[:2] for r in rows])}
    for r in less:
        n, sha = gone[r.doc_id]
        assert hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest() == sha
        assert r.text == texts[r.doc_id] if not n else r.n_chars == len(r.text)
    assert len(less) == len(rows) and sum(n > 0 for n, _ in gone.values()) > 20
    clean = text(P.benchmark_decontamination(spark, docs, d))
    bad = {r[0] for r in contamination([r[:2] for r in rows], items) if r[5]}
    assert set(clean) == {r[0] for r in rows} - bad and {4 * 10**6, 4 * 10**6 + 4} <= bad
    t, found = Tokenizer.from_file(queries.vocabulary()), {}
    for r in P.best_fit_packing(spark, docs, d).collect():
        found.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for k, x, *_ in rows:
        ids, at = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for start, n, crc in sorted(found.pop(k)):
            assert start == at and zlib.crc32(ids[start : start + n].tobytes()) == crc
            at += n
        assert at == len(ids)
    assert not found


def test_stages_keep_clashing_columns_and_odd_rows(spark):
    names = ["doc_id", "text", "n_chars", "score", "predicted", "held_out", "n_words", "n_removed", "kept_sha256", "_uid", "_anchors", "component_id", "kept", "chunk", "Score2", "items"]
    rows = [(k, t, 1, *[f"{c}{k}" for c in names[3:]]) for k, t in ((1, "some words here"), (2, None), (3, ""), (None, "some words here"), (None, None), (4, "some words here"), (4, "some words here"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, " + ", ".join(f"{c} string" for c in names[3:]))
    d = "/root/testdata/sf0.001"
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, docs, d)
        assert got.columns == names, name
        kept = got.collect()
        assert {tuple(r) for r in kept} <= set(rows), name
        if name == "near_dedup":
            assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "3", "None", "None"]
        elif name != "quality_classifier":
            assert len(kept) == len(rows), name
    assert P.STAGES[-1][1](spark, docs, d).count() == len(rows)


def test_empty_tables(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, d).count() == 0


def test_queries_equal_their_sql(spark):
    import duckdb

    from veilwork.llm import queries as Q

    d, c = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name, sql in Q.ORACLES.items():
        df = Q.QUERIES[name](spark, d)
        r = c.execute(sql)
        names = [x[0] for x in r.description]
        got = sorted(tuple(x) for x in df.select(*names).collect())
        assert sorted(df.columns) == sorted(names) and got == sorted(r.fetchall()), name
