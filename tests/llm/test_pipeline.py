"""The pipeline's stages take effect one after the other, and the queries are there."""

import os
import random

import pytest

import corpus_pipeline
from tracerage.llm.queries import ORACLES, QUERIES

from .test_corpus import slow_components, split, words


def test_stages_and_queries_are_registered():
    import __spark_entry__

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "PII", "mixing", "packing"]
    assert {int(k[2:].split("_")[0]) for k in QUERIES} == set(range(1, 14)) and set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        text = words(rng, 80, "abcdefgh" if i % 2 else "стуфхцчш")
        rows.append((i, text, "aa" if i % 2 else "bb", f"s{i % 3}", len(text)))
    rows += [(60 + i, rows[i][1], *rows[i][2:]) for i in range(6)]  # copies
    rows += [(70, "1234 5678 !", None, "s0", 11), (71, None, None, "s1", 0), (72, rows[1][1] + " mail me: joe@mail.example.com now please", "aa", "s2", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{len(seen)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen.append(docs.collect())
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    assert {r.doc_id for r in seen[0]} == {r[0] for r in rows} - {70, 71}
    kept = [r for r in rows if r[0] not in (70, 71)]
    _, comps = slow_components([r[1] for r in kept])
    assert {r.doc_id for r in seen[1]} == {kept[c][0] for c in comps}
    assert all("joe@mail" not in r.text for r in seen[2]) and len(seen[2]) == len(seen[1])
    total = {}
    for r in seen[3]:
        total[r.source] = total.get(r.source, 0) + len(split(r.text))
    size = {}
    for r in seen[2]:
        size[r.source] = size.get(r.source, 0) + len(split(r.text))
    assert sum(total.values()) == pytest.approx(1.5 * sum(size.values()), rel=0.1)
    assert {(r.doc_id) for r in seen[4]} == {r.doc_id for r in seen[3]}
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(tuple(r)[:5] for r in again) == sorted(tuple(r)[:5] for r in seen[4])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="sample tables aren't there")
def test_join_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(con.sql(ORACLES["op5_ngram_join"]).fetchall())
    assert sorted(map(tuple, QUERIES["op5_ngram_join"](spark, "/root/testdata/sf0.001").collect())) == want
