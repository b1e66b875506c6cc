"""The pipeline against a brute-force version of its decisions, and the oracle queries on small tables."""

from __future__ import annotations

import os
from collections import Counter, defaultdict

import duckdb
import pytest
from test_catalog import rows as plain_rows

import corpus_pipeline
from loomtext.llm import mix, near_dedup, rules
from loomtext.llm import queries as Q
from test_operators import LOW, split


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in rules.judge(docs).where("kept").collect()}
    best = {}
    for r in docs.collect():
        if r.doc_id in kept:
            best[r.text] = max(best.get(r.text, -1), r.doc_id)
    left = brute_five([(i, t) for t, i in best.items()])
    out = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, sf)
        if name != "packing":
            assert out.columns == docs.columns
        out = out.persist()
        seen.append(out)
    assert [{r.doc_id for r in d.select("doc_id").collect()} for d in seen[:3]] == [kept, set(best.values()), left]
    taken = Counter({r.doc_id: r.copies for r in mix.report(docs.where(docs.doc_id.isin(left))).collect() if r.copies})
    assert Counter(r.doc_id for r in seen[3].collect()) == taken
    packed = defaultdict(int)
    for r in seen[4].collect():
        packed[r.doc_id] += r.length
    assert set(packed) == set(taken)
    assert corpus_pipeline.run(spark, sf).agg({"length": "sum"}).first()[0] == sum(packed.values())


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_oracles(spark, sf, name):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    assert plain_rows(Q.queries()[name](spark, sf).toPandas()) == plain_rows(c.execute(Q.oracle_sql()[name]).df())


def brute_five(rows: list[tuple]) -> set:
    """The ids that stay at five words a shingle and 0.8, each pair compared."""
    sets = {}
    for i, t in rows:
        w = split((t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, x in enumerate(ids):
        for y in ids[k + 1 :]:
            both = len(sets[x] & sets[y])
            if both and 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
                a, b = top(x), top(y)
                root[max(a, b)] = min(a, b)
    return {i for i in ids if top(i) == i}


def test_near_stage_takes_five_words(spark, sf):
    """Five changes in 200 words: 0.816 on four words, 0.774 on five."""
    base = [f"w{k}" for k in range(200)]
    edits = lambda *at: " ".join(f"new{k}" if k in at else w for k, w in enumerate(base))
    texts = [edits(), edits(20, 60, 100, 140, 180), edits(30), edits(30, 70, 110, 150, 190, 10), "w1 w2 w3 w4", "w1 w2 w3 w4", "w1 w2 w3 w4 w5", "w1 w2 w3 w4 w6", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near = dict(corpus_pipeline.STAGES)["near dedup"]
    want = brute_five(list(enumerate(texts)))
    assert {r.doc_id for r in near(spark, docs, "").collect()} == want
    assert {0, 1} <= want and 2 not in want
    gone = {r.doc_id for r in near_dedup.groups(docs).where("NOT kept").collect()}
    assert 1 in gone
    table = spark.read.parquet(f"{sf}/documents.parquet")
    assert {r.doc_id for r in near(spark, table, sf).collect()} == brute_five([(r.doc_id, r.text) for r in table.collect()])
