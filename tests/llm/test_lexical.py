"""Lexical search against scores worked out term by term."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
from test_llm import EDGE, docs_of, made

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERMS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    split = [(d, Counter(terms(t))) for d, t, *_ in docs]
    split = [(d, c) for d, c in split if c]
    n_docs, length = len(split), sum(c.total() for _, c in split)
    df = Counter(t for _, c in split for t in c)
    out = []
    for item in {i for i, _ in items}:
        asked = {t for i, x in items if i == item for t in terms(x)}
        found = []
        for d, c in split:
            m = 10 + 90 * c.total() * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if c[t])
            if score > 0:
                found.append((-score, d is None, d))
        found.sort(key=lambda x: x if not x[1] else x[:2])
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(found[:k])]
    return sorted(out, key=str)


def held(spark, docs, items, k=10):
    from arealens.llm.lexical import lexical_search

    got = lexical_search(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string, score int"), k)
    assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == brute(docs, [i[:2] for i in items], k)


def test_ranks_equal_brute_force(spark, monkeypatch):
    from arealens.llm import lexical

    monkeypatch.setattr(lexical, "CHUNK_POSTINGS", 500)
    rng = random.Random(5)
    docs = made(6, 300) + [(1000 + i, *r[1:]) for i, r in enumerate(EDGE)] + [(7000, "Žluťoučký KŮŇ x1 x1-x2", *[None] * 4), (None, "w a wa", *[None] * 4), (None, "wa", *[None] * 4)]
    items = [(i, " ".join(rng.sample(docs[i][1].split(), min(8, len(docs[i][1].split())))), 0) for i in range(0, 60, 3)]
    held(spark, docs, items + [(100, None, 0), (101, " -- ", 0), (102, "nowhere", 0), (None, "wa wb", 0), (103, "žluťoučký KŮŇ X1", 0), (0, "wb wc", 0)])
    monkeypatch.setattr(lexical, "ITEMS_AT_ONCE", 4)  # several passes
    held(spark, docs[:80], items, k=3)


def test_ties_go_to_smaller_keys(spark):
    held(spark, [(i * 7 % 40, "same words", None, None, None, None) for i in range(40)] + [(99, "other", None, None, None, None)], [(1, "words", 0)])


def test_empty_tables(spark):
    from arealens.llm.lexical import lexical_search

    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    docs = docs_of(spark, [(1, "a", None, None, None, None)])
    for d, i in ((docs_of(spark, []), items), (docs, items.limit(0)), (docs_of(spark, EDGE[:2]), items)):
        assert lexical_search(d, i).columns == ["item_id", "rank", "doc_id", "score"] and lexical_search(d, i).count() == 0


def test_summaries_bound_all_scores_and_skip_blocks():
    from arealens.llm.lexical import Chunk, Search

    rng = np.random.default_rng(2)
    size, n = 300, 2000
    topic = rng.integers(0, 12, n)
    held_terms = [np.unique(np.concatenate([rng.integers(0, 40, 15), 40 + t * 20 + rng.integers(0, 20, 10)])) for t in topic]
    sizes, flat = np.array([len(x) for x in held_terms]), np.concatenate(held_terms)
    weights = rng.integers(400, 1000, len(flat)) * np.where(flat < 40, 1, 2)
    items = [np.unique(np.concatenate([rng.integers(0, 40, 6), 40 + q * 20 + rng.integers(0, 20, 5)])) for q in range(12)]
    search = Search(items, size, 10)
    for part in range(4):
        own = np.arange(n) % 4 == part
        keep = np.repeat(own, sizes)
        search.add(np.flatnonzero(own).tolist(), sizes[own], flat[keep], weights[keep])
    row = np.repeat(np.arange(n), sizes)
    for q, asked in enumerate(items):
        score = np.bincount(row, np.where(np.isin(flat, asked), weights, 0), n).astype(int)
        assert [(-s, i) for s, _, i in search.best[q]] == sorted(zip(score.tolist(), range(n)), key=lambda x: (-x[0], x[1]))[:10]
    assert search.scored < 0.5 * n * len(items) and search.passed
    chunk = Chunk(sizes, flat, weights, search.projection)
    rows, block = chunk.blocks(3)
    assert sorted(rows.tolist()) == np.unique(row[flat == 3]).tolist()
    summary = chunk.summary(rows, block, np.arange(size), size)
    for r, b in zip(rows.tolist(), block.tolist(), strict=True):
        own = slice(chunk.ends[r], chunk.ends[r + 1])
        assert (summary[b][flat[own]] >= weights[own]).all()


def test_query_equals_sql(spark):
    from arealens.llm.queries import ORACLES, QUERIES

    at = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    got = QUERIES["op13_lexical_search"](spark, at)
    want = db.execute(ORACLES["op13_lexical_search"])
    assert [c[0] for c in want.description] == got.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())
