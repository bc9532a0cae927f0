"""Repeated queries, long texts and many languages, determinants against numpy, the order of a mix, and the registered queries' columns."""

import hashlib
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from arealens.llm import ann, langid, line_dedup, quality
from arealens.llm.mixing import mix_sources, mixed_blocks
from arealens.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_repeated_queries_have_lists_of_their_own(spark):
    made = np.random.default_rng(2).normal(size=(30, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(made)] + [(20, made[20].tolist()), (20, made[3].tolist())]
    got = ann.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).toPandas()
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    want = []
    for q in np.flatnonzero(ids % 20 == 0):
        scores = ann._scores(vectors[[q]], vectors)[0]
        best = sorted((j for j in range(len(ids)) if j != q), key=lambda j: (-scores[j], ids[j]))[:5]
        want += [(int(ids[q]), at + 1, int(ids[j]), float(scores[j])) for at, j in enumerate(best)]
    assert sorted(map(tuple, got[["query_id", "rank", "vec_id", "score"]].itertuples(index=False))) == sorted(want)


def decode(model, text):
    """Language by plain loops over one text."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    bucket = langid._buckets(data)
    margins = [sum(int(row[k]) for k in bucket) / langid.UNIT / max(len(data) - 2, 1) for row in model.odds]
    loss = [sum(w * np.logaddexp(0, -langid.SHARPNESS * m * c) for m, c, w in zip(margins, code, model.weight, strict=True)) for code in model.code]
    return model.languages[int(np.argmin(loss))]


def test_fifty_languages_and_cuts_of_long_texts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    letters = [rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7, replace=False) for _ in range(50)]
    text = lambda k, n: " ".join("".join(rng.choice(letters[k], 4)) for _ in range(n))
    rows = [(k, text(k, 60), f"l{k:02}") for k in range(50) for _ in range(4)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = [(k, text(k, 80), f"l{k:02}") for k in range(50)] + [(99, text(7, 80) * 300, "l07")]
    df = spark.createDataFrame(asked, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(df, model).collect()}
    assert all(got[i][0] == decode(model, t) for i, t, _ in asked)
    assert sum(got[i][0] == lang for i, _, lang in asked) >= 45
    data = np.frombuffer("".join(t for _, t, _ in asked).encode(), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(t) for _, t, _ in asked])])
    whole = model.margins(data, starts)
    monkeypatch.setattr(langid, "CUT", 1000)
    assert np.array_equal(whole, model.margins(data, starts))


def concentrated(x, share, tries):
    """Least log determinant of many random starts, by numpy."""
    rng, floors, best = np.random.default_rng(1), np.array(quality.FLOORS), np.inf
    for _ in range(tries):
        near = x[rng.choice(len(x), 6, replace=False)]
        for _ in range(30):
            cov = np.cov(near.T, bias=True)
            cov[np.diag_indices(4)] = np.maximum(np.diag(cov), floors**2)
            d = np.einsum("ij,jk,ik->i", x - near.mean(0), np.linalg.pinv(cov), x - near.mean(0))
            near = x[np.argsort(d)[: int(np.ceil(share * len(x)))]]
        cov = np.cov(near.T, bias=True)
        cov[np.diag_indices(4)] = np.maximum(np.diag(cov), floors**2)
        best = min(best, np.linalg.slogdet(cov)[1])
    return best


@pytest.mark.parametrize("shape", ["clean", "cluster"])
def test_determinants_against_numpy(spark, shape):
    rng = np.random.default_rng(6)
    mixed = rng.normal(size=(4, 4))
    x = rng.normal(size=(400, 4)) @ mixed
    if shape == "cluster":
        x[:80] = rng.normal(size=(80, 4)) * 0.3 + 12
    frame = pd.DataFrame(x, columns=list(quality.FEATURES)).assign(g="one")
    found = quality.mcd_estimates(spark.createDataFrame(frame)).first()
    assert found["logdet"] <= concentrated(x, 0.75, 200) + 0.1
    if shape == "cluster":
        assert np.allclose([found[f"m{i}"] for i in range(4)], x[80:].mean(0), atol=0.6)


def test_small_languages_are_measured_and_junk_goes(spark):
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(3, 8)))
    text = lambda: " ".join(word() for _ in range(90))
    rows = [(i, text(), "a", "s") for i in range(90)] + [(100, text(), None, None), (101, " ".join(word() + "###" for _ in range(90)), "rare", "s"), (102, None, "a", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality.quality_rules(df).collect()}
    assert got[100]["kept"] and got[100]["distance"] is not None
    assert not got[101]["kept"] and not got[101]["base_failed"]
    assert got[102]["base_failed"] and not got[102]["kept"]
    assert sum(got[i]["kept"] for i in range(90)) >= 87
    assert quality.quality_rules(df.limit(0)).count() == 0


def test_a_mix_in_order_of_its_shards(spark):
    rng = np.random.default_rng(8)
    rows = [(i if i % 9 else None, " ".join(f"w{i}_{j}" for j in range(int(rng.integers(0, 60)))) or None, [None, "a", "b"][i % 3], "x") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, place string").drop("place")
    mixed = mix_sources(df, shards=5).cache()
    parts = mixed_blocks(mixed).toPandas()
    order = list(zip(parts["shard"], parts["place"], parts["at"], strict=True))
    assert order == sorted(order) and set(parts["shard"]) == set(range(5))
    assert len(set(order)) == len(order)
    # Blocks of several sources lie mixed within a shard, and every part holds the words that it names.
    first = parts[parts["shard"] == 0]["source"].fillna("-").tolist()
    assert sum(x != y for x, y in zip(first, first[1:], strict=False)) > 2
    for p in parts.itertuples():
        assert len(p.text.split()) == p.stop - p.begin
    assert (parts["stop"] - parts["begin"]).sum() == mixed.agg(F.sum("taken")).first()[0]
    assert mix_sources(df.limit(0)).count() == 0


def documents():
    return pd.read_parquet(f"{SMALL}/documents.parquet")


def test_columns_of_op2_op7_and_op8(spark):
    docs = documents().set_index("doc_id")["text"]
    got = QUERIES["op2_sharding"](spark, SMALL).toPandas()
    raw = {i: (t or "").encode() for i, t in docs.items()}
    assert len(got) == len(docs)
    for i, size, crc in got[["doc_id", "size", "text_crc32"]].itertuples(index=False):
        assert size == 8 + len(raw[i]) and crc == zlib.crc32(raw[i])
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    assert np.ptp(got.groupby("shard").size().to_numpy()) <= 1
    mix = QUERIES["op7_mixing"](spark, SMALL).toPandas()
    assert len(mix) == len(docs) and (mix["taken"] <= 3 * mix["size"]).all()
    import sentencepiece
    from arealens.llm.queries import tokenizer_path

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    for r in QUERIES["op8_sentencepiece"](spark, SMALL).collect():
        ids = model.encode(docs[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def shingles(text, width=5):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def test_stages_of_the_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "n-gram jaccard join", "mixing", "sentencepiece"]
    good = corpus_pipeline.keep_good(spark, docs, SMALL).cache()
    kept = {r["doc_id"] for r in quality.quality_rules(docs).where("kept").collect()}
    assert sorted(r["doc_id"] for r in good.collect()) == sorted(kept) and good.columns == docs.columns

    # Near copies at five words and 0.8, by brute force over all pairs.
    one = corpus_pipeline.keep_one_of_each(spark, good, SMALL)
    texts = {r["doc_id"]: shingles(r["text"]) for r in good.collect()}
    group = {i: i for i in texts}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(texts)
    for at, i in enumerate(ids):
        for j in ids[:at]:
            both = len(texts[i] & texts[j])
            if both and 100 * both >= 80 * (len(texts[i]) + len(texts[j]) - both):
                low, high = sorted((root(i), root(j)))
                group[high] = low
    assert sorted(r["doc_id"] for r in one.collect()) == [i for i in ids if root(i) == i]

    lines = corpus_pipeline.drop_lines(spark, good, SMALL)
    assert lines.columns == docs.columns
    before = {r["doc_id"]: (r["text"] or "").split("\n") for r in good.collect()}
    for r in lines.collect():  # what is left of a text are lines of it, in order
        rest = iter(before[r["doc_id"]])
        assert all(any(x == y for y in rest) for x in r["text"].split("\n"))
    mixed = corpus_pipeline.mix(spark, one, SMALL).cache()
    assert mixed.columns == docs.columns and mixed.count() > 0
    coded = corpus_pipeline.encode(spark, mixed, SMALL)
    assert coded.count() == mixed.count() and coded.where("not decodes").count() == 0


def test_mixing_workers_load_no_pandas():
    import subprocess
    import sys

    root = __file__.rsplit("/tests/", 1)[0]
    code = "import sys, arealens.llm.mixing; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, check=False).returncode == 0


def test_similar_forms_without_a_word_in_common(spark):
    # A wrong letter in each of ten words: no word is shared, ten of 109 characters differ.
    names = ["abcdefghij"[i:] + "abcdefghij"[:i] for i in range(10)]
    a, b, c = " ".join(names), " ".join("z" + w[1:] for w in names), " ".join(w[:4] + "zzz" + w[7:] for w in names)
    pairs = spark.createDataFrame([(1, a, b), (2, a, c)], "src long, a string, b string")
    assert [r["src"] for r in line_dedup.similar(pairs, 0.8).collect()] == [1]
