"""Token alignment against whole texts encoded by the libraries."""

import hashlib
import random
from collections import Counter

from test_llm import EDGE, docs_of, made, path

FILES = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def brute(rows):
    """Each text encoded whole, aligned by its tokens' bytes."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(path(FILES[0])), sentencepiece.SentencePieceProcessor(model_file=path(FILES[1]))
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [x for x in range(256) if x not in plain]
    byte = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(other)}
    found = []
    for _, t, *_ in rows:
        links, groups, sizes = [], [], (0, 0)
        if t:
            ai, bi = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            ab = [bytes(byte[c] for c in a.id_to_token(i)) for i in ai]
            bb = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(b.id_to_piece, bi)]
            if b"".join(ab) == b"".join(bb) == (" " + t).encode():
                sizes, ends = (len(ai), len(bi)), []
                for tokens in (ab, bb):
                    total, own = 0, []
                    for x in tokens:
                        own.append(total := total + len(x))
                    ends.append(own)
                low = [0, 0]
                for e in sorted(set(ends[0]) & set(ends[1])):
                    high = [ends[0].index(e) + 1, ends[1].index(e) + 1]
                    groups.append("|".join(",".join(map(str, ids[x:y])) for ids, x, y in zip((ai, bi), low, high)))
                    links.append((ai[high[0] - 1], bi[high[1] - 1]))
                    low = high
        found.append((*sizes, links, ";".join(groups)))
    count = Counter(x for f in found for x in f[2])
    most = {}
    for (_, y), k in count.items():
        most[y] = max(most.get(y, 0), k)
    digest = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    return [(r[0], na, nb, len(links), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), digest(g)) for r, (na, nb, links, g) in zip(rows, found, strict=True)]


def texts(seed):
    rng = random.Random(seed)
    odd = ["é", "日本語", "🎉🎉", "𝔘", "\r\n", "\n\n", "\n", "\t", "  ", "   ", "<|endoftext|>", "</s>", "<0x41>", "'s", "it's", "1234567", "　", "\xa0", "\x1c", "\x85", "é", "İ", "㍿", "});\r\n", "ﬁ", "​", "﻿", "word", "Hello", ".", "don't,", "x.'re", "a,###", "k>", "Ünï-co;de", "e\u0301,", "×.", "½.", "_a", "9.5%"]
    return ["".join(rng.choice([rng.choice(odd), " " + rng.choice(odd), " the", " quick"]) for _ in range(rng.randint(1, 60))) for _ in range(150)]


def held(spark, rows):
    from arealens.llm.align import align_tokenizers

    got = [tuple(r) for r in align_tokenizers(docs_of(spark, rows), *map(path, FILES)).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_alignment_equals_whole_texts(spark):
    rows = [(i, t, "en", "s", 0, 0) for i, t in enumerate([*texts(1), "▁mark", "a ▁ b", " ", "\n", "x" * 3000, "日本" * 500, "a\x00b"])]
    held(spark, rows + made(4, 60) + EDGE + [(None, "no key", None, None, None, None)] * 2)


def test_few_units_kept_and_light_pairs_looked_up(spark, monkeypatch):
    from arealens.llm import align

    monkeypatch.setattr(align, "HEAVY_PAIRS", 40)  # most pairs go through the shuffled join
    held(spark, [(i, t, None, None, None, None) for i, t in enumerate(texts(2))])
    own = align.Aligner(*map(path, FILES), unit_limit=5)
    first = [own.slice([t]).to_pylist() for t in texts(3)]
    assert first == [own.slice([t]).to_pylist() for t in texts(3)] and len(own.texts) < 400
    own.unit_limit = 10**6
    assert first == [own.slice([t]).to_pylist() for t in texts(3)]
    own.forget()
    assert all(own.met == 0) and first == [own.slice([t]).to_pylist() for t in texts(3)]


def test_spans_that_hold_other_bytes_are_refined():
    from arealens.llm.align import byte_level_bytes, piece_bytes, refined_ends

    whole = "a日b".encode()
    parts = [b"a", whole[1:2], whole[2:4], b"b"]
    assert refined_ends([(0, 1), (1, 2), (1, 2), (2, 3)], parts, whole, [0, 1, 4, 5]) == [1, 2, 4, 5]
    assert refined_ends([(0, 1), (1, 4), (1, 4), (4, 5)], parts, whole, None) == [1, 2, 4, 5]
    assert refined_ends([(0, 1)], [b"x"], b"a", None) is None
    assert (byte_level_bytes("Ġh"), piece_bytes("▁h"), piece_bytes("<0x0A>"), piece_bytes("<0x0g>")) == (b" h", b" h", b"\n", b"<0x0g>")


def test_empty_table_and_clashing_names(spark):
    from arealens.llm.align import align_tokenizers

    assert align_tokenizers(docs_of(spark, []), *map(path, FILES)).count() == 0
    docs = spark.createDataFrame([("hello there", 1, 2, "x", 5)], "text string, id long, n_a long, pairs string, doc_id long")
    assert [tuple(r) for r in align_tokenizers(docs, *map(path, FILES)).collect()] == brute([(5, "hello there")])
