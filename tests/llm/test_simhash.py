"""SimHash fingerprints and their components against brute force."""

import random
import re

import xxhash
from test_llm import EDGE, docs_of, made

EXTRA = "text string, fingerprint string, component string, doc_id long, id long, near int"


def fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [words[i : i + width] for i in range(len(words) - width + 1)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=2):
    """Least key reachable by links, for (key, fingerprint) rows."""
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= radius:
                root[top(i)] = top(j)
    least = {}
    for i, (key, _) in enumerate(prints):
        least.setdefault(top(i), []).append(key)
    return [min((k for k in least[top(i)] if k is not None), default=None) for i in range(len(prints))]


def held(spark, rows, width=3, radius=2):
    from arealens.llm.simhash import simhash_components

    got = sorted(((r[0], r[1] & (1 << 64) - 1, r[2]) for r in simhash_components(docs_of(spark, rows), width, radius).collect()), key=str)
    prints = [(r[0], fingerprint(r[1], width)) for r in rows]
    want = sorted(((k, f, c) for (k, f), c in zip(prints, components(prints, radius), strict=True)), key=str)
    assert got == want
    return got


def test_fingerprints_and_components_equal_brute_force(spark):
    rng = random.Random(7)
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(900))
    near = [base.replace(base.split()[k], f"x{k}", 1) for k in range(0, 900, 12)]  # a few bits apart, in chains
    rows = [(10_000 - i, t, "en", "s", 0, 0) for i, t in enumerate(near + [base, base, base.upper(), "É é İ ß Σ", "a b", "A  B\n", "a b c", "a\x1cb c d"])]
    got = held(spark, made(8, 150) + rows + [(2000 + i, *r[1:]) for i, r in enumerate(EDGE)] + [(None, base, None, None, None, None), (None, "only here", None, None, None, None)])
    assert len({c for _, _, c in got}) < len({f for _, f, _ in got})  # some different fingerprints are linked


def test_other_radii_and_widths(spark):
    rng = random.Random(9)
    base = " ".join(f"w{rng.randrange(500)}" for _ in range(300))
    rows = [(i, base.replace(f"w{i}", "y"), "en", "s", 0, 0) for i in range(80)]
    for width, radius in ((1, 0), (2, 4)):
        held(spark, rows, width, radius)


def test_links_of_bits_set_by_hand(spark):
    from arealens.llm.simhash import near_fingerprints
    from arealens.operators.graph import connected_components

    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for f in list(prints):
        for _ in range(6):
            f ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)  # chains of one or two bits a step, the sign bit too
            prints.add(f)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in prints]
    links = near_fingerprints(spark.createDataFrame(signed, "fingerprint long"))
    got = {r[0]: r[1] for r in connected_components(links).collect()}
    order = [(s, s & (1 << 64) - 1) for (s,) in signed]
    want = components(order)
    assert [got.get(s, s) for s, _ in order] == want


def test_long_runs_add_up_beyond_a_byte(spark):
    held(spark, [(1, "same words here " * 5000, None, None, None, None), (2, " ".join(f"t{i}" for i in range(2000)), None, None, None, None)])


def test_empty_table_repeated_rows_and_clashing_names(spark):
    from arealens.llm.simhash import simhash_components

    assert simhash_components(docs_of(spark, [])).count() == 0
    docs = spark.createDataFrame([("a b c d", "f", "c", 4, 9, 1), ("a b c d", "f", "c", 4, 9, 1), ("a b c d", None, None, 3, 9, 1)], EXTRA)
    assert sorted((r["doc_id"], r["component_id"]) for r in simhash_components(docs).collect()) == [(3, 3), (4, 3), (4, 3)]


def test_few_heavy_keys_are_joined_apart(spark, monkeypatch):
    from arealens.llm import joins

    monkeypatch.setattr(joins, "HEAVY", 0.3)
    large = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [2] * 40 + [3] * 9 + [4])], "k long, i int")
    small = spark.createDataFrame([(1, 50, "a"), (2, 40, "b"), (3, 9, "c"), (9, 0, "d")], "k long, held long, v string")
    got = sorted((r["i"], r["v"]) for r in joins.join_heavy_apart(large, small, "k", "held").collect())
    assert got == [(i, "a" if i < 50 else "b" if i < 90 else "c" if i < 99 else None) for i in range(100)]
