"""Jaccard join on word shingles by adaptive multi-match prefixes.

Shingles are ordered from rare to frequent: first by whether they are common, then by counts in hashed
classes, then by the hash. Common are those in COMMON or more of the documents' leading shingles (the first of the
order by class, LEADING times as many as a prefix has), which are counted one by one, and those of a class that stands
out; so the passages that many documents share come last, however large the corpus. A document of n shingles and its partner share
t = ceil(threshold * n) or more, so their first n - t + m shingles have m
in common: a pair is verified only if it shares min(m, m') prefix shingles, m and m' being chosen
by each document from the lengths of its lists and the candidates they promise.

Equal texts (A-Z folded) are one node. Near copies of one text would still meet in pairs on all they share, so
each document is first verified against a hub, the best-connected document of its lists, and then
only pairs that can still join two components are sought: documents around one hub that share shingles
outside it, or whose overlaps with it leave room for a link; and documents around different hubs. For those, each document
is measured against the other hub before it meets that hub's documents: Jaccard distance obeys the triangle
inequality, so it can only be linked to those that lie about as far from the hub as itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arealens.llm.joins import join_counted
from arealens.llm.text import list_slices, text_slices
from arealens.operators.graph import connected_components
from arealens.scratch import discard, stage

CLASS_BITS = 18
CLASSES = 1 << CLASS_BITS  # of the shingle counts; a fixed 2 MB on the driver and each worker
LEADING = 1.5
COMMON = 8  # documents that make a shingle common
MOST = 4  # largest number of prefix shingles that a scheme asks for
VERIFY = 20.0  # cost of a verification, in list entries
SKETCHED = 64  # sets above this size have a sketch of an eighth of their shingles
ESTIMATED = 0.45  # least similarity of sketches at which a document is measured against its hub
HUBBED = 0.6  # least similarity to its hub of a document that is treated as one of its copies
VOTES = 1 / 8  # least share of its one-match prefix that a document shares with its hub
SLICE_BYTES, SLICE_VALUES = 1_000_000, 250_000  # of text, and of shingles, that a worker holds in arrays at once

# Fixed odd multipliers of the shingle hash.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


def _shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` words, from the words' hashes."""
    out = np.zeros(max(len(hashes) - width + 1, 0), np.uint64)
    for k in range(width):
        out = (((out << np.uint64(23)) | (out >> np.uint64(41))) ^ hashes[k : k + len(out)]) * np.uint64(MIX[0])
        out ^= out >> np.uint64(32)
    out *= np.uint64(MIX[1])
    return out ^ (out >> np.uint64(29))


def shingle_sets(docs: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """(id, n, h, g, s): sorted distinct shingle hashes of each whole text with A-Z lower-cased, and a 128-bit hash of that text.

    A text of fewer than ``width`` words has one shingle, all its words; one without words has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1, SLICE_BYTES):
                folded = pc.ascii_lower(part.column(1).cast(pa.large_string()).fill_null(""))
                split = pc.ascii_split_whitespace(folded)
                offsets, words = split.offsets.to_numpy(), split.flatten()
                filled = np.concatenate([[0], np.cumsum(pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False))])
                ends = filled[offsets - offsets[0]]
                words = words.filter(pc.greater(pc.binary_length(words), 0)).dictionary_encode()
                known = np.array([xxhash.xxh3_64_intdigest(w) for w in words.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
                hashes = known[words.indices.to_numpy()] if len(known) else known
                runs = _shingles(hashes, width)
                sets: list[np.ndarray] = []
                for low, high in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    if high - low >= width:
                        own = np.sort(runs[low : high - width + 1])
                        own = own[np.concatenate([[True], own[1:] != own[:-1]])]
                    elif high > low:
                        own = np.array([xxhash.xxh3_64_intdigest(hashes[low:high].tobytes(), seed=1)], np.uint64)
                    else:
                        own = np.zeros(0, np.uint64)
                    sets.append(own.view(np.int64))
                whole = [xxhash.xxh3_128_digest(x.as_buffer()) for x in folded]
                both = np.frombuffer(b"".join(whole), np.int64).reshape(-1, 2)
                n = np.array([len(x) for x in sets], np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
                lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(n, dtype=np.int64)]), pa.array(flat)).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(both[:, 0]), pa.array(both[:, 1]), lists], ["id", "n", "h", "g", "s"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(run, "id long, n int, h long, g long, s array<long>")


def _class_counts(sets: DataFrame) -> np.ndarray:
    """Shingles of each class over all sets; every task adds up its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, np.int64)
        for batch in (part for whole in batches for part in list_slices(whole, 0, SLICE_VALUES)):
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            total += np.bincount(flat.view(np.uint64) >> np.uint64(64 - CLASS_BITS), minlength=CLASSES)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["c", "k"])

    counts = np.zeros(CLASSES, np.int64)
    rows = sets.select("s").mapInArrow(run, "c int, k long").groupBy("c").agg(F.sum("k").alias("k")).toPandas()
    counts[rows["c"].to_numpy(np.int64)] = rows["k"].to_numpy(np.int64)
    return counts


def _by_class(sets: DataFrame, counts: Broadcast, percent: int, times: float | None) -> DataFrame:
    """(id, n, base, most, light, prefix): shingles by rising count of their class, ``times`` * most of them or all (None).

    base is the length of the one-match prefix, most that of the longest; the first ``light`` shingles are of no class that stands out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = counts.value.mean() + 8 * np.sqrt(counts.value.mean()) + COMMON
        for batch in (part for whole in batches for part in list_slices(whole, 1, SLICE_VALUES)):
            shingles = batch.column(1)
            flat, ends = shingles.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(shingles).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(ends)), ends)
            count = counts.value[flat.view(np.uint64) >> np.uint64(64 - CLASS_BITS)]
            order = np.lexsort((flat, count, row))
            place = np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)
            base = ends - -(-ends.astype(np.int64) * percent // 100) + 1
            most = np.minimum(base + MOST - 1, ends)
            light = np.bincount(row[count <= heavy], minlength=len(ends))
            wanted = ends if times is None else np.minimum(np.ceil(times * most).astype(ends.dtype), ends)
            flat = flat[order][place < wanted[row]]
            prefix = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(wanted)]).astype(np.int32), pa.array(flat))
            numbers = [pa.array(x.astype(np.int32)) for x in (ends, base, most, light)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, prefix], ["id", "n", "base", "most", "light", "prefix"])

    return sets.select("id", "s").mapInArrow(run, "id long, n int, base int, most int, light int, prefix array<long>")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(id, n, base, prefix): the first base + MOST - 1 shingles, common ones last.

    The leading shingles hold the whole prefix unless too many of them are common; only documents with too few others
    have all their shingles looked up.
    """
    counts = sets.sparkSession.sparkContext.broadcast(_class_counts(sets))
    leading = stage(_by_class(sets, counts, percent, LEADING), "leading")
    seen = leading.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    common = stage(seen.where(F.col("df") >= COMMON).select("token"), "common_shingles")
    places = leading.select("id", F.posexplode("prefix").alias("pos", "token"))
    skipped = stage(join_counted(places, common, "token").groupBy("id").agg(F.collect_list("pos").alias("skip")), "skipped")
    cut = join_counted(leading, skipped, "id", "left").withColumn("skip", F.coalesce("skip", F.array().cast("array<int>")))
    near = F.slice("prefix", F.lit(1), F.greatest("light", F.lit(0)))  # none of a heavy class
    rare = F.when(F.size("skip") == 0, near).otherwise(F.filter(near, lambda x, i: ~F.array_contains("skip", i)))
    cut = stage(cut.select("id", "n", "base", "most", F.slice(rare, F.lit(1), F.col("most")).alias("prefix")), "rare")
    discard(leading, skipped)
    short = stage(cut.where(F.size("prefix") < F.col("most")).select("id"), "short")
    whole = _by_class(join_counted(sets, short, "id", "left_semi"), counts, percent, None)
    tokens = join_counted(whole.select("id", "n", "base", "most", "light", F.posexplode("prefix").alias("pos", "token")), common.withColumn("common", F.lit(1)), "token", "left")
    place = F.struct(F.when(F.col("pos") >= F.col("light"), 1).otherwise(F.coalesce("common", F.lit(0))).alias("common"), "pos", "token")
    ordered = tokens.groupBy("id", "n", "base", "most").agg(F.array_sort(F.collect_list(place)).alias("all"))
    filled = ordered.select("id", "n", "base", F.slice("all.token", F.lit(1), F.col("most")).alias("prefix"))
    prefixes = stage(cut.where(F.size("prefix") == F.col("most")).select("id", "n", "base", "prefix").unionByName(filled), "prefixes")
    discard(cut, short, common)
    return prefixes


def _sets_of(pairs: DataFrame, sets: DataFrame, columns: list[Column | str]) -> DataFrame:
    """``columns`` of the sets of the documents in pairs (src, dst); only these are moved."""
    ids = stage(pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "ids")
    few = stage(join_counted(sets.select("id", "n", "s"), ids, "id", "left_semi").select("id", "n", *columns), "sets_of_candidates")
    discard(ids)
    return few


def _sides(pairs: DataFrame, few: DataFrame, column: str) -> DataFrame:
    side = lambda end, n, into: few.select(F.col("id").alias(end), F.col("n").alias(n), F.col(column).alias(into))
    return pairs.join(side("src", "na", "a"), "src").join(side("dst", "nb", "b"), "dst")


def _linked(both: Column | str, a: Column | str, b: Column | str, percent: int) -> Column:
    both, a, b = (F.col(x) if isinstance(x, str) else x for x in (both, a, b))
    return 100 * both >= percent * (a + b - both)


def _promising(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose sketches are alike; a sketch holds the shingles that an eighth of all hashes fall on."""
    pairs = stage(pairs, "hub_pairs")
    eighth = lambda c: F.filter(c, lambda x: x.bitwiseAND(F.lit(7)) == 0)
    few = _sets_of(pairs, sets, [F.when(F.col("n") <= SKETCHED, F.col("s")).otherwise(eighth("s")).alias("sketch")])
    thin = F.greatest("na", "nb") > SKETCHED
    joined = _sides(pairs, few, "sketch").withColumns({"a": F.when(thin, eighth("a")).otherwise(F.col("a")), "b": F.when(thin, eighth("b")).otherwise(F.col("b"))})
    both = F.size(F.array_intersect("a", "b"))
    found = stage(joined.where(both >= ESTIMATED * (F.size("a") + F.size("b") - both)).select("src", "dst"), "promising")
    discard(few, pairs)
    return found


def _measured(pairs: DataFrame, sets: DataFrame, rest: bool = False) -> DataFrame:
    """(src, dst, na, nb, both): sizes and overlap of each pair, exactly; with ``rest`` the shingles of src that dst lacks."""
    pairs = stage(pairs.select("src", "dst").distinct(), "candidates")
    few = _sets_of(pairs, sets, ["s"])
    outer = [F.array_except("a", "b").alias("rest")] if rest else []
    found = stage(_sides(pairs, few, "s").select("src", "dst", "na", "nb", F.size(F.array_intersect("a", "b")).alias("both"), *outer), "measured")
    discard(few, pairs)
    return found


def _lists(prefixes: DataFrame) -> DataFrame:
    """(token, id, n, base, pos, df) for prefix shingles that two or more documents have."""
    rows = prefixes.select("id", "n", "base", F.posexplode("prefix").alias("pos", "token"))
    # Rows are moved to their token once; counts joined back would move most of them a second time, to find that nothing else has the token.
    return stage(rows.withColumn("df", F.count("*").over(Window.partitionBy("token"))).where("df > 1"), "lists")


def _hubs(lists: DataFrame) -> DataFrame:
    """(src, dst): each document and the hub that leads most of its lists; the document with most lists leads a list."""
    own = lists.where("pos < base")
    weight = own.groupBy("id").agg(F.count("*").alias("weight"))
    lead = own.join(weight, "id").groupBy("token").agg(F.max(F.struct("weight", (-F.col("id")).alias("m"))).alias("top")).select("token", (-F.col("top.m")).alias("hub"), F.col("top.weight").alias("weight"))
    votes = own.select("token", "id", "base").join(lead, "token").where("id <> hub").groupBy("id", "hub").agg(F.count("*").alias("votes"), F.max("weight").alias("weight"), F.first("base").alias("base"))
    best = votes.where(F.col("votes") >= VOTES * F.col("base")).groupBy("id").agg(F.max(F.struct("votes", "weight", (-F.col("hub")).alias("m"))).alias("top"))
    return best.select(F.col("id").alias("src"), (-F.col("top.m")).alias("dst"))


def _around_hubs(copies: DataFrame, percent: int) -> DataFrame:
    """Pairs of one hub's copies that may be linked though not both are linked to it.

    copies: id, hub, n, nh (size of the hub), both (overlap with the hub), rest (shingles outside it), component. A pair's overlap is at most
    the lesser ``both`` plus the shingles shared outside the hub.
    """
    room = lambda shared: _linked(F.least("a.both", "b.both") + shared, F.col("a.n"), F.col("b.n"), percent)
    slim = copies.select("id", "hub", "n", "nh", "both", "component")
    least = slim.groupBy("hub").agg(F.min("n").alias("least"))
    # Without shared outer shingles, a document that is not linked to the hub needs a partner smaller than the hub; few copies have one.
    able = stage(slim.join(least, "hub").where(_linked("both", "n", "least", percent)).drop("least"), "able")
    off, below = able.where(~_linked("both", "n", "nh", percent)), able.where("n < nh")
    inner = off.alias("a").join(below.alias("b"), F.expr("a.hub = b.hub and a.component <> b.component") & room(F.lit(0)))
    # Else they share that many shingles outside it as a link asks for beyond the lesser ``both``. How many depends on the partner's size, so
    # each document has a prefix of its outer shingles, those rare around the hub first, for every class of sizes that may link with it.
    share, step = percent / (100 + percent), 1.1
    size_class = lambda n: F.floor(F.log(n) / F.log(F.lit(step)) + 1e-9).cast("int")
    outer = copies.select("hub", "id", "n", "both", "component", F.size("rest").alias("r"), F.explode("rest").alias("token"))
    df = outer.groupBy("hub", "token").agg(F.count("*").alias("df"), F.min("component").alias("low"), F.max("component").alias("high")).where("df > 1")
    df = stage(df, "outer_counts")
    outer = join_counted(outer, df, ["hub", "token"], "left").withColumn("df", F.coalesce("df", F.lit(1)))
    outer = outer.withColumn("pos", F.row_number().over(Window.partitionBy("hub", "id").orderBy("df", "token"))).where("low <> high")
    outer = outer.withColumns({"own": size_class(F.col("n")), "other": F.explode(F.sequence(size_class(F.col("n") * percent / 100), size_class(F.col("n") * 100 / percent)))})
    need = F.greatest(F.ceil(share * (F.col("n") + F.pow(F.lit(step), "other")) - 1e-6) - F.col("both"), F.lit(1))
    outer = stage(outer.where(F.col("pos") <= F.col("r") - need + 1).drop("low", "high", "df", "pos"), "outer")
    most = F.least("a.both", "b.both") + F.least("a.r", "b.r")
    same = F.expr("a.hub = b.hub and a.token = b.token and a.own = b.other and a.other = b.own and a.id < b.id and a.component <> b.component")
    met = outer.alias("a").join(outer.alias("b"), same & _linked(most, F.col("a.n"), F.col("b.n"), percent))
    pairs = inner.select(F.least("a.id", "b.id").alias("src"), F.greatest("a.id", "b.id").alias("dst")).unionByName(met.select(F.col("a.id").alias("src"), F.col("b.id").alias("dst")))
    pairs = stage(pairs.distinct(), "around")
    discard(able, df, outer)
    return pairs


def _schemes(lists: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """(token, n, m and the columns of ``placed``): the prefix shingles that each document's own choice of m takes in."""
    entries = F.col("df") - 1
    sums = lists.groupBy("id").agg(F.min("n").alias("least"), *[F.sum(F.when(F.col("pos") < F.col("base") + m - 1, entries).otherwise(0)).alias(f"e{m}") for m in range(1, MOST + 1)])
    # A link's overlap may be no more than ceil(threshold * n), so no scheme asks for more; with m = 1 it never does.
    allowed = lambda m: F.lit(m == 1) | (F.lit(m) <= F.ceil(F.col("least") * percent / 100))
    cost = lambda m: F.struct(F.when(allowed(m), F.col(f"e{m}") * (1 + VERIFY / m)).otherwise(F.lit(float("inf"))).alias("cost"), F.lit(m).alias("m"))
    scheme = sums.select("id", F.least(*[cost(m) for m in range(1, MOST + 1)])["m"].alias("m")).join(placed, "id")
    return stage(lists.join(scheme, "id").where("pos < base + m - 1").select("token", "n", "m", *placed.columns), "schemes")


def _against_hubs(rows: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where documents of different hubs and components share as many prefix shingles as their schemes ask for.

    rows: token, n, m, id, hub, far (Jaccard distance to the hub), held (documents of the hub), component. Of two hubs the one with more
    documents stays whole, and documents of the other are measured against it. Returns (token, big, small, asked) and those measures.
    """
    parts = rows.groupBy("token", "hub").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("held").alias("held"), F.min("m").alias("m"))
    apart = parts.alias("a").join(parts.alias("b"), F.expr("a.token = b.token and a.hub < b.hub and not (a.low = a.high and b.low = b.high and a.low = b.low)"))
    first = F.expr("a.held >= b.held")
    side = lambda yes, c: F.when(first if yes else ~first, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))
    apart = apart.select("a.token", side(True, "hub").alias("big"), side(False, "hub").alias("small"), F.least("a.m", "b.m").alias("asked"))
    every = stage(apart, "apart")
    enough = every.groupBy("big", "small").agg(F.count("*").alias("shared"), F.min("asked").alias("asked")).where("shared >= asked").select("big", "small")
    apart = stage(every.join(enough, ["big", "small"]), "apart")
    discard(every)
    meet = apart.select("token", "big", F.col("small").alias("hub"), "asked").join(rows.select("token", "hub", "id"), ["token", "hub"])
    ask = meet.where("id <> big").groupBy("id", "big").agg(F.count("*").alias("shared"), F.min("asked").alias("asked")).where("shared >= asked")
    return apart, _measured(ask.select(F.col("id").alias("src"), F.col("big").alias("dst")), sets, rest=True)


def _across_hubs(rows: DataFrame, apart: DataFrame, asking: DataFrame, percent: int) -> DataFrame:
    """Pairs of a document and those of another hub's that lie about as far from that hub and share enough prefix shingles.

    asking: b_id, big, b_far (the document's distance from the hub); rows and apart as in ``_against_hubs``.
    """
    reach = 1 - percent / 100 + 1e-9
    own = rows.select("token", *[F.col(c).alias(f"b_{c}") for c in ("id", "n", "m", "hub", "component")])
    left = asking.join(own, "b_id").join(apart.select("token", "big", F.col("small").alias("b_hub")), ["token", "big", "b_hub"])
    steps = F.explode(F.sequence(F.floor((F.col("b_far") - reach) / reach), F.floor((F.col("b_far") + reach) / reach)))
    left = left.select("*", steps.alias("step"))
    right = rows.where("id <> hub").select("token", F.col("hub").alias("big"), F.floor(F.col("far") / reach).alias("step"), *[F.col(c).alias(f"a_{c}") for c in ("id", "n", "m", "far", "component")])
    near = F.expr(f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n) and a_component <> b_component and abs(a_far - b_far) <= {reach}")
    met = left.join(right, ["token", "big", "step"]).where(near)
    pairs = met.groupBy(F.least("a_id", "b_id").alias("src"), F.greatest("a_id", "b_id").alias("dst")).agg(F.count("*").alias("shared"), F.min(F.least("a_m", "b_m")).alias("asked"))
    return pairs.where("shared >= asked").select("src", "dst")


def ngram_components(docs: DataFrame, width: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) for every row of ``docs``.

    Two documents link when 100 * |A & B| >= percent * |A | B| for their shingle sets; component_id is the
    least key reachable by links. Null and empty texts, and texts of white space, have no shingles, link
    with nothing and are their own component. Rows with equal keys are taken as one document with several
    sets; a null key keeps its row with a null component and links nothing. An empty table gives no rows; other columns are not read.
    """
    sets = stage(shingle_sets(docs, width, key, text).withColumn("rid", F.monotonically_increasing_id()), "sets")
    rows = sets.select("rid", "id", "n", "h", "g")
    nodes = stage(rows.where("n > 0 and id is not null").groupBy("n", "h", "g").agg(F.min("rid").alias("node")), "classes")
    of_nodes = join_counted(sets.select(F.col("rid").alias("id"), "n", "s"), nodes.select(F.col("node").alias("id")), "id", "left_semi")
    prefixes = _prefixes(of_nodes, percent)
    lists = _lists(prefixes)
    discard(prefixes)
    hubs = _measured(_promising(_hubs(lists), of_nodes), of_nodes, rest=True)
    jaccard = F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
    hubbed = lambda df: df.where(100 * F.col("both") >= 100 * HUBBED * (F.col("na") + F.col("nb") - F.col("both")))
    direct = lambda df: df.where(_linked("both", "na", "nb", percent)).select("src", "dst")
    as_copies = lambda df: hubbed(df).select(F.col("src").alias("id"), F.col("dst").alias("hub"), F.col("na").alias("n"), F.col("nb").alias("nh"), "both", (1 - jaccard).alias("far"), "rest")
    copies = stage(as_copies(hubs), "copies")
    discard(hubs)
    links = direct(copies.select(F.col("id").alias("src"), F.col("hub").alias("dst"), F.col("n").alias("na"), F.col("nh").alias("nb"), "both"))
    found = stage(connected_components(links), "components")
    part = lambda df: df.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    members = lists.select("id").distinct().join(copies.select("id", "hub", "far"), "id", "left").select("id", F.coalesce("hub", "id").alias("hub"), F.coalesce("far", F.lit(0.0)).alias("far"))
    members = stage(members, "members")
    placed = part(members.join(members.groupBy("hub").agg(F.count("*").alias("held")), "hub"))
    schemes = _schemes(lists, placed.select("id", "hub", "far", "held", "component"), percent)
    discard(lists)
    apart, measured = _against_hubs(schemes, of_nodes)
    # A document may be a copy of several hubs; what is further off meets the hub's documents shingle by shingle.
    links = stage(links.unionByName(direct(measured)), "links")
    found = stage(connected_components(links), "components")
    asking = measured.where(100 * F.col("both") < 100 * HUBBED * (F.col("na") + F.col("nb") - F.col("both"))).select(F.col("src").alias("b_id"), F.col("dst").alias("big"), (1 - jaccard).alias("b_far"))
    around = _around_hubs(part(copies.unionByName(as_copies(measured))), percent)
    discard(copies)
    more = direct(_measured(around.unionByName(_across_hubs(schemes, apart, asking, percent)), of_nodes))
    discard(around, schemes, apart, measured, members)
    # Rows of one key are one document, whatever their texts.
    kept = stage(join_counted(rows, nodes, ["n", "h", "g"], "left").select("id", "n", "node"), "rows")
    discard(sets)
    same = kept.where("node is not null").groupBy("id").agg(F.min("node").alias("src"), F.max("node").alias("top")).where("src <> top").select("id", "src")
    same = kept.join(same, "id").select("src", F.col("node").alias("dst"))
    found = connected_components(links.unionByName(more).unionByName(same)).withColumnRenamed("id", "node")
    named = stage(kept.join(found, "node", "left").select("id", "n", F.coalesce("component", "node").alias("component")), "named")
    least = stage(named.where("component is not null and id is not null").groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("k")).where("k > 1").drop("k"), "least")
    joined = join_counted(named, least, "component", "left")
    return joined.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
