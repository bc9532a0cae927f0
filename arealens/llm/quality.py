"""Quality rules: word statistics, fixed limits and robust multivariate outliers per language and source.

Everything here is DataFrame expressions. The text is read once; the estimates work on a written table
of a few numbers a document. Minimum-covariance-determinant estimates are found by concentration
steps: each step takes the ``share`` of a group's documents that lie nearest by Mahalanobis distance and
estimates mean and covariance anew from them, until no group's determinant falls any more. Three fixed starts
run side by side (medians with median absolute deviations, the same with correlations of tanh scores, and the inner half of the first),
and each group keeps the estimate of least determinant.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arealens.llm.text import WHITE, let, window_hashes, words
from arealens.scratch import stage

SYMBOLS = "#*$%&|<>"
#: Transformed statistics: mean word length (log), symbols a character (root), repeated lines' share, repeated words' share.
FEATURES = ("x0", "x1", "x2", "x3")
#: Least standard deviation that a feature is taken to have; many groups have no symbols or repeats at all.
FLOORS = (0.1, 0.07, 0.1, 0.08)
ALL = "all"  # the group of all documents; those of a language and source are JSON objects
CHI2_MEDIAN = 3.3567  # of 4 degrees of freedom
CHI2_CUTOFF = 18.4668  # its quantile of 0.999


def _covered(hashes: Column, width: int) -> Column:
    """Number of words in windows whose hash occurs twice or more; ``hashes`` has one entry a window start.

    Sorting (hash, start) brings equal windows together, so the cost is n log n also where all repeat.
    """

    def repeated(s: Column) -> Column:
        same = lambda x, k: F.get(s, k)["h"].eqNullSafe(x["h"])
        kept = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return F.array_sort(F.transform(kept, lambda x: x["i"]))

    gaps = lambda p: F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width))))
    by_hash = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.aggregate(let(let(by_hash, repeated), gaps), F.lit(0), lambda a, x: a + x).cast("long")


def repeat_words(items: Column, width: int = 3) -> Column:
    count = lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0).cast("long")).otherwise(_covered(t, width))
    return let(window_hashes(items, width), count)


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long); null text counts 0 of each."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0)
    counted = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"))
    per_line = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    return (
        docs.withColumn("_w", let(words(F.col("text")), counted))
        .withColumn("_l", let(lines, per_line))
        .withColumns(
            {
                "n_words": F.col("_w.n_words"),
                "word_chars": F.length(F.translate(text, WHITE, "")).cast("long"),
                "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
                "n_lines": F.col("_l.n_lines"),
                "n_dup_lines": F.col("_l.n_dup_lines"),
                "n_repeat_words": F.col("_w.n_repeat_words"),
            }
        )
        .drop("_w", "_l")
    )


def _quantile_bucket(rows: DataFrame, bucket: str, share: float) -> DataFrame:
    """Per group ``g`` the least integer ``bucket`` up to which at least ``share`` of its rows lie (from counts, so reruns agree)."""
    counts = rows.groupBy("g", bucket).count()
    up = Window.partitionBy("g").orderBy(bucket)
    ranked = counts.select("g", bucket, F.sum("count").over(up).alias("upto"), F.sum("count").over(Window.partitionBy("g")).alias("n"))
    return ranked.where(F.col("upto") >= F.ceil(F.col("n") * F.lit(share))).groupBy("g").agg(F.min(bucket).alias(f"{bucket}_q"))


STEP = 0.005  # width of the classes by which medians are found


def _medians(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Per ``g`` the median of each value, to within STEP."""
    long = rows.select("g", F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.floor(v / STEP).alias("b")) for k, v in values.items()])).alias("v"))
    mid = _quantile_bucket(long.select(F.struct("g", "v.f").alias("g"), F.col("v.b").alias("b")), "b", 0.5)
    return mid.groupBy("g.g").agg(*[F.max(F.when(F.col("g.f") == k, (F.col("b_q") + 0.5) * STEP)).alias(k) for k in values])


def _root(cov: dict[tuple[int, int], Column]) -> dict[str, Column]:
    """Lower Cholesky factor of a positive definite matrix, entry by entry, as columns l_i_j."""
    low: dict[tuple[int, int], Column] = {}
    for i in range(len(FEATURES)):
        for j in range(i + 1):
            rest = cov[i, j]
            for k in range(j):
                rest = rest - low[i, k] * low[j, k]
            low[i, j] = F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / low[j, j]
    return {f"l{i}{j}": c for (i, j), c in low.items()}


def _distance() -> Column:
    """Squared Mahalanobis distance from columns x*, m* and l**, by forward substitution."""
    z: list[Column] = []
    for i, x in enumerate(FEATURES):
        rest = F.col(x) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * z[j]
        z.append(rest / F.col(f"l{i}{i}"))
    total = z[0] * z[0]
    for v in z[1:]:
        total = total + v * v
    return total


CLASSES = 40.0  # classes of squared distance per unit of its logarithm


def _with_distance(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    measured = rows.join(estimates, "g").withColumn("d2", _distance())
    return measured.select("g", *FEATURES, "d2", F.floor(F.log(F.col("d2") + 1e-6) * CLASSES).alias("b"))


def _estimates(centre: list[Column], scatter: dict[tuple[int, int], Column]) -> list[Column]:
    """Columns g, m*, l** and logdet (logarithm of the determinant) of estimates with variances of FLOORS squared at least."""
    floored = {(i, j): F.greatest(c, F.lit(FLOORS[i] ** 2)) if i == j else c for (i, j), c in scatter.items()}
    root = _root(floored)
    logdet = sum((2 * F.log(root[f"l{i}{i}"]) for i in range(len(FEATURES))), F.lit(0.0))
    return [F.col("g"), *[m.alias(f"m{i}") for i, m in enumerate(centre)], *[c.alias(k) for k, c in root.items()], logdet.alias("logdet")]


def _concentrated(rows: DataFrame, estimates: DataFrame, share: float) -> DataFrame:
    """Estimates from the ``share`` of each group's rows that lie nearest to the given ones."""
    p = range(len(FEATURES))
    measured = _with_distance(rows, estimates)
    near = measured.join(_quantile_bucket(measured, "b", share), "g").where("b <= b_q")
    sums = near.groupBy("g").agg(*[F.avg(x).alias(f"a{i}") for i, x in enumerate(FEATURES)], *[F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c{i}{j}") for i in p for j in range(i + 1)])
    return sums.select(*_estimates([F.col(f"a{i}") for i in p], {(i, j): F.col(f"c{i}{j}") for i in p for j in range(i + 1)}))


def _starts(rows: DataFrame) -> DataFrame:
    """Estimates of all starts; ``g`` becomes a struct of group and start."""
    p = range(len(FEATURES))
    centre = stage(_medians(rows, {f"a{i}": F.col(x) for i, x in enumerate(FEATURES)}), "centre")
    spread = _medians(rows.join(centre, "g"), {f"s{i}": F.abs(F.col(x) - F.col(f"a{i}")) for i, x in enumerate(FEATURES)})
    robust = stage(centre.join(spread, "g").select("g", *[f"a{i}" for i in p], *[F.greatest(F.col(f"s{i}") * 1.4826, F.lit(FLOORS[i])).alias(f"s{i}") for i in p]), "robust")
    middle = [F.col(f"a{i}") for i in p]
    plain = stage(robust.select(*_estimates(middle, {(i, j): F.pow(f"s{i}", F.lit(2)) if i == j else F.lit(0.0) for i in p for j in range(i + 1)})), "mcd_start")
    score = [F.tanh((F.col(x) - F.col(f"a{i}")) / F.col(f"s{i}")) for i, x in enumerate(FEATURES)]
    bent = rows.join(robust, "g").select("g", *[c.alias(f"t{i}") for i, c in enumerate(score)]).groupBy("g")
    safe = lambda i, j: F.coalesce(F.try_divide(F.covar_pop(f"t{i}", f"t{j}"), F.stddev_pop(f"t{i}") * F.stddev_pop(f"t{j}")), F.lit(0.0))
    bent = bent.agg(*[safe(i, j).alias(f"r{i}{j}") for i in p for j in range(i)]).join(robust, "g")
    tilted = bent.select(*_estimates(middle, {(i, j): F.col(f"s{i}") * F.col(f"s{j}") * (F.lit(1.0) if i == j else F.col(f"r{i}{j}")) for i in p for j in range(i + 1)}))
    named = [df.withColumn("g", F.struct(F.col("g").alias("group"), F.lit(k).alias("start"))) for k, df in enumerate((plain, tilted, _concentrated(rows, plain, 0.5)))]
    return stage(named[0].unionByName(named[1]).unionByName(named[2]), "mcd")


def mcd_estimates(rows: DataFrame, share: float = 0.75, steps: int = 20) -> DataFrame:
    """Per group ``g``: n, centre m*, Cholesky factor l** of the scatter, logdet, and scale (median squared distance over that of chi-square).

    Steps end when no determinant falls by a thousandth, after ``steps`` at the latest; one number a step reaches the driver.
    """
    estimates, last = _starts(rows), None
    each = rows.select(F.explode(F.array(*[F.struct(F.col("g").alias("group"), F.lit(k).alias("start")) for k in range(3)])).alias("g"), *FEATURES)
    for _ in range(steps):
        estimates = stage(_concentrated(each, estimates, share), "mcd")
        if last is not None:
            fallen = estimates.join(last, "g").agg(F.max(F.col("before") - F.col("logdet"))).first()[0]
            if fallen is None or fallen < 1e-3:
                break
        last = estimates.select("g", F.col("logdet").alias("before"))
    best = estimates.groupBy("g.group").agg(F.min_by(F.struct("*"), F.struct("logdet", "g.start")).alias("e"))
    best = stage(best.select(F.col("group").alias("g"), *[F.col(f"e.{c}").alias(c) for c in estimates.columns if c != "g"]), "mcd_best")
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"))
    middle = _quantile_bucket(_with_distance(rows, best), "b", 0.5)
    scale = F.greatest(F.exp((F.col("b_q") + 0.5) / CLASSES) / CHI2_MEDIAN, F.lit(1.0))
    return stage(best.join(middle, "g").join(sizes, "g").select("*", scale.alias("scale")).drop("b_q"), "mcd")


def quality_rules(docs: DataFrame, cutoff: float = CHI2_CUTOFF, min_group: int = 60, key: str = "doc_id") -> DataFrame:
    """Verdict on every row of ``docs`` (``key``, text, lang, source).

    Returns ``key``, text_hash, the statistics, base_failed, distance (scaled squared Mahalanobis distance, null if not measured)
    and kept. base_failed: fewer than 50 words, or over half of the words in repeated three-word windows;
    such rows are not kept and take no part in the estimates. The others are measured against their
    (lang, source) group, against their language where the group has under ``min_group`` rows, and against
    all documents where the language has too few as well, so every such row is measured. Rows beyond ``cutoff`` (by default what chi-square of 4 degrees of freedom exceeds with probability 0.001) are not kept.

    Null lang or source is a value of its own; null or empty text has zero counts and fails the base
    rules; repeated rows are judged alike; an empty table gives no rows. Other columns of ``docs`` are not read.
    """
    counted = statistics(docs.select(F.col(key).alias("_key"), "text", "lang", "source"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    chars, n = F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_words"), F.lit(1))
    values = (
        F.log((F.col("word_chars") + 1) / n),
        F.sqrt(F.col("n_symbols") / chars),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.col("n_repeat_words") / n,
    )
    own = F.struct("lang", "source", F.lit(1).alias("level"))
    wide = F.struct("lang", F.lit(None).cast("string").alias("source"), F.lit(0).alias("level"))
    table = stage(
        counted.select("_key", F.xxhash64("text").alias("text_hash"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.to_json(own).alias("own"), F.to_json(wide).alias("wide"), *[v.alias(x) for v, x in zip(values, FEATURES, strict=True)]),
        "statistics",
    )
    rows = table.where("not base_failed").select(F.explode(F.array("own", "wide", F.lit(ALL))).alias("g"), *FEATURES)
    estimates = mcd_estimates(rows).where((F.col("n") >= min_group) | (F.col("g") == ALL)).select("g", F.struct("*").alias("e"))
    judged = table.join(estimates.select(F.col("g").alias("own"), F.col("e").alias("e_own")), "own", "left").join(
        estimates.select(F.col("g").alias("wide"), F.col("e").alias("e_wide")), "wide", "left"
    )
    whole = estimates.where(F.col("g") == ALL).select(F.col("e").alias("e_all"))  # one row, none if no row passes the base rules
    judged = judged.join(F.broadcast(whole), F.lit(True), "left").withColumn("e", F.coalesce("e_own", "e_wide", "e_all")).select("*", *[F.col(f"e.{c}").alias(c) for c in estimates.select("e.*").columns if c not in ("g", "n")])
    distance = F.when(~F.col("base_failed"), _distance() / F.col("scale"))
    return judged.withColumn("distance", distance).select(
        F.col("_key").alias(key), "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).alias("kept"),
    )
