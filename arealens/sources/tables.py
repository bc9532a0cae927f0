"""Reading raw tables, cached results and an append-only log of runs."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def clean_name(name: str) -> str:
    """Lower case, ``#`` as ``num``, other runs of signs and spaces as one underscore."""
    return re.sub(r"\W+", "_", name.strip().lower().replace("#", " num ").strip()).strip("_")


def clean_names(df: DataFrame, fixes: Mapping[str, str] | None = None) -> DataFrame:
    """Columns by ``clean_name``, then by ``fixes``; two columns of one name raise ValueError."""
    names = [(fixes or {}).get(n, n) for n in map(clean_name, df.columns)]
    if len(set(names)) < len(names):
        raise ValueError(f"names clash: {sorted(n for n in names if names.count(n) > 1)}")
    return df.toDF(*names)


def read_raw_csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """All columns as text, malformed lines left out, names cleaned; several files or folders are one table."""
    return clean_names(spark.read.csv(list(paths) if not isinstance(paths, str) else paths, header=True, mode="DROPMALFORMED", inferSchema=False))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS"))


def materialize(spark: SparkSession, path: str, compute: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """The Parquet table at ``path``, computed and written first if it is missing, unfinished or to be refreshed."""
    if refresh or not _exists(spark, path):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_run(predictions: DataFrame, path: str, run_id: str, name: str, order: int) -> None:
    """Add a run's rows to the log; ``order`` is its place in time."""
    predictions.select("*", F.lit(name).alias("run_name"), F.lit(order).cast("long").alias("run_order"), F.lit(run_id).alias("run_id")).write.mode("append").partitionBy("run_id").parquet(path)


def load_run(spark: SparkSession, path: str, name: str, pool: DataFrame, key: str) -> DataFrame:
    """Rows of the newest run of that name joined to ``pool``; a key that occurs twice in either raises ValueError."""
    log = spark.read.parquet(path).where(F.col("run_name") == name)
    newest = log.agg(F.max_by("run_id", "run_order")).first()[0]
    run = log.where(F.col("run_id") == newest).drop("run_name", "run_order")
    for df in (run, pool):
        if df.groupBy(key).count().where("count > 1").take(1):
            raise ValueError(f"{key} is not unique")
    return pool.join(run, key)


def drift(cached: DataFrame, source: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Per column the number of keys on one side only or null on one side, and the largest difference of the rest."""
    a, b = cached.select(key, *columns), source.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = a.join(b, key, "full_outer")
    cells = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull() != F.col(f"_{c}").isNull()).alias("unmatched"), F.max(F.abs(F.col(c) - F.col(f"_{c}"))).cast("double").alias("largest")) for c in columns]
    return joined.agg(F.array(*cells).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column the percentage of rows that are not null, from one pass."""
    cells = [F.struct(F.lit(c).alias("column"), (F.try_divide(F.count(c), F.count("*")) * 100).alias("pct")) for c in columns]
    return df.agg(F.array(*cells).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def quality_gate(df: DataFrame, source: str, category: str, mapped_from: str, required: Sequence[str], baseline: DataFrame, *, least_mapped: float, least_growth: float) -> DataFrame:
    """Per source n, mapped (rows with a category), kinds (different values of ``mapped_from`` among them) and three findings.

    too_few: under ``least_mapped`` of the rows are mapped; shrunk: fewer rows than ``least_growth`` times those of ``baseline`` (source, baseline), false
    for a source that it lacks; missing: how many of the ``required`` categories have no row.
    """
    has = [F.max((F.col(category) == c).cast("int")) for c in required]
    mapped = F.col(category).isNotNull()
    found = df.groupBy(source).agg(F.count("*").alias("n"), F.count_if(mapped).alias("mapped"), F.count_distinct(F.when(mapped, F.col(mapped_from))).alias("kinds"), *[F.coalesce(h, F.lit(0)).alias(f"_has{i}") for i, h in enumerate(has)])
    joined = found.join(baseline, source, "left")
    missing = sum((1 - F.col(f"_has{i}") for i in range(len(required))), F.lit(0))
    shrunk = F.coalesce(F.col("n") < F.lit(least_growth) * F.col("baseline"), F.lit(False))
    return joined.select(source, "n", "mapped", "kinds", (F.col("mapped") < least_mapped * F.col("n")).alias("too_few"), shrunk.alias("shrunk"), missing.alias("missing"))
