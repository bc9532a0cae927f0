"""The domain's tables laid over the given ones, by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "areas": """SELECT lpad(cast(c_custkey AS varchar(20)), 12, '0') AS geoid, c_custkey AS id, c_nationkey AS city, c_nationkey % 5 AS state,
        CASE WHEN c_custkey % 17 = 0 THEN 0 ELSE 100 + (c_custkey * 37) % 4000 END AS population, (c_custkey * 53) % 900 AS jobs,
        c_acctbal AS balance, c_mktsegment AS segment,
        ((c_custkey * 7919) % 10007) / 1e2 AS x, ((c_custkey * 104729) % 10009) / 1e2 AS y FROM customer""",
    "incidents": """SELECT o_orderkey AS id, o_custkey AS area_id, lpad(cast(o_custkey AS varchar(20)), 12, '0') AS geoid, o_orderpriority AS code, o_orderstatus AS status, o_orderdate AS occurred, o_totalprice AS amount,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE ((o_orderkey * 7919) % 10007) / 1e2 END AS x, ((o_orderkey * 104729) % 10009) / 1e2 AS y,
        CASE WHEN o_orderkey % 13 = 0 THEN 'REDACTED' ELSE concat('POINT (', cast((o_orderkey * 7919) % 10007 AS varchar(20)), ' ', cast((o_orderkey * 104729) % 10009 AS varchar(20)), ')') END AS wkt FROM orders""",
    "facilities": """SELECT s_suppkey AS id, s_nationkey % 3 AS kind, s_nationkey AS city, ((s_suppkey * 7919) % 10007) / 1e2 AS x, ((s_suppkey * 104729) % 10009) / 1e2 AS y, 2.0037 + s_suppkey % 5 AS r FROM supplier""",
    "exposures": """SELECT l_orderkey AS id, l_linenumber AS line, l_returnflag AS carrier, l_suppkey AS agency, l_partkey AS part, l_quantity AS exposure, cast(l_linenumber AS double) AS claims, l_extendedprice AS price, l_shipdate AS occurred FROM lineitem""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS, or a given table."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    table = text.rsplit("FROM ", 1)[1].strip()
    return spark.sql(text.replace(f"FROM {table}", "FROM {t}"), t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def oracle(text: str) -> str:
    """DuckDB SQL with the views that ``text`` names put before it."""
    used = [f"{k} AS ({v})" for k, v in VIEWS.items() if k in text]
    if used and text.startswith("WITH "):
        return f"WITH {', '.join(used)}, {text[5:]}"
    return f"WITH {', '.join(used)} {text}" if used else text
