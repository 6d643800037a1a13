"""Registry of queries and of the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SIG = """sig0 AS (
  SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS x,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, CAST(extract(minute FROM ts) AS DOUBLE) AS z,
         event_type IN ('click', 'view') AS sacc, event_type IN ('view', 'error') AS blink, event_type AS kind FROM events),
sig AS (SELECT *, t // 10 AS vid, count(*) OVER (PARTITION BY u) AS n FROM sig0)"""
EMB = "emb AS (SELECT vec_id AS vec, CAST(label AS BIGINT) AS grp, CAST(embedding AS DOUBLE[]) AS ch FROM embeddings)"
RES = """res AS (
  SELECT c_mktsegment AS modality, o_orderpriority AS component, c_custkey AS subject, o_totalprice / 997 AS value, o_orderkey AS trial
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
NUM = "num AS (SELECT l_returnflag AS flag, l_quantity AS q, l_extendedprice / 1000 AS p, l_discount AS d, l_tax AS tax FROM lineitem)"


def rd(e: str, digits: int = 6) -> str:
    return f"CASE WHEN abs({e}) < 0.5e-{digits} THEN 0.0 ELSE round({e}, {digits}) END"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
