"""The registered queries and the declared tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowgrain.frame import GrainedFrame
from rowgrain.sources.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with SQL that gives the same rows where there is such SQL."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


#: Columns that tell item rows apart at every scale; fewer are not enough in this data.
ITEM_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")

DECLARED = {
    "region": dict(grain="r_regionkey", kind="entity"),
    "nation": dict(grain="n_nationkey", kind="entity"),
    "customer": dict(
        grain="c_custkey", entity_key="c_custkey", kind="entity", measures=["c_acctbal"],
        fds=[(["c_custkey"], ["c_name", "c_nationkey", "c_mktsegment"])],
    ),
    "supplier": dict(grain="s_suppkey", entity_key="s_suppkey", kind="entity", measures=["s_acctbal"]),
    "part": dict(grain="p_partkey", entity_key="p_partkey", kind="entity", measures=["p_retailprice"]),
    "orders": dict(grain="o_orderkey", entity_key="o_orderkey", kind="entity", measures=["o_totalprice"]),
    "lineitem": dict(grain=ITEM_KEY, kind="link", measures=["l_quantity", "l_extendedprice"]),
    "events": dict(
        grain=["user_id", "ts"], entity_key="user_id", kind="event", measures=["value"], alternatives=[["event_id"]]
    ),
    "documents": dict(grain="doc_id", entity_key="doc_id", kind="entity", measures=["n_chars"]),
    "labels": dict(grain="doc_id", entity_key="doc_id", kind="entity"),
    "conversations": dict(grain=["conv_id", "turn"], entity_key="conv_id", kind="ordered"),
    "pages": dict(grain="page_id", entity_key="page_id", kind="entity"),
    "embeddings": dict(grain="vec_id", entity_key="vec_id", kind="entity"),
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> GrainedFrame:
    """A given table with its declaration."""
    return read(spark, f"{sf_dir}/{name}.parquet", **DECLARED[name])


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
