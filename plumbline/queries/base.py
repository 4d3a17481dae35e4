"""Shared parts of the registered queries: inputs as tables of checks, and issues as flat rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import session
from plumbline.issues import Table

Query = Callable[[SparkSession, str], DataFrame]

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "documents": "doc_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id", "events": "event_id", "embeddings": "vec_id"}
#: lineitem and conversations have two-part keys; one number for each row.
MADE = {"lineitem": "l_orderkey * 10 + l_linenumber", "conversations": "conv_id * 1000 + turn"}


def table(spark: SparkSession, sf_dir: str, name: str, where: str | None = None) -> Table:
    df = session.table(spark, sf_dir, name)
    if name in MADE:
        return Table(df.withColumn("oid", F.expr(MADE[name])), name, "oid", where=where)
    return Table(df, name, KEYS[name], where=where)


def flat(found: DataFrame, *extra: str) -> DataFrame:
    """issue_code and oid, and of extra: component, other_oid, tab, value, value2."""
    made = {"component": F.col("component"), "other_oid": F.col("involved")[1]["oid"], "tab": F.col("involved")[0]["tab"], "value": F.get("values", F.lit(0)), "value2": F.get("values", F.lit(1)), "description": F.col("description")}
    oid = [] if "no_oid" in extra else [F.get("involved", F.lit(0))["oid"].alias("oid")]
    return found.select("issue_code", *oid, *[made[e].alias(e) for e in extra if e != "no_oid"])
