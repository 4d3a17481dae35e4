"""Transformers of tables: joins, appends, SQL. Spatial ones are in spatial_transformers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.expressions import projection, names_of
from plumbline.issues import Table

BASE_ROWS = "base_rows"


def with_base_rows(table: Table) -> DataFrame:
    """The rows of a table with base_rows, the source rows that issues on derived rows report."""
    rows = table.rows
    if BASE_ROWS in rows.columns:
        return rows
    return rows.withColumn(BASE_ROWS, F.array(F.struct(F.lit(table.name).alias("tab"), F.col(table.oid).cast("bigint").alias("oid"))))


def _qualified(table: Table, taken: set[str]) -> DataFrame:
    """Fields that another side has too are called table_field."""
    rows = with_base_rows(table)
    return rows.select(*[F.col(f"`{c}`").alias(f"{table.name}_{c}" if c.lower() in taken and c != BASE_ROWS else c) for c in rows.columns])


def tr_table_join(left: Table, right: Table, left_key: str, right_key: str, how: str = "inner", bridge: Table | None = None, bridge_left: str | None = None, bridge_right: str | None = None) -> Table:
    """Equi-join on one key, by text; inner or left; with a bridge table, m:n. Null keys meet nothing.

    Fields of the right side (and bridge) that the left one has are prefixed with their table's name. The oid is that of the side whose rows are
    unique in the result: the bridge's, else the left one's.
    """
    if how not in ("inner", "left"):
        raise NotImplementedError(f"join type {how}")
    if (bridge is None) != (bridge_left is None) or (bridge is None) != (bridge_right is None):
        raise ValueError("a bridge table needs both of its keys")
    a = with_base_rows(left)
    taken = {c.lower() for c in a.columns} - {BASE_ROWS}
    b = _qualified(right, taken)
    name = lambda t, k: f"{t.name}_{k}" if k.lower() in taken else k
    text = lambda c: F.col(c).cast("string")
    a = a.withColumnRenamed(BASE_ROWS, "_base_a").withColumn("_key_a", text(left_key))
    b = b.withColumnRenamed(BASE_ROWS, "_base_b").withColumn("_key_b", text(name(right, right_key)))
    oid = left.oid
    if bridge is not None:
        m = bridge.rows.select(F.col(bridge_left).cast("string").alias("_m_a"), F.col(bridge_right).cast("string").alias("_m_b"), F.col(bridge.oid).alias(f"{bridge.name}_oid"))
        a = a.join(m, F.col("_key_a") == F.col("_m_a"), how)
        out = a.join(b, F.col("_m_b") == F.col("_key_b"), how).drop("_m_a", "_m_b")
        oid = f"{bridge.name}_oid"
    else:
        out = a.join(b, F.col("_key_a") == F.col("_key_b"), how)
    none = F.array().cast("array<struct<tab:string,oid:bigint>>")
    out = out.withColumn(BASE_ROWS, F.concat("_base_a", F.coalesce("_base_b", none))).drop("_base_a", "_base_b", "_key_a", "_key_b")
    if right.geom and name(right, right.geom) in out.columns:
        out = out.drop(name(right, right.geom))
    return Table(out, f"{left.name}_{right.name}", oid, left.geom)


@dataclass(frozen=True)
class Relation:
    """A named association of a catalog."""

    left: str
    left_key: str
    right: str
    right_key: str
    bridge: str | None = None
    bridge_left: str | None = None
    bridge_right: str | None = None


def tr_table_join_by_name(tables: Mapping[str, Table], relations: Mapping[str, Relation], name: str, how: str = "inner") -> Table:
    """The join of a stored relation; its inputs may not be filtered."""
    r = relations[name]
    used = [tables[r.left], tables[r.right], *([tables[r.bridge]] if r.bridge else [])]
    if any(t.where for t in used):
        raise ValueError("filters belong to the use of a joined table, not to its inputs")
    return tr_table_join(tables[r.left], tables[r.right], r.left_key, r.right_key, how, tables[r.bridge] if r.bridge else None, r.bridge_left, r.bridge_right)


def tr_table_append(tables: Sequence[Table], name: str = "appended") -> Table:
    """All rows by field name, missing fields null. appended_oid numbers rows by (table, oid) without a shuffle."""
    parts = []
    for k, t in enumerate(tables):
        rows = with_base_rows(t)
        parts.append(rows.withColumn("appended_oid", F.col(t.oid).cast("bigint") * len(tables) + k).withColumn("appended_table", F.lit(t.name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return Table(out, name, "appended_oid", tables[0].geom if all(t.geom for t in tables) else None)


def tr_make_table(spark: SparkSession, tables: Mapping[str, Table], sql: str, oid: str, name: str = "made") -> Table:
    """A view by SQL over tables, which it names {like_this}."""
    if any(t.where for t in tables.values()):
        raise ValueError("filters belong into the statement")
    return Table(spark.sql(sql, **{k: t.df for k, t in tables.items()}), name, oid)


def tr_open_table(spark: SparkSession, name: str, oid: str) -> Table:
    """An existing table or view of the catalog."""
    return Table(spark.table(name), name.rpartition(".")[2], oid)


def tr_attributes(table: Table, attributes: Sequence[str]) -> Table:
    """A table with computed attributes, each ``expression AS name`` or a field."""
    names = names_of(table.df)
    made = [column.alias(name) for name, column in (projection(a, names) for a in attributes)]
    keep = [F.col(table.oid), *([F.col(table.geom)] if table.geom else [])]
    return Table(with_base_rows(table).select(*keep, *made, BASE_ROWS), table.name, table.oid, table.geom)


def grouped(table: Table, group_by: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """Aggregate attributes (``SUM(a) AS total``) by group expressions."""
    names = names_of(table.df)
    keys = [column.alias(name) for name, column in (projection(g, names) for g in group_by)]
    return table.rows.groupBy(*keys).agg(*[column.alias(name) for name, column in (projection(a, names) for a in attributes)])
