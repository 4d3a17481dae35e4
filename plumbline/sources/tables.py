"""Scans and sinks: parquet, CSV, JSON, ORC, JDBC and SQL sources, issue stores and table exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.expressions import holds, names_of
from plumbline.issues import Table


def scan(spark: SparkSession, path: str, fmt: str = "parquet", fields: Sequence[str] | None = None, where: str | None = None, schema: str | None = None, **options: str) -> DataFrame:
    """A filtered and projected scan; both reach the reader. CSV skips lines that begin with # unless told otherwise."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        options = {"header": "true", "comment": "#"} | options
    if schema:
        reader = reader.schema(schema)
    df = reader.options(**options).load(path) if path else reader.options(**options).load()
    if where:
        df = df.where(holds(where, names_of(df)))
    return df.select(*fields) if fields else df


def remote_query(spark: SparkSession, url: str, query: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """The rows of a query that a database evaluates. partition: (column, lowest, highest, number), so that many tasks read side by
    side; the bounds only deal rows out and leave none away."""
    reader = spark.read.format("jdbc").options(url=url, **options)
    if partition is None:
        return reader.option("query", query).load()
    column, lowest, highest, number = partition
    return reader.option("dbtable", f"({query}) q").options(partitionColumn=column, lowerBound=lowest, upperBound=highest, numPartitions=number).load()


def keyed_scan(df: DataFrame, key: str, keys: DataFrame, keys_field: str) -> DataFrame:
    """The rows whose key is among keys: a semi-join, which the planner broadcasts only if it finds keys small."""
    return df.join(keys.select(F.col(keys_field).alias("_key")).distinct(), F.col(key) == F.col("_key"), "left_semi")


def geometry_kind(geom: str = "geom"):
    return F.when(F.col(geom).isNull(), F.lit("none")).otherwise(F.lower(F.regexp_extract(geom, r"^\s*(?:MULTI)?([A-Z]+)", 1)))


def write_issues(found: DataFrame, path: str, mode: str = "overwrite") -> None:
    """An issue store: one folder for each kind of geometry."""
    found.withColumn("shape", geometry_kind()).write.mode(mode).partitionBy("shape").parquet(path)


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export_tables(tables: Sequence[Table], path: str, tile: Mapping[str, str] | None = None, mode: str = "overwrite") -> list[str]:
    """Every table as parquet under path, filtered ones with the suffix _sel, names made unique; tile gives a tile expression by table."""
    written: list[str] = []
    for t in tables:
        name = t.name + ("_sel" if t.where else "")
        while f"{path}/{name}" in written:
            name += "_1"
        rows = t.rows
        writer = rows.write
        if tile and t.name in tile:
            writer = rows.withColumn("tile_id", F.expr(tile[t.name])).write.partitionBy("tile_id")
        writer.mode(mode).parquet(f"{path}/{name}")
        written.append(f"{path}/{name}")
    return written


def external_graphic_conflict(table: Table, conflicts: Table, distance: float, scale: float, call=None, schema: str = "oid long, other long") -> DataFrame:
    """Pairs of features nearer than a map distance at a scale, by an outside service if one is given, else by the features themselves."""
    if call is not None:
        return external_service([table, conflicts], call, schema)
    from plumbline.operators.relations import near_pairs

    return near_pairs([table], [conflicts], distance * scale).select(F.col("a.oid").alias("oid"), F.col("b.oid").alias("other"))


def external_service(tables: Sequence[Table], call, schema: str) -> DataFrame:
    """A check by an outside service: call(iterator of Arrow batches) gives batches of the schema, partition by partition."""
    from plumbline.session import share_code

    share_code(tables[0].df.sparkSession)
    return tables[0].rows.mapInArrow(call, schema)
