"""Issues: the rows that checks give, and what a run does with them.

An issue is (issue_code, component, involved, description, values, geom): involved is array<struct<tab, oid>>; geom is
well-known text or null. A run adds condition and severity.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expressions import holds, names_of

SCHEMA = "issue_code string, component string, involved array<struct<tab:string,oid:bigint>>, description string, values array<string>, geom string"


@dataclass(frozen=True)
class Table:
    """An input of a check: rows, the name issues call it by, its key column, its geometry column and a row filter."""

    df: DataFrame
    name: str
    oid: str = "oid"
    geom: str | None = None
    where: str | None = None
    sensitive: bool = False

    @property
    def rows(self) -> DataFrame:
        return self.df.where(holds(self.where, names_of(self.df), self.sensitive)) if self.where else self.df


def involved(*rows: tuple[str, str | Column]) -> Column:
    return F.array(*[F.struct(F.lit(name).alias("tab"), (F.col(oid) if isinstance(oid, str) else oid).cast("bigint").alias("oid")) for name, oid in rows])


def issues(df: DataFrame, code: str | Column, rows: Sequence[tuple[str, str | Column]] | Column, component: str | Column | None = None, description: str | Column | None = None, values: Sequence[Column] = (), geom: Column | None = None) -> DataFrame:
    """df's rows as issues."""
    text = lambda x: F.lit(x).cast("string") if x is None or isinstance(x, str) else x.cast("string")
    return df.select(
        text(code).alias("issue_code"), text(component).alias("component"), (rows if isinstance(rows, Column) else involved(*rows)).alias("involved"), text(description).alias("description"),
        F.array(*[v.cast("string") for v in values]).cast("array<string>").alias("values"), (F.lit(None).cast("string") if geom is None else geom.cast("string")).alias("geom"),
    )


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def distinct(found: DataFrame) -> DataFrame:
    """Issues are equal if condition, code, component, rows (in any order) and place agree."""
    keys = [c for c in ("condition", "issue_code", "component", "geom") if c in found.columns]
    return found.withColumn("_rows", F.array_sort("involved")).dropDuplicates([*keys, "_rows"]).drop("_rows")


def _envelope(wkt: Column) -> dict[str, Column]:
    """The envelope of a well-known text of x and y coordinates."""
    numbers = F.transform(F.regexp_extract_all(wkt, F.lit(r"(-?[0-9][0-9.]*(?:[eE][+-]?[0-9]+)?)"), F.lit(1)), lambda v: v.cast("double"))
    axis = lambda k: F.filter(numbers, lambda v, i: i % 2 == k)
    return {"xmin": F.array_min(axis(0)), "ymin": F.array_min(axis(1)), "xmax": F.array_max(axis(0)), "ymax": F.array_max(axis(1))}


def _matches(found: DataFrame, exceptions: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame, Column]:
    """The two sides, aliased a and b, and the condition under which an allowed issue b matches an issue a."""
    names = exceptions.columns
    kept = exceptions.where(F.coalesce(F.lower("status"), F.lit("active")) == "active") if "status" in names else exceptions
    kept = kept.withColumn("_rows", F.array_sort("involved"))
    a, b = found.alias("a"), kept.alias("b")
    same = F.col("a.condition") == F.col("b.condition")
    same = same & (F.col("b.issue_code").isNull() | (F.lower("a.issue_code") == F.lower("b.issue_code"))) & (F.col("b._rows").isNull() | (F.array_sort("a.involved") == F.col("b._rows")))
    if "component" in names:
        same = same & (F.col("b.component").isNull() | (F.lower("a.component") == F.lower("b.component")))
    if "geom" in names and "shape_match" in names:
        x, y = _envelope(F.col("a.geom")), _envelope(F.col("b.geom"))
        equal, within = F.lit(True), F.lit(True)
        for k in x:
            equal = equal & (F.abs(x[k] - y[k]) <= tolerance)
            within = within & ((x[k] >= y[k] - tolerance) if k.endswith("min") else (x[k] <= y[k] + tolerance))
        how = F.coalesce(F.lower("b.shape_match"), F.lit("ignore_shape"))
        met = F.when(how == "equal_envelope", equal).when(how == "within_envelope", within).otherwise(True)
        same = same & (F.col("b.geom").isNull() | F.coalesce(met, F.lit(False)))
    return a, b, same


def without_exceptions(found: DataFrame, exceptions: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Issues that no allowed issue matches; exceptions has condition, issue_code and involved, nulls match anything.

    Further columns count where they are there: status (only "active" ones and those without any are used), component, and geom with
    shape_match: equal_envelope, within_envelope (the issue lies within the envelope of the allowed one) or ignore_shape.
    """
    a, b, same = _matches(found, exceptions, tolerance)
    return a.join(b, same, "left_anti")


def exception_usage(found: DataFrame, exceptions: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """exceptions with n_used, how many issues each of them matches; 0 for those that are not active or match none."""
    numbered = exceptions.withColumn("_exception", F.monotonically_increasing_id())
    a, b, same = _matches(found, numbered, tolerance)
    used = a.join(b, same).groupBy(F.col("b._exception").alias("_used")).agg(F.count("*").alias("n_used"))
    return numbered.join(used, F.col("_exception") == F.col("_used"), "left").withColumn("n_used", F.coalesce("n_used", F.lit(0))).drop("_exception", "_used")


def statistics(found: DataFrame, by: Sequence[str] = ("condition", "issue_code", "component")) -> DataFrame:
    return found.groupBy(*by).agg(F.count("*").alias("n_issues"))
