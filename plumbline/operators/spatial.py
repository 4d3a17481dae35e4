"""Spatial joins: candidate pairs by grid cells, then exact relations: expressions for points and boxes, else in Arrow batches.

Every shape has a level, the power of two of the cell that is at least as large as it, so that it covers at most four cells of its
level; a large shape does not multiply. A pair meets at the higher of its two levels, in the one cell that is the maximum of
both lower-left cells, so pairs come out once and no distinct is needed. A dense cell is split by adaptive skew joins.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType
from pyspark.sql.types import StructType

from plumbline.functions import geometry as G
from plumbline.functions import planar
from plumbline.functions.expressions import Value, holds, kind_of
from plumbline.issues import Table
from plumbline.session import share_code

#: Shapes as columns of plain arrays: these cross to Python without nested rows.
PACKED = "struct<kind:string,sizes:array<int>,x:array<double>,y:array<double>>"


def packed(geom: Column) -> Column:
    pts = G.points(geom)
    return F.struct(geom["kind"].alias("kind"), F.transform(geom["parts"], F.size).alias("sizes"), F.transform(pts, lambda p: p["x"]).alias("x"), F.transform(pts, lambda p: p["y"]).alias("y"))


def unpacked(row: dict) -> planar.Shape:
    x, y = row["x"], row["y"]
    points = list(zip(map(float, x), map(float, y), strict=True))
    out, at = [], 0
    for n in row["sizes"]:
        out.append(points[at : at + n])
        at += n
    return row["kind"], out


#: What the envelope alone tells all of: single points and axis-parallel rectangles.
POINT, BOX = 1, 2


def _plain(geom: Column, e: dict[str, Column]) -> Column:
    """POINT or BOX for shapes that their envelope tells all of, else 0."""
    p = G.points(geom)
    corner = F.forall(p, lambda q: q["x"].isin(e["xmin"], e["xmax"]) & q["y"].isin(e["ymin"], e["ymax"]))
    at = lambda k: F.get(p, F.lit(k))
    across = lambda i, j: (at(i)["x"] != at(j)["x"]) & (at(i)["y"] != at(j)["y"])
    closed = (at(0)["x"] == at(4)["x"]) & (at(0)["y"] == at(4)["y"]) & ((at(0)["x"] == at(1)["x"]) != (at(0)["y"] == at(1)["y"]))
    box = (geom["kind"] == "polygon") & (F.size(geom["parts"]) == 1) & (F.size(p) == 5) & corner & across(0, 2) & across(1, 3) & closed
    return F.when((geom["kind"] == "point") & (F.size(p) == 1), POINT).when(box, BOX).otherwise(0)


def shapes(table: Table, keep: tuple[str, ...] = (), grow: float = 0.0) -> DataFrame:
    """oid, geom, the kept fields and the envelope (grown) of the non-empty rows of a table."""
    g = F.col(table.geom)
    rows = table.rows.where(~G.is_empty(g)).select(F.col(table.oid).cast("bigint").alias("oid"), g.alias("geom"), *keep)
    rows = rows.withColumns(G.envelope(F.col("geom")))
    rows = rows.withColumn("_plain", _plain(F.col("geom"), {k: F.col(k) for k in ("xmin", "ymin", "xmax", "ymax")}))
    # the envelope as it is, beside the grown one, and the tolerance of planar.relate(), from the largest coordinate
    ends = ("xmin", "ymin", "xmax", "ymax")
    rows = rows.withColumn("_own", F.struct(*ends, (1e-9 * F.greatest(F.lit(1.0), *[F.abs(c) for c in ends])).alias("eps")))
    return rows.withColumns({k: F.col(k) - grow if k.endswith("min") else F.col(k) + grow for k in ("xmin", "ymin", "xmax", "ymax")}) if grow else rows


def _leveled(rows: DataFrame) -> DataFrame:
    size = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"), F.lit(1e-6))
    return rows.withColumn("_level", F.ceil(F.log2(size)).cast("int"))


def candidate_pairs(a: DataFrame, b: DataFrame, same: bool = False) -> DataFrame:
    """Pairs whose envelopes meet; columns are those of a and b as struct columns a and b, and _easy: both are points or boxes. same: each
    unordered pair once.

    Both sides are sorted and merged, never broadcast: a small file can hold millions of shapes.
    """
    sides = [_leveled(d) for d in ([a] if a is b else [a, b])]
    a, b = sides[0], sides[-1]
    # the levels in use, at most a few dozen for any data, and whether shapes other than points and boxes are there
    seen = [{tuple(r) for r in d.where("_level is not null").select("_level", F.col("_plain") > 0).distinct().limit(4096).toLocalIterator()} for d in sides]
    levels = [sorted({level for level, _ in side}) for side in (seen[0], seen[-1])]
    plain = [{easy for _, easy in side} for side in (seen[0], seen[-1])]

    def dealt(rows: DataFrame, side: str, others: list[int]) -> DataFrame:
        def cells(level: Column) -> Column:
            cell = F.pow(F.lit(2.0), level)
            across = lambda low, high: F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell))
            return F.flatten(F.transform(across("xmin", "xmax"), lambda i: F.transform(across("ymin", "ymax"), lambda j: F.struct(level.alias("level"), i.alias("cx"), j.alias("cy")))))

        # a pair meets at the higher level: a shape's own one if the other side has any as low, else one of the other side's
        own, level = F.col("_level"), F.array(*[F.lit(x) for x in others]) if others else F.array().cast("array<int>")
        met = F.filter(level, lambda x: x > own)
        places = F.flatten(F.transform(F.when(own >= F.lit(others[0] if others else None), F.concat(F.array(own), met)).otherwise(met), cells))
        columns = rows.columns
        rows = rows.withColumn("_cell", F.explode(places))
        return rows.select(F.struct(*columns).alias(side), F.col("_cell.level").alias("level"), F.col("_cell.cx").alias("cx"), F.col("_cell.cy").alias("cy"))

    x, y = dealt(a, "a", levels[1]), dealt(b, "b", levels[0])
    cell = F.pow(F.lit(2.0), F.col("level"))
    corner = lambda axis: F.floor(F.greatest(F.col(f"a.{axis}min"), F.col(f"b.{axis}min")) / cell)
    meet = (F.col("a.xmin") <= F.col("b.xmax")) & (F.col("b.xmin") <= F.col("a.xmax")) & (F.col("a.ymin") <= F.col("b.ymax")) & (F.col("b.ymin") <= F.col("a.ymax"))
    once = (F.col("level") == F.greatest("a._level", "b._level")) & (F.col("cx") == corner("x")) & (F.col("cy") == corner("y"))
    order = F.col("a.oid") < F.col("b.oid") if same else F.lit(True)
    easy = F.lit(False) if {False} in plain else F.lit(True) if plain == [{True}, {True}] else _both_plain()
    return x.hint("merge").join(y, ["level", "cx", "cy"]).where(once & meet & order).select("a", "b", easy.alias("_easy"))


def _both_plain() -> Column:
    return (F.col("a._plain") > 0) & (F.col("b._plain") > 0)


def with_function(pairs: DataFrame, name: str, kind: str, function: Callable[[planar.Shape, planar.Shape], object]) -> DataFrame:
    """pairs with a column of function(shape of a, shape of b), in Arrow batches.

    Pairs are few bytes and much work: they are dealt out evenly first, which also parts the pairs of dense cells.
    """
    spark = pairs.sparkSession
    share_code(spark)
    pairs = pairs.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))

    shape = _result(kind)

    @_udf(kind)
    def run(batches):
        for a, b in batches:
            yield shape([function(unpacked(x), unpacked(y)) for x, y in zip(a.to_dict("records"), b.to_dict("records"), strict=True)])

    return pairs.withColumn(name, run(packed(F.col("a.geom")), packed(F.col("b.geom"))))


def of_shape(column: Column, kind: str, function: Callable[[planar.Shape], object]) -> Column:
    """function(shape) of a geometry column, in Arrow batches."""
    shape = _result(kind)

    @_udf(kind)
    def run(batches):
        for a in batches:
            yield shape([function(unpacked(x)) for x in a.to_dict("records")])

    return run(packed(column))


def _udf(kind: str):
    def wrap(function):
        with warnings.catch_warnings():  # one function serves results of several types, which type hints cannot say
            warnings.simplefilter("ignore", UserWarning)
            # else a filter on the result is pushed below it with a second call of the function
            return F.pandas_udf(function, kind, PandasUDFType.SCALAR_ITER).asNondeterministic()

    return wrap


def _result(kind: str) -> Callable[[list], pd.Series | pd.DataFrame]:
    """Arrow takes structs as frames, everything else as series."""
    if not kind.startswith("struct"):
        return lambda values: pd.Series(values, dtype="object")
    names = StructType.fromDDL(f"v {kind}")[0].dataType.names
    return lambda values: pd.DataFrame({n: pd.Series([None if v is None else v[n] for v in values], dtype="object") for n in names})


def as_geometry(found: planar.Shape) -> dict | None:
    return {"kind": found[0], "parts": [[{"x": x, "y": y, "z": None, "m": None, "id": None} for x, y in part] for part in found[1]]} if found[1] else None


def _sides() -> tuple[Column, ...]:
    return tuple(F.col(f"{s}._own.{k}") for s in "ab" for k in ("xmin", "ymin", "xmax", "ymax"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value evaluated once, however often the body names it and wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _plain_matrix() -> Column:
    """The intersection matrix of points and boxes from their envelopes."""
    names = ("ax0", "ay0", "ax1", "ay1", "bx0", "by0", "bx1", "by1")
    sides = F.struct(*[c.alias(n) for c, n in zip(_sides(), names, strict=True)], F.greatest("a._own.eps", "b._own.eps").alias("eps"), F.col("a._plain").alias("a"), F.col("b._plain").alias("b"))
    return _let(sides, lambda s: _let(_facts(*[s[n] for n in names], s["eps"]), lambda f: _matrix(f, s["a"] == POINT, s["b"] == POINT)))


def _facts(ax0: Column, ay0: Column, ax1: Column, ay1: Column, bx0: Column, by0: Column, bx1: Column, by1: Column, eps: Column) -> Column:
    less = lambda x, y: y - x > eps
    same = lambda x, y: F.abs(x - y) <= eps
    over_x, over_y = less(ax0, bx1) & less(bx0, ax1), less(ay0, by1) & less(by0, ay1)
    facts = {
        "inner": over_x & over_y,
        "apart": less(ax1, bx0) | less(bx1, ax0) | less(ay1, by0) | less(by1, ay0),
        "a_in_b": ~(less(ax0, bx0) | less(bx1, ax1) | less(ay0, by0) | less(by1, ay1)),
        "b_in_a": ~(less(bx0, ax0) | less(ax1, bx1) | less(by0, ay0) | less(ay1, by1)),
        "a_inside": less(bx0, ax0) & less(ax1, bx1) & less(by0, ay0) & less(ay1, by1),
        "b_inside": less(ax0, bx0) & less(bx1, ax1) & less(ay0, by0) & less(by1, ay1),
        "along": over_y & (same(ax0, bx0) | same(ax0, bx1) | same(ax1, bx0) | same(ax1, bx1)) | over_x & (same(ay0, by0) | same(ay0, by1) | same(ay1, by0) | same(ay1, by1)),
    }
    return F.struct(*[c.alias(n) for n, c in facts.items()])


def _matrix(facts: Column, a_point: Column, b_point: Column) -> Column:
    one = lambda condition, yes, no="F": F.when(condition, yes).otherwise(no)
    inner, apart, a_in_b, b_in_a, a_inside, b_inside, along = (facts[n] for n in ("inner", "apart", "a_in_b", "b_in_a", "a_inside", "b_inside", "along"))
    edges = F.when(apart | a_inside | b_inside, "F").when(along, "1").otherwise("0")
    boxes = F.concat(one(inner, "2"), one(inner & ~a_in_b, "1"), one(~a_in_b, "2"), one(inner & ~b_in_a, "1"), edges, one(~a_in_b, "1"), one(~b_in_a, "2"), one(~b_in_a, "1"), F.lit("2"))
    points = one(a_in_b, "0FFFFFFF2", "FF0FFF0F2")
    point_box = F.when(a_inside, "0FFFFF212").when(a_in_b, "F0FFFF212").otherwise("FF0FFF212")
    box_point = F.when(b_inside, "0F2FF1FF2").when(b_in_a, "FF20F1FF2").otherwise("FF2FF10F2")
    return F.when(a_point & b_point, points).when(a_point, point_box).when(b_point, box_point).otherwise(boxes)


def _plain_distance() -> Column:
    ax0, ay0, ax1, ay1, bx0, by0, bx1, by1 = _sides()
    zero = F.lit(0.0)
    return F.sqrt(F.greatest(bx0 - ax1, ax0 - bx1, zero) ** 2 + F.greatest(by0 - ay1, ay0 - by1, zero) ** 2)


def _parted(pairs: DataFrame, name: str, kind: str, plain: Column, function: Callable[[planar.Shape, planar.Shape], object]) -> DataFrame:
    """pairs with a column that is an expression for points and boxes, and a function of the shapes for all others.

    Where _easy is known for all pairs, one of the two parts is empty to the optimizer and costs nothing.
    """
    easy = F.col("_easy") if "_easy" in pairs.columns else _both_plain()
    return pairs.where(easy).withColumn(name, plain).unionByName(with_function(pairs.where(~easy), name, kind, function))


def distances(pairs: DataFrame, name: str = "distance") -> DataFrame:
    """pairs with the distance of their shapes."""
    return _parted(pairs, name, "double", _plain_distance(), planar.distance)


def related(pairs: DataFrame, relation: str | Callable[[str], Column] = "intersects") -> DataFrame:
    """Pairs that stand in a relation, with their matrix."""
    pairs = _parted(pairs, "matrix", "string", _plain_matrix(), planar.relate)
    return pairs.where(_let(F.col("matrix"), relation if callable(relation) else lambda m: relation_column(relation, m)))


def relation_column(relation: str, matrix: Column) -> Column:
    """A named relation from a matrix and the columns a.geom and b.geom."""
    m = lambda i: F.substring(matrix, i + 1, 1)
    t = lambda i: m(i) != "F"
    dim = lambda c: F.when(c == "point", 0).when(c == "line", 1).otherwise(2)
    da, db = dim(F.col("a.geom.kind")), dim(F.col("b.geom.kind"))
    contact = t(0) | t(1) | t(3) | t(4)
    return {
        "intersects": contact,
        "interior_intersects": t(0),
        "touches": contact & ~t(0),
        "crosses": F.when((da == 1) & (db == 1), m(0) == "0").otherwise(t(0) & (da != db) & F.when(da < db, t(2)).otherwise(t(6))),
        "overlaps": (da == db) & (m(0) == da.cast("string")) & t(2) & t(6),
        "within": t(0) & ~t(2) & ~t(5),
        "contains": t(0) & ~t(6) & ~t(7),
        "covered_by": contact & ~t(2) & ~t(5),
        "equals": t(0) & ~t(2) & ~t(5) & ~t(6) & ~t(7),
    }[relation]


def matrix_matches(pattern: str) -> Column:
    wanted = re_of(pattern)
    return F.col("matrix").rlike(wanted)


def re_of(pattern: str) -> str:
    return "^" + "".join({"*": ".", "T": "[012]", "F": "F"}.get(c, c) for c in pattern.upper()) + "$"


def conditioned(pairs: DataFrame, text: str | None, undirected: bool = False, default: bool = False) -> Column:
    """A pair condition (aliases G1, G2) over the fields of both sides."""
    if not text:
        return F.lit(default)
    a, b = pairs.select("a.*"), pairs.select("b.*")
    fields = lambda df, side, called: {f"{called}.{n}".lower(): Value(F.col(f"{side}.`{n}`"), kind_of(t)) for n, t in df.dtypes}
    straight = holds(text, fields(a, "a", "g1") | fields(b, "b", "g2"))
    return straight | holds(text, fields(b, "b", "g1") | fields(a, "a", "g2")) if undirected else straight


def self_pairs(tables: list[Table], keep: tuple[str, ...] = (), grow: float = 0.0) -> DataFrame:
    """Candidate pairs within a set of tables, each unordered pair once; oid is made unique over the tables by tab."""
    rows = reduce(DataFrame.unionByName, [shapes(t, keep, grow).withColumn("tab", F.lit(t.name)) for t in tables])
    if len(tables) == 1:
        return candidate_pairs(rows, rows, same=True)
    pairs = candidate_pairs(rows, rows)
    return pairs.where((F.col("a.tab") < F.col("b.tab")) | ((F.col("a.tab") == F.col("b.tab")) & (F.col("a.oid") < F.col("b.oid"))))


def other_pairs(one: list[Table], two: list[Table], keep: tuple[str, ...] = (), other_keep: tuple[str, ...] = (), grow: float = 0.0) -> DataFrame:
    both = [reduce(DataFrame.unionByName, [shapes(t, k, g).withColumn("tab", F.lit(t.name)) for t in tables]) for tables, k, g in ((one, keep, 0.0), (two, other_keep, grow))]
    return candidate_pairs(*both)
