"""Checks of nearness and coincidence of points, vertices and line parts."""

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.functions import planar
from plumbline.functions.expressions import compile_expression, names_of
from plumbline.issues import Table, issues
from plumbline.operators import spatial as S
from plumbline.operators.relations import _all, _both, _fields, _missing, near_pairs
from plumbline.session import share_code

Tables = Sequence[Table]


def with_distance(table: Table, expression: str | float) -> Table:
    """A table with a field near, the distance an expression gives for each row."""
    column = F.lit(float(expression)) if isinstance(expression, int | float) else compile_expression(expression, names_of(table.df)).cast("double")
    return Table(table.df.withColumn("near", column), table.name, table.oid, table.geom, table.where)


def qa_point_not_near(points: Table, references: Tables, limit: float, point_distance: str | None = None, reference_distance: str | None = None, allow_coincident: bool = False, valid: str | None = None) -> DataFrame:
    """Points nearer to a reference than the limit, or than the sum of the two rows' distances where expressions give them."""
    if point_distance or reference_distance:
        points = with_distance(points, point_distance or 0.0)
        references = [with_distance(r, reference_distance or 0.0) for r in references]
    pairs = near_pairs([points], references, limit)
    same = (F.col("a.tab") == F.col("b.tab")) & (F.col("a.oid") == F.col("b.oid"))
    reach = F.col("a.near") + F.col("b.near") if point_distance or reference_distance else F.lit(limit)
    bad = ~same & (F.col("distance") < reach) & ~S.conditioned(pairs, valid)
    if allow_coincident:
        bad = bad & (F.col("distance") > 0)
    return issues(pairs.where(bad), "PointNotNear.PointTooClose", _both(), values=[F.round("distance", 9)])


def qa_point_on_line(points: Table, lines: Tables, near: float) -> DataFrame:
    """Points that are farther than near from the lines and polygon borders of all tables."""
    borders = [Table(t.rows.withColumn(t.geom, F.struct(F.lit("line").alias("kind"), F.col(f"{t.geom}.parts").alias("parts"))), t.name, t.oid, t.geom) for t in lines]
    return _missing([points], near_pairs([points], borders, near).select("a.tab", "a.oid"), "PointOnLine.PointNotOnLine")


def qa_measures_at_points(points: Table, lines: Tables, expected: str, search: float, tolerance: float, require_line: bool = False, ignore_undefined: bool = False, condition: str | None = None) -> DataFrame:
    """Points at which the nearest line within search (of equally near ones the one with the smaller measure) has another measure than the
    expression gives. Measures are interpolated along segments, in the plan."""
    own = Table(points.df.withColumn("expected", compile_expression(expected, names_of(points.df)).cast("double")), points.name, points.oid, points.geom, points.where)
    pairs = S.other_pairs([own], list(lines), _fields([own]), _fields(lines), search)
    pairs = pairs.where(S.conditioned(pairs, condition, default=True))
    x, y = F.col("a.geom.parts")[0][0]["x"], F.col("a.geom.parts")[0][0]["y"]

    def nearest(u, v):
        dx, dy = v["x"] - u["x"], v["y"] - u["y"]
        t = F.coalesce(F.least(F.greatest(F.try_divide((x - u["x"]) * dx + (y - u["y"]) * dy, dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
        return F.struct(F.hypot(u["x"] + t * dx - x, u["y"] + t * dy - y).alias("d"), (u["m"] + t * (v["m"] - u["m"])).alias("m"))

    tail = lambda p: F.greatest(F.size(p) - 1, F.lit(0))
    found = F.flatten(F.transform(F.col("b.geom.parts"), lambda p: F.zip_with(F.slice(p, F.lit(1), tail(p)), F.slice(p, F.lit(2), tail(p)), nearest)))
    near = pairs.select(F.col("a.oid").alias("oid"), F.array_min(found).alias("at")).where(F.col("at.d") <= search)
    best = near.groupBy("oid").agg(F.min("at").alias("at"))
    rows = own.rows.where(~G.is_empty(F.col(own.geom))).select(F.col(own.oid).cast("bigint").alias("oid"), "expected").join(best, "oid", "left")
    code = (
        F.when(F.col("at").isNull(), F.lit("MeasuresAtPoints.NoLineWithinDistance") if require_line else F.lit(None).cast("string"))
        .when(F.col("expected").isNull(), F.lit(None).cast("string") if ignore_undefined else F.lit("MeasuresAtPoints.UndefinedExpectedMValue"))
        .when(F.col("at.m").isNull(), F.lit("MeasuresAtPoints.UndefinedMValue"))
        .when(F.abs(F.col("at.m") - F.col("expected")) > tolerance, F.lit("MeasuresAtPoints.UnexpectedMValue"))
    )
    return issues(rows.withColumn("_code", code).where("_code is not null"), F.col("_code"), [(points.name, "oid")], values=[F.col("at.m")])


def _vertices(table: Table, ends_only: bool = False) -> DataFrame:
    rows = table.rows.select(F.col(table.oid).cast("bigint").alias("oid"), F.col(table.geom).alias("g"))
    v = G.vertices_of(rows, "oid", "g")
    return v.where("vertex = 0 or vertex = n - 1") if ends_only else v


def as_points(table: Table, ends_only: bool = False) -> Table:
    """The vertices (or path ends) of a table as points; pid numbers them, owner is the feature's oid."""
    v = _vertices(table, ends_only)
    made = v.select(F.xxhash64("oid", "part", "vertex").alias("pid"), F.col("oid").alias("owner"), "vertex", G.point("x", "y", "z").alias("geom"))
    return Table(made, table.name, "pid", "geom")


def qa_node_line_coincidence(nodes: Table, lines: Tables, near: float, coincidence: float = 0.0) -> DataFrame:
    """Nodes (points or line ends) nearer than near to a line of another feature without lying on it."""
    own = as_points(nodes, ends_only=True)
    own = Table(own.df, nodes.name, "pid", "geom")
    pairs = near_pairs([own], lines, near)
    other = ~((F.col("a.tab") == F.col("b.tab")) & (F.col("a.owner") == F.col("b.oid")))
    least = pairs.where(other).groupBy("a.tab", "a.oid", "a.owner").agg(F.min("distance").alias("d"))
    return issues(least.where(F.col("d") > coincidence), "NodeLineCoincidence.NodeTooCloseToLine", F.array(F.struct("tab", F.col("owner").alias("oid"))), values=[F.round("d", 9)])


def qa_vertex_coincidence_other(tables: Tables, others: Tables, tolerance: float, coincidence: float = 0.0, z_tolerance: float | None = None) -> DataFrame:
    """Vertices with a vertex of another table within tolerance, but none within coincidence; heights may be compared as well."""
    found = None
    for t in tables:
        pairs = near_pairs([as_points(t)], [as_points(o) for o in others], tolerance)
        dz = F.abs(F.element_at(G.points(F.col("a.geom")), 1)["z"] - F.element_at(G.points(F.col("b.geom")), 1)["z"])
        apart = (F.col("distance") > coincidence) | (F.lit(False) if z_tolerance is None else F.coalesce(dz > z_tolerance, F.lit(False)))
        per = pairs.groupBy("a.tab", "a.oid", "a.owner").agg(F.bool_and(apart).alias("all_apart"), F.min("distance").alias("d")).where("all_apart")
        made = issues(per, "VertexCoincidence.NearbyVertexNotCoincident", F.array(F.struct("tab", F.col("owner").alias("oid"))), values=[F.round("d", 9)])
        found = made if found is None else found.unionByName(made)
    return found


def qa_vertex_coincidence_self(table: Table, tolerance: float, coincidence: float = 0.0, within_feature: bool = False) -> DataFrame:
    """Pairs of vertices nearer than tolerance that do not coincide, of different features or (within_feature) of one."""
    pts = as_points(table)
    pairs = S.candidate_pairs(S.shapes(pts, ("owner", "vertex")).withColumn("tab", F.lit(table.name)), S.shapes(pts, ("owner", "vertex"), tolerance).withColumn("tab", F.lit(table.name)), same=True)
    d = F.hypot(F.col("a.geom.parts")[0][0]["x"] - F.col("b.geom.parts")[0][0]["x"], F.col("a.geom.parts")[0][0]["y"] - F.col("b.geom.parts")[0][0]["y"])
    owners = (F.col("a.owner") == F.col("b.owner")) if within_feature else (F.col("a.owner") != F.col("b.owner"))
    pairs = pairs.withColumn("d", d).where(owners & (F.col("d") <= tolerance) & (F.col("d") > coincidence))
    low, high = F.least("a.owner", "b.owner"), F.greatest("a.owner", "b.owner")
    return issues(pairs.select(low.alias("o1"), high.alias("o2"), "d"), "VertexCoincidence.NearbyVertexNotCoincident", [(table.name, "o1"), (table.name, "o2")], values=[F.round("d", 9)])


def qa_vertex_coincidence(table: Table, tolerance: float, coincidence: float = 0.0) -> DataFrame:
    return qa_vertex_coincidence_self(table, tolerance, coincidence, within_feature=True)


def near_stretch(p: planar.Point, q: planar.Point, r: planar.Point, s: planar.Point, near: float) -> tuple[float, float] | None:
    """The stretch of segment pq, in shares of its length, within near of segment rs.

    What is near rs is two discs and a band between them, together convex: the line through pq enters and leaves each of them at most once.
    """
    dx, dy = q[0] - p[0], q[1] - p[1]
    square = dx * dx + dy * dy
    found: list[tuple[float, float]] = []
    for cx, cy in (r, s):
        ex, ey = p[0] - cx, p[1] - cy
        half = dx * ex + dy * ey
        root = half * half - square * (ex * ex + ey * ey - near * near)
        if root >= 0:
            root = math.sqrt(root)
            found.append(((-half - root) / square, (-half + root) / square))
    size = math.dist(r, s)
    if size:
        ux, uy = (s[0] - r[0]) / size, (s[1] - r[1]) / size
        ex, ey = p[0] - r[0], p[1] - r[1]
        low, high = -math.inf, math.inf
        for base, slope, least, most in ((ex * ux + ey * uy, dx * ux + dy * uy, 0.0, size), (ux * ey - uy * ex, ux * dy - uy * dx, -near, near)):
            if abs(slope) < 1e-12:
                if base < least - 1e-9 or base > most + 1e-9:
                    low = math.inf
            else:
                ends = sorted(((least - base) / slope, (most - base) / slope))
                low, high = max(low, ends[0]), min(high, ends[1])
        if low <= high:
            found.append((low, high))
    low, high = max(0.0, min((f[0] for f in found), default=2.0)), min(1.0, max((f[1] for f in found), default=-1.0))
    return (low, high) if low <= high else None


def near_stretches(a: planar.Shape, b: planar.Shape, near: float) -> list[dict]:
    """Stretches of a's parts within near of b, by length along the part."""
    out = []
    for k, part in enumerate(a[1]):
        done = 0.0
        for p, q in zip(part, part[1:], strict=False):
            size = math.dist(p, q)
            if size:
                for r, s in planar.segments(b) or [(x, x) for c in b[1] for x in c]:
                    if max(p[0], q[0]) + near < min(r[0], s[0]) or max(r[0], s[0]) + near < min(p[0], q[0]) or max(p[1], q[1]) + near < min(r[1], s[1]) or max(r[1], s[1]) + near < min(p[1], q[1]):
                        continue
                    found = near_stretch(p, q, r, s, near)
                    if found:
                        out.append({"part": k, "low": done + found[0] * size, "high": done + found[1] * size})
            done += size
    return out


_STRETCH = "array<struct<part:int,low:double,high:double>>"


def merged(stretches: DataFrame, keys: Sequence[str], gap: float = 1e-9) -> DataFrame:
    """Unions of intervals low..high by keys."""
    w = Window.partitionBy(*keys).orderBy("low", "high")
    before = F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = stretches.withColumn("_new", F.when(before.isNull() | (F.col("low") > before + gap), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_run").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("_run")


def _stretches(pairs: DataFrame, near: float, condition: str | None) -> DataFrame:
    pairs = pairs.where(~S.conditioned(pairs, condition))
    made = S.with_function(pairs, "found", _STRETCH, lambda a, b: near_stretches(a, b, near))
    return made.select("a.tab", "a.oid", F.struct("b.tab", "b.oid").alias("other"), F.explode("found").alias("f")).select("tab", "oid", "other", "f.*")


def qa_not_near(table: Table, reference: Table, near: float, min_length: float, ignore: str | None = None) -> DataFrame:
    """Parts of lines within near of one reference feature over more than min_length."""
    pairs = S.other_pairs([table], [reference], _fields([table]), _fields([reference]), near)
    runs = merged(_stretches(pairs, near, ignore), ["tab", "oid", "other", "part"])
    return issues(runs.where(F.col("high") - F.col("low") > min_length), "NotNear.PartTooClose", F.array(F.struct("tab", "oid"), F.struct("other.tab", "other.oid")), values=[F.round("low", 6), F.round("high", 6)])


def qa_part_coincidence_other(table: Table, reference: Table, near: float, min_length: float, ignore: str | None = None) -> DataFrame:
    """Nearly coincident parts: within near over more than min_length, but not exactly coincident along it."""
    pairs = S.other_pairs([table], [reference], _fields([table]), _fields([reference]), near)
    return _part_coincidence(pairs, near, min_length, ignore)


def qa_part_coincidence_self(table: Table, near: float, min_length: float, ignore: str | None = None) -> DataFrame:
    rows = [S.shapes(table, _fields([table]), g).withColumn("tab", F.lit(table.name)) for g in (0.0, near)]
    return _part_coincidence(S.candidate_pairs(*rows, same=True), near, min_length, ignore)


def _part_coincidence(pairs: DataFrame, near: float, min_length: float, ignore: str | None) -> DataFrame:
    keys = ["tab", "oid", "other", "part"]
    runs = merged(_stretches(pairs, near, ignore), keys).where(F.col("high") - F.col("low") > min_length)
    exact = merged(_stretches(pairs, 1e-9, ignore), keys).select(*keys, F.col("low").alias("elow"), F.col("high").alias("ehigh"))
    same = (F.col("elow") <= F.col("low") + 1e-6) & (F.col("ehigh") >= F.col("high") - 1e-6)
    found = runs.join(exact, keys, "left").groupBy(*keys, "low", "high").agg(F.max(F.coalesce(same, F.lit(False))).alias("same")).where("not same")
    return issues(found, "PartCoincidence.PartNotCoincident", F.array(F.struct("tab", "oid"), F.struct("other.tab", "other.oid")), values=[F.round("low", 6), F.round("high", 6)])


def qa_full_coincidence(table: Table, references: Tables, near: float) -> DataFrame:
    """Features with a part that is not within near of any reference, and by how much."""
    pairs = S.other_pairs([table], list(references), (), (), near)
    covered = merged(_stretches(pairs, near, None), ["tab", "oid", "part"]).groupBy("tab", "oid").agg(F.sum(F.col("high") - F.col("low")).alias("c"))
    lengths = table.rows.where(~G.is_empty(F.col(table.geom))).select(F.col(table.oid).cast("bigint").alias("oid"), G.length(F.col(table.geom)).alias("len"))
    left = _all([table]).join(lengths, "oid").join(covered, ["tab", "oid"], "left").withColumn("rest", F.col("len") - F.coalesce("c", F.lit(0.0)))
    return issues(left.where("rest > 1e-6"), "FullCoincidence.PartNotNearReference", F.array(F.struct("tab", "oid")), values=[F.round("rest", 6)])


def qa_topo_not_near(table: Table, reference: Table, near: str | float, connected_factor: float, unconnected_factor: float, limit: float) -> DataFrame:
    """Parts nearer to a reference than each row's own distance, over more than a factor of that distance: one factor for lines that
    share an end point, one for others. limit bounds the distances."""
    own = with_distance(table, near)
    pairs = S.other_pairs([own], [reference], ("near",), (), limit)
    pairs = pairs.where(~((F.col("a.tab") == F.col("b.tab")) & (F.col("a.oid") == F.col("b.oid"))))
    ends = lambda side: F.flatten(F.transform(F.col(f"{side}.geom.parts"), lambda p: F.array(F.struct(p[0]["x"].alias("x"), p[0]["y"].alias("y")), F.struct(F.element_at(p, -1)["x"].alias("x"), F.element_at(p, -1)["y"].alias("y")))))
    made = pairs.withColumn("linked", F.arrays_overlap(ends("a"), ends("b")))
    made = _own_stretches(made)
    runs = merged(made.select("tab", "oid", "other", "near", "linked", "part", "low", "high"), ["tab", "oid", "other", "near", "linked", "part"])
    least = F.col("near") * F.when(F.col("linked"), connected_factor).otherwise(unconnected_factor)
    return issues(runs.where(F.col("high") - F.col("low") > least), "TopoNotNear.PartTooClose", F.array(F.struct("tab", "oid"), F.struct("other.tab", "other.oid")), values=[F.round("low", 6), F.round("high", 6)])


def _own_stretches(pairs: DataFrame) -> DataFrame:
    share_code(pairs.sparkSession)

    @F.pandas_udf(_STRETCH)
    def run(a: pd.DataFrame, b: pd.DataFrame, near: pd.Series) -> pd.Series:
        return pd.Series([near_stretches(S.unpacked(x), S.unpacked(y), n) for x, y, n in zip(a.to_dict("records"), b.to_dict("records"), near, strict=True)], dtype="object")

    made = pairs.withColumn("found", run(S.packed(F.col("a.geom")), S.packed(F.col("b.geom")), F.col("a.near")))
    return made.select("a.tab", "a.oid", F.struct("b.tab", "b.oid").alias("other"), F.col("a.near").alias("near"), "linked", F.explode("found").alias("f")).select("tab", "oid", "other", "near", "linked", "f.*")

