"""Geometries as columns, and their measures as Catalyst expressions.

A geometry is struct<kind, parts>: kind is point, line, polygon or multipatch; parts is an array of point arrays, the points of
a multipoint, the paths of a line or the closed rings of a polygon. Points are struct<x, y, z, m, id>. Exterior rings run
clockwise, interior ones counter-clockwise. A null or empty parts array is an empty geometry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double,z:double,m:double,id:int>"
GEOMETRY = f"struct<kind:string,parts:array<array<{POINT}>>>"


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def vertex(x, y, z=None, m=None, id=None) -> Column:
    made = [("x", x, "double"), ("y", y, "double"), ("z", z, "double"), ("m", m, "double"), ("id", id, "int")]
    return F.struct(*[(F.lit(None) if v is None else _c(v)).cast(t).alias(n) for n, v, t in made])


def geometry(kind: str, parts: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), parts.cast(f"array<array<{POINT}>>").alias("parts"))


def point(x, y, z=None, m=None) -> Column:
    return geometry("point", F.array(F.array(vertex(x, y, z, m))))


def line(points: Column) -> Column:
    return geometry("line", F.array(points))


def polygon(rings: Column) -> Column:
    return geometry("polygon", rings)


def box(xmin, ymin, xmax, ymax) -> Column:
    a, b, c, d = map(_c, (xmin, ymin, xmax, ymax))
    return polygon(F.array(F.array(vertex(a, b), vertex(a, d), vertex(c, d), vertex(c, b), vertex(a, b))))


def segment(x0, y0, x1, y1) -> Column:
    return line(F.array(vertex(x0, y0), vertex(x1, y1)))


def points(geom: Column) -> Column:
    return F.flatten(geom["parts"])


def lowest(geom: Column, axis: str) -> Column:
    return F.array_min(F.transform(points(geom), lambda p: p[axis]))


def highest(geom: Column, axis: str) -> Column:
    return F.array_max(F.transform(points(geom), lambda p: p[axis]))


def envelope(geom: Column) -> dict[str, Column]:
    return {"xmin": lowest(geom, "x"), "ymin": lowest(geom, "y"), "xmax": highest(geom, "x"), "ymax": highest(geom, "y")}


def is_empty(geom: Column) -> Column:
    return geom.isNull() | F.coalesce(F.size(points(geom)) == 0, F.lit(True))


def _over_segments(part: Column, value) -> Column:
    """The sum of value(a, b) over consecutive points."""
    pairs = F.zip_with(F.slice(part, F.lit(1), F.greatest(F.size(part) - 1, F.lit(0))), F.slice(part, F.lit(2), F.greatest(F.size(part) - 1, F.lit(0))), value)
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def part_length(part: Column, is_3d: bool = False) -> Column:
    flat = lambda a, b: (b["x"] - a["x"]) ** 2 + (b["y"] - a["y"]) ** 2
    return _over_segments(part, lambda a, b: F.sqrt(flat(a, b) + (b["z"] - a["z"]) ** 2 if is_3d else flat(a, b)))


def ring_area(ring: Column) -> Column:
    """Positive for clockwise rings. Coordinates are taken from the first point, for precision."""
    o = ring[0]
    return _over_segments(ring, lambda a, b: ((b["x"] - o["x"]) * (a["y"] - o["y"]) - (a["x"] - o["x"]) * (b["y"] - o["y"])) / 2)


def length(geom: Column, is_3d: bool = False) -> Column:
    return F.aggregate(F.transform(geom["parts"], lambda p: part_length(p, is_3d)), F.lit(0.0), lambda acc, x: acc + x)


def area(geom: Column) -> Column:
    return F.aggregate(F.transform(geom["parts"], ring_area), F.lit(0.0), lambda acc, x: acc + x)


def exterior_rings(geom: Column) -> Column:
    return F.filter(geom["parts"], lambda r: ring_area(r) >= 0)


def interior_rings(geom: Column) -> Column:
    return F.filter(geom["parts"], lambda r: ring_area(r) < 0)


def is_closed(part: Column) -> Column:
    a, b = part[0], F.element_at(part, -1)
    return (F.size(part) > 1) & (a["x"] == b["x"]) & (a["y"] == b["y"])


COMPONENTS = ("entire", "boundary", "vertices", "line_end_points", "line_start_point", "line_end_point", "centroid", "label_point", "interior_vertices")


def component(geom: Column, name: str) -> Column:
    """A component of a geometry, one of COMPONENTS: its boundary, (inner) vertices, path ends, or a point for the whole."""
    parts, single = geom["parts"], lambda p: F.array(p)
    ends = F.flatten(F.transform(parts, lambda p: F.array(p[0], F.element_at(p, -1))))
    several = lambda points: geometry("point", F.transform(points, single))
    if name == "entire":
        return geom
    if name == "boundary":
        edge = F.struct(F.lit("line").alias("kind"), parts.alias("parts"))
        return F.when(geom["kind"] == "line", several(ends)).when(geom["kind"] == "point", geom).otherwise(edge)
    if name == "vertices":
        return several(points(geom))
    if name == "interior_vertices":
        return several(F.flatten(F.transform(parts, lambda p: F.slice(p, F.lit(2), F.greatest(F.size(p) - 2, F.lit(0))))))
    if name in ("line_end_points", "line_start_point", "line_end_point"):
        return several(ends if name == "line_end_points" else F.transform(parts, lambda p: p[0] if name == "line_start_point" else F.element_at(p, -1)))
    if name == "label_point":  # a place on the geometry: its first point
        return several(F.slice(points(geom), F.lit(1), F.lit(1)))
    if name == "centroid":
        mean = lambda axis: F.aggregate(F.transform(points(geom), lambda p: p[axis]), F.lit(0.0), lambda acc, v: acc + v) / F.size(points(geom))
        moment = lambda axis: F.aggregate(F.transform(parts, lambda r: _over_segments(r, lambda a, b: ((b["x"]) * (a["y"]) - (a["x"]) * (b["y"])) * (a[axis] + b[axis]) / 6)), F.lit(0.0), lambda acc, v: acc + v)
        inside = point(F.try_divide(moment("x"), area(geom)), F.try_divide(moment("y"), area(geom)))
        return F.when((geom["kind"] == "polygon") & (area(geom) != 0), inside).otherwise(point(mean("x"), mean("y")))
    raise ValueError(f"unknown component {name!r}")


def parts_of(df: DataFrame, oid: str, geom: str, *keep: str) -> DataFrame:
    """(oid, part, points): one row a part."""
    return df.select(F.col(oid).alias("oid"), *keep, F.posexplode(F.col(geom)["parts"]).alias("part", "points"))


def vertices_of(df: DataFrame, oid: str, geom: str, *keep: str) -> DataFrame:
    """(oid, part, vertex, x, y, z, m, id, n): one row a vertex; n is the part's number of vertices."""
    parts = parts_of(df, oid, geom, *keep)
    rows = parts.select("oid", *keep, "part", F.size("points").alias("n"), F.posexplode("points").alias("vertex", "p"))
    return rows.select("oid", *keep, "part", "vertex", "n", "p.*")


def segments_of(df: DataFrame, oid: str, geom: str, *keep: str) -> DataFrame:
    """(oid, part, segment, n, x0, y0, z0, m0, x1, ...): one row a segment, made inside the row: no shuffle."""
    parts = parts_of(df, oid, geom, *keep)
    tail = F.greatest(F.size("points") - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice("points", F.lit(1), tail).alias("a"), F.slice("points", F.lit(2), tail).alias("b"))
    rows = parts.select("oid", *keep, "part", tail.alias("n"), F.posexplode(pairs).alias("segment", "s"))
    ends = [F.col(f"s.{e}.{axis}").alias(f"{axis}{k}") for k, e in enumerate("ab") for axis in "xyzm"]
    return rows.select("oid", *keep, "part", "segment", "n", *ends)


def _number_of(values: Column, wanted: str) -> Column:
    return F.size(F.filter(values, lambda v: v == wanted))


def properties(geom: Column, segment_types: Column | None = None, part_types: Column | None = None) -> dict[str, tuple[Column, str]]:
    """The $ properties of a geometry column that expressions can name, each with its kind.

    segment_types (array<array<string>>: line, circular_arc, elliptic_arc or bezier, as parts are) and part_types (array<string>: ring,
    triangle_fan, triangle_strip or triangles) say what a geometry does not hold itself; without them, segments are lines and the parts
    of a multipatch rings.
    """
    parts = geom["parts"]
    rings = F.size(exterior_rings(geom))
    surface = F.when(geom["kind"].isin("point", "line"), F.lit(0.0)).otherwise(area(geom))
    out = {"$ShapeArea": surface, "$ShapeLength": length(geom), "$ShapeVertexCount": F.size(points(geom)), "$ShapePartCount": F.size(parts), "$ShapeExteriorRingCount": rings, "$ShapeInteriorRingCount": F.size(interior_rings(geom))}
    for axis in "XYZM":
        out[f"$Shape{axis}Min"], out[f"$Shape{axis}Max"] = lowest(geom, axis.lower()), highest(geom, axis.lower())
    out |= {"$Area": surface, "$Length": length(geom), "$VertexCount": F.size(points(geom)), "$PartCount": F.size(parts), "$ExteriorRingCount": rings, "$InteriorRingCount": F.size(interior_rings(geom))}
    for axis in "XYZM":
        out[f"${axis}Min"], out[f"${axis}Max"] = lowest(geom, axis.lower()), highest(geom, axis.lower())
    out["$SliverRatio"] = F.try_divide(length(geom) ** 2, F.abs(area(geom)))
    out["$IsClosed"] = F.forall(parts, is_closed)
    out["$SegmentCount"] = F.aggregate(F.transform(parts, lambda p: F.greatest(F.size(p) - 1, F.lit(0))), F.lit(0), lambda acc, x: acc + x)
    out["$IsMultipart"] = F.size(parts) > 1
    out["$IsExteriorRing"] = F.forall(parts, lambda p: ring_area(p) >= 0)
    out["$IsInteriorRing"] = F.forall(parts, lambda p: ring_area(p) < 0)
    out["$UndefinedMValueCount"] = F.size(F.filter(points(geom), lambda p: p["m"].isNull() | F.isnan(p["m"])))
    zero = F.lit(0)
    segments = out["$SegmentCount"]
    kinds = F.flatten(segment_types) if segment_types is not None else None
    for name, wanted in (("$EllipticArcCount", "elliptic_arc"), ("$CircularArcCount", "circular_arc"), ("$BezierCount", "bezier")):
        out[name] = zero if kinds is None else _number_of(kinds, wanted)
    out["$NonLinearSegmentCount"] = zero if kinds is None else F.size(F.filter(kinds, lambda t: t != "line"))
    out["$LinearSegmentCount"] = segments - out["$NonLinearSegmentCount"]
    out["$Dimension"] = F.when(geom["kind"] == "point", 0.0).when(geom["kind"] == "line", 1.0).when(geom["kind"] == "polygon", 2.0).when(geom["kind"] == "multipatch", 2.5)
    # a vertex without an id has id 0; shapes that know no ids have none to count
    aware = F.exists(points(geom), lambda p: p["id"].isNotNull())
    ids = F.transform(points(geom), lambda p: F.coalesce(p["id"], zero))
    out["$IsPointIdAware"] = F.coalesce(aware, F.lit(False))
    for name, value in (("$PointIdMin", F.array_min(ids)), ("$PointIdMax", F.array_max(ids)), ("$PointIdCount", F.size(F.filter(ids, lambda i: i != 0)))):
        out[name] = F.when(aware, F.coalesce(value, zero)).otherwise(zero)
    out["$ControlPointCount"] = out["$PointIdCount"]
    patches = part_types if part_types is not None else F.transform(parts, lambda p: F.lit("ring"))
    for name, wanted in (("$RingCount", "ring"), ("$TriangleFanCount", "triangle_fan"), ("$TriangleStripCount", "triangle_strip"), ("$TrianglesPatchCount", "triangles")):
        out[name] = F.when(geom["kind"] == "multipatch", _number_of(patches, wanted)).otherwise(zero)
    boolean = {"$IsClosed", "$IsMultipart", "$IsExteriorRing", "$IsInteriorRing", "$IsPointIdAware"}
    return {k: (v, "boolean" if k in boolean else "number") for k, v in out.items()}
