"""Checks of multipatches (rings and triangles in space), of points against surfaces, and of edge matching."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.functions import planar
from plumbline.functions.expressions import Value, holds, kind_of
from plumbline.issues import Table, issues
from plumbline.operators import spatial as S
from plumbline.operators.attributes import equal_values_condition
from plumbline.operators.network import node_table
from plumbline.operators.relations import _fields
from plumbline.operators.single_geometry import _rows
from plumbline.session import materialize


def qa_mp_allowed_part_types(table: Table, types: str, allowed: Sequence[str]) -> DataFrame:
    """types: array<string>, the kind of each part (ring, triangle_fan, triangle_strip, triangles)."""
    rows = table.rows.select(F.col(table.oid).cast("bigint").alias("oid"), F.posexplode(types).alias("part", "type")).where(~F.col("type").isin(list(allowed)))
    return issues(rows, "MpAllowedPartTypes.PartTypeNotAllowed", [(table.name, "oid")], F.col("type"), values=[F.col("part")])


def qa_mp_constant_point_ids_per_ring(table: Table, include_inner: bool = False) -> DataFrame:
    """Rings with more than one point id; with include_inner, features whose rings are constant but differ."""
    rows = G.parts_of(_rows(table), "oid", "g").withColumn("ids", F.array_distinct(F.transform("points", lambda p: p["id"])))
    found = issues(rows.where(F.size("ids") > 1), "MpConstantPointIdsPerRing.DifferentIds", [(table.name, "oid")], values=[F.col("part")])
    if include_inner:
        whole = rows.groupBy("oid").agg(F.max(F.size("ids")).alias("most"), F.count_distinct(F.col("ids")[0]).alias("kinds")).where("most = 1 and kinds > 1")
        found = found.unionByName(issues(whole, "MpConstantPointIdsPerRing.DifferentIdsInnerRing", [(table.name, "oid")], values=[F.lit(None)]))
    return found


def normal(ring: Column) -> dict[str, Column]:
    """Newell's normal of a ring: its length is twice the area."""
    pairs = F.zip_with(F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), lambda a, b: F.struct(((a["y"] - b["y"]) * (a["z"] + b["z"])).alias("x"), ((a["z"] - b["z"]) * (a["x"] + b["x"])).alias("y"), ((a["x"] - b["x"]) * (a["y"] + b["y"])).alias("z")))
    return {k: F.aggregate(F.transform(pairs, lambda p: p[k]), F.lit(0.0), lambda acc, v: acc + v) for k in "xyz"}


def _faces(table: Table) -> DataFrame:
    rows = G.parts_of(_rows(table), "oid", "g")
    n = normal(F.col("points"))
    rows = rows.withColumns({f"n{k}": v for k, v in n.items()})
    return rows.withColumn("size", F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2))


def qa_mp_vertical_faces(table: Table, near: float, tolerance: float) -> DataFrame:
    """Faces that are nearly vertical (within near of it, radians) but not within tolerance."""
    rows = _faces(table).where("size > 0").withColumn("tilt", F.asin(F.least(F.abs(F.col("nz")) / F.col("size"), F.lit(1.0))))
    return issues(rows.where((F.col("tilt") <= near) & (F.col("tilt") > tolerance)), "MpVerticalFaces.FaceNotVertical", [(table.name, "oid")], values=[F.col("part")])


def qa_coplanar_rings(table: Table, tolerance: float) -> DataFrame:
    """Rings that define no plane, or have a vertex farther than tolerance from it."""
    rows = _faces(table)
    at = F.aggregate("points", F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")), lambda acc, p: F.struct((acc["x"] + p["x"]).alias("x"), (acc["y"] + p["y"]).alias("y"), (acc["z"] + p["z"]).alias("z")))
    rows = rows.withColumn("c", at).withColumn("n", F.size("points"))
    off = F.array_max(F.transform("points", lambda p: F.abs((p["x"] - F.col("c.x") / F.col("n")) * F.col("nx") + (p["y"] - F.col("c.y") / F.col("n")) * F.col("ny") + (p["z"] - F.col("c.z") / F.col("n")) * F.col("nz")) / F.col("size")))
    code = F.when((F.col("size") == 0) | (F.col("n") < 4), F.lit("CoplanarRings.FaceDoesNotDefineValidPlane")).when(off > tolerance, F.lit("CoplanarRings.FaceNotCoplanar"))
    return issues(rows.withColumn("_code", code).where("_code is not null"), F.col("_code"), [(table.name, "oid")], values=[F.col("part")])


def _near_values(rows: DataFrame, value: str, near: float, tolerance: float, keys: Sequence[str]) -> DataFrame:
    """Neighbours in order of value that are within near of each other but farther than tolerance."""
    w = Window.partitionBy(*keys).orderBy(value)
    return rows.select(*keys, value).distinct().withColumn("next", F.lead(value).over(w)).where((F.col("next") - F.col(value) <= near) & (F.col("next") - F.col(value) > tolerance))


def qa_mp_horizontal_heights(table: Table, near: float, tolerance: float) -> DataFrame:
    """Heights of horizontal segments of a feature that are nearly the same."""
    s = G.segments_of(_rows(table), "oid", "g").where("z0 = z1").withColumnRenamed("z0", "z")
    return issues(_near_values(s, "z", near, tolerance, ["oid"]), "MpHorizontalHeights.HeightsNearlyEqual", [(table.name, "oid")], values=[F.col("z"), F.col("next")])


def _azimuths(table: Table, horizontal: float) -> DataFrame:
    s = G.segments_of(_rows(table), "oid", "g").where(F.abs(F.col("z1") - F.col("z0")) <= horizontal)
    # to 1e-12, so that the two directions of a line are one azimuth; a half turn is none
    turn = F.round(F.pmod(F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")), F.lit(math.pi)), 12)
    return s.withColumn("az", F.when(turn >= round(math.pi, 12), 0.0).otherwise(turn))


def qa_mp_horizontal_azimuths(table: Table, near: float, tolerance: float, horizontal: float = 0.0, per_ring: bool = False) -> DataFrame:
    keys = ["oid", "part"] if per_ring else ["oid"]
    return issues(_near_values(_azimuths(table, horizontal), "az", near, tolerance, keys), "MpHorizontalAzimuths.AzimuthsNearlyEqual", [(table.name, "oid")], values=[F.round("az", 9), F.round("next", 9)])


def qa_mp_horizontal_perpendicular(table: Table, near: float, tolerance: float, horizontal: float = 0.0) -> DataFrame:
    """Azimuths of a feature that are nearly perpendicular: shifted by a right angle, they are nearly equal to another one."""
    rows = _azimuths(table, horizontal).select("oid", "az").distinct()
    a, b = rows.alias("a"), rows.alias("b")
    off = F.abs(F.abs(F.col("a.az") - F.col("b.az")) - math.pi / 2)
    pairs = a.join(b, (F.col("a.oid") == F.col("b.oid")) & (F.col("a.az") < F.col("b.az"))).where((off <= near) & (off > tolerance))
    return issues(pairs.select(F.col("a.oid").alias("oid"), F.col("a.az").alias("p"), F.col("b.az").alias("q")), "MpHorizontalPerpendicular.NearlyPerpendicular", [(table.name, "oid")], values=[F.round("p", 9), F.round("q", 9)])


def _rings(shape: planar.Shape) -> list[planar.Shape]:
    return [("polygon", [r if planar.ring_area(r) > 0 else r[::-1]]) for r in shape[1] if abs(planar.ring_area(r)) > 1e-12]


def _box_facts(rings: list[planar.Shape], most: int = 16) -> dict | None:
    """The facts of a few axis-parallel rectangles, counted on the cells between their sides; None for all other rings.

    Sides as near as the tolerance and cells that meet in a corner only are left to the exact shapes.
    """
    boxes = []
    for _, (r,) in rings:
        if len(r) != 5 or r[0] != r[4] or any((p[0] == q[0]) == (p[1] == q[1]) for p, q in zip(r, r[1:], strict=False)) or (r[0][0] == r[1][0]) == (r[1][0] == r[2][0]):
            return None
        boxes.append((min(r[0][0], r[2][0]), min(r[0][1], r[2][1]), max(r[0][0], r[2][0]), max(r[0][1], r[2][1])))
    if not 0 < len(boxes) <= most:
        return None
    xs, ys = sorted({b[k] for b in boxes for k in (0, 2)}), sorted({b[k] for b in boxes for k in (1, 3)})
    eps = 1e-9 * max(1.0, -xs[0], xs[-1], -ys[0], ys[-1])
    if any(q - p <= eps for axis in (xs, ys) for p, q in zip(axis, axis[1:], strict=False)):
        return None
    # a border of empty cells goes round all
    wide, high = len(xs) + 1, len(ys) + 1
    x, y = {v: i + 1 for i, v in enumerate(xs)}, {v: j + 1 for j, v in enumerate(ys)}
    count = [0] * (wide * high)
    for x0, y0, x1, y1 in boxes:
        for i in range(x[x0], x[x1]):
            for k in range(i * high + y[y0], i * high + y[y1]):
                count[k] += 1
    full = [c > 0 for c in count]
    for k in range(len(full) - high - 1):
        if full[k] == full[k + high + 1] != full[k + 1] == full[k + high] and (k + 1) % high:
            return None
    kinds, left = {True: 0, False: 0}, set(range(len(full)))
    while left:
        todo = [left.pop()]
        kinds[full[todo[0]]] += 1
        while todo:
            k = todo.pop()
            for n in (k - high, k + high, k - 1 if k % high else -1, k + 1 if (k + 1) % high else -1):
                if n in left and full[n] == full[k]:
                    left.remove(n)
                    todo.append(n)
    return {"outer": kinds[True], "holes": kinds[False] - 1, "crossing": max(count) > 1}


def _footprint_facts(table: Table) -> DataFrame:
    """(oid, outer, holes, crossing): parts and holes of the footprint, and whether footprints of rings overlap."""

    def facts(shape: planar.Shape) -> dict:
        rings = _rings(shape)
        if known := _box_facts(rings):
            return known
        total = planar.union(rings)[1]
        overlap = any(planar.relate(a, b)[0] == "2" for i, a in enumerate(rings) for b in rings[:i])
        return {"outer": sum(planar.ring_area(r) > 0 for r in total), "holes": sum(planar.ring_area(r) < 0 for r in total), "crossing": overlap}

    # a small file is one task, but its shapes are much work: they are dealt out evenly first
    spark = table.df.sparkSession
    rows = _rows(table).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    return rows.select("oid", S.of_shape(F.col("g"), "struct<outer:int,holes:int,crossing:boolean>", facts).alias("f")).select("oid", "f.*")


def qa_mp_footprint_holes(table: Table) -> DataFrame:
    return issues(_footprint_facts(table).where("holes > 0"), "MpFootprintHoles.InnerRing", [(table.name, "oid")], values=[F.col("holes")])


def qa_mp_single_part_footprint(table: Table) -> DataFrame:
    return issues(_footprint_facts(table).where("outer > 1"), "MpSinglePartFootprint.MultipleParts", [(table.name, "oid")], values=[F.col("outer")])


def qa_mp_non_intersecting_ring_footprints(table: Table) -> DataFrame:
    return issues(_footprint_facts(table).where("crossing"), "MpNonIntersectingRingFootprints.RingFootprintsIntersect", [(table.name, "oid")])


def qa_mp_vertex_not_near_face(table: Table, vertices: Table, above: float, below: float) -> DataFrame:
    """Vertices whose height over or under a face that covers them is within the minimum distances (and not 0)."""
    faces = _faces(table).where("abs(nz) > 1e-12").select(F.col("oid").alias("owner"), "part", "nx", "ny", "nz", F.col("points")[0].alias("o"), F.xxhash64("oid", "part").alias("fid"), F.struct(F.lit("polygon").alias("kind"), F.array("points").alias("parts")).alias("geom"))
    f = Table(faces, table.name, "fid", "geom")
    v = G.vertices_of(_rows(vertices), "oid", "g").select(F.xxhash64("oid", "part", "vertex").alias("vid"), F.col("oid").alias("owner"), "x", "y", "z", G.point("x", "y").alias("geom"))
    pairs = S.related(S.other_pairs([Table(v, vertices.name, "vid", "geom")], [f], ("owner", "x", "y", "z"), ("owner", "nx", "ny", "nz", "o")), "intersects")
    plane = F.col("b.o.z") - (F.col("b.nx") * (F.col("a.x") - F.col("b.o.x")) + F.col("b.ny") * (F.col("a.y") - F.col("b.o.y"))) / F.col("b.nz")
    rows = pairs.withColumn("dz", F.col("a.z") - plane).where((F.abs("dz") > 1e-9) & (F.col("dz") < above) & (F.col("dz") > -below))
    return issues(rows.select(F.col("a.owner").alias("o1"), F.col("b.owner").alias("o2"), "dz"), "MpVertexNotNearFace.VertexTooCloseToFace", [(vertices.name, "o1"), (table.name, "o2")], values=[F.round("dz", 9)])


# surfaces: rows (tx, ty, cell, z) with z an array of rows of heights, one row a tile of the raster


def sampled(points: DataFrame, tiles: DataFrame, size: int, cell: float) -> DataFrame:
    """points (x, y) with surface, the height of the raster cell they are in (null without a tile)."""
    at = lambda c: F.floor(F.col(c) / cell)
    rows = points.withColumns({"_ix": at("x"), "_iy": at("y")}).withColumns({"_tx": F.floor(F.col("_ix") / size), "_ty": F.floor(F.col("_iy") / size)})
    t = tiles.select(F.col("tx").alias("_tx"), F.col("ty").alias("_ty"), F.col("z").alias("_z"))
    out = rows.join(t, ["_tx", "_ty"], "left")
    return out.withColumn("surface", F.get(F.get("_z", F.pmod("_iy", F.lit(size)).cast("int")), F.pmod("_ix", F.lit(size)).cast("int"))).drop("_ix", "_iy", "_tx", "_ty", "_z")


def raster_tiles(cells: DataFrame, size: int) -> DataFrame:
    """(tx, ty, z) from rows (ix, iy, z): one row a tile of size by size cells."""
    placed = cells.select(F.floor(F.col("ix") / size).alias("tx"), F.floor(F.col("iy") / size).alias("ty"), (F.pmod("iy", F.lit(size)) * size + F.pmod("ix", F.lit(size))).cast("int").alias("k"), "z")
    tiles = placed.groupBy("tx", "ty").agg(F.map_from_entries(F.collect_list(F.struct("k", "z"))).alias("m"))
    z = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.try_element_at(F.col("m"), j * size + i)))
    return tiles.select("tx", "ty", z.alias("z"))


def _offset_code(dz: Column, limit: float, rule: str, prefix: str) -> Column:
    bad = {"above": dz < limit, "below": dz > -limit, "within": F.abs(dz) > limit, "outside": F.abs(dz) < limit}[rule]
    return F.when(dz.isNull(), F.lit(f"{prefix}.NoTerrainData")).when(bad, F.lit(f"{prefix}.ZOffset.{rule}"))


def qa_surface_vertex(table: Table, tiles: DataFrame, size: int, cell: float, limit: float, rule: str = "within") -> DataFrame:
    """Vertices whose height above the surface breaks the rule; above/below: at least limit over/under it, within/outside: at most/least."""
    v = sampled(G.vertices_of(_rows(table), "oid", "g"), tiles, size, cell).withColumn("dz", F.col("z") - F.col("surface"))
    rows = v.withColumn("_code", _offset_code(F.col("dz"), limit, rule, "SurfaceVertex")).where("_code is not null")
    return issues(rows, F.col("_code"), [(table.name, "oid")], values=[F.round("dz", 9)])


def qa_surface_pipe(table: Table, tiles: DataFrame, size: int, cell: float, limit: float, rule: str = "within", ignore_ends: float = 0.0) -> DataFrame:
    """Lines sampled every cell along their length; a feature is reported once if any sample beyond ignore_ends breaks the rule."""
    s = G.segments_of(_rows(table), "oid", "g").withColumn("len", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    w = Window.partitionBy("oid", "part").orderBy("segment")
    s = s.withColumn("done", F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("len")).withColumn("total", F.sum("len").over(Window.partitionBy("oid", "part")))
    steps = F.greatest(F.ceil(F.col("len") / cell), F.lit(1)).cast("int")
    s = s.withColumn("t", F.explode(F.transform(F.sequence(F.lit(0), steps), lambda k: k / steps)))
    mixed = lambda c: F.col(f"{c}0") + F.col("t") * (F.col(f"{c}1") - F.col(f"{c}0"))
    s = s.withColumns({"x": mixed("x"), "y": mixed("y"), "z": mixed("z"), "at": F.col("done") + F.col("t") * F.col("len")})
    s = s.where((F.col("at") >= ignore_ends) & (F.col("at") <= F.col("total") - ignore_ends))
    v = sampled(s, tiles, size, cell).withColumn("_code", _offset_code(F.col("z") - F.col("surface"), limit, rule, "SurfacePipe"))
    return issues(v.where("_code is not null").groupBy("oid").agg(F.min("_code").alias("code"), F.count("*").alias("n")), F.col("code"), [(table.name, "oid")], values=[F.col("n")])


def qa_surface_spikes(cells: DataFrame, cell: float, max_slope: float, max_dz: float) -> DataFrame:
    """Raster cells (ix, iy, z) that are higher or lower than all four neighbours by more than max_dz and a slope over max_slope."""
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    n = cells.withColumn("s", around).select((F.col("ix") + F.col("s.i")).alias("ix"), (F.col("iy") + F.col("s.j")).alias("iy"), F.col("z").alias("nz"))
    rows = cells.join(n, ["ix", "iy"]).groupBy("ix", "iy", "z").agg(F.min("nz").alias("low"), F.max("nz").alias("high"), F.count("*").alias("n")).where("n = 4")
    up, down = F.col("z") - F.col("high"), F.col("low") - F.col("z")
    dz = F.greatest(up, down)
    found = rows.where((dz > max_dz) & (F.atan(dz / cell) > max_slope))
    return issues(found, "SurfaceSpikes.Spike", F.array().cast("array<struct<tab:string,oid:bigint>>"), values=[F.col("ix"), F.col("iy")])


def tr_z_assign(table: Table, tiles: DataFrame, size: int, cell: float) -> DataFrame:
    """(oid, geom): vertices with the surface's heights, null where there is none."""
    v = sampled(G.vertices_of(_rows(table), "oid", "g"), tiles, size, cell)
    kind = _rows(table).select("oid", F.col("g.kind").alias("kind"))
    parts = v.groupBy("oid", "part").agg(F.array_sort(F.collect_list(F.struct("vertex", "x", "y", F.col("surface").cast("double").alias("z"), "m", "id"))).alias("p"))
    shapes = parts.groupBy("oid").agg(F.array_sort(F.collect_list(F.struct("part", "p"))).alias("ps"))
    geom = F.transform("ps", lambda q: F.transform(q["p"], lambda p: G.vertex(p["x"], p["y"], p["z"], p["m"], p["id"])))
    return shapes.join(kind, "oid").select("oid", F.struct("kind", geom.alias("parts")).alias("geom"))


# edge matching: features on either side of a border


def _at_border(tables: Sequence[Table], border: Table, distance: float = 1e-6) -> DataFrame:
    """Line ends and points (tab, oid, x, y and the fields) that lie on a border."""
    fields = _fields(tables)
    nodes = node_table(tables, 0.0, fields).withColumn("nid", F.xxhash64("tab", "oid", "is_start", "x", "y")).withColumn("geom", G.point("x", "y"))
    n = Table(nodes.drop("kind", "is_start", "ax", "ay", "m", "z"), "nodes", "nid", "geom")
    near = S.distances(S.other_pairs([n], [border], (), (), distance), "d").where(F.col("d") <= distance)
    return n.df.join(near.select(F.col("a.oid").alias("_n")).distinct(), F.col("nid") == F.col("_n"), "left_semi")


def edge_match(one: Sequence[Table], border1: Table, two: Sequence[Table], border2: Table, search: float, condition: str | None = None, constraint: str | None = None, coincidence: float = 0.0, prefix: str = "EdgeMatch") -> DataFrame:
    """Ends on border 1 against ends on border 2 within the search distance.

    No candidate that meets the condition (G1, G2): NoCandidate. A candidate farther than coincidence: CandidateNotCoincident. Coincident, but the attribute
    constraint is broken: AttributesNotFulfilled. The nearest candidate of an end counts, the smaller oid on a tie.
    """
    a, b = _at_border(one, border1), _at_border(two, border2)
    ta, tb = Table(a, "one", "nid", "geom"), Table(b, "two", "nid", "geom")
    keep = lambda t: tuple(c for c in t.df.columns if c not in ("nid", "geom"))
    rename = lambda t, n: Table(t.df.withColumnRenamed("tab", "own_tab").withColumnRenamed("oid", "own_oid"), n, "nid", "geom")
    ta, tb = rename(ta, "one"), rename(tb, "two")
    pairs = S.other_pairs([ta], [tb], keep(ta), keep(tb), search)
    d = F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))
    fields = {f"{g}.{c}".lower(): Value(F.col(f"{s}.{c}"), kind_of(t)) for g, s, table in (("g1", "a", ta), ("g2", "b", tb)) for c, t in table.df.dtypes}
    pairs = pairs.withColumn("d", d).where((F.col("d") <= search) & holds(condition, fields))
    met = holds(constraint, fields)
    best = pairs.groupBy(F.col("a.oid").alias("nid")).agg(F.min(F.struct("d", F.col("b.own_oid").alias("other"), (~met).alias("bad"))).alias("best"))
    rows = ta.df.join(best, "nid", "left")
    code = F.when(F.col("best").isNull(), F.lit(f"{prefix}.NoCandidate")).when(F.col("best.d") > coincidence, F.lit(f"{prefix}.CandidateNotCoincident")).when(F.col("best.bad"), F.lit(f"{prefix}.AttributesNotFulfilled"))
    rows = rows.withColumn("_code", code).where("_code is not null")
    both = F.array_compact(F.array(F.struct(F.col("own_tab").alias("tab"), F.col("own_oid").alias("oid")), F.when(F.col("best").isNotNull(), F.struct(F.lit(two[0].name).alias("tab"), F.col("best.other").alias("oid")))))
    return issues(rows, F.col("_code"), both, values=[F.round("best.d", 9)])


def _pair_names(one: str, a: DataFrame, two: str, b: DataFrame, sides: tuple[str, str] = ("a", "b")) -> dict[str, Value]:
    """The fields of two struct columns under the names that conditions call the sides by."""
    return {f"{called}.{c}".lower(): Value(F.col(f"{side}.`{c}`"), kind_of(t)) for called, df, side in ((one, a, sides[0]), (two, b, sides[1])) for c, t in df.dtypes}


def _touching(points: Sequence[Table], border: Table) -> DataFrame:
    """Pairs of a point (a) and a border feature (b) that it lies on."""
    pairs = S.other_pairs(list(points), [border], _fields(points), _fields([border]), 1e-9)
    return S.distances(pairs, "d").where("d <= 1e-9").select("a", "b")


def qa_edge_match_bordering_points(
    points1: Sequence[Table], border1: Table, points2: Sequence[Table], border2: Table, search_distance: float, *, point_class_1_border_match_condition: str | None = None, point_class_2_border_match_condition: str | None = None,
    bordering_point_match_condition: str | None = None, bordering_point_attribute_constraint: str | None = None, is_bordering_point_attribute_constraint_symmetric: bool = False, bordering_point_equal_attributes: str | None = None, bordering_point_equal_attribute_options: Sequence[str] = (),
    report_individual_attribute_constraint_violations: bool = False, coincidence_tolerance: float = 0.0, allow_disjoint_candidate_feature_if_borders_are_not_coincident: bool = False, allow_no_feature_within_search_distance: bool = False, allow_disjoint_candidate_feature_if_attribute_constraints_are_fulfilled: bool = False,
) -> DataFrame:
    """Points on the border of their side against the points on the other side's border within the search distance, from both sides.

    A point is matched if a candidate (a neighbour that fulfils the match condition, POINT1 and POINT2, and lies on its own border)
    is coincident and breaks neither the attribute constraint nor equal attributes. Else a coincident candidate (the one of the smallest oid) is
    reported with what it breaks, else every candidate, by whether the two lie on each other's border and what they break; without a
    candidate, the point alone. Border match conditions call the sides POINT and BORDER. A pair is reported once, from side 1 if both see it:
    a point of side 2 with a candidate that was reported together with it is left alone.
    """
    prefix, tolerance = "BorderingPoints.", max(coincidence_tolerance, 1e-9)
    sides = ((points1, border1, point_class_1_border_match_condition), (points2, border2, point_class_2_border_match_condition))
    keys = ["tab", "oid"]

    def on_border(points: Sequence[Table], border: Table, condition: str | None) -> DataFrame:
        pairs = _touching(points, border)
        return pairs.where(holds(condition, _pair_names("point", pairs.select("a.*"), "border", pairs.select("b.*")))).select("a.tab", "a.oid").distinct()

    own = [materialize(on_border(*side), "border_points") for side in sides]
    rows = [reduce(DataFrame.unionByName, [S.shapes(t, _fields(points)).withColumn("tab", F.lit(t.name)) for t in points]).join(known, keys, "left_semi") for (points, _, _), known in zip(sides, own, strict=True)]
    grown = reduce(DataFrame.unionByName, [S.shapes(t, _fields(points2), search_distance).withColumn("tab", F.lit(t.name)) for t in points2]).join(own[1], keys, "left_semi")
    pairs = S.distances(S.candidate_pairs(rows[0], grown)).where(F.col("distance") <= search_distance)
    # whether each of the two lies on the border of the other, as the other's border match condition has it
    together = F.lit(True)
    pairs = pairs.withColumn("_pair", F.xxhash64("a.tab", "a.oid", "b.tab", "b.oid"))
    for k, side, other in ((0, "a", 1), (1, "b", 0)):
        touch = _touching(sides[k][0], sides[other][1]).select(F.col("a.tab").alias("_tab"), F.col("a.oid").alias("_oid"), F.col("b").alias("c"))
        met = pairs.join(touch, (F.col(f"{side}.tab") == F.col("_tab")) & (F.col(f"{side}.oid") == F.col("_oid")))
        neighbour = "b" if side == "a" else "a"
        met = met.where(holds(sides[other][2], _pair_names("point", pairs.select(f"{neighbour}.*"), "border", touch.select("c.*"), (neighbour, "c"))))
        pairs = pairs.join(met.select(F.col("_pair").alias(f"_met{k}")).distinct(), F.col("_pair") == F.col(f"_met{k}"), "left")
        together = together & F.col(f"_met{k}").isNotNull()
    pairs = materialize(pairs.withColumn("together", together).select("a", "b", "distance", "together"), "candidates")
    fields = (pairs.select("a.*"), pairs.select("b.*"))

    def seen_from(side: int) -> DataFrame:
        """The candidates of one side's points: p, n, and what is broken."""
        x, y = ("a", "b") if side == 0 else ("b", "a")
        df = (fields[side], fields[1 - side])
        names = _pair_names("point1", df[0], "point2", df[1], (x, y))
        met = holds(bordering_point_attribute_constraint, names)
        if is_bordering_point_attribute_constraint_symmetric:
            met = met | holds(bordering_point_attribute_constraint, _pair_names("point1", df[1], "point2", df[0], (y, x)))
        broken = [F.when(~met, F.struct(F.lit(None).cast("string").alias("component"), F.lit(bordering_point_attribute_constraint).alias("text")))]
        unequal = []
        for part in re.split(r"(?<!\\)[,;]", bordering_point_equal_attributes or ""):
            name = part.partition(":")[0].strip().upper()
            if name:
                options = [o for o in bordering_point_equal_attribute_options if o.partition(":")[0].strip().upper() == name]
                same = equal_values_condition(part, x, y, options, df, sensitive=False)
                unequal.append(F.when(~same, F.struct(F.lit(name).alias("component"), F.concat(F.lit(f"{name} differs")).alias("text"))))
        if report_individual_attribute_constraint_violations or not unequal:
            broken += unequal
        else:
            all_of = F.array_compact(F.array(*unequal))
            joined = F.struct(F.array_join(F.transform(all_of, lambda u: u["component"]), ",").alias("component"), F.array_join(F.transform(all_of, lambda u: u["text"]), "; ").alias("text"))
            broken.append(F.when(F.size(all_of) > 0, joined))
        key = lambda c: F.struct(F.col(f"{c}.tab").alias("tab"), F.col(f"{c}.oid").alias("oid"))
        return pairs.where(holds(bordering_point_match_condition, names)).select(key(x).alias("p"), key(y).alias("n"), "distance", "together", F.array_compact(F.array(*broken)).alias("broken"))

    clean = (F.size("broken") == 0)
    reports, missing, told = [], [], None
    for side in (0, 1):
        seen = materialize(seen_from(side), "seen")
        near = F.col("distance") <= tolerance
        best = seen.groupBy("p").agg(F.max(near & clean).alias("matched"), F.min(F.when(near, F.col("n"))).alias("first"))
        left = seen.join(best, "p").where(~F.col("matched") & (F.col("first").isNull() | (F.col("first") == F.col("n"))))
        if told is not None:
            left = left.join(told.select(F.col("n").alias("p")).distinct(), "p", "left_anti")
        told = left.select("p", "n")
        found = F.concat(F.lit("NoMatch.CandidateExists."), F.when(F.col("together"), "").otherwise("BordersNotCoincident+"), F.when(clean, "ConstraintsFulfilled").otherwise("ConstraintsNotFulfilled"))
        allowed = F.lit(allow_disjoint_candidate_feature_if_borders_are_not_coincident) & ~F.col("together") | F.lit(allow_disjoint_candidate_feature_if_attribute_constraints_are_fulfilled) & clean
        left = left.where(near | ~allowed).withColumn("code", F.when(near, F.lit("Match.ConstraintsNotFulfilled")).otherwise(found))
        left = left.withColumn("v", F.explode_outer("broken"))
        reports.append(issues(left, F.concat(F.lit(prefix), "code"), F.array("p", "n"), F.col("v.component"), F.col("v.text"), values=[F.round("distance", 9)]))
        alone = own[side].join(seen.select("p.tab", "p.oid").distinct(), keys, "left_anti")
        missing.append(issues(alone, f"{prefix}NoMatch.NoCandidate", F.array(F.struct(*keys)), values=[F.lit(None)]))
    return reduce(DataFrame.unionByName, reports if allow_no_feature_within_search_distance else reports + missing)


def qa_edge_match_crossing_lines(*args, **kwargs) -> DataFrame:
    return edge_match(*args, prefix="EdgeMatchCrossingLines", **kwargs)


def _border_share(tables: Sequence[Table], border: Table, kind: str) -> DataFrame:
    """(tab, oid, length) of the stretch that each feature shares with a border."""
    pairs = S.related(S.other_pairs(list(tables), [border]), "intersects")

    def shared(a: planar.Shape, b: planar.Shape) -> float:
        return planar.length(planar.intersection(("line", a[1]) if a[0] == "polygon" else a, ("line", b[1]), 1))

    made = S.with_function(pairs, "len", "double", shared).where("len > 0")
    return made.groupBy(F.col("a.tab").alias("tab"), F.col("a.oid").alias("oid")).agg(F.sum("len").alias(kind))


def _stretches_match(one: Sequence[Table], border1: Table, two: Sequence[Table], border2: Table, prefix: str) -> DataFrame:
    """Features that run along border 1 without features of the other side along the whole of that stretch."""
    mine = _border_share(one, border1, "len")
    pairs = S.related(S.other_pairs(list(one), list(two)), "intersects")

    def shared(a: planar.Shape, b: planar.Shape) -> float:
        return planar.length(planar.intersection(("line", a[1]), ("line", b[1]), 1))

    met = S.with_function(pairs, "s", "double", shared).groupBy(F.col("a.tab").alias("tab"), F.col("a.oid").alias("oid")).agg(F.sum("s").alias("met"))
    rows = mine.join(met, ["tab", "oid"], "left").withColumn("met", F.coalesce("met", F.lit(0.0)))
    code = F.when(F.col("met") <= 0, F.lit(f"{prefix}.NoCandidate")).when(F.col("met") < F.col("len") - 1e-6, F.lit(f"{prefix}.PartlyMatched"))
    return issues(rows.withColumn("_code", code).where("_code is not null"), F.col("_code"), F.array(F.struct("tab", "oid")), values=[F.round("met", 6)])


def qa_edge_match_bordering_lines(one: Sequence[Table], border1: Table, two: Sequence[Table], border2: Table) -> DataFrame:
    return _stretches_match(one, border1, two, border2, "EdgeMatchBorderingLines")


def qa_edge_match_crossing_areas(one: Sequence[Table], border1: Table, two: Sequence[Table], border2: Table) -> DataFrame:
    return _stretches_match(one, border1, two, border2, "EdgeMatchCrossingAreas")


