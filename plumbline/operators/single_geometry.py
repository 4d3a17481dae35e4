"""Checks of one geometry at a time: sizes, rings, segments, slopes, heights and measures.

All of them are Catalyst expressions over the geometry struct; sequences of segments are windows within a part, so that only
one feature's rows have to meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.functions import planar
from plumbline.functions.expressions import Value, holds, names_of
from plumbline.issues import Table, issues
from plumbline.operators import spatial as S


def _rows(table: Table, *keep: str) -> DataFrame:
    return table.rows.select(F.col(table.oid).cast("bigint").alias("oid"), F.col(table.geom).alias("g"), *keep).where(~G.is_empty(F.col("g")))


def _limit(table: Table, per_part: bool, whole: Column, part: Column, broken, code: str) -> DataFrame:
    rows = _rows(table)
    if per_part:
        rows = rows.select("oid", F.explode("g.parts").alias("p")).withColumn("v", part)
    else:
        rows = rows.withColumn("v", whole)
    return issues(rows.where(broken(F.col("v"))), code, [(table.name, "oid")], values=[F.col("v")])


def qa_min_length(table: Table, limit: float, is_3d: bool = False, per_part: bool = False) -> DataFrame:
    return _limit(table, per_part, G.length(F.col("g"), is_3d), G.part_length(F.col("p"), is_3d), lambda v: v < limit, "MinLength.LengthTooSmall")


def qa_max_length(table: Table, limit: float, is_3d: bool = False, per_part: bool = False) -> DataFrame:
    return _limit(table, per_part, G.length(F.col("g"), is_3d), G.part_length(F.col("p"), is_3d), lambda v: v > limit, "MaxLength.LengthTooLarge")


def qa_min_area(table: Table, limit: float, per_part: bool = False) -> DataFrame:
    return _limit(table, per_part, F.abs(G.area(F.col("g"))), F.abs(G.ring_area(F.col("p"))), lambda v: v < limit, "MinArea.AreaTooSmall")


def qa_max_area(table: Table, limit: float, per_part: bool = False) -> DataFrame:
    return _limit(table, per_part, F.abs(G.area(F.col("g"))), F.abs(G.ring_area(F.col("p"))), lambda v: v > limit, "MaxArea.AreaTooLarge")


def _extent(geom: Column) -> Column:
    return F.greatest(G.highest(geom, "x") - G.lowest(geom, "x"), G.highest(geom, "y") - G.lowest(geom, "y"))


def _part(p: Column) -> Column:
    return F.struct(F.lit("part").alias("kind"), F.array(p).alias("parts"))


def qa_extent(table: Table, limit: float, per_part: bool = False) -> DataFrame:
    return _limit(table, per_part, _extent(F.col("g")), _extent(_part(F.col("p"))), lambda v: v > limit, "Extent.ExtentTooLarge")


def qa_min_extent(table: Table, limit: float, per_part: bool = False) -> DataFrame:
    return _limit(table, per_part, _extent(F.col("g")), _extent(_part(F.col("p"))), lambda v: v < limit, "MinExtent.ExtentTooSmall")


def qa_max_vertex_count(table: Table, limit: int, per_part: bool = False) -> DataFrame:
    return _limit(table, per_part, F.size(G.points(F.col("g"))), F.size("p"), lambda v: v > limit, "MaxVertexCount.TooManyVertices")


def qa_multipart(table: Table, single_ring: bool = False) -> DataFrame:
    g = F.col("g")
    n = F.size(g["parts"]) if single_ring else F.when(g["kind"] == "polygon", F.size(G.exterior_rings(g))).otherwise(F.size(g["parts"]))
    return issues(_rows(table).withColumn("n", n).where("n > 1"), "Multipart.MultipleParts", [(table.name, "oid")], values=[F.col("n")])


def qa_interior_rings(table: Table, maximum: int = 0, ignore_larger_than: float = -1, individual: bool = False, only_smallest: bool = False) -> DataFrame:
    """Polygons with more interior rings than maximum; larger rings can be ignored, and rings be reported one by one."""
    rings = F.transform(G.interior_rings(F.col("g")), lambda r: -G.ring_area(r))
    if ignore_larger_than > 0:
        rings = F.filter(rings, lambda a: a <= ignore_larger_than)
    rows = _rows(table).withColumn("areas", F.array_sort(rings)).where(F.size("areas") > maximum)
    if not individual:
        return issues(rows, "InteriorRings.UnexpectedInteriorRings", [(table.name, "oid")], values=[F.size("areas")])
    told = F.slice("areas", F.lit(1), F.size("areas") - maximum) if only_smallest else F.col("areas")
    return issues(rows.select("oid", F.explode(told).alias("a")), "InteriorRings.UnexpectedInteriorRings", [(table.name, "oid")], values=[F.col("a")])


def qa_no_closed_paths(table: Table) -> DataFrame:
    return issues(G.parts_of(_rows(table), "oid", "g").where(G.is_closed(F.col("points"))), "NoClosedPaths.ClosedPath", [(table.name, "oid")], values=[F.col("part")])


def qa_no_boundary_loops(table: Table) -> DataFrame:
    """Places that a ring visits twice, apart from its end."""
    rows = G.vertices_of(_rows(table), "oid", "g").where("vertex < n - 1").groupBy("oid", "part", "x", "y").count().where("count > 1")
    return issues(rows, "NoBoundaryLoops.BoundaryLoop", [(table.name, "oid")], values=[F.col("part")], geom=_wkt_point())


def _wkt_point() -> Column:
    return F.concat(F.lit("POINT("), F.col("x").cast("string"), F.lit(" "), F.col("y").cast("string"), F.lit(")"))


def qa_no_touching_parts(table: Table) -> DataFrame:
    rows = G.vertices_of(_rows(table), "oid", "g").groupBy("oid", "x", "y").agg(F.count_distinct("part").alias("n")).where("n > 1")
    return issues(rows, "NoTouchingParts.TouchingParts", [(table.name, "oid")], geom=_wkt_point())


def qa_non_empty_geometry(table: Table) -> DataFrame:
    g = F.col(table.geom)
    code = F.when(g.isNull(), F.lit("NonEmptyGeometry.GeometryNull")).when(G.is_empty(g), F.lit("NonEmptyGeometry.GeometryEmpty"))
    return issues(table.rows.withColumn("_code", code).where("_code is not null"), F.col("_code"), [(table.name, table.oid)])


def qa_simple_geometry(table: Table, tolerance: float = 0.0, allow_non_planar_lines: bool = False) -> DataFrame:
    """Null, empty, rings that are not closed or have fewer than four points, segments not longer than the tolerance, and shapes whose
    segments meet elsewhere than at the ends of neighbours (lines are spared with allow_non_planar_lines)."""
    g = F.col(table.geom)
    short = F.exists(g["parts"], lambda p: F.exists(F.zip_with(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: (b["x"] - a["x"]) ** 2 + (b["y"] - a["y"]) ** 2), lambda d: d <= tolerance**2))
    ring = (g["kind"] == "polygon") & F.exists(g["parts"], lambda p: ~G.is_closed(p) | (F.size(p) < 4))
    code = F.when(g.isNull(), F.lit("SimpleGeometry.Null")).when(G.is_empty(g), F.lit("SimpleGeometry.Empty")).when(ring, F.lit("SimpleGeometry.UnclosedRing")).when((g["kind"] != "point") & short, F.lit("SimpleGeometry.ShortSegments"))
    found = table.rows.withColumn("_code", code)
    told = issues(found.where("_code is not null"), F.col("_code"), [(table.name, table.oid)])
    # only shapes with enough segments to cross themselves go to Python
    many = found.where(F.col("_code").isNull() & (g["kind"] != "point") & (F.size(G.points(g)) > 3) & (F.lit(not allow_non_planar_lines) | (g["kind"] != "line")))
    crossing = many.where(S.of_shape(F.col(table.geom), "boolean", planar.crosses_itself))
    return told.unionByName(issues(crossing, "SimpleGeometry.SelfIntersection", [(table.name, table.oid)]))


def qa_sliver_polygon(table: Table, limit: float, max_area: float = -1) -> DataFrame:
    """Rings whose perimeter squared over area exceeds limit, of at most max_area if that is given."""
    rows = G.parts_of(_rows(table), "oid", "g").withColumn("a", F.abs(G.ring_area(F.col("points")))).withColumn("r", F.try_divide(G.part_length(F.col("points")) ** 2, F.col("a")))
    bad = (F.col("r") > limit) & ((F.col("a") <= max_area) if max_area > 0 else F.lit(True))
    return issues(rows.where(bad), "SliverPolygon.TooSmallAndThin" if max_area > 0 else "SliverPolygon.TooThin", [(table.name, "oid")], values=[F.col("r")])


def islands(segments: DataFrame, bad: Column, *same: str) -> DataFrame:
    """(oid, part, first, last, n_segments) of maximal runs of consecutive bad segments (equal in same)."""
    w = Window.partitionBy("oid", "part", *same).orderBy("segment")
    runs = segments.where(bad).withColumn("run", F.col("segment") - F.row_number().over(w))
    return runs.groupBy("oid", "part", "run", *same).agg(F.min("segment").alias("first"), F.max("segment").alias("last"), F.count("*").alias("n_segments")).drop("run")


def _dxy() -> Column:
    return F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2)


def _run_issues(table: Table, runs: DataFrame, prefix: str) -> DataFrame:
    code = F.when(F.col("n_segments") == 1, F.lit(f"{prefix}.OneSegment")).otherwise(F.lit(f"{prefix}.ConsecutiveSegments"))
    return issues(runs, code, [(table.name, "oid")], values=[F.col("first"), F.col("last")])


def qa_segment_length(table: Table, limit: float, is_3d: bool = False) -> DataFrame:
    size = F.sqrt(_dxy() ** 2 + (F.col("z1") - F.col("z0")) ** 2) if is_3d else _dxy()
    return _run_issues(table, islands(G.segments_of(_rows(table), "oid", "g"), size < limit), "SegmentLength")


def qa_min_mean_segment_length(table: Table, limit: float, per_part: bool = False, is_3d: bool = False) -> DataFrame:
    count = F.aggregate(F.transform(F.col("g.parts"), lambda p: F.greatest(F.size(p) - 1, F.lit(0))), F.lit(0), lambda acc, x: acc + x)
    whole = F.try_divide(G.length(F.col("g"), is_3d), count)
    return _limit(table, per_part, whole, F.try_divide(G.part_length(F.col("p"), is_3d), F.size("p") - 1), lambda v: v < limit, "MinMeanSegmentLength.MeanSegmentLengthTooSmall")


def _next(segments: DataFrame) -> DataFrame:
    w = Window.partitionBy("oid", "part").orderBy("segment")
    return segments.withColumns({f"n{c}": F.lead(c).over(w) for c in ("x1", "y1", "z1")})


def qa_min_seg_angle(table: Table, limit: float) -> DataFrame:
    """Inner vertices whose two segments enclose less than limit (radians)."""
    rows = _next(G.segments_of(_rows(table), "oid", "g")).where("nx1 is not null")
    ax, ay, bx, by = F.col("x0") - F.col("x1"), F.col("y0") - F.col("y1"), F.col("nx1") - F.col("x1"), F.col("ny1") - F.col("y1")
    angle = F.abs(F.atan2(ax * by - ay * bx, ax * bx + ay * by))
    return issues(rows.withColumn("a", angle).where(F.col("a") < limit), "MinSegAngle.AngleTooSmall", [(table.name, "oid")], values=[F.col("segment")])


def qa_smooth(table: Table, limit: float) -> DataFrame:
    """Places where the change of direction itself changes by more than limit over three consecutive segments."""
    rows = G.segments_of(_rows(table), "oid", "g")
    w = Window.partitionBy("oid", "part").orderBy("segment")
    rows = rows.withColumn("d", F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")))
    rows = rows.withColumns({"d1": F.lead("d").over(w), "d2": F.lead("d", 2).over(w)}).where("d2 is not null")
    turn = lambda a, b: F.atan2(F.sin(b - a), F.cos(b - a))
    rough = F.abs(turn(F.col("d1"), F.col("d2")) - turn(F.col("d"), F.col("d1")))
    return issues(rows.withColumn("r", rough).where(F.col("r") > limit), "Smooth.AbruptChangeInSlopeAngle", [(table.name, "oid")], values=[F.col("segment")])


def _slope() -> Column:
    return F.atan2(F.abs(F.col("z1") - F.col("z0")), _dxy())


def qa_max_slope(table: Table, limit: float) -> DataFrame:
    rows = G.segments_of(_rows(table), "oid", "g").where("z0 is not null and z1 is not null").withColumn("s", _slope())
    return issues(rows.where(F.col("s") > limit), "MaxSlope.SlopeTooLarge", [(table.name, "oid")], values=[F.col("segment")])


def qa_horizontal_segments(table: Table, limit: float, tolerance: float) -> DataFrame:
    """Segments that are nearly but not sufficiently horizontal: steeper than tolerance, at most limit."""
    bad = (_slope() > tolerance) & (_slope() <= limit)
    return _run_issues(table, islands(G.segments_of(_rows(table), "oid", "g"), bad), "HorizontalSegments")


def qa_within_box(table: Table, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    e = G.envelope(F.col("g"))
    inside = (e["xmin"] >= xmin) & (e["ymin"] >= ymin) & (e["xmax"] <= xmax) & (e["ymax"] <= ymax)
    return issues(_rows(table).where(~inside), "WithinBox.NotWithinBox", [(table.name, "oid")])


def qa_geometry_constraint(table: Table, constraint: str, per_part: bool = False, segment_types: str | None = None, part_types: str | None = None) -> DataFrame:
    """A condition over geometry properties, for the whole shape or each part; see properties() for the columns of types."""
    types = [c for c in (segment_types, part_types) if c]
    rows = _rows(table, *types)
    if per_part:
        rows = rows.select("oid", F.posexplode("g.parts").alias("i", "p"), F.col("g.kind").alias("kind"), *types)
        rows = rows.select("oid", F.struct("kind", F.array("p").alias("parts")).alias("g"), *[F.array(F.get(c, F.col("i"))).alias(c) for c in types])
    found = G.properties(F.col("g"), F.col(segment_types) if segment_types else None, F.col(part_types) if part_types else None)
    names = {k.lower(): Value(v, kind) for k, (v, kind) in found.items()}
    return issues(rows.where(~holds(constraint, names)), "GeometryConstraint.ConstraintNotFulfilled", [(table.name, "oid")], description=constraint)


def with_properties(table: Table, *wanted: str) -> Table:
    """A table with $ property columns added as fields of expressions, under the names without $."""
    made = G.properties(F.col(table.geom))
    name = F.lit(table.name.rpartition(".")[2])
    made |= {"$ObjectID": (F.col(table.oid), "number"), "$TableName": (name, "text"), "$QualifiedTableName": (F.lit(table.name), "text")}
    return Table(table.df.withColumns({w: made[w][0] for w in wanted}), table.name, table.oid, table.geom, table.where)


# heights and measures


def qa_3d_constant_z(table: Table, tolerance: float) -> DataFrame:
    """Shapes with a height range over tolerance: the points more than half of it off the most frequent height, in runs, or the
    whole shape if more than half of its points are off."""
    rows = _rows(table).where(G.highest(F.col("g"), "z") - G.lowest(F.col("g"), "z") > tolerance)
    v = G.vertices_of(rows, "oid", "g").withColumnRenamed("vertex", "segment")
    common = v.groupBy("oid", "z").count().groupBy("oid").agg(F.max_by("z", F.struct("count", "z")).alias("mode"), F.sum("count").alias("total"))
    off = v.join(common, "oid").where(F.abs(F.col("z") - F.col("mode")) > tolerance / 2)
    many = off.groupBy("oid").agg(F.count("*").alias("n_off"), F.first("total").alias("total"))
    whole = many.where("n_off * 2 > total")
    runs = islands(off.join(whole, "oid", "left_anti"), F.lit(True))
    return issues(runs, "ConstantZ.ZNotConstant", [(table.name, "oid")], values=[F.col("first"), F.col("last")]).unionByName(issues(whole, "ConstantZ.MajorityOff", [(table.name, "oid")], values=[F.lit(None), F.lit(None)]))


def _monotonic(table: Table, axis: str, expected: str, allow_constant: bool, flip: str | None, code: str) -> DataFrame:
    flipped = holds(flip, names_of(table.df), default=False)
    rows = table.rows.select(F.col(table.oid).cast("bigint").alias("oid"), F.col(table.geom).alias("g"), flipped.alias("flip"))
    s = G.segments_of(rows, "oid", "g", "flip").withColumn("d", F.signum(F.col(f"{axis}1") - F.col(f"{axis}0"))).where("d is not null")
    if expected == "any":  # the line's own trend
        first, last = F.min_by(f"{axis}0", F.struct("part", "segment")), F.max_by(f"{axis}1", F.struct("part", "segment"))
        trend = s.groupBy("oid").agg(F.signum(last - first).alias("want"))
        s = s.join(trend, "oid").withColumn("want", F.when(F.col("want") == 0, 1.0).otherwise(F.col("want")))
    else:
        s = s.withColumn("want", F.when(F.col("flip"), -1.0).otherwise(1.0) * (1.0 if expected == "increasing" else -1.0))
    bad = (F.col("d") != F.col("want")) & (F.lit(not allow_constant) | (F.col("d") != 0))
    return issues(islands(s, bad), code, [(table.name, "oid")], values=[F.col("first"), F.col("last")])


def qa_monotonic_z(table: Table, expected: str = "any", allow_constant: bool = True, flip: str | None = None) -> DataFrame:
    return _monotonic(table, "z", expected, allow_constant, flip, "MonotonicZ.NonMonotonicZ")


def qa_monotonic_measures(table: Table, expected: str = "any", allow_constant: bool = True, flip: str | None = None) -> DataFrame:
    return _monotonic(table, "m", expected, allow_constant, flip, "MonotonicMeasures.NonMonotonicM")


def qa_measures(table: Table, invalid: float | None = None) -> DataFrame:
    """Runs of vertices without a measure, or with the invalid one."""
    v = G.vertices_of(_rows(table), "oid", "g").withColumnRenamed("vertex", "segment")
    bad = F.col("m").isNull() | F.isnan("m") if invalid is None else F.col("m") == invalid
    return issues(islands(v, bad), "Measures.UndefinedMValues" if invalid is None else "Measures.InvalidMValues", [(table.name, "oid")], values=[F.col("first"), F.col("last")])


def qa_within_z_range(table: Table, minimum: float, maximum: float, allowed: Sequence[float] = ()) -> DataFrame:
    """Runs of vertices below or above the range, apart from exactly allowed heights."""
    v = G.vertices_of(_rows(table), "oid", "g").withColumnRenamed("vertex", "segment")
    if allowed:
        v = v.where(~F.col("z").isin(list(allowed)))
    v = v.withColumn("side", F.when(F.col("z") < minimum, F.lit("below")).when(F.col("z") > maximum, F.lit("above"))).where("side is not null")
    code = F.when(F.col("side") == "below", F.lit("WithinZRange.TooLow")).otherwise(F.lit("WithinZRange.TooHigh"))
    return issues(islands(v, F.lit(True), "side"), code, [(table.name, "oid")], values=[F.col("first"), F.col("last")])


def _ends(table: Table, route: str) -> DataFrame:
    rows = table.rows.where(F.col(route).isNotNull()).select(F.col(table.oid).cast("bigint").alias("oid"), F.col(route).alias("route"), F.col(table.geom).alias("g"))
    parts = G.parts_of(rows, "oid", "g", "route")
    ends = F.array(F.col("points")[0], F.element_at("points", -1))
    return parts.select("oid", "route", "part", F.posexplode(ends).alias("end", "p")).select("oid", "route", "part", "end", "p.x", "p.y", "p.m")


#: The pairs of one place are made in parts of about so many first lines.
PLACE_LINES = 4096


def qa_route_measures_continuous(table: Table, route: str, tolerance: float) -> DataFrame:
    """Pairs of lines of a route that share an end point whose measures differ.

    Few bytes make many pairs: ends are merged, never broadcast, and dealt out by place to a fixed number of tasks; a place of many lines
    goes to several.
    """
    # one key, as doubles would be dealt anew by the join; both zeros are one place
    place = F.concat_ws(" ", *[(F.col(c) + F.lit(0.0)).cast("string") for c in "xy"], F.col("route").cast("string"))
    e = _ends(table, route).where("x is not null and y is not null").select(place.alias("place"), "oid", "m")
    shared = e.groupBy("place").agg(F.count("*").alias("n")).where("n > 1").select("place", F.ceil(F.col("n") / PLACE_LINES).cast("int").alias("blocks"))
    e = e.join(shared.hint("merge"), "place")
    spark = e.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    first = e.withColumn("block", F.pmod(F.xxhash64("oid"), "blocks").cast("int"))
    second = e.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    a, b = (d.select("place", "block", "oid", "m").repartition(tasks, "place", "block").alias(s) for d, s in ((first, "a"), (second, "b")))
    met = (F.col("a.place") == F.col("b.place")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.oid") < F.col("b.oid"))
    bad = (F.col("a.m").isNull() != F.col("b.m").isNull()) | (F.abs(F.col("a.m") - F.col("b.m")) > tolerance)
    return issues(a.hint("merge").join(b, met & bad).select(F.col("a.oid").alias("oid"), F.col("b.oid").alias("other")), "RouteMeasuresContinuous.MeasuresNotContinuous", [(table.name, "oid"), (table.name, "other")])


def qa_route_measures_unique(table: Table, route: str, tolerance: float, width: float) -> DataFrame:
    """Pairs of lines of a route whose measure ranges overlap by more than tolerance: a range join over buckets of width.

    Lines with the same range are compared as one, and only the pairs that count are made of them.
    """
    g = F.col(table.geom)
    rows = table.rows.where(F.col(route).isNotNull()).select(F.col(table.oid).cast("bigint").alias("oid"), F.col(route).alias("route"), G.lowest(g, "m").alias("low"), G.highest(g, "m").alias("high")).where("low is not null")
    rows = rows.where(F.col("high") - F.col("low") > tolerance)  # no overlap is longer than its ranges
    ranges = rows.select("route", "low", "high").distinct().withColumn("bucket", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))))
    a, b = ranges.alias("a"), ranges.alias("b")
    overlap = F.least("a.high", "b.high") - F.greatest("a.low", "b.low")
    once = F.col("a.bucket") == F.greatest(F.floor(F.col("a.low") / width), F.floor(F.col("b.low") / width))
    order = F.struct("a.low", "a.high") <= F.struct("b.low", "b.high")
    met = (F.col("a.route") == F.col("b.route")) & (F.col("a.bucket") == F.col("b.bucket")) & order & once & (overlap > tolerance)
    pairs = a.join(b, met).select(F.col("a.route").alias("route"), *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("low", "high")])
    for s in "ab":
        named = rows.select("route", F.col("oid").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("low", "high")])
        pairs = pairs.join(named.hint("merge"), ["route", f"{s}_low", f"{s}_high"])
    same = (F.col("a_low") == F.col("b_low")) & (F.col("a_high") == F.col("b_high"))
    pairs = pairs.where((F.col("a") < F.col("b")) | (~same & (F.col("a") > F.col("b"))))
    return issues(pairs.select(F.least("a", "b").alias("oid"), F.greatest("a", "b").alias("other")), "RouteMeasuresUnique.OverlappingMeasures", [(table.name, "oid"), (table.name, "other")])


# segment types: curves are given as an array of segment types beside the geometry


def qa_curve(table: Table, types: str, allowed: Sequence[str] = ()) -> DataFrame:
    """Runs of non-linear segments of types that are not allowed; types is a column array<array<string>>, as parts are."""
    rows = table.rows.select(F.col(table.oid).cast("bigint").alias("oid"), F.posexplode(types).alias("part", "t")).select("oid", "part", F.posexplode("t").alias("segment", "type"))
    runs = islands(rows, (F.col("type") != "line") & ~F.col("type").isin(list(allowed)), "type")
    return issues(runs, "Curve.NonLinearSegments", [(table.name, "oid")], F.col("type"), values=[F.col("first"), F.col("last")])


def qa_valid_non_linear_segments(table: Table, arcs: str, minimum_chord_height: float) -> DataFrame:
    """arcs: array<struct<segment, radius, chord, has_centre>>. Arcs without a centre or with too low a chord height."""
    rows = table.rows.select(F.col(table.oid).cast("bigint").alias("oid"), F.explode(arcs).alias("a"))
    height = F.col("a.radius") - F.sqrt(F.greatest(F.col("a.radius") ** 2 - (F.col("a.chord") / 2) ** 2, F.lit(0.0)))
    code = F.when(~F.col("a.has_centre"), F.lit("ValidNonLinearSegments.CircularArcWithoutCentre")).when(height < minimum_chord_height, F.lit("ValidNonLinearSegments.ChordHeightTooSmall"))
    return issues(rows.withColumn("_code", code).where("_code is not null"), F.col("_code"), [(table.name, "oid")], values=[F.col("a.segment")])
