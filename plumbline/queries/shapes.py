"""Queries of single-geometry checks over derived shapes: one line per user of the events, boxes of customers and parts."""

from __future__ import annotations


from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.issues import Table
from plumbline.operators import single_geometry as S
from plumbline.queries.base import Query, flat, table


def event_lines(s, d) -> Table:
    """A line per user through its events in order of time: x = number of the event, y = value, z = value modulo 10, m = hour."""
    e = table(s, d, "events").df
    one = F.struct("ts", "event_id", "value")
    lines = e.groupBy("user_id").agg(F.array_sort(F.collect_list(one)).alias("e"))
    points = F.transform("e", lambda p, i: G.vertex(i.cast("double"), p["value"], F.floor(p["value"] % 10).cast("double"), F.hour(p["ts"]).cast("double")))
    return Table(lines.select(F.col("user_id").alias("oid"), G.line(points).alias("geom"), (F.col("user_id") % 5).alias("route")), "event_lines", "oid", "geom")


def part_boxes(s, d) -> Table:
    """A box per part, with an inner box if its number is even and a second box beside it if that is divisible by 3."""
    p = table(s, d, "part").df.select("p_partkey", "p_size", F.floor("p_retailprice").cast("double").alias("y"))
    w, h = F.col("p_size").cast("double"), 1.0 + F.col("p_partkey") % 4
    x, y = F.lit(0.0), F.col("y")
    v = G.vertex
    outer = F.array(v(x, y), v(x, y + h), v(x + w, y + h), v(x + w, y), v(x, y))
    inner = F.array(v(x + w / 4, y + h / 4), v(x + w / 2, y + h / 4), v(x + w / 2, y + h / 2), v(x + w / 4, y + h / 2), v(x + w / 4, y + h / 4))
    beside = F.array(v(x + w, y + h), v(x + w, y + h + h), v(x + w + w, y + h + h), v(x + w + w, y + h), v(x + w, y + h))
    rings = F.array_compact(F.array(outer, F.when(F.col("p_partkey") % 2 == 0, inner), F.when(F.col("p_partkey") % 3 == 0, beside)))
    return Table(p.select(F.col("p_partkey").alias("oid"), G.polygon(rings).alias("geom")), "part_boxes", "oid", "geom")


def customer_shapes(s, d) -> Table:
    c = table(s, d, "customer").df
    g = F.when(F.col("c_custkey") % 9 == 0, F.lit(None).cast(G.GEOMETRY)).when(F.col("c_custkey") % 9 == 1, G.geometry("line", F.array())).when(F.col("c_custkey") % 9 == 2, G.segment("c_acctbal", 0, "c_acctbal", 0)).otherwise(G.segment("c_acctbal", 0, 0, F.col("c_custkey")))
    return Table(c.select(F.col("c_custkey").alias("oid"), g.alias("geom"), F.col("c_acctbal")), "customers", "oid", "geom")


def _arcs(s, d) -> Table:
    p = table(s, d, "part").df
    kinds = F.array(F.array(F.lit("line"), *[F.when(F.col("p_partkey") % k == 0, F.lit("arc")).otherwise(F.lit("line")) for k in (2, 3)], F.when(F.col("p_partkey") % 5 == 0, F.lit("bezier")).otherwise(F.lit("line"))))
    arcs = F.array(F.struct(F.lit(0).alias("segment"), F.col("p_size").cast("double").alias("radius"), F.lit(4.0).alias("chord"), (F.col("p_partkey") % 7 != 0).alias("has_centre")))
    return Table(p.select(F.col("p_partkey").alias("oid"), kinds.alias("types"), arcs.alias("arcs")), "arcs")


QUERIES: dict[str, Query] = {
    "qa_min_length": lambda s, d: flat(S.qa_min_length(event_lines(s, d), 2000)),
    "qa_max_length": lambda s, d: flat(S.qa_max_length(event_lines(s, d), 1500, is_3d=True)),
    "qa_min_area": lambda s, d: flat(S.qa_min_area(part_boxes(s, d), 20)),
    "qa_max_area": lambda s, d: flat(S.qa_max_area(part_boxes(s, d), 60, per_part=True)),
    "qa_extent": lambda s, d: flat(S.qa_extent(part_boxes(s, d), 40)),
    "qa_min_extent": lambda s, d: flat(S.qa_min_extent(part_boxes(s, d), 8)),
    "qa_max_vertex_count": lambda s, d: flat(S.qa_max_vertex_count(part_boxes(s, d), 10)),
    "qa_multipart": lambda s, d: flat(S.qa_multipart(part_boxes(s, d))),
    "qa_interior_rings": lambda s, d: flat(S.qa_interior_rings(part_boxes(s, d), 0, ignore_larger_than=3)),
    "qa_no_closed_paths": lambda s, d: flat(S.qa_no_closed_paths(part_boxes(s, d)), "value"),
    "qa_no_touching_parts": lambda s, d: flat(S.qa_no_touching_parts(part_boxes(s, d))),
    "qa_no_boundary_loops": lambda s, d: flat(S.qa_no_boundary_loops(_loops(s, d))),
    "qa_simple_geometry": lambda s, d: flat(S.qa_simple_geometry(customer_shapes(s, d))),
    "qa_simple_geometry_crossing": lambda s, d: flat(S.qa_simple_geometry(_bows(s, d))),
    "qa_non_empty_geometry": lambda s, d: flat(S.qa_non_empty_geometry(customer_shapes(s, d))),
    "qa_sliver_polygon": lambda s, d: flat(S.qa_sliver_polygon(part_boxes(s, d), 60, 100)),
    "qa_segment_length": lambda s, d: flat(S.qa_segment_length(event_lines(s, d), 12), "value", "value2"),
    "qa_min_mean_segment_length": lambda s, d: flat(S.qa_min_mean_segment_length(event_lines(s, d), 40)),
    "qa_min_seg_angle": lambda s, d: flat(S.qa_min_seg_angle(event_lines(s, d), 0.05), "value"),
    "qa_smooth": lambda s, d: flat(S.qa_smooth(event_lines(s, d), 3.0), "value"),
    "qa_max_slope": lambda s, d: flat(S.qa_max_slope(event_lines(s, d), 0.5), "value"),
    "qa_horizontal_segments": lambda s, d: flat(S.qa_horizontal_segments(event_lines(s, d), 0.3, 0.01), "value", "value2"),
    "qa_within_box": lambda s, d: flat(S.qa_within_box(part_boxes(s, d), 0, 910, 60, 1500)),
    "qa_geometry_constraint": lambda s, d: flat(S.qa_geometry_constraint(part_boxes(s, d), "$Area > 10 AND $PartCount < 3")),
    "qa_geometry_constraint_per_part": lambda s, d: flat(S.qa_geometry_constraint(part_boxes(s, d), "$IsExteriorRing OR $Area < -2", per_part=True)),
    "shape_properties": lambda s, d: S.with_properties(part_boxes(s, d), "$ShapeArea", "$ShapeVertexCount", "$ShapeXMax").df.select("oid", F.round("$ShapeArea", 6).alias("area"), F.col("$ShapeVertexCount").alias("n"), F.col("$ShapeXMax").alias("xmax")),
    "qa_3d_constant_z": lambda s, d: flat(S.qa_3d_constant_z(event_lines(s, d), 8.5)),
    "qa_monotonic_z": lambda s, d: flat(S.qa_monotonic_z(event_lines(s, d), "increasing", True), "value", "value2"),
    "qa_monotonic_measures": lambda s, d: flat(S.qa_monotonic_measures(event_lines(s, d), "decreasing", False, "oid % 2 = 0"), "value", "value2"),
    "qa_measures": lambda s, d: flat(S.qa_measures(event_lines(s, d), 7), "value", "value2"),
    "qa_within_z_range": lambda s, d: flat(S.qa_within_z_range(event_lines(s, d), 1, 8, [0.0]), "value", "value2"),
    "qa_route_measures_continuous": lambda s, d: flat(S.qa_route_measures_continuous(_routes(s, d), "route", 1.5), "other_oid"),
    "qa_route_measures_unique": lambda s, d: flat(S.qa_route_measures_unique(_routes(s, d), "route", 2, 10), "other_oid"),
    "qa_curve": lambda s, d: flat(S.qa_curve(_arcs(s, d), "types", ["bezier"]), "value", "value2"),
    "qa_valid_non_linear_segments": lambda s, d: flat(S.qa_valid_non_linear_segments(_arcs(s, d), "arcs", 0.2)),
}


def _loops(s, d) -> Table:
    p = table(s, d, "part").df.select("p_partkey")
    v = G.vertex
    k = F.col("p_partkey").cast("double") + 1
    bow = F.array(v(0, 0), v(0, k), v(1, 1), v(k + 2, 0), v(F.when(F.col("p_partkey") % 4 == 0, 1).otherwise(2), 1), v(0, 0))
    return Table(p.select(F.col("p_partkey").alias("oid"), G.polygon(F.array(bow)).alias("geom")), "loops", "oid", "geom")


def _bows(s, d) -> Table:
    """Polygons that cross themselves if their key is divisible by 4."""
    p = table(s, d, "part").df.select("p_partkey")
    v, far = G.vertex, F.when(F.col("p_partkey") % 4 == 0, 3.0).otherwise(1.0)
    ring = F.array(v(F.lit(0), F.lit(0)), v(F.lit(0), F.lit(2)), v(F.lit(2), F.lit(2)), v(F.lit(2), F.lit(0)), v(F.lit(1), far), v(F.lit(0), F.lit(0)))
    return Table(p.select(F.col("p_partkey").alias("oid"), G.polygon(F.array(ring)).alias("geom")), "bows", "oid", "geom")


def _routes(s, d) -> Table:
    """A segment per part, from corner to corner of a grid, measured by size; routes by brand."""
    p = table(s, d, "part").df
    k = F.col("p_partkey")
    a = G.vertex((k % 10).cast("double"), (k % 7).cast("double"), None, F.col("p_size").cast("double"))
    b = G.vertex((k % 10 + 1).cast("double"), (k % 7).cast("double"), None, (F.col("p_size") + k % 5).cast("double"))
    return Table(p.select(k.alias("oid"), F.col("p_brand").alias("route"), G.line(F.array(a, b)).alias("geom")), "routes", "oid", "geom")


E = "WITH v AS (SELECT user_id AS oid, row_number() OVER w - 1 AS i, value AS y, floor(fmod(value, 10)) AS z, hour(ts) AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT oid, i, y AS y0, z AS z0, m AS m0, lead(y) OVER w AS y1, lead(z) OVER w AS z1, lead(m) OVER w AS m1, lead(y, 2) OVER w AS y2, lead(y, 3) OVER w AS y3 FROM v WINDOW w AS (PARTITION BY oid ORDER BY i))"
P = "WITH p AS (SELECT p_partkey AS oid, CAST(p_size AS DOUBLE) AS w, 1.0 + p_partkey % 4 AS h, floor(p_retailprice) AS y, p_partkey % 2 = 0 AS i, p_partkey % 3 = 0 AS b FROM part)"


def _islands(bad: str, rows: str = "s", code: str | None = None, prefix: str = "", cond: str = "y1 IS NOT NULL") -> str:
    name = f"'{code}'" if code else f"CASE WHEN count(*) = 1 THEN '{prefix}.OneSegment' ELSE '{prefix}.ConsecutiveSegments' END"
    return f"{E} SELECT {name} AS issue_code, oid, CAST(min(i) AS VARCHAR) AS value, CAST(max(i) AS VARCHAR) AS value2 FROM (SELECT oid, i, i - row_number() OVER (PARTITION BY oid ORDER BY i) AS run FROM {rows} WHERE {cond} AND ({bad})) GROUP BY oid, run"


D = "sqrt(1 + (y1 - y0) ** 2)"
SLOPE = f"atan2(abs(z1 - z0), {D})"
ORACLES: dict[str, str] = {
    "qa_min_length": f"{E} SELECT 'MinLength.LengthTooSmall' AS issue_code, oid FROM s GROUP BY oid HAVING coalesce(sum({D}), 0) < 2000",
    "qa_max_length": f"{E} SELECT 'MaxLength.LengthTooLarge' AS issue_code, oid FROM s GROUP BY oid HAVING sum(sqrt(1 + (y1 - y0) ** 2 + (z1 - z0) ** 2)) > 1500",
    "qa_min_area": f"{P} SELECT 'MinArea.AreaTooSmall' AS issue_code, oid FROM p WHERE w * h * (1 - CASE WHEN i THEN 1 / 16.0 ELSE 0 END + CASE WHEN b THEN 1 ELSE 0 END) < 20",
    "qa_max_area": f"{P} SELECT 'MaxArea.AreaTooLarge' AS issue_code, oid FROM (SELECT oid, w * h AS a FROM p UNION ALL SELECT oid, w * h FROM p WHERE b) WHERE a > 60",
    "qa_extent": f"{P} SELECT 'Extent.ExtentTooLarge' AS issue_code, oid FROM p WHERE greatest(w, h) * CASE WHEN b THEN 2 ELSE 1 END > 40",
    "qa_min_extent": f"{P} SELECT 'MinExtent.ExtentTooSmall' AS issue_code, oid FROM p WHERE greatest(w, h) * CASE WHEN b THEN 2 ELSE 1 END < 8",
    "qa_max_vertex_count": f"{P} SELECT 'MaxVertexCount.TooManyVertices' AS issue_code, oid FROM p WHERE i AND b",
    "qa_multipart": f"{P} SELECT 'Multipart.MultipleParts' AS issue_code, oid FROM p WHERE b",
    "qa_interior_rings": f"{P} SELECT 'InteriorRings.UnexpectedInteriorRings' AS issue_code, oid FROM p WHERE i AND w * h / 16 <= 3",
    "qa_no_closed_paths": f"{P} SELECT 'NoClosedPaths.ClosedPath' AS issue_code, oid, CAST(k AS VARCHAR) AS value FROM (SELECT oid, unnest(generate_series(0, CASE WHEN i THEN 1 ELSE 0 END + CASE WHEN b THEN 1 ELSE 0 END)) AS k FROM p)",
    "qa_no_touching_parts": f"{P} SELECT 'NoTouchingParts.TouchingParts' AS issue_code, oid FROM p WHERE b",
    "qa_no_boundary_loops": "SELECT 'NoBoundaryLoops.BoundaryLoop' AS issue_code, p_partkey AS oid FROM part WHERE p_partkey % 4 = 0",
    "qa_simple_geometry": "SELECT CASE c_custkey % 9 WHEN 0 THEN 'SimpleGeometry.Null' WHEN 1 THEN 'SimpleGeometry.Empty' ELSE 'SimpleGeometry.ShortSegments' END AS issue_code, c_custkey AS oid FROM customer WHERE c_custkey % 9 < 3",
    "qa_simple_geometry_crossing": "SELECT 'SimpleGeometry.SelfIntersection' AS issue_code, p_partkey AS oid FROM part WHERE p_partkey % 4 = 0",
    "qa_non_empty_geometry": "SELECT CASE c_custkey % 9 WHEN 0 THEN 'NonEmptyGeometry.GeometryNull' ELSE 'NonEmptyGeometry.GeometryEmpty' END AS issue_code, c_custkey AS oid FROM customer WHERE c_custkey % 9 < 2",
    "qa_sliver_polygon": f"{P} SELECT 'SliverPolygon.TooSmallAndThin' AS issue_code, oid FROM (SELECT oid, w, h FROM p UNION ALL SELECT oid, w / 4, h / 4 FROM p WHERE i UNION ALL SELECT oid, w, h FROM p WHERE b) WHERE w * h <= 100 AND (2 * w + 2 * h) ** 2 / (w * h) > 60",
    "qa_segment_length": _islands(f"{D} < 12", prefix="SegmentLength"),
    "qa_min_mean_segment_length": f"{E} SELECT 'MinMeanSegmentLength.MeanSegmentLengthTooSmall' AS issue_code, oid FROM s GROUP BY oid HAVING sum({D}) / count(y1) < 40",
    "qa_min_seg_angle": f"{E} SELECT 'MinSegAngle.AngleTooSmall' AS issue_code, oid, CAST(i AS VARCHAR) AS value FROM s WHERE y2 IS NOT NULL AND abs(atan2(-1 * (y2 - y1) - (y0 - y1) * 1, -1 + (y0 - y1) * (y2 - y1))) < 0.05",
    "qa_smooth": f"""{E}, t AS (SELECT oid, i, atan2(y1 - y0, 1) AS a, atan2(y2 - y1, 1) AS b, atan2(y3 - y2, 1) AS c FROM s WHERE y3 IS NOT NULL)
        SELECT 'Smooth.AbruptChangeInSlopeAngle' AS issue_code, oid, CAST(i AS VARCHAR) AS value FROM t WHERE abs(atan2(sin(c - b), cos(c - b)) - atan2(sin(b - a), cos(b - a))) > 3.0""",
    "qa_max_slope": f"{E} SELECT 'MaxSlope.SlopeTooLarge' AS issue_code, oid, CAST(i AS VARCHAR) AS value FROM s WHERE y1 IS NOT NULL AND {SLOPE} > 0.5",
    "qa_horizontal_segments": _islands(f"{SLOPE} > 0.01 AND {SLOPE} <= 0.3", prefix="HorizontalSegments"),
    "qa_within_box": f"{P} SELECT 'WithinBox.NotWithinBox' AS issue_code, oid FROM p WHERE y < 910 OR w * CASE WHEN b THEN 2 ELSE 1 END > 60 OR y + h * CASE WHEN b THEN 2 ELSE 1 END > 1500",
    "qa_geometry_constraint": f"{P} SELECT 'GeometryConstraint.ConstraintNotFulfilled' AS issue_code, oid FROM p WHERE NOT (w * h * (1 - CASE WHEN i THEN 1 / 16.0 ELSE 0 END + CASE WHEN b THEN 1 ELSE 0 END) > 10 AND NOT (i AND b))",
    "qa_geometry_constraint_per_part": f"{P} SELECT 'GeometryConstraint.ConstraintNotFulfilled' AS issue_code, oid FROM p WHERE i AND w * h / 16 <= 2",
    "shape_properties": f"{P} SELECT oid, round(w * h * (1 - CASE WHEN i THEN 1 / 16.0 ELSE 0 END + CASE WHEN b THEN 1 ELSE 0 END), 6) AS area, 5 * (1 + CASE WHEN i THEN 1 ELSE 0 END + CASE WHEN b THEN 1 ELSE 0 END) AS n, w * CASE WHEN b THEN 2 ELSE 1 END AS xmax FROM p",
    "qa_3d_constant_z": f"""{E}, c AS (SELECT oid, z, count(*) AS n FROM v GROUP BY 1, 2), mo AS (SELECT oid, z AS mode FROM c QUALIFY row_number() OVER (PARTITION BY oid ORDER BY n DESC, z DESC) = 1),
        r AS (SELECT oid, max(z) - min(z) AS range, count(*) AS total FROM v GROUP BY 1 HAVING max(z) - min(z) > 8.5),
        o AS (SELECT v.oid, v.i, total FROM v JOIN mo USING (oid) JOIN r USING (oid) WHERE abs(z - mode) > 4.25), m AS (SELECT oid FROM o GROUP BY oid HAVING count(*) * 2 > max(total))
        SELECT 'ConstantZ.MajorityOff' AS issue_code, oid FROM m UNION ALL
        SELECT 'ConstantZ.ZNotConstant', oid FROM (SELECT oid, i - row_number() OVER (PARTITION BY oid ORDER BY i) AS run FROM o WHERE oid NOT IN (SELECT oid FROM m)) GROUP BY oid, run""",
    "qa_monotonic_z": _islands("z1 < z0", code="MonotonicZ.NonMonotonicZ"),
    "qa_monotonic_measures": _islands("CASE WHEN oid % 2 = 0 THEN m1 <= m0 ELSE m1 >= m0 END", code="MonotonicMeasures.NonMonotonicM"),
    "qa_measures": _islands("m = 7", rows="v", code="Measures.InvalidMValues", cond="true"),
    "qa_within_z_range": _islands("z > 8", rows="v", code="WithinZRange.TooHigh", cond="z <> 0"),
    "qa_route_measures_continuous": """WITH e AS (SELECT p_partkey AS oid, p_brand AS r, p_partkey % 10 AS x, p_partkey % 7 AS y, p_size AS m FROM part UNION ALL SELECT p_partkey, p_brand, p_partkey % 10 + 1, p_partkey % 7, p_size + p_partkey % 5 FROM part)
        SELECT 'RouteMeasuresContinuous.MeasuresNotContinuous' AS issue_code, a.oid, b.oid AS other_oid FROM e a JOIN e b ON a.r = b.r AND a.x = b.x AND a.y = b.y AND a.oid < b.oid WHERE abs(a.m - b.m) > 1.5""",
    "qa_route_measures_unique": """WITH e AS (SELECT p_partkey AS oid, p_brand AS r, p_size AS a, p_size + p_partkey % 5 AS b FROM part)
        SELECT 'RouteMeasuresUnique.OverlappingMeasures' AS issue_code, x.oid, y.oid AS other_oid FROM e x JOIN e y ON x.r = y.r AND x.oid < y.oid WHERE least(x.b, y.b) - greatest(x.a, y.a) > 2""",
    "qa_curve": """SELECT 'Curve.NonLinearSegments' AS issue_code, p_partkey AS oid, CASE WHEN p_partkey % 2 = 0 THEN '1' ELSE '2' END AS value, CASE WHEN p_partkey % 3 = 0 THEN '2' ELSE '1' END AS value2
        FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0""",
    "qa_valid_non_linear_segments": """SELECT CASE WHEN p_partkey % 7 = 0 THEN 'ValidNonLinearSegments.CircularArcWithoutCentre' ELSE 'ValidNonLinearSegments.ChordHeightTooSmall' END AS issue_code, p_partkey AS oid
        FROM part WHERE p_partkey % 7 = 0 OR p_size - sqrt(greatest(p_size ** 2 - 4, 0)) < 0.2""",
}
