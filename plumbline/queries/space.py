"""Queries of spatial relations, nearness, networks and spatial transformers over derived shapes.

Boxes of parts, points and straight lines of customers, on a grid of halves so that SQL gets the same answers; shapes lie in
blocks of 500 keys side by side, so that their density is the same at every scale.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.functions import wkb
from plumbline.issues import Table
from plumbline.operators import network as N
from plumbline.operators import proximity as P
from plumbline.operators import relations as R
from plumbline.operators import spatial_transformers as T
from plumbline.operators.attributes import qa_constraint
from plumbline.queries.base import Query, flat, table
from plumbline.queries.shapes import part_boxes

BLOCK = "100 * floor({k} / 500)"


def boxes(s, d, where: str | None = None) -> Table:
    p = table(s, d, "part").df
    x, y = F.expr(f"p_partkey % 40 + {BLOCK.format(k='p_partkey')}"), F.expr("floor(p_retailprice) % 20")
    made = p.select(F.col("p_partkey").alias("oid"), G.box(x, y, x + F.expr("1 + p_size % 3"), y + F.expr("1 + p_partkey % 2")).alias("geom"), "p_brand", "p_size", (F.col("p_size") % 4).alias("grade"))
    return Table(made, "boxes", "oid", "geom", where)


def points(s, d, where: str | None = None) -> Table:
    c = table(s, d, "customer").df
    x, y = F.expr(f"c_custkey % 40 + 0.5 * (c_nationkey % 2) + {BLOCK.format(k='c_custkey')}"), F.expr("c_nationkey % 20")
    return Table(c.select(F.col("c_custkey").alias("oid"), G.point(x, y, F.floor("c_acctbal")).alias("geom"), "c_nationkey", "c_acctbal"), "points", "oid", "geom", where)


def lines(s, d, where: str | None = None) -> Table:
    """Even customers run east for 3 at half heights, odd ones north for 3 at half widths; heights are the key modulo 7."""
    c = table(s, d, "customer").df
    x, y, z = F.expr(f"c_custkey % 40 + {BLOCK.format(k='c_custkey')}"), F.expr("c_nationkey % 20"), F.expr("c_custkey % 7")
    v = G.vertex
    east, north = F.array(v(x, y + 0.5, z), v(x + 3, y + 0.5, z)), F.array(v(x + 0.5, y, z), v(x + 0.5, y + 3, z))
    made = c.select(F.col("c_custkey").alias("oid"), G.line(F.when(F.col("c_custkey") % 2 == 0, east).otherwise(north)).alias("geom"), "c_nationkey", (F.col("c_custkey") % 7).alias("z"))
    return Table(made, "lines", "oid", "geom", where)


def measured(s, d) -> Table:
    """The lines with measures from 0 at their start to 3 at their end."""
    t = lines(s, d)
    p = F.col("geom.parts")[0]
    v = lambda k, m: G.vertex(p[k]["x"], p[k]["y"], None, F.lit(m))
    return Table(t.df.withColumn("geom", G.line(F.array(v(0, 0.0), v(1, 3.0)))), "lines", "oid", "geom")


def streets(s, d, where: str | None = None) -> Table:
    """Unit lines between grid points: east from (k % 20, nation % 10), or north if the key is divisible by 3."""
    c = table(s, d, "customer").df
    x, y = F.expr(f"c_custkey % 20 + {BLOCK.format(k='c_custkey')}"), F.expr("c_nationkey % 10")
    v = G.vertex
    made = c.select(F.col("c_custkey").alias("oid"), G.line(F.array(v(x, y), F.when(F.col("c_custkey") % 3 == 0, v(x, y + 1)).otherwise(v(x + 1, y)))).alias("geom"), "c_mktsegment", "c_nationkey")
    return Table(made, "streets", "oid", "geom", where)


def junctions(s, d) -> Table:
    p = table(s, d, "supplier").df
    x, y = F.expr(f"s_suppkey % 20 + {BLOCK.format(k='s_suppkey')}"), F.expr("s_nationkey % 10")
    return Table(p.select(F.col("s_suppkey").alias("oid"), G.point(x, y).alias("geom"), F.lit("BUILDING").alias("kind")), "junctions", "oid", "geom")


def walls(s, d, where: str | None = None) -> Table:
    """The four sides of a square per region and nation, one line each; they meet at corners."""
    n = table(s, d, "nation").df
    x = F.expr("n_nationkey * 2.0")
    v = G.vertex
    corner = [v(x, F.lit(0)), v(x, F.lit(1)), v(x + 1, F.lit(1)), v(x + 1, F.lit(0))]
    sides = F.array(*[F.array(corner[k], corner[(k + 1) % 4]) for k in range(4)])
    made = n.select("n_nationkey", F.posexplode(sides).alias("k", "p"))
    turned = F.when((F.col("n_nationkey") % 5 == 1) | ((F.col("n_nationkey") % 5 == 2) & (F.col("k") == 0)), F.reverse("p")).otherwise(F.col("p"))
    kept = made.where("not (n_nationkey % 5 = 3 and k = 2)")
    return Table(kept.select((F.col("n_nationkey") * 4 + F.col("k")).cast("bigint").alias("oid"), G.line(turned).alias("geom")), "walls", "oid", "geom", where)


def seeds(s, d) -> Table:
    """Points in the squares of walls: none, one, two or one on the border."""
    n = table(s, d, "nation").df
    x = F.expr("n_nationkey * 2.0")
    spots = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), (x + dx).alias("x"), F.lit(dy).alias("y"), F.lit(k).alias("least")) for k, dx, dy in ((0, 0.5, 0.5), (1, 0.25, 0.25), (2, 0.0, 0.5))]), lambda p: p["k"] < F.col("n_nationkey") % 4)
    made = n.select("n_nationkey", F.explode(spots).alias("p"))
    return Table(made.select((F.col("n_nationkey") * 4 + F.col("p.k")).cast("bigint").alias("oid"), G.point(F.col("p.x"), F.col("p.y")).alias("geom")), "seeds", "oid", "geom")


def _nodes(s, d):
    return N.tr_get_nodes(streets(s, d), ["COUNT(c_mktsegment) AS n", "MIN(c_nationkey) AS least"]).select("node_oid", "n", "least", "n_ends")


def _wkb(s, d):
    """Boxes and lines with heights written in both byte orders and read again."""
    kept = boxes(s, d).df.select("oid", "geom").unionByName(lines(s, d).df.select((-F.col("oid")).alias("oid"), "geom"))
    written = kept.select("oid", F.length(wkb.encoded(s, F.col("geom"))).alias("n_bytes"), wkb.encoded(s, F.col("geom"), F.col("oid") % 2 == 0).alias("data"))
    g = written.select("oid", "n_bytes", wkb.decoded(s, F.col("data")).alias("g"))
    return g.select("oid", "n_bytes", F.col("g.kind").alias("kind"), G.lowest(F.col("g"), "x").alias("xmin"), G.highest(F.col("g"), "y").alias("ymax"), G.highest(F.col("g"), "z").alias("zmax"), F.size(G.points(F.col("g"))).alias("n"))


def _issues_of(s, d):
    return qa_constraint(points(s, d), "c_acctbal > 1000")


def _placed(s, d):
    return T.with_place(_issues_of(s, d), [points(s, d)])


def _street_edges(s, d):
    e = N.node_table([streets(s, d)])
    ends = e.groupBy("oid").agg(F.min(F.struct("x", "y")).alias("p"), F.max(F.struct("x", "y")).alias("q"))
    node = lambda c: F.col(f"{c}.x").cast("bigint") * 1000 + F.col(f"{c}.y").cast("bigint")
    return ends.select(node("p").alias("a"), node("q").alias("b"), F.lit(1.0).alias("cost"))


def _path_to_goal(s, d):
    """From a corner to a place five east and two north, guided by the distance along the axes."""
    edges, goal = _street_edges(s, d), 5 * 1000 + 2
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    left = nodes.select("node", (F.abs(F.floor(F.col("node") / 1000) - 5) + F.abs(F.col("node") % 1000 - 2)).cast("double").alias("h"))
    return N.shortest_paths(edges, 0, goal=goal, heuristic=left).where(F.col("node") == goal)


def _related(s, d):
    """Orders have no geometry; their customers' points have."""
    places = Table(points(s, d, "c_acctbal > 0").df, "points", "oid", "geom", "c_acctbal > 0")
    found = qa_constraint(table(s, d, "orders"), "o_totalprice < 300000")
    placed = T.with_place(found, [T.related_shapes(table(s, d, "orders"), places, "o_custkey", "oid")])
    return placed.df.select(F.col("involved")[0]["oid"].alias("oid"), F.col("place.parts")[0][0]["x"].alias("x"), F.col("place.parts")[0][0]["y"].alias("y"))


QUERIES: dict[str, Query] = {
    "qa_intersects_self": lambda s, d: flat(R.qa_intersects_self([boxes(s, d)], "G1.grade = G2.grade"), "other_oid"),
    "qa_intersects_self_geometry": lambda s, d: flat(R.qa_intersects_self([boxes(s, d)], valid_geometry="$Area <= 1.5"), "other_oid"),
    "qa_intersects_other_boundary": lambda s, d: flat(R.qa_intersects_other([boxes(s, d)], [points(s, d)], component="boundary"), "other_oid"),
    "geometry_components": lambda s, d: _components_of(s, d),
    "qa_intersects_other": lambda s, d: flat(R.qa_intersects_other([boxes(s, d)], [points(s, d)]), "other_oid"),
    "qa_interior_intersects_self": lambda s, d: flat(R.qa_interior_intersects_self([boxes(s, d)]), "other_oid"),
    "qa_interior_intersects_other": lambda s, d: flat(R.qa_interior_intersects_other([boxes(s, d)], [points(s, d)], "G2.c_acctbal < 0"), "other_oid"),
    "qa_crosses_self": lambda s, d: flat(R.qa_crosses_self([lines(s, d)]), "other_oid"),
    "qa_crosses_other": lambda s, d: flat(R.qa_crosses_other([lines(s, d)], [boxes(s, d)]), "other_oid"),
    "qa_overlaps_self": lambda s, d: flat(R.qa_overlaps_self([boxes(s, d)]), "other_oid"),
    "qa_overlaps_other": lambda s, d: flat(R.qa_overlaps_other([boxes(s, d, "grade = 1")], [boxes(s, d, "grade = 2")]), "other_oid"),
    "qa_touches_self": lambda s, d: flat(R.qa_touches_self([boxes(s, d)]), "other_oid"),
    "qa_touches_other": lambda s, d: flat(R.qa_touches_other([points(s, d)], [boxes(s, d)], "G1.c_acctbal > G2.p_size * 100"), "other_oid"),
    "qa_intersection_matrix_self": lambda s, d: flat(R.qa_intersection_matrix_self([boxes(s, d)], "T*F**F***"), "other_oid"),
    "qa_intersection_matrix_other": lambda s, d: flat(R.qa_intersection_matrix_other([points(s, d)], [boxes(s, d)], "0FF******"), "other_oid"),
    "qa_intersection_matrix_disjoint": lambda s, d: flat(R.qa_intersection_matrix_other([points(s, d)], [boxes(s, d)], "FF*FF****")),
    "qa_duplicate_geometry_self": lambda s, d: flat(R.qa_duplicate_geometry_self(points(s, d)), "other_oid"),
    "qa_duplicate_geometry_sets": lambda s, d: R.qa_duplicate_geometry_self(boxes(s, d), one_per_set=True).select(F.size("involved").alias("n"), F.col("involved")[0]["oid"].alias("oid")),
    "qa_contains_other": lambda s, d: flat(R.qa_contains_other([boxes(s, d)], [points(s, d)], "G1.grade > 0")),
    "qa_is_covered_by_other": lambda s, d: flat(R.qa_is_covered_by_other([boxes(s, d, "grade > 0")], [boxes(s, d, "grade = 0")], 50.0), "value"),
    "qa_contained_points_count": lambda s, d: flat(R.qa_contained_points_count(boxes(s, d), points(s, d), 1, 2, on_border=True), "value"),
    "qa_min_intersect": lambda s, d: flat(R.qa_min_intersect([boxes(s, d)], 1.5), "other_oid"),
    "qa_line_intersect": lambda s, d: flat(R.qa_line_intersect([lines(s, d)]), "other_oid"),
    "qa_line_intersect_angle": lambda s, d: flat(R.qa_line_intersect_angle([lines(s, d)], 1.6), "other_oid"),
    "qa_line_intersect_z": lambda s, d: flat(R.qa_line_intersect_z([lines(s, d)], 2, 5), "other_oid"),
    "qa_z_difference_self": lambda s, d: flat(R.qa_z_difference_self([lines(s, d)], 3, 0), "other_oid"),
    "qa_z_difference_other": lambda s, d: flat(R.qa_z_difference_other([lines(s, d, "z < 3")], [lines(s, d, "z >= 3")], 0, 4), "other_oid"),
    "qa_must_intersect_other": lambda s, d: flat(R.qa_must_intersect_other([points(s, d)], [boxes(s, d)], "G2.grade <> 0")),
    "qa_must_touch_other": lambda s, d: flat(R.qa_must_touch_other([boxes(s, d)], [boxes(s, d, "grade = 3")])),
    "qa_must_touch_self": lambda s, d: flat(R.qa_must_touch_self([boxes(s, d)], "G1.grade = G2.grade")),
    "qa_must_intersect_matrix_other": lambda s, d: flat(R.qa_must_intersect_matrix_other([points(s, d)], [boxes(s, d)], ["0********"])),
    "qa_must_be_near_other": lambda s, d: flat(R.qa_must_be_near_other(points(s, d), [boxes(s, d, "grade = 0")], 1.0)),
    "qa_rel_must_be_near_other": lambda s, d: flat(R.qa_must_be_near_other(_joined_points(s, d), [boxes(s, d, "grade = 0")], 0.5)),
    "qa_neighbour_areas": lambda s, d: flat(R.qa_neighbour_areas(boxes(s, d), fields=["grade"]), "other_oid"),
    "qa_no_gaps": lambda s, d: flat(R.qa_no_gaps(_frames(s, d), max_area=2.0), "value"),
    "qa_point_not_near": lambda s, d: flat(P.qa_point_not_near(points(s, d), [points(s, d)], 1.25, allow_coincident=True), "other_oid"),
    "qa_point_not_near_expression": lambda s, d: flat(P.qa_point_not_near(points(s, d), [boxes(s, d)], 2.0, "c_nationkey % 2 * 0.5", "grade * 0.25"), "other_oid"),
    "qa_point_on_line": lambda s, d: flat(P.qa_point_on_line(points(s, d), [lines(s, d)], 0.25)),
    "qa_min_node_distance": lambda s, d: flat(N.qa_min_node_distance([lines(s, d)], 0.8), "other_oid", "value"),
    "qa_node_line_coincidence": lambda s, d: flat(P.qa_node_line_coincidence(points(s, d), [lines(s, d)], 0.75), "value"),
    "qa_not_near": lambda s, d: flat(P.qa_not_near(lines(s, d, "oid % 2 = 0"), lines(s, d, "oid % 2 = 1"), 1.0, 1.9), "other_oid", "value", "value2"),
    "qa_part_coincidence_self": lambda s, d: flat(P.qa_part_coincidence_self(lines(s, d), 1.0, 2.5), "other_oid"),
    "qa_part_coincidence_other": lambda s, d: flat(P.qa_part_coincidence_other(lines(s, d, "z < 3"), lines(s, d, "z >= 3"), 1.0, 2.5), "other_oid"),
    "qa_full_coincidence": lambda s, d: flat(P.qa_full_coincidence(lines(s, d, "z = 0"), [lines(s, d, "z > 0")], 0.0), "value"),
    "qa_topo_not_near": lambda s, d: flat(P.qa_topo_not_near(lines(s, d), lines(s, d), "0.5 + z * 0.0", 2.0, 2.0, 0.5), "other_oid"),
    "qa_topo_not_near_poly_factory": lambda s, d: flat(P.qa_topo_not_near(lines(s, d, "z < 2"), T.tr_polygon_to_line(boxes(s, d)), 0.5, 3.0, 3.0, 0.5).unionByName(R.qa_intersects_other([lines(s, d, "z < 2")], [boxes(s, d)], "G2.grade > 0")), "other_oid"),
    "qa_vertex_coincidence": lambda s, d: flat(P.qa_vertex_coincidence(lines(s, d), 3.5), "value"),
    "qa_vertex_coincidence_self": lambda s, d: flat(P.qa_vertex_coincidence_self(lines(s, d), 0.8), "other_oid", "value"),
    "qa_vertex_coincidence_other": lambda s, d: flat(P.qa_vertex_coincidence_other([points(s, d)], [points(s, d, "c_nationkey % 2 = 0")], 1.2), "value"),
    "qa_measures_at_points": lambda s, d: flat(P.qa_measures_at_points(points(s, d), [measured(s, d)], "c_nationkey % 4", 0.75, 1.0, require_line=True), "value"),
    "expression_based_distance_provider": lambda s, d: P.with_distance(points(s, d), "c_nationkey % 2 * 0.5 + 1").df.select("oid", "near"),
    "qa_dangle_count": lambda s, d: flat(N.qa_dangle_count([streets(s, d)], "_DangleCount < 1"), "value"),
    "qa_dangle_factory": lambda s, d: N.qa_dangles([streets(s, d)]).select("issue_code", "geom"),
    "qa_orphan_node": lambda s, d: flat(N.qa_orphan_node([junctions(s, d)], [streets(s, d)]), "tab"),
    "qa_pseudo_nodes": lambda s, d: flat(N.qa_pseudo_nodes([streets(s, d)], ["c_mktsegment"]), "other_oid"),
    "qa_flow_logic": lambda s, d: N.qa_flow_logic([streets(s, d)], "c_nationkey > 20").select("issue_code", "geom"),
    "qa_connections": lambda s, d: N.qa_connections([streets(s, d)], [["_StartsIn"], ["NOT _StartsIn AND c_nationkey > 3"]], fields=["c_nationkey"]).select("issue_code", "geom"),
    "qa_line_connection": lambda s, d: N.qa_connections([streets(s, d), junctions(s, d)], [["", None], ["_StartsIn", ""]]).select("issue_code", "geom"),
    "qa_line_connection_field_values": lambda s, d: N.qa_line_connection_field_values([streets(s, d)], "c_mktsegment").select("issue_code", "geom"),
    "qa_min_angle": lambda s, d: flat(N.qa_min_angle([streets(s, d)], 1.0), "other_oid"),
    "qa_group_connected": lambda s, d: flat(N.qa_group_connected(streets(s, d), ["c_mktsegment"]), "no_oid", "value", "value2"),
    "qa_rel_group_connected": lambda s, d: flat(N.qa_group_connected(_joined_streets(s, d), ["n_name"]), "no_oid", "value"),
    "qa_line_group_constraints": lambda s, d: flat(N.qa_line_group_constraints(streets(s, d), ["c_mktsegment"], 3.0), "value"),
    "qa_rel_line_group_constraints": lambda s, d: flat(N.qa_line_group_constraints(_joined_streets(s, d), ["n_name"], 2.0, 0.5), "value"),
    "qa_gdb_topology": lambda s, d: flat(N.qa_gdb_topology(s.sql("select * from values ('streets', 5L, 'must not overlap', false), ('streets', 7L, 'must not dangle', true) as t(tab, oid, rule, dirty)"))),
    "clustering": lambda s, d: N.clusters(points(s, d), 0.6),
    "connected_components": lambda s, d: _components(s, d),
    "shortest_path": lambda s, d: N.shortest_paths(_street_edges(s, d), 0),
    "shortest_path_to_goal": _path_to_goal,
    "related_geometry": _related,
    "polygon_building": lambda s, d: N.polygons_of_lines(walls(s, d)).select("comp", F.round(G.ring_area(F.transform("ring", lambda p: G.vertex(p["x"], p["y"]))), 6).alias("area")),
    "qa_centroids": lambda s, d: flat(N.qa_centroids(walls(s, d), seeds(s, d)), "value"),
    "qa_border_sense": lambda s, d: flat(N.qa_border_sense(walls(s, d))),
    "tr_get_nodes": _nodes,
    "tr_spatial_join": lambda s, d: T.tr_spatial_join(boxes(s, d), points(s, d), "T1.c_acctbal > 0").df.select("oid", "points_oid", "c_nationkey"),
    "tr_spatial_join_grouped": lambda s, d: T.tr_spatial_join(boxes(s, d), points(s, d), outer=True, grouped=True, attributes=["COUNT(ObjectID) AS n", "SUM(c_nationkey) AS total"]).df.select("oid", "n", "total"),
    "tr_intersect": lambda s, d: T.tr_intersect(boxes(s, d), boxes(s, d), 2).select("oid", "other", F.round("part_intersected", 6).alias("part"), F.round("intersection_ratio", 6).alias("ratio")),
    "tr_dissolve": lambda s, d: T.tr_dissolve(boxes(s, d, "p_size < 10"), ["grade"], ["SUM(p_size) AS total"]).select("oid", "grade", "n_merged", "total", F.round(G.area(F.col("geom")), 6).alias("area")),
    "tr_geometry_to_points": lambda s, d: T.tr_geometry_to_points(boxes(s, d)).select("oid", "part_index", "vertex_index", F.col("geom.parts")[0][0]["x"].alias("x")),
    "tr_multiline_to_line": lambda s, d: T.tr_multiline_to_line(boxes(s, d)).select("oid", "part_index", F.round(G.length(F.col("geom")), 6).alias("len")),
    "tr_multipolygon_to_polygon": lambda s, d: _single(s, d),
    "tr_polygon_to_line": lambda s, d: T.tr_polygon_to_line(boxes(s, d)).df.select("oid", F.col("geom.kind").alias("kind"), F.round(G.length(F.col("geom")), 6).alias("len")),
    "tr_line_to_polygon": lambda s, d: T.tr_line_to_polygon(T.tr_polygon_to_line(boxes(s, d))).df.select("oid", F.round(G.area(F.col("geom")), 6).alias("area")),
    "tr_footprint": lambda s, d: T.tr_footprint(boxes(s, d)).df.select("oid", F.round(G.area(F.col("geom")), 6).alias("area")),
    "tr_project": lambda s, d: T.tr_project(T.tr_project(points(s, d), "EPSG:4326"), "EPSG:3857").df.select("oid", F.round(F.col("geom.parts")[0][0]["x"], 4).alias("x"), F.round(F.col("geom.parts")[0][0]["y"], 4).alias("y")),
    "tr_only_intersecting_features": lambda s, d: T.tr_only_intersecting(points(s, d), boxes(s, d, "grade = 0")).df.select("oid"),
    "tr_only_disjoint_features": lambda s, d: T.tr_only_disjoint(points(s, d), boxes(s, d, "grade = 0")).df.select("oid"),
    "tr_only_contained_features": lambda s, d: T.tr_only_contained(points(s, d), boxes(s, d, "grade = 0")).df.select("oid"),
    "tr_combined_filter": lambda s, d: (lambda p: T.tr_combined_filter(p, {"near": T.tr_only_intersecting(p, boxes(s, d, "grade = 0")), "rich": Table(p.df, p.name, "oid", "geom", "c_acctbal > 5000")}, "near OR NOT rich").df.select("oid"))(points(s, d)),
    "rf_execute_area": lambda s, d: T.rf_execute_area(points(s, d), boxes(s, d, "grade = 1")).df.select("oid"),
    "if_all": lambda s, d: flat(T.if_all(_issues_of(s, d), suppress=False).unionByName(T.if_all(_issues_of(s, d)))),
    "if_intersecting": lambda s, d: flat(T.if_intersecting(_placed(s, d), boxes(s, d, "grade = 1"))),
    "if_within": lambda s, d: flat(T.if_within(_placed(s, d), boxes(s, d, "grade = 2"))),
    "if_near": lambda s, d: flat(T.if_near(_placed(s, d), boxes(s, d, "grade = 3"), 1.0)),
    "if_involved_rows": lambda s, d: flat(T.if_involved_rows(_issues_of(s, d), "c_nationkey < 10", [points(s, d)])),
    "wkb": _wkb,
}


def _components_of(s, d):
    g = F.col("geom")
    c = G.component(g, "centroid")["parts"][0][0]
    return boxes(s, d).df.select("oid", F.round(c["x"], 6).alias("cx"), F.round(c["y"], 6).alias("cy"), *[F.size(G.points(G.component(g, n))).alias(f"n_{n}") for n in ("boundary", "vertices", "interior_vertices", "line_end_points", "label_point")])


def _joined_points(s, d) -> Table:
    p, n = points(s, d), table(s, d, "nation").df
    return Table(p.df.join(n, p.df.c_nationkey == n.n_nationkey), "points", "oid", "geom", "n_regionkey = 1")


def _joined_streets(s, d) -> Table:
    p, n = streets(s, d), table(s, d, "nation").df
    return Table(p.df.join(n, p.df.c_nationkey == n.n_nationkey), "streets", "oid", "geom")


def _frames(s, d) -> Table:
    """Four boxes round a hole per part: a hole of the width of the size modulo 3 plus 1, one high."""
    p = table(s, d, "part").df.select("p_partkey", (F.col("p_size") % 3 + 1).cast("double").alias("w"), (F.col("p_partkey") * 10.0).alias("x"))
    x, w = F.col("x"), F.col("w")
    made = F.array(G.box(x, F.lit(0), x + w + 1, F.lit(1)), G.box(x, F.lit(1), x + 1, F.lit(2)), G.box(x + w + 1, F.lit(0), x + w + 2, F.lit(2)), G.box(x, F.lit(2), x + w + 2, F.lit(3)))
    return Table(p.select("p_partkey", F.posexplode(made).alias("k", "geom")).select((F.col("p_partkey") * 4 + F.col("k")).alias("oid"), "geom"), "frames", "oid", "geom")


def _components(s, d):
    c = table(s, d, "customer").df
    edges = c.select((F.col("c_custkey") * 2).alias("a"), (F.floor(F.col("c_acctbal") / 500) * 2 + 1).cast("bigint").alias("b"))
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    return N.connected(nodes, edges)


def _single(s, d):
    return T.tr_multipolygon_to_polygon(part_boxes(s, d)).select("oid", "polygon_index", F.size("geom.parts").alias("n_rings"), F.round(G.area(F.col("geom")), 6).alias("area"))


W = f"""WITH bx AS (SELECT p_partkey AS oid, p_size, p_brand, p_size % 4 AS grade, p_partkey % 40 + {BLOCK.format(k='p_partkey')} AS x0, floor(p_retailprice) % 20 AS y0, p_partkey % 40 + {BLOCK.format(k='p_partkey')} + 1 + p_size % 3 AS x1, floor(p_retailprice) % 20 + 1 + p_partkey % 2 AS y1 FROM part),
pt AS (SELECT c_custkey AS oid, c_nationkey, c_acctbal, c_custkey % 40 + 0.5 * (c_nationkey % 2) + {BLOCK.format(k='c_custkey')} AS x, c_nationkey % 20 AS y FROM customer),
ln AS (SELECT c_custkey AS oid, c_custkey % 7 AS z, c_custkey % 2 = 0 AS h, c_custkey % 40 + {BLOCK.format(k='c_custkey')} AS x, c_nationkey % 20 AS y FROM customer),
lx AS (SELECT oid, z, h, CASE WHEN h THEN x ELSE x + 0.5 END AS x0, CASE WHEN h THEN y + 0.5 ELSE y END AS y0, CASE WHEN h THEN x + 3 ELSE x + 0.5 END AS x1, CASE WHEN h THEN y + 0.5 ELSE y + 3 END AS y1 FROM ln),
st AS (SELECT c_custkey AS oid, c_mktsegment, c_nationkey, c_custkey % 20 + {BLOCK.format(k='c_custkey')} AS x, c_nationkey % 10 AS y, c_custkey % 3 = 0 AS n FROM customer),
nd AS (SELECT oid, c_mktsegment, c_nationkey, n, true AS s, x, y FROM st UNION ALL SELECT oid, c_mktsegment, c_nationkey, n, false, CASE WHEN n THEN x ELSE x + 1 END, CASE WHEN n THEN y + 1 ELSE y END FROM st),
jn AS (SELECT s_suppkey AS oid, s_suppkey % 20 + {BLOCK.format(k='s_suppkey')} AS x, s_nationkey % 10 AS y FROM supplier)"""
MEET = "a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1"
INNER = "a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"
IN_A = "a.x0 >= b.x0 AND a.x1 <= b.x1 AND a.y0 >= b.y0 AND a.y1 <= b.y1"
IN_B = "b.x0 >= a.x0 AND b.x1 <= a.x1 AND b.y0 >= a.y0 AND b.y1 <= a.y1"
PIN = "p.x > b.x0 AND p.x < b.x1 AND p.y > b.y0 AND p.y < b.y1"
PON = "p.x >= b.x0 AND p.x <= b.x1 AND p.y >= b.y0 AND p.y <= b.y1"
CROSS = "a.h AND NOT b.h AND b.x0 > a.x0 AND b.x0 < a.x1 AND a.y0 > b.y0 AND a.y0 < b.y1"
PD = "sqrt(greatest(b.x0 - p.x, p.x - b.x1, 0) ** 2 + greatest(b.y0 - p.y, p.y - b.y1, 0) ** 2)"
POINT = "'POINT(' || CAST(CAST(x AS DOUBLE) AS VARCHAR) || ' ' || CAST(CAST(y AS DOUBLE) AS VARCHAR) || ')'"


def _boxes(code: str, condition: str, extra: str = "a.oid < b.oid", a: str = "bx", b: str = "bx") -> str:
    return f"{W} SELECT '{code}' AS issue_code, a.oid, b.oid AS other_oid FROM {a} a JOIN {b} b ON {extra} AND {condition}"


def _crossed(code: str, condition: str) -> str:
    return f"{W} SELECT '{code}' AS issue_code, least(a.oid, b.oid) AS oid, greatest(a.oid, b.oid) AS other_oid FROM lx a JOIN lx b ON {CROSS} AND {condition}"


def _no_point(code: str, condition: str, boxes_where: str = "true", points_where: str = "true") -> str:
    return f"{W} SELECT '{code}' AS issue_code, p.oid FROM pt p WHERE {points_where} AND NOT EXISTS (SELECT 1 FROM bx b WHERE {boxes_where} AND {condition})"


def _ends(code: str) -> str:
    """Pairs of line ends of different lines nearer than 0.8, apart from equal ones."""
    return f"""{W}, e AS (SELECT oid, x0 AS x, y0 AS y FROM lx UNION ALL SELECT oid, x1, y1 FROM lx), q AS (SELECT a.oid, b.oid AS other_oid, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM e a JOIN e b ON a.oid < b.oid AND abs(a.x - b.x) < 1 AND abs(a.y - b.y) < 1)
        SELECT '{code}' AS issue_code, oid, other_oid, CAST(CAST(round(d, 9) AS DOUBLE) AS VARCHAR) AS value FROM q WHERE d > 0 AND d < 0.8"""


#: a and b run side by side or shifted along each other by 1, at lengths of 3.
ALONG = "a.h = b.h AND ((CASE WHEN a.h THEN a.y0 - b.y0 ELSE a.x0 - b.x0 END = 0 AND abs(CASE WHEN a.h THEN a.x0 - b.x0 ELSE a.y0 - b.y0 END) = 1) OR (abs(CASE WHEN a.h THEN a.y0 - b.y0 ELSE a.x0 - b.x0 END) = 1 AND CASE WHEN a.h THEN a.x0 - b.x0 ELSE a.y0 - b.y0 END = 0))"

#: Streets that reach each other over shared ends inside their group; reached(oid, c) has the lines from which each can be reached.
def _street_groups(field: str) -> str:
    streets = W.replace("WITH", "WITH RECURSIVE", 1)
    return f"""{streets}, gr AS (SELECT nd.*, {field} AS g FROM nd JOIN nation ON n_nationkey = c_nationkey), link AS (SELECT DISTINCT a.oid AS a, b.oid AS b FROM gr a JOIN gr b ON a.x = b.x AND a.y = b.y AND a.g = b.g),
        reached(oid, c) AS (SELECT oid, oid FROM st UNION SELECT link.b, reached.c FROM reached JOIN link ON reached.oid = link.a), comp AS (SELECT oid, min(c) AS c FROM reached GROUP BY oid), named AS (SELECT DISTINCT oid, g, c FROM gr JOIN comp USING (oid))"""


def _groups_apart(field: str, extra: str = "") -> str:
    return f"{_street_groups(field)} SELECT 'GroupConnected.GroupNotConnected' AS issue_code, g AS value{extra} FROM named GROUP BY g HAVING count(DISTINCT c) > 1"


def _short_groups(field: str, least: float) -> str:
    return f"{_street_groups(field)} SELECT 'LineGroupConstraints.GroupTooShort' AS issue_code, c AS oid, CAST(CAST(count(*) AS DOUBLE) AS VARCHAR) AS value FROM named GROUP BY g, c HAVING count(*) < {least}"


#: Boxes as unit squares: all their coordinates are whole numbers.
CELLS = f"{W}, cell AS (SELECT oid, grade, p_size, CAST(unnest(generate_series(CAST(x0 AS BIGINT), CAST(x1 AS BIGINT) - 1)) AS BIGINT) AS i, y0, y1 FROM bx), sq AS (SELECT oid, grade, p_size, i, unnest(generate_series(CAST(y0 AS BIGINT), CAST(y1 AS BIGINT) - 1)) AS j FROM cell)"

ORACLES: dict[str, str] = {
    "qa_group_connected": _groups_apart("c_mktsegment", ", CAST(count(DISTINCT c) AS VARCHAR) AS value2"),
    "qa_rel_group_connected": _groups_apart("n_name"),
    "qa_line_group_constraints": _short_groups("c_mktsegment", 3),
    "qa_rel_line_group_constraints": _short_groups("n_name", 2),
    "qa_is_covered_by_other": f"""{CELLS}, own AS (SELECT oid, i, j, EXISTS (SELECT 1 FROM sq o WHERE o.grade > 0 AND o.i = sq.i AND o.j = sq.j) AS covered FROM sq WHERE grade = 0),
        met AS (SELECT DISTINCT a.oid FROM bx a JOIN bx b ON a.grade = 0 AND b.grade > 0 AND {MEET}), r AS (SELECT oid, round(100 * count(*) FILTER (NOT covered) / count(*), 6) AS rest FROM own GROUP BY oid)
        SELECT CASE WHEN met.oid IS NULL THEN 'IsCoveredByOther.NotCoveredByAnyFeature' ELSE 'IsCoveredByOther.NotFullyCovered' END AS issue_code, r.oid, CASE WHEN met.oid IS NOT NULL THEN CAST(CAST(rest AS DOUBLE) AS VARCHAR) END AS value
        FROM r LEFT JOIN met ON r.oid = met.oid WHERE met.oid IS NULL OR rest > 50""",
    "tr_dissolve": f"""{CELLS.replace("WITH", "WITH RECURSIVE", 1)}, b10 AS (SELECT * FROM bx WHERE p_size < 10),
        link AS (SELECT a.oid AS a, b.oid AS b FROM b10 a JOIN b10 b ON a.grade = b.grade AND {MEET} AND (least(a.x1, b.x1) > greatest(a.x0, b.x0) OR least(a.y1, b.y1) > greatest(a.y0, b.y0))),
        reached(oid, c) AS (SELECT oid, oid FROM b10 UNION SELECT link.b, reached.c FROM reached JOIN link ON reached.oid = link.a), comp AS (SELECT oid, min(c) AS c FROM reached GROUP BY oid),
        size AS (SELECT c, count(DISTINCT (i, j)) AS area FROM sq JOIN comp USING (oid) GROUP BY c)
        SELECT c AS oid, grade, count(*) AS n_merged, CAST(sum(p_size) AS BIGINT) AS total, CAST(any_value(area) AS DOUBLE) AS area FROM b10 JOIN comp USING (oid) JOIN size USING (c) GROUP BY c, grade""",
    "shortest_path": f"""{W.replace("WITH", "WITH RECURSIVE", 1)}, e AS (SELECT CAST(a.x * 1000 + a.y AS BIGINT) AS a, CAST(b.x * 1000 + b.y AS BIGINT) AS b FROM nd a JOIN nd b ON a.oid = b.oid AND a.s <> b.s),
        way(node, cost) AS (SELECT 0::BIGINT, 0 UNION SELECT e.b, cost + 1 FROM way JOIN e ON way.node = e.a WHERE cost < 300) SELECT node, CAST(min(cost) AS DOUBLE) AS cost FROM way GROUP BY node""",
    "shortest_path_to_goal": f"""{W.replace("WITH", "WITH RECURSIVE", 1)}, e AS (SELECT CAST(a.x * 1000 + a.y AS BIGINT) AS a, CAST(b.x * 1000 + b.y AS BIGINT) AS b FROM nd a JOIN nd b ON a.oid = b.oid AND a.s <> b.s),
        way(node, cost) AS (SELECT 0::BIGINT, 0 UNION SELECT e.b, cost + 1 FROM way JOIN e ON way.node = e.a WHERE cost < 300) SELECT node, CAST(min(cost) AS DOUBLE) AS cost FROM way WHERE node = 5002 GROUP BY node""",
    "related_geometry": f"{W} SELECT o_orderkey AS oid, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM orders LEFT JOIN pt ON o_custkey = oid AND c_acctbal > 0 WHERE NOT o_totalprice < 300000",
    # collinear lines: a stretch reaches half a unit beyond the other's ends; a crossing gives one unit exactly, which is no more than the least
    "qa_topo_not_near": f"""{W} SELECT 'TopoNotNear.PartTooClose' AS issue_code, a.oid, b.oid AS other_oid FROM lx a JOIN lx b ON a.oid <> b.oid AND a.h = b.h AND CASE WHEN a.h THEN a.y0 = b.y0 AND least(a.x1, b.x1 + 0.5) - greatest(a.x0, b.x0 - 0.5) > 1 ELSE a.x0 = b.x0 AND least(a.y1, b.y1 + 0.5) - greatest(a.y0, b.y0 - 0.5) > 1 END""",
    # all coordinates are multiples of a half: a half unit of a line is near a border or not as its middle is
    "qa_topo_not_near_poly_factory": f"""{W}, part AS (SELECT oid, h, x0, y0, unnest(generate_series(0, 5)) AS k FROM lx WHERE z < 2), mid AS (SELECT oid, k, CASE WHEN h THEN x0 + k / 2.0 + 0.25 ELSE x0 END AS x, CASE WHEN h THEN y0 ELSE y0 + k / 2.0 + 0.25 END AS y FROM part),
        near AS (SELECT p.oid, b.oid AS other_oid, k, k - row_number() OVER (PARTITION BY p.oid, b.oid ORDER BY k) AS run FROM mid p JOIN bx b ON CASE WHEN {PON} THEN least(p.x - b.x0, b.x1 - p.x, p.y - b.y0, b.y1 - p.y) ELSE {PD} END <= 0.5)
        SELECT 'TopoNotNear.PartTooClose' AS issue_code, oid, other_oid FROM near GROUP BY oid, other_oid, run HAVING count(*) > 3
        UNION ALL SELECT 'IntersectsOther.GeometriesIntersect.ConstraintNotFulfilled', a.oid, b.oid FROM lx a JOIN bx b ON a.z < 2 AND b.grade = 0 AND {MEET}""",
    "qa_intersects_self": _boxes("IntersectsSelf.GeometriesIntersect.ConstraintNotFulfilled", f"{MEET} AND a.grade <> b.grade"),
    "qa_intersects_self_geometry": _boxes("IntersectsSelf.GeometriesIntersect", f"{INNER} AND (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) > 1.5"),
    "qa_intersects_other_boundary": f"{W} SELECT 'IntersectsOther.GeometriesIntersect' AS issue_code, b.oid, p.oid AS other_oid FROM bx b JOIN pt p ON {PON} AND NOT ({PIN})",
    "geometry_components": f"{W} SELECT oid, (x0 + x1) / 2e0 AS cx, (y0 + y1) / 2e0 AS cy, 5 AS n_boundary, 5 AS n_vertices, 3 AS n_interior_vertices, 2 AS n_line_end_points, 1 AS n_label_point FROM bx",
    "qa_intersects_other": f"{W} SELECT 'IntersectsOther.GeometriesIntersect' AS issue_code, b.oid, p.oid AS other_oid FROM bx b JOIN pt p ON {PON}",
    "qa_interior_intersects_self": _boxes("InteriorIntersectsSelf.InteriorsIntersect", INNER),
    "qa_interior_intersects_other": f"{W} SELECT 'InteriorIntersectsOther.InteriorsIntersect.ConstraintNotFulfilled' AS issue_code, b.oid, p.oid AS other_oid FROM bx b JOIN pt p ON {PIN} AND NOT p.c_acctbal < 0",
    "qa_crosses_self": _crossed("CrossesSelf.GeometriesCross", "true"),
    "qa_crosses_other": _boxes("CrossesOther.GeometriesCross", f"{INNER.replace('<', '<')} AND NOT ({IN_A})", "true", "lx", "bx"),
    "qa_overlaps_self": _boxes("OverlapsSelf.GeometriesOverlap", f"{INNER} AND NOT ({IN_A}) AND NOT ({IN_B})"),
    "qa_overlaps_other": _boxes("OverlapsOther.GeometriesOverlap", f"{INNER} AND NOT ({IN_A}) AND NOT ({IN_B}) AND a.grade = 1 AND b.grade = 2", "true"),
    "qa_touches_self": _boxes("TouchesSelf.GeometriesTouch", f"{MEET} AND NOT ({INNER})"),
    "qa_touches_other": f"{W} SELECT 'TouchesOther.GeometriesTouch.ConstraintNotFulfilled' AS issue_code, p.oid, b.oid AS other_oid FROM pt p JOIN bx b ON {PON} AND NOT ({PIN}) AND NOT p.c_acctbal > b.p_size * 100",
    "qa_intersection_matrix_self": _boxes("IntersectionMatrix.GeometriesIntersectWithMatrix", IN_A),
    "qa_intersection_matrix_other": f"{W} SELECT 'IntersectionMatrix.GeometriesIntersectWithMatrix' AS issue_code, p.oid, b.oid AS other_oid FROM pt p JOIN bx b ON {PIN}",
    "qa_intersection_matrix_disjoint": _no_point("IntersectionMatrix.NoIntersection", PON),
    "qa_duplicate_geometry_self": f"{W} SELECT 'DuplicateGeometrySelf.GeometriesEqualInXY' AS issue_code, a.oid, b.oid AS other_oid FROM pt a JOIN pt b ON a.x = b.x AND a.y = b.y AND a.oid < b.oid",
    "qa_duplicate_geometry_sets": f"{W} SELECT count(*) AS n, min(oid) AS oid FROM bx GROUP BY x0, y0, x1, y1 HAVING count(*) > 1",
    "qa_contains_other": f"""{W}, m AS (SELECT p.oid, bool_or(b.grade > 0) AS met FROM pt p JOIN bx b ON {PIN} GROUP BY 1)
        SELECT CASE WHEN met IS NULL THEN 'ContainsOther.NoContainingFeature' ELSE 'ContainsOther.ContainingFeatureConditionNotFulfilled' END AS issue_code, p.oid FROM pt p LEFT JOIN m USING (oid) WHERE met IS NULL OR NOT met""",
    "qa_contained_points_count": f"""{W}, c AS (SELECT b.oid, count(p.oid) AS n FROM bx b LEFT JOIN pt p ON {PON} GROUP BY 1)
        SELECT CASE WHEN n < 1 THEN 'ContainedPointsCount.TooFewPoints' ELSE 'ContainedPointsCount.TooManyPoints' END AS issue_code, oid, CAST(n AS VARCHAR) AS value FROM c WHERE n < 1 OR n > 2""",
    "qa_min_intersect": _boxes("MinIntersect.IntersectionTooSmall", f"{INNER} AND (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) < 1.5"),
    "qa_line_intersect_angle": _crossed("LineIntersectAngle.AngleTooSmall", "true"),
    "qa_line_intersect_z": f"{W} SELECT CASE WHEN abs(a.z - b.z) < 2 THEN 'LineIntersectZ.DifferenceTooSmall' ELSE 'LineIntersectZ.DifferenceTooLarge' END AS issue_code, least(a.oid, b.oid) AS oid, greatest(a.oid, b.oid) AS other_oid FROM lx a JOIN lx b ON {CROSS} AND (abs(a.z - b.z) < 2 OR abs(a.z - b.z) > 5)",
    "qa_z_difference_self": _boxes("ZDifference.TooSmall", f"{MEET} AND abs(a.z - b.z) < 3", a="lx", b="lx"),
    "qa_z_difference_other": _boxes("ZDifference.TooLarge", f"{MEET} AND a.z < 3 AND b.z >= 3 AND abs(a.z - b.z) > 4", "true", "lx", "lx"),
    "qa_must_intersect_other": _no_point("MustIntersectOther.NoIntersectingFeature", PON, "b.grade <> 0"),
    "qa_must_touch_other": f"{W} SELECT 'MustTouchOther.NoTouchingFeature' AS issue_code, a.oid FROM bx a WHERE NOT EXISTS (SELECT 1 FROM bx b WHERE b.grade = 3 AND {MEET} AND NOT ({INNER}))",
    "qa_must_touch_self": f"{W} SELECT 'MustTouchSelf.NoTouchingFeature' AS issue_code, a.oid FROM bx a WHERE NOT EXISTS (SELECT 1 FROM bx b WHERE b.grade = a.grade AND a.oid <> b.oid AND {MEET} AND NOT ({INNER}))",
    "qa_must_intersect_matrix_other": _no_point("MustIntersectMatrixOther.NoMatchingFeature", PIN),
    "qa_must_be_near_other": _no_point("MustBeNearOther.NoFeatureWithinDistance", f"{PD} <= 1.0", "b.grade = 0"),
    "qa_rel_must_be_near_other": _no_point("MustBeNearOther.NoFeatureWithinDistance", f"{PD} <= 0.5", "b.grade = 0", "p.c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)"),
    "qa_neighbour_areas": _boxes("NeighbourAreas.FieldValuesEqual", f"{MEET} AND NOT ({INNER}) AND NOT ((a.x1 = b.x0 OR b.x1 = a.x0) AND (a.y1 = b.y0 OR b.y1 = a.y0)) AND a.grade = b.grade"),
    "qa_no_gaps": "SELECT 'NoGaps.Gap' AS issue_code, p_partkey * 4 AS oid, CAST(CAST(p_size % 3 + 1 AS DOUBLE) AS VARCHAR) AS value FROM part WHERE p_size % 3 + 1 <= 2",
    "qa_point_not_near": f"{W} SELECT 'PointNotNear.PointTooClose' AS issue_code, a.oid, b.oid AS other_oid FROM pt a JOIN pt b ON a.oid <> b.oid AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 < 1.25 ** 2 AND NOT (a.x = b.x AND a.y = b.y)",
    "qa_point_not_near_expression": f"{W} SELECT 'PointNotNear.PointTooClose' AS issue_code, p.oid, b.oid AS other_oid FROM pt p JOIN bx b ON {PD} < p.c_nationkey % 2 * 0.5 + b.grade * 0.25",
    "qa_point_on_line": f"{W} SELECT 'PointOnLine.PointNotOnLine' AS issue_code, p.oid FROM pt p WHERE NOT EXISTS (SELECT 1 FROM lx b WHERE {PD} <= 0.25)",
    "qa_dangle_count": f"""{W}, g AS (SELECT x, y, count(*) AS n FROM nd GROUP BY 1, 2), c AS (SELECT oid, count(*) FILTER (g.n = 1) AS k FROM nd JOIN g USING (x, y) GROUP BY 1)
        SELECT 'DangleCount.DangleCountNotExpected' AS issue_code, oid, CAST(k AS VARCHAR) AS value FROM c WHERE k >= 1""",
    "qa_dangle_factory": f"{W} SELECT 'Connections.Dangle' AS issue_code, {POINT} AS geom FROM nd GROUP BY x, y HAVING count(*) = 1",
    "qa_orphan_node": f"""{W} SELECT 'OrphanNode.OrphanNode' AS issue_code, oid, 'junctions' AS tab FROM jn WHERE NOT EXISTS (SELECT 1 FROM nd WHERE nd.x = jn.x AND nd.y = jn.y)
        UNION ALL SELECT 'OrphanNode.MissingNode', oid, 'streets' FROM nd WHERE NOT EXISTS (SELECT 1 FROM jn WHERE nd.x = jn.x AND nd.y = jn.y)""",
    "qa_pseudo_nodes": f"{W} SELECT 'PseudoNodes.PseudoNode' AS issue_code, min(oid) AS oid, max(oid) AS other_oid FROM nd GROUP BY x, y HAVING count(*) = 2 AND count(DISTINCT c_mktsegment) = 1",
    "qa_flow_logic": f"{W} SELECT CASE WHEN count(*) FILTER (s <> (c_nationkey > 20)) = 0 THEN 'FlowLogic.NoOutgoingLine' ELSE 'FlowLogic.MultipleOutgoingLines' END AS issue_code, {POINT} AS geom FROM nd GROUP BY x, y HAVING count(*) FILTER (s <> (c_nationkey > 20)) <> 1",
    "qa_connections": f"{W} SELECT 'Connections.NoRuleFulfilled' AS issue_code, {POINT} AS geom FROM nd GROUP BY x, y HAVING NOT (bool_and(s) OR bool_and(NOT s AND c_nationkey > 3))",
    "qa_line_connection": f"""{W}, al AS (SELECT x, y, s, false AS j FROM nd UNION ALL SELECT x, y, false, true FROM jn)
        SELECT 'Connections.NoRuleFulfilled' AS issue_code, {POINT} AS geom FROM al GROUP BY x, y HAVING NOT (bool_and(NOT j) OR bool_and(j OR s))""",
    "qa_line_connection_field_values": f"{W} SELECT 'LineConnectionFieldValues.all_equal' AS issue_code, {POINT} AS geom FROM nd GROUP BY x, y HAVING count(*) > 1 AND count(DISTINCT c_mktsegment) > 1",
    "tr_get_nodes": f"{W} SELECT min(oid * 2 + CASE WHEN s THEN 0 ELSE 1 END) AS node_oid, count(c_mktsegment) AS n, min(c_nationkey) AS least, count(*) AS n_ends FROM nd GROUP BY x, y",
    "tr_spatial_join": f"{W} SELECT b.oid, p.oid AS points_oid, p.c_nationkey FROM bx b JOIN pt p ON {PON} AND p.c_acctbal > 0",
    "tr_spatial_join_grouped": f"{W} SELECT b.oid, nullif(count(p.oid), 0) AS n, CAST(sum(p.c_nationkey) AS BIGINT) AS total FROM bx b LEFT JOIN pt p ON {PON} GROUP BY b.oid",
    "tr_intersect": f"""{W} SELECT a.oid, b.oid AS other, round((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)), 6) AS part,
        round((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / ((a.x1 - a.x0) * (a.y1 - a.y0)), 6) AS ratio FROM bx a JOIN bx b ON b.oid < a.oid AND {INNER}""",
    "tr_geometry_to_points": f"{W} SELECT oid, 0 AS part_index, k AS vertex_index, CASE WHEN k IN (0, 1, 4) THEN x0 ELSE x1 END AS x FROM bx, (VALUES (0), (1), (2), (3), (4)) v(k)",
    "tr_multiline_to_line": f"{W} SELECT oid, 0 AS part_index, 2.0 * (x1 - x0 + y1 - y0) AS len FROM bx",
    "tr_polygon_to_line": f"{W} SELECT oid, 'line' AS kind, 2.0 * (x1 - x0 + y1 - y0) AS len FROM bx",
    "tr_line_to_polygon": f"{W} SELECT oid, (x1 - x0) * (y1 - y0) * 1.0 AS area FROM bx",
    "tr_footprint": f"{W} SELECT oid, (x1 - x0) * (y1 - y0) * 1.0 AS area FROM bx",
    "tr_project": f"{W} SELECT oid, x, CAST(y AS DOUBLE) AS y FROM pt",
    "tr_multipolygon_to_polygon": """WITH p AS (SELECT p_partkey AS oid, CAST(p_size AS DOUBLE) AS w, 1.0 + p_partkey % 4 AS h, p_partkey % 2 = 0 AS i, p_partkey % 3 = 0 AS b FROM part)
        SELECT oid, 0 AS polygon_index, CASE WHEN i THEN 2 ELSE 1 END AS n_rings, round(w * h * CASE WHEN i THEN 15 / 16.0 ELSE 1 END, 6) AS area FROM p UNION ALL SELECT oid, 1, 1, w * h FROM p WHERE b""",
    "tr_only_intersecting_features": f"{W} SELECT oid FROM pt p WHERE EXISTS (SELECT 1 FROM bx b WHERE b.grade = 0 AND {PON})",
    "tr_only_disjoint_features": f"{W} SELECT oid FROM pt p WHERE NOT EXISTS (SELECT 1 FROM bx b WHERE b.grade = 0 AND {PON})",
    "tr_only_contained_features": f"{W} SELECT oid FROM pt p WHERE EXISTS (SELECT 1 FROM bx b WHERE b.grade = 0 AND {PIN})",
    "tr_combined_filter": f"{W} SELECT oid FROM pt p WHERE NOT p.c_acctbal > 5000 OR EXISTS (SELECT 1 FROM bx b WHERE b.grade = 0 AND {PON})",
    "rf_execute_area": f"{W} SELECT oid FROM pt p WHERE EXISTS (SELECT 1 FROM bx b WHERE b.grade = 1 AND {PIN})",
    "if_all": "SELECT 'Constraints.ConstraintNotFulfilled' AS issue_code, c_custkey AS oid FROM customer WHERE NOT c_acctbal > 1000",
    "if_intersecting": _no_point("Constraints.ConstraintNotFulfilled", PON, "b.grade = 1", "NOT p.c_acctbal > 1000"),
    "if_within": _no_point("Constraints.ConstraintNotFulfilled", PON, "b.grade = 2", "NOT p.c_acctbal > 1000"),
    "if_near": _no_point("Constraints.ConstraintNotFulfilled", f"{PD} < 1", "b.grade = 3", "NOT p.c_acctbal > 1000"),
    "if_involved_rows": "SELECT 'Constraints.ConstraintNotFulfilled' AS issue_code, c_custkey AS oid FROM customer WHERE NOT c_acctbal > 1000 AND NOT c_nationkey < 10",
    "qa_measures_at_points": f"""{W}, m AS (SELECT p.oid, min({{'d': {PD}, 'm': CASE WHEN b.h THEN least(greatest(p.x - b.x0, 0), 3) ELSE least(greatest(p.y - b.y0, 0), 3) END}}) AS hit FROM pt p JOIN lx b ON {PD} <= 0.75 GROUP BY 1)
        SELECT CASE WHEN hit IS NULL THEN 'MeasuresAtPoints.NoLineWithinDistance' ELSE 'MeasuresAtPoints.UnexpectedMValue' END AS issue_code, oid, CAST(CAST(hit.m AS DOUBLE) AS VARCHAR) AS value
        FROM pt LEFT JOIN m USING (oid) WHERE hit IS NULL OR abs(hit.m - c_nationkey % 4) > 1""",
    "expression_based_distance_provider": "SELECT c_custkey AS oid, c_nationkey % 2 * 5e-1 + 1 AS near FROM customer",
    "qa_part_coincidence_self": _boxes("PartCoincidence.PartNotCoincident", ALONG, "a.oid < b.oid", "lx", "lx"),
    "qa_part_coincidence_other": _boxes("PartCoincidence.PartNotCoincident", ALONG, "a.z < 3 AND b.z >= 3", "lx", "lx"),
    "qa_full_coincidence": f"""{W}, u AS (SELECT a.oid, k, EXISTS (SELECT 1 FROM lx b WHERE b.z > 0 AND a.h = b.h AND CASE WHEN a.h THEN a.y0 = b.y0 AND b.x0 <= a.x0 + k AND b.x1 >= a.x0 + k + 1 ELSE a.x0 = b.x0 AND b.y0 <= a.y0 + k AND b.y1 >= a.y0 + k + 1 END) AS met
        FROM lx a, (VALUES (0), (1), (2)) v(k) WHERE a.z = 0) SELECT 'FullCoincidence.PartNotNearReference' AS issue_code, oid, CAST(CAST(count(*) AS DOUBLE) AS VARCHAR) AS value FROM u WHERE NOT met GROUP BY oid""",
    "qa_vertex_coincidence_other": f"""{W}, m AS (SELECT p.oid, min(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2)) AS d FROM pt p JOIN pt q ON q.c_nationkey % 2 = 0 AND (p.x - q.x) ** 2 + (p.y - q.y) ** 2 <= 1.2 ** 2 GROUP BY 1)
        SELECT 'VertexCoincidence.NearbyVertexNotCoincident' AS issue_code, oid, CAST(CAST(round(d, 9) AS DOUBLE) AS VARCHAR) AS value FROM m WHERE d > 0""",
    "qa_gdb_topology": "SELECT * FROM (VALUES ('GdbTopology.RuleViolated', 5::BIGINT), ('GdbTopology.DirtyArea', 7::BIGINT)) t(issue_code, oid)",
    "clustering": f"""{W.replace('WITH bx', 'WITH RECURSIVE bx')}, e AS (SELECT a.oid AS a, b.oid AS b FROM pt a JOIN pt b ON a.oid <> b.oid AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 0.6 ** 2), r(oid, c) AS (SELECT oid, oid FROM pt UNION SELECT e.b, r.c FROM r JOIN e ON r.oid = e.a)
        SELECT oid, min(c) AS cluster FROM r GROUP BY oid""",
    "qa_not_near": f"""{W}, q AS (SELECT a.oid, b.oid AS other_oid, a.x0, a.x1, b.x0 AS vx, sqrt(1 - greatest(b.y0 - a.y0, a.y0 - b.y1, 0) ** 2) AS hw FROM lx a JOIN lx b ON a.h AND NOT b.h AND greatest(b.y0 - a.y0, a.y0 - b.y1, 0) <= 1 AND b.x0 BETWEEN a.x0 - 1 AND a.x1 + 1),
        t AS (SELECT oid, other_oid, greatest(x0, vx - hw) - x0 AS low, least(x1, vx + hw) - x0 AS high FROM q)
        SELECT 'NotNear.PartTooClose' AS issue_code, oid, other_oid, CAST(CAST(round(low, 6) AS DOUBLE) AS VARCHAR) AS value, CAST(CAST(round(high, 6) AS DOUBLE) AS VARCHAR) AS value2 FROM t WHERE high - low > 1.9""",
    "qa_line_intersect": _crossed("LineIntersect.LinesIntersect", "true"),
    "qa_min_node_distance": _ends("MinNodeDistance.NodeDistanceTooSmall"),
    "qa_vertex_coincidence_self": _ends("VertexCoincidence.NearbyVertexNotCoincident"),
    "qa_vertex_coincidence": "SELECT 'VertexCoincidence.NearbyVertexNotCoincident' AS issue_code, c_custkey AS oid, '3.0' AS value FROM customer",
    "qa_node_line_coincidence": f"""{W}, m AS (SELECT p.oid, min({PD}) AS d FROM pt p JOIN lx b ON {PD} <= 0.75 GROUP BY 1)
        SELECT 'NodeLineCoincidence.NodeTooCloseToLine' AS issue_code, oid, CAST(CAST(round(d, 9) AS DOUBLE) AS VARCHAR) AS value FROM m WHERE d > 0""",
    "qa_min_angle": f"{W} SELECT 'MinAngle.AngleTooSmall' AS issue_code, a.oid, b.oid AS other_oid FROM nd a JOIN nd b ON a.x = b.x AND a.y = b.y AND a.oid < b.oid AND a.s = b.s AND a.n = b.n",
    "connected_components": """WITH e AS (SELECT c_custkey * 2 AS a, CAST(floor(c_acctbal / 500) * 2 + 1 AS BIGINT) AS b FROM customer), c AS (SELECT b, least(b, min(a)) AS comp FROM e GROUP BY b)
        SELECT a AS node, comp FROM e JOIN c USING (b) UNION ALL SELECT b, comp FROM c""",
    "qa_centroids": """WITH n AS (SELECT n_nationkey AS k, n_nationkey % 4 AS p FROM nation WHERE n_nationkey % 5 <> 3)
        SELECT CASE p WHEN 0 THEN 'Centroids.NoCentroid' ELSE 'Centroids.MultipleCentroids' END AS issue_code, NULL AS oid, CAST(least(p, 2) AS VARCHAR) AS value FROM n WHERE p <> 1
        UNION ALL SELECT 'Centroids.CentroidLiesOnBorder', k * 4 + 2, NULL FROM n WHERE p = 3""",
    "wkb": f"""{W} SELECT oid, 93 AS n_bytes, 'polygon' AS kind, CAST(x0 AS DOUBLE) AS xmin, CAST(y1 AS DOUBLE) AS ymax, CAST(NULL AS DOUBLE) AS zmax, 5 AS n FROM bx
        UNION ALL SELECT -oid, 57, 'line', x0, y1, z, 2 FROM lx""",
    "polygon_building": "SELECT n_nationkey * 4 AS comp, 1e0 AS area FROM nation WHERE n_nationkey % 5 <> 3",
    "qa_border_sense": """SELECT CASE n_nationkey % 5 WHEN 1 THEN 'BorderSense.InvertedOrientation' WHEN 2 THEN 'BorderSense.InconsistentOrientation' ELSE 'BorderSense.IncompleteLine' END AS issue_code, n_nationkey * 4 AS oid
        FROM nation WHERE n_nationkey % 5 IN (1, 2, 3)""",
}
