"""Specifications with transformers and issue filters, data quality documents, reports, and conditions with options."""

import json
import xml.etree.ElementTree as ET

import pytest

from plumbline.functions import geometry as G
from plumbline.functions import wkb
from plumbline.functions.expressions import ExpressionError
from plumbline.issues import Table
from plumbline.operators import attributes as A
from plumbline.operators import network as N
from plumbline.operators import single_geometry as S
from plumbline.operators import solids as M
from plumbline.operators import spatial as X
from plumbline.plans import documents as D
from plumbline.plans import specification as P
from plumbline.queries.runs import DOCUMENT


def make(spark, rows, schema, name="t", geom=None):
    return Table(spark.createDataFrame(rows, schema), name, "oid", geom)


def places(spark, rows, name):
    """(oid, x0, y0, x1, y1): boxes, or points where both corners are one."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "oid long, x0 double, y0 double, x1 double, y1 double")
    geom = F.when(F.col("x0") == F.col("x1"), G.point("x0", "y0")).otherwise(G.box("x0", "y0", "x1", "y1"))
    return Table(df.select("oid", geom.alias("geom")), name, "oid", "geom")


def spec_of(**more):
    return {"name": "s", "conditions": [{"name": "c", "check": "qa_constraint", "tables": {"table": "t"}, "parameters": {"constraints": "v < 3"}} | more]}


def found_oids(found):
    return sorted(r.involved[0].oid for r in found.collect())


def test_issue_filters_combine_by_expression(spark):
    t = make(spark, [(k, k, "ab"[k % 2]) for k in range(1, 9)], "oid long, v int, k string")
    filters = [{"name": "even", "function": "if_involved_rows", "parameters": {"constraint": "k = 'a'"}}, {"name": "late", "function": "if_involved_rows", "parameters": {"constraint": "v > 6"}}]
    run = lambda **more: found_oids(P.run(P.from_json(json.dumps(spec_of(**more) | {"issue_filters": filters})), {"t": t}))
    assert run() == [3, 4, 5, 6, 7, 8]
    assert run(issue_filters=["even", "late"]) == [3, 5]  # any of them will do
    assert run(issue_filters=["even", "late"], filter_expression="even AND late") == [3, 4, 5, 6, 7]
    assert run(issue_filters=["even", "late"], filter_expression="even AND NOT late") == [3, 5, 7, 8]
    assert run(issue_filter="involved_oid = 4 or involved_table = 'u'") == [3, 5, 6, 7, 8]


def test_spatial_issue_filters_see_the_involved_shape(spark):
    boxes = places(spark, [(1, 0.0, 0.0, 1.0, 1.0), (2, 5.0, 0.0, 6.0, 1.0), (3, 9.0, 0.0, 9.5, 1.0)], "boxes")
    marks = places(spark, [(1, 0.5, 0.5, 0.5, 0.5), (2, 7.0, 0.0, 7.0, 0.0)], "marks")
    base = {"name": "s", "conditions": [{"name": "c", "check": "qa_min_area", "tables": {"table": "boxes"}, "parameters": {"limit": 2.0}, "issue_filters": ["f"]}]}
    for function, parameters, want in (("if_intersecting", {}, [2, 3]), ("if_near", {"near": 1.5}, [2, 3]), ("if_near", {"near": 0.4}, [1, 2, 3]), ("if_all", None, [])):
        f = {"name": "f", "function": function, "tables": {"other": "marks"} if parameters is not None else {}, "parameters": parameters or {}}
        assert found_oids(P.run(P.from_json(json.dumps(base | {"issue_filters": [f]})), {"boxes": boxes, "marks": marks})) == want, function


def test_transformers_feed_conditions_and_each_other(spark):
    a, b = make(spark, [(1, 7, 5), (2, 8, 1)], "oid long, k int, v int", "a"), make(spark, [(1, 7, 2), (2, 8, 9)], "oid long, k int, w int", "b")
    spec = spec_of(tables={"table": "named"}, parameters={"constraints": "total < 8"}) | {
        "transformers": [
            {"name": "named", "function": "tr_attributes", "tables": {"table": "joined"}, "parameters": {"attributes": ["v + w AS total"]}},
            {"name": "joined", "function": "tr_table_join", "tables": {"left": "a", "right": "b"}, "parameters": {"left_key": "k", "right_key": "k"}, "filters": {"b": "w > 2"}},
        ]
    }
    s = P.from_json(json.dumps(spec))
    assert P.from_json(P.to_json(s)) == s
    assert P.run(s, {"a": a, "b": b}).count() == 1
    round_about = spec | {"transformers": [{"name": "named", "function": "tr_attributes", "tables": {"table": "named"}, "parameters": {"attributes": ["v"]}}]}
    with pytest.raises(ValueError, match="use each other"):
        P.run(P.from_json(json.dumps(round_about)), {"a": a, "b": b})
    with pytest.raises(KeyError):
        P.run(s, {"a": a})


def test_document(spark):
    d = D.from_document(DOCUMENT)
    assert d.workspaces == {"w": "/data"} and set(d.table_workspaces) == {"boxes", "orders", "customer", "points"}
    spec = d.specifications["boxes and orders"]
    by = {c.name: c for c in spec.conditions}
    assert [c.name for c in spec.conditions] == ["small boxes", "poor customers", "names"]
    assert by["poor customers"].severity == "warning" and by["poor customers"].category == "attributes/orders" and by["small boxes"].severity == "error"
    assert by["small boxes"].check == "qa_min_area" and by["small boxes"].parameters == {"limit": 3.0} and by["small boxes"].filters == {"boxes": "p_size > 3"}
    assert by["small boxes"].issue_filters == ("at a point", "brand") and by["names"].parameters == {"maximum": 11}
    assert D.function_name("a.b.Qa3dConstantZ") == "qa3d_constant_z" and D.function_name("QaGdbRelease") == "qa_gdb_release"
    short = D.from_xml('<QualitySpecification name="x"><Condition name="c" check="qa_unique" issueFilters="f g" filterExpression="f"><Table parameter="tables" name="t"/></Condition><IssueFilter name="f" function="if_all"/></QualitySpecification>')
    assert short.conditions[0].issue_filters == ("f", "g") and short.issue_filters[0].function == "if_all"


def test_every_check_transformer_and_filter_is_registered():
    P._register()
    assert {"qa_schema_field_names", "qa_constraint", "qa_min_length"} <= set(P.REGISTRY) and {"tr_table_join", "tr_intersect", "rf_execute_area"} <= set(P.TRANSFORMERS) and {"if_all", "if_near", "if_within"} <= set(P.FILTERS)


def test_reports_list_all_conditions(spark):
    t = make(spark, [(1, 1), (2, 5)], "oid long, v int")
    spec = P.from_json(json.dumps({"name": "s & t", "conditions": [spec_of()["conditions"][0], {"name": "fine", "check": "qa_constraint", "tables": {"table": "t"}, "parameters": {"constraints": "v > 0"}, "severity": "warning"}]}))
    root = ET.fromstring(P.xml_report(P.run(spec, {"t": t}), spec))
    assert root.attrib == {"specification": "s & t", "errorCount": "1", "warningCount": "0", "fulfilled": "false"}
    assert [(c.get("name"), c.get("issueCount")) for c in root] == [("c", "1"), ("fine", "0")]


def test_allowed_issues_by_status_and_place(spark):
    from pyspark.sql import functions as F

    from plumbline import issues as I

    df = spark.createDataFrame([("c", "X.Y", k, f"POINT({k}.0 1.5E1)") for k in range(1, 6)], "condition string, issue_code string, oid long, geom string")
    found = df.select("condition", "issue_code", F.lit(None).cast("string").alias("component"), F.array(F.struct(F.lit("t").alias("tab"), "oid")).alias("involved"), "geom")
    rows = [("c", "x.y", 1, None, None, None), ("c", None, 2, None, None, "inactive"), ("c", "X.Y", None, "POINT(3 15)", "equal_envelope", "Active"), ("c", None, None, "LINESTRING(3.5 14, 4.5 16)", "within_envelope", None), ("d", None, None, None, None, None), ("c", None, 5, "POINT(0 0)", "equal_envelope", None)]
    allowed = spark.createDataFrame(rows, "condition string, issue_code string, oid long, geom string, shape_match string, status string")
    allowed = allowed.withColumn("involved", F.when(F.col("oid").isNotNull(), F.array(F.struct(F.lit("t").alias("tab"), "oid"))))
    assert sorted(r.involved[0].oid for r in I.without_exceptions(found, allowed).collect()) == [2, 5]
    assert [r.n_used for r in I.exception_usage(found, allowed.coalesce(1)).orderBy("condition", F.col("oid").asc_nulls_last(), "geom").collect()] == [1, 0, 0, 1, 1, 0]


def test_equal_values_options(spark):
    from pyspark.sql import functions as F

    rows = [(1, "A-1", 1.0, "x,y"), (2, "a-2", 1.5, "y, x"), (3, None, 9.0, None), (4, "b", 1.0, "x,")]
    df = spark.createDataFrame(rows, "oid long, s string, v double, m string")
    a, b = df.alias("a"), df.alias("b")

    def pairs(spec, *options, **more):
        same = A.equal_values_condition(spec, options=options, rows=(df, df), **{"sensitive": False} | more)
        return [(r[0], r[1]) for r in a.join(b, (F.col("a.oid") < F.col("b.oid")) & same).select("a.oid", "b.oid").orderBy("a.oid", "b.oid").collect()]

    assert pairs("s") == [] and pairs("s", "s:ignore=-[0-9]") == [(1, 2)] and pairs("s", "s:ignore=-[0-9]", sensitive=True) == []
    assert pairs("v") == [(1, 4)] and pairs("v", "v:allowedDifferenceCondition=G2._VALUE - G1._VALUE <= 0.5 AND G2._VALUE >= G1._VALUE") == [(1, 2), (1, 4), (2, 4)]
    assert pairs("s", "s:ignoreCondition=_VALUE LIKE 'a*' OR v = 1") == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]
    assert pairs("m:\\,") == [(1, 2)]
    for options in (["x:ignore=a"], ["s:what=1"], ["s"]):
        with pytest.raises(ExpressionError):
            pairs("s", *options)
    with pytest.raises(ExpressionError):
        pairs("s,S")


def test_geometry_properties(spark):
    from pyspark.sql import functions as F

    v = G.vertex
    ring = F.array(v(0, 0, 1, None, 0), v(0, 1, 1, None, 3), v(1, 1, 1, None, 5), v(0, 0, 1, None, 0))
    df = spark.range(1).select(F.lit(1).cast("long").alias("oid"), G.geometry("multipatch", F.array(ring, ring)).alias("geom"), F.array(F.array(F.lit("line"), F.lit("bezier"), F.lit("circular_arc")), F.array(F.lit("line"), F.lit("line"), F.lit("elliptic_arc"))).alias("st"), F.array(F.lit("ring"), F.lit("triangle_strip")).alias("pt"))
    t = Table(df, "db.owner.t", "oid", "geom")
    fulfilled = lambda text, **more: S.qa_geometry_constraint(t, text, segment_types="st", part_types="pt", **more).count() == 0
    assert fulfilled("$Dimension = 2.5 AND $BezierCount = 1 AND $CircularArcCount = 1 AND $EllipticArcCount = 1 AND $NonLinearSegmentCount = 3 AND $LinearSegmentCount = 3 AND $SegmentCount = 6")
    assert fulfilled("$IsPointIdAware AND $PointIdMin = 0 AND $PointIdMax = 5 AND $PointIdCount = 4 AND $ControlPointCount = 4")
    assert fulfilled("$RingCount = 1 AND $TriangleStripCount = 1 AND $TriangleFanCount = 0 AND $TrianglesPatchCount = 0")
    assert fulfilled("$NonLinearSegmentCount = $BezierCount + $CircularArcCount + $EllipticArcCount AND $RingCount + $TriangleStripCount = 1", per_part=True)
    row = S.with_properties(t, "$QualifiedTableName", "$TableName").df.first()
    assert (row["$QualifiedTableName"], row["$TableName"]) == ("db.owner.t", "t")


def test_well_known_binary_columns(spark):
    from pyspark.sql import functions as F

    v = G.vertex
    shapes = [G.point(1, 2), G.point(1, 2, 3), G.line(F.array(v(0, 0, 1, 2), v(1, 1, 3, 4))), G.geometry("line", F.array(F.array(v(0, 0), v(1, 1)), F.array(v(2, 2), v(3, 3)))), G.box(0, 0, 1, 1), F.lit(None).cast(G.GEOMETRY)]
    df = None
    for k, g in enumerate(shapes):
        row = spark.range(1).select(F.lit(k).alias("k"), g.cast(G.GEOMETRY).alias("geom"))
        df = row if df is None else df.unionByName(row)
    for big in (False, F.col("k") % 2 == 0):
        out = df.withColumn("back", wkb.decoded(spark, wkb.encoded(spark, F.col("geom"), big))).collect()
        assert all(r.geom == r.back for r in out)


def test_points_and_boxes_relate_by_their_envelopes(spark):
    """The expressions agree with the exact predicates on all pairs of a small grid."""
    import itertools

    from plumbline.functions import planar

    spans = [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3), (0, 3)]
    rows = [(k, float(a), float(c), float(b), float(d)) for k, ((a, b), (c, d)) in enumerate(itertools.product(spans, spans))]
    rows += [(100 + k, float(x), float(y), float(x), float(y)) for k, (x, y) in enumerate(itertools.product(range(4), range(3)))]
    t = places(spark, rows, "t")
    pairs = X.other_pairs([t], [t], (), (), 5.0)
    got = X.distances(X._parted(pairs, "matrix", "string", X._plain_matrix(), planar.relate))
    shape = lambda r: ("point", [[(r[1], r[2])]]) if r[1] == r[3] else ("polygon", [[(r[1], r[2]), (r[1], r[4]), (r[3], r[4]), (r[3], r[2]), (r[1], r[2])]])
    by = {r[0]: shape(r) for r in rows}
    found = got.select("a.oid", "b.oid", "matrix", "distance").collect()
    assert len(found) == len(rows) ** 2
    for a, b, matrix, distance in found:
        assert matrix == planar.relate(by[a], by[b]), (rows[a] if a < 100 else a, b)
        assert abs(distance - planar.distance(by[a], by[b])) < 1e-9


def test_small_angles_at_a_hub(spark):
    import math
    import random

    from pyspark.sql import functions as F

    r = random.Random(3)
    angles = [r.uniform(-math.pi, math.pi) for _ in range(60)] + [math.pi - 1e-3, -math.pi + 1e-3]
    df = spark.createDataFrame([(k, math.cos(a), math.sin(a)) for k, a in enumerate(angles)], "oid long, x double, y double")
    t = Table(df.select("oid", G.line(F.array(G.vertex(F.lit(0.0), F.lit(0.0)), G.vertex("x", "y"))).alias("geom")), "t", "oid", "geom")
    turn = lambda a, b: abs(math.atan2(math.sin(a - b), math.cos(a - b)))
    for limit in (0.05, 0.7, 2.5):
        want = sorted((i, j) for j in range(len(angles)) for i in range(j) if turn(angles[i], angles[j]) < limit)
        assert sorted((x.involved[0].oid, x.involved[1].oid) for x in N.qa_min_angle([t], limit).collect()) == want


def test_bordering_points(spark):
    from pyspark.sql import functions as F

    border = Table(spark.range(1).select(F.col("id").alias("oid"), G.segment(0, 0, 100, 0).alias("geom")), "border", "oid", "geom")
    other = Table(spark.range(1).select(F.col("id").alias("oid"), G.segment(0, 0.25, 100, 0.25).alias("geom")), "other", "oid", "geom")

    def side(rows, name):
        return Table(spark.createDataFrame(rows, "oid long, x double, y double, g int").select("oid", G.point("x", "y").alias("geom"), "g"), name, "oid", "geom")

    one = side([(1, 0.0, 0.0, 1), (2, 10.0, 0.0, 1), (3, 20.0, 0.0, 1), (4, 30.0, 0.0, 1), (5, 40.0, 7.0, 1)], "one")
    two = side([(1, 0.0, 0.0, 1), (2, 10.0, 0.0, 2), (3, 20.5, 0.0, 1), (4, 20.75, 0.0, 2), (6, 50.0, 0.0, 1)], "two")
    run = lambda b2=border, **more: sorted((x.issue_code[16:], *[(r.tab, r.oid) for r in x.involved]) for x in M.qa_edge_match_bordering_points([one], border, [two], b2, 1.0, bordering_point_attribute_constraint="POINT1.g = POINT2.g", **more).collect())
    alone = [("NoMatch.NoCandidate", ("one", 4)), ("NoMatch.NoCandidate", ("two", 6))]
    near = [("NoMatch.CandidateExists.ConstraintsFulfilled", ("one", 3), ("two", 3)), ("NoMatch.CandidateExists.ConstraintsNotFulfilled", ("one", 3), ("two", 4))]
    broken = [("Match.ConstraintsNotFulfilled", ("one", 2), ("two", 2))]
    assert run() == sorted(broken + near + alone)
    assert run(allow_no_feature_within_search_distance=True) == sorted(broken + near)
    assert run(allow_disjoint_candidate_feature_if_attribute_constraints_are_fulfilled=True) == sorted(broken + near[1:] + alone)
    assert run(bordering_point_match_condition="POINT1.g = POINT2.g") == sorted(near[:1] + alone + [("NoMatch.NoCandidate", ("one", 2)), ("NoMatch.NoCandidate", ("two", 2)), ("NoMatch.NoCandidate", ("two", 4))])
    far = side([(3, 20.0, 0.25, 1)], "two")
    apart = M.qa_edge_match_bordering_points([one], border, [far], other, 1.0, allow_no_feature_within_search_distance=True)
    assert [x.issue_code for x in apart.collect()] == ["BorderingPoints.NoMatch.CandidateExists.BordersNotCoincident+ConstraintsFulfilled"]
    assert M.qa_edge_match_bordering_points([one], border, [far], other, 1.0, allow_no_feature_within_search_distance=True, allow_disjoint_candidate_feature_if_borders_are_not_coincident=True).count() == 0


def test_paths_to_a_goal(spark):
    import random

    r = random.Random(7)
    rows = [(a, b, float(r.randint(1, 9))) for a in range(30) for b in (a + 1, a + 6) if b < 30] + [(50, 51, 1.0)]
    edges = spark.createDataFrame(rows, "a long, b long, cost double")
    full = {x.node: x.cost for x in N.shortest_paths(edges, 0).collect()}
    assert 50 not in full and full[0] == 0
    low = spark.createDataFrame([(n, max(0.0, 0.9 * abs(full[29] - c) * 0)) for n, c in full.items()], "node long, h double")
    for goal in (29, 7, 50):
        for h in (None, low):
            found = {x.node: x.cost for x in N.shortest_paths(edges, 0, goal=goal, heuristic=h).collect()}
            assert found.get(goal) == full.get(goal)


def test_a_database_evaluates_queries(spark):
    from plumbline.sources.tables import remote_query

    url = "jdbc:derby:memory:remote;create=true"
    spark.range(20).selectExpr("cast(id as int) as K", "cast(id % 3 as int) as V").write.format("jdbc").options(url=url, dbtable="T").save()
    assert sorted(r.K for r in remote_query(spark, url, "SELECT K FROM T WHERE V = 1").collect()) == list(range(1, 20, 3))
    dealt = remote_query(spark, url, "SELECT K, V FROM T WHERE V > 0", ("K", 0, 10, 3))
    assert dealt.rdd.getNumPartitions() == 3 and dealt.count() == 13
