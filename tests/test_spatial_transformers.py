"""Spatial transformers, filters and measures on small shapes."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.functions import planar
from plumbline.issues import Table
from plumbline.operators import network as N
from plumbline.operators import proximity as P
from plumbline.operators import relations as R
from plumbline.operators import single_geometry as S
from plumbline.operators import spatial_transformers as T


def boxes(spark, rows, name="b"):
    df = spark.createDataFrame([(r[0], *map(float, r[1:5]), r[5]) for r in rows], "oid long, x double, y double, w double, h double, k string")
    return Table(df.select("oid", "k", G.box("x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h")).alias("geom")), name, "oid", "geom")


def lines(spark, rows, name="l"):
    df = spark.createDataFrame(rows, "oid long, pts array<struct<x:double,y:double>>, k string")
    return Table(df.select("oid", "k", G.line(F.transform("pts", lambda p: G.vertex(p["x"], p["y"]))).alias("geom")), name, "oid", "geom")


def test_dissolve_unites_touching_boxes_of_a_group(spark):
    t = boxes(spark, [(1, 0, 0, 1, 1, "a"), (2, 1, 0, 1, 1, "a"), (3, 2, 0, 1, 1, "b"), (4, 9, 9, 1, 1, "a"), (5, 2, 1, 1, 1, "a")])
    got = sorted((r.oid, r.k, r.n_merged, round(r.a, 6), r.n) for r in T.tr_dissolve(t, ["k"]).withColumns({"a": G.area(F.col("geom")), "n": F.size("geom.parts")}).collect())
    assert got == [(1, "a", 2, 2.0, 1), (3, "b", 1, 1.0, 1), (4, "a", 1, 1.0, 1), (5, "a", 1, 1.0, 1)]
    assert [r.oid for r in T.tr_dissolve(t, ["k"], ["COUNT(*) AS n"], "n > 1").collect()] == [1]


def test_dissolve_links_lines_by_their_ends(spark):
    t = lines(spark, [(1, [(0.0, 0.0), (1.0, 0.0)], "a"), (2, [(1.0, 0.0), (2.0, 0.0)], "a"), (3, [(5.0, 5.0), (6.0, 6.0)], "a"), (4, [(2.0, 0.0), (3.0, 0.0)], "b")])
    assert sorted((r.oid, r.n_merged) for r in T.tr_dissolve(t, ["k"]).collect()) == [(1, 2), (3, 1), (4, 1)]


def test_spatial_join_outer_count_is_null(spark):
    a, b = boxes(spark, [(1, 0, 0, 2, 2, "x"), (2, 9, 9, 1, 1, "y")], "a"), boxes(spark, [(7, 1, 1, 1, 1, "p"), (8, 1, 1, 3, 3, "q")], "b")
    out = {r.oid: r.n for r in T.tr_spatial_join(a, b, outer=True, grouped=True, attributes=["COUNT(OBJECTID) AS n"]).df.collect()}
    assert out == {1: 2, 2: None}
    assert T.tr_spatial_join(a, b, outer=True).df.count() == 3
    assert [r.b_k for r in T.tr_spatial_join(a, b, "T1.k = 'Q' AND T0.k = 'x'").df.collect()] == ["q"]


def test_intersect_ratio_and_dimensions(spark):
    a, b = boxes(spark, [(1, 0, 0, 2, 2, "x")], "a"), boxes(spark, [(7, 1, 0, 2, 2, "p"), (8, 2, 2, 1, 1, "q")], "b")
    got = {r.other: (r.geom.kind, r.part_intersected, r.intersection_ratio) for r in T.tr_intersect(a, b).collect()}
    assert got == {7: ("polygon", 2.0, 0.5), 8: ("point", 1.0, None)}


def test_near_parts_and_coverage(spark):
    a = lines(spark, [(1, [(0.0, 0.0), (10.0, 0.0)], "a")], "a")
    b = lines(spark, [(1, [(2.0, 0.5), (5.0, 0.5)], "b"), (2, [(5.0, -0.5), (8.0, -0.5)], "b")], "b")
    got = sorted(tuple(round(float(v), 4) for v in r["values"]) for r in P.qa_not_near(a, b, 0.5, 2.0).collect())
    assert got == [(2.0, 5.0), (5.0, 8.0)]
    assert [float(r["values"][0]) for r in P.qa_full_coincidence(a, [b], 0.5).collect()] == pytest.approx([4.0], abs=1e-4)


def test_covered_percentage(spark):
    a, b = boxes(spark, [(1, 0, 0, 4, 1, "x"), (2, 50, 0, 1, 1, "x")], "a"), boxes(spark, [(1, 0, 0, 1, 1, "p"), (2, 1, 0, 1, 1, "q")], "b")
    got = {r.involved[0].oid: r["values"][0] for r in R.qa_is_covered_by_other([b], [a], 10.0).collect()}
    assert got == {1: "50.0", 2: None}
    assert R.qa_is_covered_by_other([b], [a], 60.0).count() == 1


def test_self_intersection(spark):
    t = lines(spark, [(1, [(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0)], "x"), (2, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)], "y"), (3, [(0.0, 0.0), (3.0, 0.0), (1.0, 0.0), (1.0, 1.0)], "z")])
    assert sorted(r.involved[0].oid for r in S.qa_simple_geometry(t).collect()) == [1, 3]
    assert S.qa_simple_geometry(t, allow_non_planar_lines=True).count() == 0


def test_clusters_are_chains(spark):
    df = spark.createDataFrame([(k, x) for k, x in enumerate([0.0, 1.0, 2.0, 5.0, 5.5, 9.0])], "oid long, x double")
    t = Table(df.select("oid", G.point("x", F.lit(0.0)).alias("geom")), "p", "oid", "geom")
    assert sorted(tuple(r) for r in N.clusters(t, 1.0).collect()) == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 5)]


@settings(max_examples=200, deadline=None)
@given(*[st.tuples(st.integers(-5, 5), st.integers(-5, 5)) for _ in range(4)], st.sampled_from([0.5, 1.0, 2.5]))
def test_near_stretch_is_what_sampling_finds(p, q, r, s, near):
    if p == q:
        return
    found = P.near_stretch(p, q, r, s, near)
    for k in range(101):
        u = k / 100
        d = planar.segment_distance((p[0] + u * (q[0] - p[0]), p[1] + u * (q[1] - p[1])), r, s)
        if abs(d - near) > 1e-6:
            assert (d < near) == (found is not None and found[0] <= u <= found[1])
