"""Planar predicates against analytic results, and the grid join against a brute-force join."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.functions import planar, wkb
from plumbline.issues import Table
from plumbline.operators import network as N
from plumbline.operators import relations as R
from plumbline.operators import spatial as S


def box(a, b, c, d):
    return ("polygon", [[(a, b), (a, d), (c, d), (c, b), (a, b)]])


@settings(max_examples=150, deadline=None)
@given(*[st.integers(0, 6) for _ in range(4)], *[st.integers(1, 4) for _ in range(4)])
def test_boxes(ax, ay, bx, by, aw, ah, bw, bh):
    a, b = box(ax, ay, ax + aw, ay + ah), box(bx, by, bx + bw, by + bh)
    m = planar.relate(a, b)
    w, h = min(ax + aw, bx + bw) - max(ax, bx), min(ay + ah, by + bh) - max(ay, by)
    assert planar.holds(m, "intersects", "polygon", "polygon") == (w >= 0 and h >= 0)
    assert planar.holds(m, "interior_intersects", "polygon", "polygon") == (w > 0 and h > 0)
    inside = ax >= bx and ay >= by and ax + aw <= bx + bw and ay + ah <= by + bh
    assert planar.holds(m, "within", "polygon", "polygon") == inside
    assert planar.holds(m, "equals", "polygon", "polygon") == ((ax, ay, aw, ah) == (bx, by, bw, bh))
    overlap = max(w, 0) * max(h, 0)
    assert planar.area(planar.intersection(a, b, 2)) == pytest.approx(overlap)
    assert planar.area(planar.union([a, b])) == pytest.approx(aw * ah + bw * bh - overlap)
    assert planar.area(planar.difference(a, b)) == pytest.approx(aw * ah - overlap)
    assert planar.distance(a, b) == pytest.approx((max(-w, 0) ** 2 + max(-h, 0) ** 2) ** 0.5)


@given(st.sampled_from(["point", "line", "polygon"]), st.lists(st.lists(st.tuples(*[st.floats(-1e6, 1e6)] * 4), min_size=1, max_size=4), min_size=1, max_size=3), st.sampled_from("<>"))
def test_wkb_round_trip(kind, parts, order):
    if kind == "point":
        parts = [[p[0]] for p in parts]
    assert wkb.read(wkb.write(kind, parts, order)) == (kind, parts)


def test_line_relations():
    east, north = ("line", [[(0.0, 0.0), (2.0, 0.0)]]), ("line", [[(1.0, -1.0), (1.0, 1.0)]])
    assert planar.relate(east, north) == "0F1FF0102"
    assert planar.relate(("point", [[(1.0, 0.0)]]), east)[0] == "0"
    assert planar.matches("212101212", "T*T***T**") and not planar.matches("FF2FF1212", "T********")
    assert planar.polygonize([[(0, 0), (1, 0)], [(1, 0), (0, 1)], [(0, 1), (0, 0)], [(5, 5), (6, 6)]])[0][0] in ((0, 0), (1, 0), (0, 1))


@pytest.fixture(scope="module")
def random_boxes(spark):
    r = random.Random(5)
    rows = []
    for k in range(120):
        rows.append((k, r.uniform(0, 60), r.uniform(0, 60), r.choice([0.1, 1.0, 5.0, 40.0]), r.choice([0.1, 1.0, 5.0])))
    df = spark.createDataFrame(rows, "oid long, x double, y double, w double, h double")
    return rows, Table(df.select("oid", G.box("x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h")).alias("geom")), "b", "oid", "geom")


def test_grid_join_is_the_brute_force_join(random_boxes):
    rows, table = random_boxes
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] <= b[1] + b[3] and b[1] <= a[1] + a[3] and a[2] <= b[2] + b[4] and b[2] <= a[2] + a[4]}
    got = [tuple(r) for r in S.self_pairs([table]).select("a.oid", "b.oid").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_partitions_do_not_change_results(random_boxes):
    _, table = random_boxes
    one = {tuple(x.oid for x in r.involved) for r in R.qa_touches_self([table]).unionByName(R.qa_overlaps_self([table])).collect()}
    spread = Table(table.df.repartition(7), "b", "oid", "geom")
    assert one == {tuple(x.oid for x in r.involved) for r in R.qa_touches_self([spread]).unionByName(R.qa_overlaps_self([spread])).collect()}


def test_empty_and_null_shapes_take_no_part(spark):
    df = spark.range(3).select(F.col("id").alias("oid"), F.when(F.col("id") == 0, F.lit(None).cast(G.GEOMETRY)).when(F.col("id") == 1, G.geometry("line", F.array())).otherwise(G.segment(0, 0, 1, 1)).alias("geom"))
    t = Table(df, "t", "oid", "geom")
    assert R.qa_must_touch_self([t]).count() == 1 and R.qa_intersects_self([t]).count() == 0


def test_components_and_paths(spark):
    edges = spark.createDataFrame([(k, k + 1, 1.0) for k in range(40) if k != 20] + [(50, 51, 2.0)], "a long, b long, cost double")
    nodes = spark.range(52).withColumnRenamed("id", "node")
    got = {r.node: r.comp for r in N.connected(nodes, edges).collect()}
    assert all(got[k] == (0 if k <= 20 else 21 if k <= 40 else 50 if k >= 50 else k) for k in range(52))
    cost = {r.node: r.cost for r in N.shortest_paths(edges, 21).collect()}
    assert cost[40] == 19 and 20 not in cost
