"""Plans and paths that decide whether large tables fit: no broadcast of shapes, no work on pairs or rings that can't matter."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.functions import planar
from plumbline.issues import Table
from plumbline.operators import single_geometry
from plumbline.operators import solids as M
from plumbline.operators import spatial as S
from plumbline.operators.single_geometry import qa_route_measures_continuous, qa_route_measures_unique
from plumbline.queries import QUERIES
from plumbline.queries.space import boxes, lines, points

#: Their files are small and hold many shapes: a broadcast takes the driver's memory.
MERGED = [
    "qa_contained_points_count",
    "tr_spatial_join",
    "qa_interior_intersects_other",
    "qa_interior_intersects_self",
    "qa_intersection_matrix_disjoint",
    "qa_intersection_matrix_other",
    "qa_intersection_matrix_self",
    "qa_intersects_other",
    "qa_intersects_self",
    "qa_must_intersect_matrix_other",
    "qa_must_intersect_other",
    "qa_neighbour_areas",
    "qa_must_touch_self",
    "qa_touches_other",
    "qa_contains_other",
    "qa_no_gaps",
    "tr_spatial_join_grouped",
    "qa_touches_self",
    "qa_mp_vertex_not_near_face",
]
#: These join their features with keys found, once more.
KEYS_ONLY = {"qa_contained_points_count", "qa_contains_other", "qa_intersection_matrix_disjoint", "qa_must_intersect_matrix_other", "qa_must_intersect_other", "qa_must_touch_self"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", MERGED)
def test_shapes_are_not_broadcast(spark, sf_dir, name):
    """By default settings: shapes meet by cells in a merge join; only results of a key and a number may be broadcast, where they are few."""
    plan = plan_of(QUERIES[name](spark, sf_dir))
    broadcast = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert "SortMergeJoin" in plan and not any("level#" in line for line in broadcast)
    assert not broadcast or name in KEYS_ONLY


#: Features meet the keys found once more: as many as the features, and compressed they look few to adaptive execution.
KEYS_MERGED = ["qa_must_intersect_other", "qa_intersection_matrix_disjoint", "qa_must_intersect_matrix_other", "qa_contains_other"]


@pytest.mark.parametrize("name", KEYS_MERGED)
def test_keys_found_are_not_broadcast(spark, sf_dir, name):
    """In the plan that ran, not only in the one that was made."""
    df = QUERIES[name](spark, sf_dir)
    df.collect()
    plan = plan_of(df)
    assert "isFinalPlan=true" in plan and "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") >= 2


def test_points_and_boxes_never_go_to_python(spark, sf_dir):
    def plan(one, two):
        return plan_of(S.related(S.other_pairs([one(spark, sf_dir)], [two(spark, sf_dir)])).select("a.oid"))

    assert "Python" not in plan(boxes, points) and "Python" in plan(lines, boxes)


def test_pairs_of_levels_against_brute_force(spark):
    """Boxes of very different sizes: each pair that meets comes out once, whichever side is larger."""
    rng = random.Random(5)
    sides = []
    for n in (60, 50):
        made = []
        for k in range(n):
            w, h = (rng.choice([0.25, 1.0, 3.0, 20.0, 100.0]) for _ in "wh")
            x, y = rng.randrange(-40, 40) / 2, rng.randrange(-40, 40) / 2
            made.append((k, x, y, x + w, y + h))
        sides.append(made)

    def shapes(rows, least):
        df = spark.createDataFrame([r for r in rows if r[3] - r[1] >= least], "oid long, xmin double, ymin double, xmax double, ymax double")
        return df.withColumn("_plain", F.lit(S.BOX))

    meet = lambda a, b: a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]
    for least in ((0, 0), (3.0, 0), (0, 20.0)):
        found = sorted(tuple(r) for r in S.candidate_pairs(*[shapes(r, m) for r, m in zip(sides, least, strict=True)]).select("a.oid", "b.oid").collect())
        assert found == sorted((a[0], b[0]) for a in sides[0] for b in sides[1] if a[3] - a[1] >= least[0] and b[3] - b[1] >= least[1] and meet(a, b))
    own = shapes(sides[0], 0)
    found = sorted(tuple(r) for r in S.candidate_pairs(own, own, same=True).select("a.oid", "b.oid").collect())
    assert found == sorted((a[0], b[0]) for a in sides[0] for b in sides[0] if a[0] < b[0] and meet(a, b))


def test_footprints_of_rectangles_are_counted_on_cells():
    """As the exact shapes have them; rectangles that meet in a corner only are left to those."""
    rng = random.Random(3)
    known = 0
    for _ in range(200):
        made = []
        for _ in range(rng.randint(1, 6)):
            x, y, w, h = rng.randint(0, 6), rng.randint(0, 6), rng.randint(1, 4), rng.randint(1, 4)
            ring = [(float(a), float(b)) for a, b in ((x, y), (x, y + h), (x + w, y + h), (x + w, y), (x, y))]
            made.append(rng.choice([ring, ring[::-1]]))
        rings = M._rings(("multipatch", made))
        found = M._box_facts(rings)
        if found is not None:
            total = planar.union(rings)[1]
            crossing = any(planar.relate(a, b)[0] == "2" for i, a in enumerate(rings) for b in rings[:i])
            assert found == {"outer": sum(planar.ring_area(r) > 0 for r in total), "holes": sum(planar.ring_area(r) < 0 for r in total), "crossing": crossing}
            known += 1
    assert known > 150
    box = lambda x, y: ("polygon", [[(x, y), (x, y + 1.0), (x + 1.0, y + 1.0), (x + 1.0, y), (x, y)]])
    assert M._box_facts([box(0.0, 0.0), box(1.0, 1.0)]) is None
    assert M._box_facts([box(0.0, 0.0), box(1e-10, 0.0)]) is None


def test_a_small_file_of_faces_is_dealt_out(spark, sf_dir):
    plan = plan_of(QUERIES["qa_mp_single_part_footprint"](spark, sf_dir))
    assert "RoundRobinPartitioning" in plan


def test_route_ranges_against_brute_force(spark):
    """Equal ranges, ranges no longer than the tolerance and points: the same pairs, and ranges are compared once however many share them."""
    rng = random.Random(7)
    rows = [(k, "ab"[k % 2], float(low := rng.randint(0, 12)), float(low + rng.randint(0, 5))) for k in range(120)]
    df = spark.createDataFrame(rows, "oid long, route string, low double, high double")
    made = df.select("oid", "route", G.line(F.array(G.vertex("oid", 0, None, F.col("low")), G.vertex("oid", 1, None, F.col("high")))).alias("geom"))
    found = qa_route_measures_unique(Table(made, "routes", "oid", "geom"), "route", 2, 10)
    pairs = sorted((r.involved[0].oid, r.involved[1].oid) for r in found.collect())
    assert pairs == sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and min(a[3], b[3]) - max(a[2], b[2]) > 2)
    assert "HashAggregate" in plan_of(found)


@pytest.mark.parametrize("at_once", [4096, 5])
def test_ends_of_routes_against_brute_force(spark, monkeypatch, at_once):
    """Places of many lines, both zeros, measures that are missing: each pair once for each shared end, and no broadcast."""
    monkeypatch.setattr(single_geometry, "PLACE_LINES", at_once, raising=False)
    rng = random.Random(11)
    rows = [(k, "ab"[k % 2], rng.choice([-0.0, 0.0, 1.0]), float(rng.randint(2, 3)), rng.choice([None, 0.0, 2.0, 5.0]), rng.choice([None, 1.0, 3.0])) for k in range(90)]
    df = spark.createDataFrame(rows, "oid long, route string, x double, far double, m double, n double")
    made = df.select("oid", "route", G.line(F.array(G.vertex("x", F.lit(0.0), None, F.col("m")), G.vertex("far", F.lit(0.0), None, F.col("n")))).alias("geom"))
    found = qa_route_measures_continuous(Table(made, "routes", "oid", "geom"), "route", 1.5)
    ends = [(r[0], r[1], x, m) for r in rows for x, m in ((r[2], r[4]), (r[3], r[5]))]
    bad = lambda m, n: (m is None) != (n is None) or m is not None and abs(m - n) > 1.5
    assert sorted((r.involved[0].oid, r.involved[1].oid) for r in found.collect()) == sorted((a[0], b[0]) for a in ends for b in ends if a[0] < b[0] and a[1:3] == b[1:3] and bad(a[3], b[3]))


def test_ends_of_routes_are_dealt_out(spark, sf_dir):
    """A small file of them makes many pairs."""
    plan = plan_of(QUERIES["qa_route_measures_continuous"](spark, sf_dir))
    assert "Broadcast" not in plan and "SortMergeJoin" in plan and plan.count("REPARTITION_BY_NUM") == 2
