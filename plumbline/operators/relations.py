"""Checks of pairs of features: which relations must not, may and must occur."""

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.functions import planar
from plumbline.functions.expressions import Value, holds
from plumbline.issues import Table, issues
from plumbline.operators import spatial as S
from plumbline.operators.network import connected

Tables = Sequence[Table]


def _both() -> Column:
    return F.array(*[F.struct(F.col(f"{s}.tab").alias("tab"), F.col(f"{s}.oid").alias("oid")) for s in "ab"])


def _one(side: str = "a") -> Column:
    return F.array(F.struct(F.col(f"{side}.tab").alias("tab"), F.col(f"{side}.oid").alias("oid")))


def _fields(tables: Tables) -> tuple[str, ...]:
    """The fields that all tables have, besides key and shape."""
    common = set.intersection(*[{c for c in t.df.columns if c not in (t.oid, t.geom)} for t in tables])
    return tuple(c for c in tables[0].df.columns if c in common and c not in ("oid", "geom", "tab"))


def _relation(tables: Tables, others: Tables | None, relation, code: str, valid: str | None, valid_geometry: str | None = None, component: str = "entire") -> DataFrame:
    """Pairs in a relation for which no valid-relation condition holds: undirected within one set, else directed.

    valid_geometry: a condition over the properties of the intersection ($Area, $Length ...) that makes a pair valid too. component: what of the
    shapes is related.
    """
    if component != "entire":
        part = lambda ts: [Table(t.df.withColumn(t.geom, G.component(F.col(t.geom), component)), t.name, t.oid, t.geom, t.where) for t in ts]
        tables, others = part(tables), None if others is None else part(others)
    pairs = S.self_pairs(list(tables), _fields(tables)) if others is None else S.other_pairs(list(tables), list(others), _fields(tables), _fields(others))
    pairs = pairs.where(~S.conditioned(pairs, valid, undirected=others is None))
    found = S.related(pairs, relation)
    if valid_geometry:
        found = S.with_function(found, "common", G.GEOMETRY, lambda a, b: S.as_geometry(planar.intersection(a, b)))
        names = {k.lower(): Value(v, kind) for k, (v, kind) in G.properties(F.col("common")).items()}
        found = found.where(~holds(valid_geometry, names))
    return issues(found, f"{code}{'.ConstraintNotFulfilled' if valid else ''}", _both())


def qa_intersects_self(tables: Tables, valid: str | None = None, valid_geometry: str | None = None, component: str = "entire") -> DataFrame:
    return _relation(tables, None, "intersects", "IntersectsSelf.GeometriesIntersect", valid, valid_geometry, component)


def qa_intersects_other(tables: Tables, others: Tables, valid: str | None = None, valid_geometry: str | None = None, component: str = "entire") -> DataFrame:
    return _relation(tables, others, "intersects", "IntersectsOther.GeometriesIntersect", valid, valid_geometry, component)


def qa_interior_intersects_self(tables: Tables, valid: str | None = None, valid_geometry: str | None = None, component: str = "entire") -> DataFrame:
    return _relation(tables, None, "interior_intersects", "InteriorIntersectsSelf.InteriorsIntersect", valid, valid_geometry, component)


def qa_interior_intersects_other(tables: Tables, others: Tables, valid: str | None = None, valid_geometry: str | None = None, component: str = "entire") -> DataFrame:
    return _relation(tables, others, "interior_intersects", "InteriorIntersectsOther.InteriorsIntersect", valid, valid_geometry, component)


def qa_crosses_self(tables: Tables, valid: str | None = None, valid_geometry: str | None = None, component: str = "entire") -> DataFrame:
    return _relation(tables, None, "crosses", "CrossesSelf.GeometriesCross", valid, valid_geometry, component)


def qa_crosses_other(tables: Tables, others: Tables, valid: str | None = None, valid_geometry: str | None = None, component: str = "entire") -> DataFrame:
    return _relation(tables, others, "crosses", "CrossesOther.GeometriesCross", valid, valid_geometry, component)


def qa_overlaps_self(tables: Tables, valid: str | None = None, valid_geometry: str | None = None, component: str = "entire") -> DataFrame:
    return _relation(tables, None, "overlaps", "OverlapsSelf.GeometriesOverlap", valid, valid_geometry, component)


def qa_overlaps_other(tables: Tables, others: Tables, valid: str | None = None, valid_geometry: str | None = None, component: str = "entire") -> DataFrame:
    return _relation(tables, others, "overlaps", "OverlapsOther.GeometriesOverlap", valid, valid_geometry, component)


def qa_touches_self(tables: Tables, valid: str | None = None, valid_geometry: str | None = None, component: str = "entire") -> DataFrame:
    return _relation(tables, None, "touches", "TouchesSelf.GeometriesTouch", valid, valid_geometry, component)


def qa_touches_other(tables: Tables, others: Tables, valid: str | None = None, valid_geometry: str | None = None, component: str = "entire") -> DataFrame:
    return _relation(tables, others, "touches", "TouchesOther.GeometriesTouch", valid, valid_geometry, component)


def qa_intersection_matrix_self(tables: Tables, pattern: str, valid: str | None = None, allowed_dimensions: Sequence[int] = ()) -> DataFrame:
    return _relation(tables, None, _pattern(pattern, allowed_dimensions), "IntersectionMatrix.GeometriesIntersectWithMatrix", valid)


def qa_intersection_matrix_other(tables: Tables, others: Tables, pattern: str, valid: str | None = None, allowed_dimensions: Sequence[int] = ()) -> DataFrame:
    """Pairs whose matrix matches; for a pattern that disjoint shapes match, the features without any partner are reported."""
    if planar.matches("FF2FF1212", pattern):
        hit = S.related(S.other_pairs(list(tables), list(others)), lambda m: ~m.rlike(S.re_of(pattern))).select(F.col("a.tab").alias("tab"), F.col("a.oid").alias("oid")).distinct()
        return _missing(tables, hit, "IntersectionMatrix.NoIntersection")
    return _relation(tables, others, _pattern(pattern, allowed_dimensions), "IntersectionMatrix.GeometriesIntersectWithMatrix", valid)


def _pattern(pattern: str, allowed: Sequence[int]):
    def run(matrix: Column) -> Column:
        out = matrix.rlike(S.re_of(pattern))
        return out & ~F.substring(matrix, 1, 1).isin([str(d) for d in allowed]) if allowed else out

    return run


def _all(tables: Tables) -> DataFrame:
    out = None
    for t in tables:
        rows = t.rows.where(~G.is_empty(F.col(t.geom))).select(F.lit(t.name).alias("tab"), F.col(t.oid).cast("bigint").alias("oid"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _missing(tables: Tables, hit: DataFrame, code: str) -> DataFrame:
    # merged: keys found are as many as features, and compressed they would look few enough to broadcast
    left = _all(tables).hint("merge").join(hit.select("tab", "oid").distinct(), ["tab", "oid"], "left_anti")
    return issues(left, code, F.array(F.struct("tab", "oid")))


def _must(tables: Tables, others: Tables | None, relation, code: str, condition: str | None, grow: float = 0.0) -> DataFrame:
    """Features without any partner that stands in the relation and fulfils the condition."""
    if others is None:
        pairs = S.self_pairs(list(tables), _fields(tables))
    else:
        pairs = S.other_pairs(list(tables), list(others), _fields(tables), _fields(others), grow)
    met = S.related(pairs.where(S.conditioned(pairs, condition, default=True)), relation)
    hit = met.select("a.tab", "a.oid")
    if others is None:  # finding one settles both; of one pass over the pairs
        hit = met.select(F.explode(F.concat(_one("a"), _one("b"))).alias("k")).select("k.tab", "k.oid")
    return _missing(tables, hit, code)


def qa_must_intersect_other(tables: Tables, others: Tables, condition: str | None = None) -> DataFrame:
    return _must(tables, others, "intersects", "MustIntersectOther.NoIntersectingFeature", condition)


def qa_must_touch_other(tables: Tables, others: Tables, condition: str | None = None) -> DataFrame:
    return _must(tables, others, "touches", "MustTouchOther.NoTouchingFeature", condition)


def qa_must_touch_self(tables: Tables, condition: str | None = None) -> DataFrame:
    return _must(tables, None, "touches", "MustTouchSelf.NoTouchingFeature", condition)


def qa_must_intersect_matrix_other(tables: Tables, others: Tables, patterns: Sequence[str], condition: str | None = None, required: Sequence[int] = (), unallowed: Sequence[int] = ()) -> DataFrame:
    def met(matrix: Column) -> Column:
        out = F.lit(False)
        for p in patterns:
            out = out | matrix.rlike(S.re_of(p))
        dimension = F.substring(matrix, 1, 1)
        if required:
            out = out & dimension.isin([str(d) for d in required])
        return out & ~dimension.isin([str(d) for d in unallowed]) if unallowed else out

    return _must(tables, others, met, "MustIntersectMatrixOther.NoMatchingFeature", condition)


def near_pairs(tables: Tables, others: Tables, limit: float, condition: str | None = None) -> DataFrame:
    """Pairs at most limit apart, with their distance: by expressions for points and boxes, else from the exact shapes."""
    pairs = S.other_pairs(list(tables), list(others), _fields(tables), _fields(others), limit)
    pairs = pairs.where(S.conditioned(pairs, condition, default=True))
    return S.distances(pairs).where(F.col("distance") <= limit)


def qa_must_be_near_other(table: Table, others: Tables, limit: float, condition: str | None = None) -> DataFrame:
    return _missing([table], near_pairs([table], others, limit, condition).select("a.tab", "a.oid"), "MustBeNearOther.NoFeatureWithinDistance")


def qa_contains_other(containing: Tables, contained: Tables, condition: str | None = None) -> DataFrame:
    """Contained features that no containing feature has inside; the code tells if only the condition failed."""
    pairs = S.other_pairs(list(contained), list(containing), _fields(contained), _fields(containing))
    inside = S.related(pairs, "within")
    flags = inside.select("a.tab", "a.oid", S.conditioned(inside, condition and condition.replace("G1", "G0").replace("G2", "G1").replace("G0", "G2"), default=True).alias("met"))
    best = flags.groupBy("tab", "oid").agg(F.max("met").alias("met"))
    left = _all(contained).hint("merge").join(best, ["tab", "oid"], "left").where("met is null or not met")
    code = F.when(F.col("met").isNull(), F.lit("ContainsOther.NoContainingFeature")).otherwise(F.lit("ContainsOther.ContainingFeatureConditionNotFulfilled"))
    return issues(left, code, F.array(F.struct("tab", "oid")))


def qa_is_covered_by_other(covering: Tables, covered: Tables, allowed_uncovered: float = 0.0) -> DataFrame:
    """Features of which more than the allowed percentage is outside the union of the covering ones.

    The covering shapes of one feature are subtracted one after the other in its own group, without building a union.
    """
    pairs = S.other_pairs(list(covered), list(covering))
    met = S.related(pairs, "intersects").select("a.tab", "a.oid", S.packed(F.col("a.geom")).alias("own"), S.packed(F.col("b.geom")).alias("other"))

    def uncovered(own, others) -> float:
        rest = S.unpacked(own)
        size = planar.area if rest[0] == "polygon" else planar.length
        total = size(rest)
        for o in others:
            if rest[1]:
                rest = planar.difference(rest, S.unpacked(o))
        return 100 * size(rest) / total if total else 0.0

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.iloc[:1][["tab", "oid"]].assign(rest=uncovered(rows["own"].iloc[0], list(rows["other"])))

    found = met.groupBy("tab", "oid").applyInPandas(run, "tab string, oid long, rest double")
    left = _all(covered).join(found, ["tab", "oid"], "left").where(F.coalesce("rest", F.lit(100.0)) > allowed_uncovered + 1e-9)
    code = F.when(F.col("rest").isNull(), F.lit("IsCoveredByOther.NotCoveredByAnyFeature")).otherwise(F.lit("IsCoveredByOther.NotFullyCovered"))
    return issues(left, code, F.array(F.struct("tab", "oid")), values=[F.round("rest", 6)])


def qa_contained_points_count(polygons: Table, points: Tables, minimum: int, maximum: int, condition: str | None = None, on_border: bool = False) -> DataFrame:
    pairs = S.other_pairs([points], [polygons], _fields([points]), _fields([polygons]))
    pairs = pairs.where(S.conditioned(pairs, condition, default=True))
    inside = S.related(pairs, "covered_by" if on_border else "within")
    counts = inside.groupBy(F.col("b.oid").alias("oid")).agg(F.count("*").alias("n"))
    rows = _all([polygons]).join(counts, "oid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    code = F.when(F.col("n") < minimum, F.lit("ContainedPointsCount.TooFewPoints")).when(F.col("n") > maximum, F.lit("ContainedPointsCount.TooManyPoints"))
    return issues(rows.withColumn("_code", code).where("_code is not null"), F.col("_code"), F.array(F.struct("tab", "oid")), values=[F.col("n")])


def qa_duplicate_geometry_self(table: Table, valid: str | None = None, one_per_set: bool = False) -> DataFrame:
    """Equal shapes, found by a hash of the points (in any order and direction) and never by comparing pairs of all shapes."""
    pts = F.array_sort(F.array_distinct(F.transform(G.points(F.col(table.geom)), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))))
    rows = table.rows.where(~G.is_empty(F.col(table.geom))).select(F.col(table.oid).cast("bigint").alias("oid"), F.sha2(F.to_json(F.struct(F.col(f"{table.geom}.kind").alias("k"), pts.alias("p"))), 256).alias("h"), *_fields([table]))
    if one_per_set:
        sets = rows.groupBy("h").agg(F.array_sort(F.collect_list("oid")).alias("oids")).where(F.size("oids") > 1)
        return issues(sets, "DuplicateGeometrySelf.GeometriesEqualInXY", F.transform("oids", lambda o: F.struct(F.lit(table.name).alias("tab"), o.alias("oid"))))
    pairs = rows.select(F.struct("*").alias("a"), "h").join(rows.select(F.struct("*").alias("b"), F.col("h").alias("h2")), F.col("h") == F.col("h2")).where("a.oid < b.oid")
    pairs = pairs.where(~S.conditioned(pairs, valid, undirected=True))
    return issues(pairs, "DuplicateGeometrySelf.GeometriesEqualInXY", [(table.name, "a.oid"), (table.name, "b.oid")])


def qa_min_intersect(tables: Tables, limit: float) -> DataFrame:
    """Pairs of polygons with a part of their intersection smaller than limit."""
    pairs = S.related(S.self_pairs(list(tables)), "interior_intersects")
    areas = S.with_function(pairs, "areas", "array<double>", lambda a, b: [abs(planar.ring_area(r)) for r in planar.intersection(a, b, 2)[1]])
    return issues(areas.select("a", "b", F.explode("areas").alias("v")).where(F.col("v") < limit), "MinIntersect.IntersectionTooSmall", _both(), values=[F.round("v", 9)])


def _crossings(a: planar.Shape, b: planar.Shape) -> list[tuple[float, float, float, bool, bool]]:
    """(x, y, angle, end of a, end of b) of the places where two lines meet in a point."""
    eps = planar.tolerance(a, b)
    ends = [[p for part in s[1] for p in (part[0], part[-1])] for s in (a, b)]
    found: dict[tuple, tuple] = {}
    for p, q in planar.segments(a):
        for r, s in planar.segments(b):
            hits = planar.meeting(p, q, r, s, eps)
            if len(hits) != 1:
                continue
            x, y = hits[0]
            turn = abs(math.atan2((q[0] - p[0]) * (s[1] - r[1]) - (q[1] - p[1]) * (s[0] - r[0]), (q[0] - p[0]) * (s[0] - r[0]) + (q[1] - p[1]) * (s[1] - r[1])))
            at_end = [any(math.dist(hits[0], e) <= eps for e in side) for side in ends]
            key = (round(x / (8 * eps)), round(y / (8 * eps)))
            angle = min(turn, math.pi - turn)
            if key not in found or angle < found[key][2]:
                found[key] = (x, y, angle, *at_end)
    return list(found.values())


_CROSSING = "array<struct<x:double,y:double,angle:double,end_a:boolean,end_b:boolean>>"


def line_crossings(tables: Tables, valid: str | None = None) -> DataFrame:
    pairs = S.self_pairs(list(tables), _fields(tables))
    pairs = pairs.where(~S.conditioned(pairs, valid, undirected=True))
    keys = ("x", "y", "angle", "end_a", "end_b")
    made = S.with_function(pairs, "hits", _CROSSING, lambda a, b: [dict(zip(keys, h, strict=True)) for h in _crossings(a, b)])
    return made.select("a", "b", F.explode("hits").alias("hit"))


def qa_line_intersect(tables: Tables, valid: str | None = None, allow_end_on_interior: bool = False) -> DataFrame:
    """Meetings of two lines that are not end on end, one by one."""
    hits = line_crossings(tables, valid).where(~(F.col("hit.end_a") & F.col("hit.end_b")))
    if allow_end_on_interior:
        hits = hits.where(~(F.col("hit.end_a") | F.col("hit.end_b")))
    return issues(hits, "LineIntersect.LinesIntersect", _both())


def qa_line_intersect_angle(tables: Tables, limit: float) -> DataFrame:
    hits = line_crossings(tables).where(~F.col("hit.end_a") & ~F.col("hit.end_b") & (F.col("hit.angle") < limit))
    return issues(hits, "LineIntersectAngle.AngleTooSmall", _both(), values=[F.round("hit.angle", 9)])


def _z_expression(side: str) -> Column:
    """The height of a line at the meeting point, interpolated along the segment it is on."""
    parts = F.flatten(F.transform(F.col(f"{side}.geom.parts"), lambda p: F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda u, v: F.struct(u.alias("u"), v.alias("v")))))
    x, y = F.col("hit.x"), F.col("hit.y")

    def place(s: Column) -> Column:
        dx, dy = s["v"]["x"] - s["u"]["x"], s["v"]["y"] - s["u"]["y"]
        return F.try_divide((x - s["u"]["x"]) * dx + (y - s["u"]["y"]) * dy, dx * dx + dy * dy)

    def off(s: Column) -> Column:
        t = place(s)
        return F.hypot(s["u"]["x"] + t * (s["v"]["x"] - s["u"]["x"]) - x, s["u"]["y"] + t * (s["v"]["y"] - s["u"]["y"]) - y)

    here = F.filter(parts, lambda s: place(s).between(-1e-9, 1 + 1e-9) & (off(s) < 1e-6))
    s = F.get(here, F.lit(0))
    return s["u"]["z"] + place(s) * (s["v"]["z"] - s["u"]["z"])


def qa_line_intersect_z(tables: Tables, minimum: float, maximum: float, constraint: str | None = None) -> DataFrame:
    """Crossings whose height difference is out of bounds (a bound of 0 is none), then those that break the pair constraint, where G1 is
    the upper feature."""
    hits = line_crossings(tables).withColumn("za", _z_expression("a")).withColumn("zb", _z_expression("b")).where("za is not null and zb is not null and not (hit.end_a and hit.end_b)").withColumn("dz", F.abs(F.col("za") - F.col("zb")))
    code = F.when(F.lit(minimum > 0) & (F.col("dz") < minimum), F.lit("LineIntersectZ.DifferenceTooSmall")).when(F.lit(maximum > 0) & (F.col("dz") > maximum), F.lit("LineIntersectZ.DifferenceTooLarge"))
    upper = F.when(F.col("za") >= F.col("zb"), F.col("a"))
    if constraint:
        turned = hits.select(F.coalesce(upper, F.col("b")).alias("a"), F.when(F.col("za") >= F.col("zb"), F.col("b")).otherwise(F.col("a")).alias("b"), "hit", "dz")
        hits = turned
        code = F.coalesce(code, F.when(~S.conditioned(turned, constraint, default=True), F.lit("LineIntersectZ.ConstraintNotFulfilled")))
    return issues(hits.withColumn("_code", code).where("_code is not null"), F.col("_code"), _both(), values=[F.round("dz", 9)])


def qa_z_difference_self(tables: Tables, minimum: float, maximum: float) -> DataFrame:
    return _z_difference(S.related(S.self_pairs(list(tables)), "intersects"), minimum, maximum)


def qa_z_difference_other(tables: Tables, others: Tables, minimum: float, maximum: float) -> DataFrame:
    return _z_difference(S.related(S.other_pairs(list(tables), list(others)), "intersects"), minimum, maximum)


def _z_difference(pairs: DataFrame, minimum: float, maximum: float) -> DataFrame:
    """Distance of the height ranges (0 if they overlap) of intersecting features out of bounds."""
    ends = {f"{s}{k}": f(F.col(f"{s}.geom"), "z") for s in "ab" for k, f in (("low", G.lowest), ("high", G.highest))}
    pairs = pairs.withColumns(ends).withColumn("dz", F.greatest(F.col("alow") - F.col("bhigh"), F.col("blow") - F.col("ahigh"), F.lit(0.0)))
    code = F.when(F.lit(minimum > 0) & (F.col("dz") < minimum), F.lit("ZDifference.TooSmall")).when(F.lit(maximum > 0) & (F.col("dz") > maximum), F.lit("ZDifference.TooLarge"))
    return issues(pairs.withColumn("_code", code).where("_code is not null"), F.col("_code"), _both(), values=[F.round("dz", 9)])


def qa_neighbour_areas(table: Table, constraint: str | None = None, fields: Sequence[str] = (), allow_point: bool = True) -> DataFrame:
    """Touching polygons that break a constraint, or agree in all compared fields."""
    pairs = S.related(S.self_pairs([table], _fields([table])), "touches")
    if allow_point:
        pairs = pairs.where(F.substring("matrix", 5, 1) == "1")
    if constraint:
        return issues(pairs.where(~S.conditioned(pairs, constraint, undirected=True)), "NeighbourAreas.ConstraintNotFulfilled", _both())
    same = F.lit(True)
    for f in fields or _fields([table]):
        same = same & F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))
    return issues(pairs.where(same), "NeighbourAreas.FieldValuesEqual", _both())


def qa_no_gaps(table: Table, sliver_limit: float = -1, max_area: float = -1) -> DataFrame:
    """Holes between polygons: interior rings of the union of each block of touching polygons, thin or small enough to be gaps.

    Blocks are connected components of touching polygons, dissolved one by one.
    """
    pairs = S.related(S.self_pairs([table]), "intersects").select(F.col("a.oid").alias("a"), F.col("b.oid").alias("b"))
    rows = S.shapes(table).select("oid", S.packed(F.col("geom")).alias("own"))
    blocks = connected(rows.select("oid"), pairs, "oid")

    def holes(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        total = planar.union([S.unpacked(x) for x in part["own"]])
        found = [(-planar.ring_area(r), planar.length(("line", [r]))) for r in total[1] if planar.ring_area(r) < 0]
        kept = [a for a, p in found if a > 0 and (sliver_limit <= 0 or p * p / a > sliver_limit) and (max_area <= 0 or a <= max_area)]
        return pd.DataFrame({"oid": [key[0]] * len(kept), "size": kept}).astype({"oid": "int64", "size": "float64"})

    gaps = rows.hint("merge").join(blocks, "oid").groupBy("comp").applyInPandas(holes, "oid long, size double")
    return issues(gaps, "NoGaps.Gap", [(table.name, "oid")], values=[F.round("size", 6)])
