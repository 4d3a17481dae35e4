"""Transformers that make, change or filter geometry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.functions import planar
from plumbline.functions.expressions import Value, holds, kind_of, names_of, projection
from plumbline.issues import Table
from plumbline.operators import spatial as S
from plumbline.operators.network import connected, node_table
from plumbline.operators.relations import _fields


def tr_spatial_join(left: Table, right: Table, constraint: str | None = None, outer: bool = False, grouped: bool = False, attributes: Sequence[str] = (), calc: Sequence[str] = ()) -> Table:
    """Each left feature with the right ones that are not disjoint from it and meet the constraint (aliases T0, T1).

    Pairs: the fields of both, those that clash prefixed with the right table's name. grouped: one row per left feature with aggregate
    attributes over the right rows, which see calc, row-level attributes. outer keeps left features without partners, with nulls (also for COUNT).
    """
    t0, t1 = _fields([left]), _fields([right])
    pairs = S.other_pairs([left], [right], t0, t1)
    condition = constraint and constraint.replace("T0.", "G1.").replace("T1.", "G2.").replace("t0.", "G1.").replace("t1.", "G2.")
    met = S.related(pairs.where(S.conditioned(pairs, condition, default=True)), "intersects").select("a", "b")
    names = {n.lower(): Value(F.col(f"b.`{n}`"), kind_of(t)) for n, t in right.df.dtypes if n in t1} | {right.oid.lower(): Value(F.col("b.oid"), "number"), "objectid": Value(F.col("b.oid"), "number")}
    for text in calc:
        name, column = projection(text, names)
        met = met.withColumn(name, column)
        names[name.lower()] = Value(F.col(name), kind_of(dict(met.dtypes)[name]))
    base = left.rows.where(~G.is_empty(F.col(left.geom)))
    key = F.col(left.oid).cast("bigint")
    if grouped:
        made = [column.alias(name) for name, column in (projection(a, names) for a in attributes)]
        right_side = met.groupBy(F.col("a.oid").alias("_oid")).agg(*made)
    else:
        taken = {c.lower() for c in base.columns}
        fields = [F.col(f"b.{c}").alias(f"{right.name}_{c}" if c.lower() in taken else c) for c in t1]
        right_side = met.select(F.col("a.oid").alias("_oid"), F.col("b.oid").alias(f"{right.name}_oid"), *fields)
    # merged: a small file can hold millions of shapes, too many to broadcast
    out = base.hint("merge").join(right_side, key == F.col("_oid"), "left" if outer else "inner").drop("_oid")
    return Table(out, f"{left.name}_{right.name}", left.oid, left.geom)


def tr_intersect(one: Table, two: Table, dimension: int = -1) -> DataFrame:
    """(oid, other, geom, part_intersected, intersection_ratio) of each intersecting pair; of one table with itself, other < oid."""
    same = one.name == two.name
    pairs = S.related(S.other_pairs([one], [two]), "intersects")
    if same:
        pairs = pairs.where("b.oid < a.oid")
    wanted = None if dimension < 0 else dimension

    def measure(s: planar.Shape) -> float:
        return planar.area(s) if s[0] == "polygon" else planar.length(s) if s[0] == "line" else float(len(s[1]))

    def cut(a: planar.Shape, b: planar.Shape) -> dict:
        found = planar.intersection(a, b, wanted)
        part = measure(found)
        return {"geom": S.as_geometry(found), "part": part, "ratio": part / measure(a) if found[0] == a[0] and measure(a) else None}

    made = S.with_function(pairs, "cut", f"struct<geom:{G.GEOMETRY},part:double,ratio:double>", cut)
    return made.where("cut.geom is not null").select(F.col("a.oid").alias("oid"), F.col("b.oid").alias("other"), F.col("cut.geom").alias("geom"), F.col("cut.part").alias("part_intersected"), F.col("cut.ratio").alias("intersection_ratio"))


def tr_dissolve(table: Table, group_by: Sequence[str] = (), attributes: Sequence[str] = (), constraint: str | None = None) -> DataFrame:
    """Connected features of equal group values merged: polygons that share a border are united, lines that share an end become one
    multi-part line. Aggregate attributes see the merged rows; the constraint filters results.

    Lines link by nodes, polygons by pairs; a component is dissolved in its own task.
    """
    keyed = table.rows.where(~G.is_empty(F.col(table.geom))).withColumn("_g", F.to_json(F.struct(*[F.col(g) for g in group_by])) if group_by else F.lit(""))
    t = Table(keyed, table.name, table.oid, table.geom)
    kind = F.col(f"{table.geom}.kind")
    part = lambda where: Table(keyed.where(where), table.name, table.oid, table.geom)
    # lines and polygons of one table are dissolved apart, and points stay as they are
    nodes = node_table([part(kind == "line")], 0.0, ["_g"])
    least = nodes.groupBy("_g", "x", "y").agg(F.min("oid").alias("a"))
    links = nodes.join(least, ["_g", "x", "y"]).where("oid <> a").select("a", F.col("oid").alias("b"))
    pairs = S.self_pairs([part(~kind.isin("line", "point"))], ("_g",)).where("a._g = b._g")
    met = S.related(pairs, lambda m: F.substring(m, 1, 1).isin("1", "2") | (F.substring(m, 5, 1) == "1"))
    links = links.unionByName(met.select(F.col("a.oid").alias("a"), F.col("b.oid").alias("b")))
    comps = connected(keyed.select(F.col(table.oid).cast("bigint").alias("node")), links)
    rows = keyed.join(comps, F.col(table.oid).cast("bigint") == F.col("node"))
    names = names_of(rows)
    made = [column.alias(name) for name, column in (projection(a, names) for a in attributes)]

    def merge(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        shapes = [S.unpacked(x) for x in part["own"]]
        total = planar.union(shapes) if shapes[0][0] == "polygon" else (shapes[0][0], [p for s in shapes for p in s[1]])
        x, y = ([float(q[k]) for r in total[1] for q in r] for k in (0, 1))
        return pd.DataFrame({"comp": [key[0]], "_g": [key[1]], "kind": [total[0]], "sizes": [[len(r) for r in total[1]]], "x": [x], "y": [y]})

    shapes = rows.select("comp", "_g", S.packed(F.col(table.geom)).alias("own")).groupBy("comp", "_g").applyInPandas(merge, "comp long, _g string, kind string, sizes array<int>, x array<double>, y array<double>")
    points = F.transform(F.arrays_zip("x", "y"), lambda p: G.vertex(p["x"], p["y"]))
    starts = F.transform("sizes", lambda n, i: F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0), lambda acc, v: acc + v))
    parts = F.zip_with(starts, F.col("sizes"), lambda at, n: F.slice(points, at + 1, n))
    shapes = shapes.select("comp", "_g", F.struct("kind", parts.alias("parts")).alias("geom"))
    plain = rows.groupBy("comp", "_g").agg(F.count("*").alias("n_merged"), *[F.first(g).alias(g) for g in group_by], *made)
    out = plain.join(shapes, ["comp", "_g"]).drop("_g").withColumnRenamed("comp", "oid")
    return out.where(holds(constraint, names_of(out))) if constraint else out


def tr_geometry_to_points(table: Table, component: str = "entire") -> DataFrame:
    """Every vertex of a component as a point, with part_index and vertex_index; all fields stay."""
    keep = _fields([table])
    rows = table.rows.select(F.col(table.oid).cast("bigint").alias("oid"), G.component(F.col(table.geom), component).alias("g"), *keep)
    v = G.vertices_of(rows, "oid", "g", *keep)
    return v.select("oid", *keep, F.col("part").alias("part_index"), F.col("vertex").alias("vertex_index"), G.point("x", "y", "z", "m").alias("geom"))


def tr_multiline_to_line(table: Table) -> DataFrame:
    """One line per part (of polygons: per ring), with part_index."""
    keep = _fields([table])
    return table.rows.select(F.col(table.oid).cast("bigint").alias("oid"), *keep, F.posexplode(f"{table.geom}.parts").alias("part_index", "p")).select("oid", *keep, "part_index", G.line(F.col("p")).alias("geom"))


def tr_polygon_to_line(table: Table) -> Table:
    return Table(table.df.withColumn(table.geom, F.struct(F.lit("line").alias("kind"), F.col(f"{table.geom}.parts").alias("parts"))), table.name, table.oid, table.geom, table.where)


def tr_line_to_polygon(table: Table, close: bool = False) -> Table:
    """Closed lines as polygons; others are left out, or closed."""
    parts = F.col(f"{table.geom}.parts")
    closed = F.transform(parts, lambda p: F.when(G.is_closed(p), p).otherwise(F.concat(p, F.array(p[0]))))
    clockwise = F.transform(closed, lambda p: F.when(G.ring_area(p) < 0, F.reverse(p)).otherwise(p))
    rows = table.df if close else table.df.where(F.forall(parts, G.is_closed))
    return Table(rows.withColumn(table.geom, F.struct(F.lit("polygon").alias("kind"), clockwise.alias("parts"))), table.name, table.oid, table.geom, table.where)


def tr_multipolygon_to_polygon(table: Table, parts: str = "single") -> DataFrame:
    """single: exterior rings with the interior ones inside them (ring_index -2); outer (-1), inner (0 on, turned round) or all rings."""
    g = F.col(table.geom)
    keep = _fields([table])
    base = table.rows.select(F.col(table.oid).cast("bigint").alias("oid"), *keep, G.exterior_rings(g).alias("outer"), G.interior_rings(g).alias("inner"))
    outer = base.select("oid", *keep, "inner", F.posexplode("outer").alias("polygon_index", "ring"))
    if parts == "single":
        # a hole belongs to the exterior ring whose envelope holds its first point
        box = lambda axis, f: f(F.transform(F.col("ring"), lambda p: p[axis]))
        own = F.filter("inner", lambda r: r[0]["x"].between(box("x", F.array_min), box("x", F.array_max)) & r[0]["y"].between(box("y", F.array_min), box("y", F.array_max)))
        return outer.select("oid", *keep, "polygon_index", F.lit(-2).alias("ring_index"), G.polygon(F.concat(F.array("ring"), own)).alias("geom"))
    exterior = outer.select("oid", *keep, "polygon_index", F.lit(-1).alias("ring_index"), G.polygon(F.array("ring")).alias("geom"))
    interior = base.select("oid", *keep, F.posexplode("inner").alias("ring_index", "ring")).select("oid", *keep, F.lit(-1).alias("polygon_index"), "ring_index", G.polygon(F.array(F.reverse("ring"))).alias("geom"))
    return {"outer": exterior, "inner": interior, "all": exterior.unionByName(interior)}[parts]


def tr_footprint(table: Table) -> Table:
    """The outline of the rings of a multipatch in the plane, one after the other united."""

    def outline(shape: planar.Shape) -> dict | None:
        rings = [("polygon", [r if planar.ring_area(r) > 0 else r[::-1]]) for r in shape[1] if abs(planar.ring_area(r)) > 1e-12]
        return S.as_geometry(planar.union(rings))

    return Table(table.df.withColumn(table.geom, S.of_shape(F.col(table.geom), G.GEOMETRY, outline)), table.name, table.oid, table.geom, table.where)


def tr_project(table: Table, target: str) -> Table:
    """Web-Mercator metres from degrees (EPSG:3857) or back (EPSG:4326); other systems need a library."""
    r = 6378137.0
    g = F.col(table.geom)

    def to_metres(p):
        return F.struct((F.radians(p["x"]) * r).alias("x"), (F.log(F.tan(F.lit(0.7853981633974483) + F.radians(p["y"]) / 2)) * r).alias("y"), p["z"].alias("z"), p["m"].alias("m"), p["id"].alias("id"))

    def to_degrees(p):
        return F.struct(F.degrees(p["x"] / r).alias("x"), F.degrees(2 * F.atan(F.exp(p["y"] / r)) - F.lit(1.5707963267948966)).alias("y"), p["z"].alias("z"), p["m"].alias("m"), p["id"].alias("id"))

    made = {"EPSG:3857": to_metres, "EPSG:4326": to_degrees}[target]
    parts = F.transform(g["parts"], lambda part: F.transform(part, made))
    return Table(table.df.withColumn(table.geom, F.struct(g["kind"].alias("kind"), parts.alias("parts"))), table.name, table.oid, table.geom, table.where)


# filters of features and issues


def _meeting(table: Table, other: Table, relation: str) -> DataFrame:
    return S.related(S.other_pairs([table], [other]), relation).select(F.col("a.oid").alias("_hit")).distinct()


def _kept(table: Table, hits: DataFrame, how: str) -> Table:
    return Table(table.rows.join(hits, F.col(table.oid).cast("bigint") == F.col("_hit"), how), table.name, table.oid, table.geom)


def tr_only_intersecting(table: Table, other: Table) -> Table:
    return _kept(table, _meeting(table, other, "intersects"), "left_semi")


def tr_only_disjoint(table: Table, other: Table) -> Table:
    return _kept(table, _meeting(table, other, "intersects"), "left_anti")


def tr_only_contained(table: Table, other: Table) -> Table:
    return _kept(table, _meeting(table, other, "within"), "left_semi")


def tr_combined_filter(table: Table, filters: Mapping[str, Table], expression: str | None = None) -> Table:
    """A boolean expression over filters by name, each the rows of the table it keeps; all of them without one."""
    rows, flags = table.rows, {}
    for k, (name, kept) in enumerate(filters.items()):
        hits = kept.rows.select(F.col(kept.oid).alias(f"_hit{k}")).distinct()
        rows = rows.join(hits, F.col(table.oid) == F.col(f"_hit{k}"), "left").withColumn(f"_f{k}", F.col(f"_hit{k}").isNotNull()).drop(f"_hit{k}")
        flags[name.lower()] = Value(F.col(f"_f{k}"), "boolean")
    wanted = holds(expression or " AND ".join(filters), flags)
    return Table(rows.where(wanted).drop(*[f"_f{k}" for k in range(len(filters))]), table.name, table.oid, table.geom)


def rf_execute_area(table: Table, area: Table) -> Table:
    """Features within a feature of the area; tables without geometry pass."""
    return tr_only_contained(table, area) if table.geom else table


def with_place(found: DataFrame, tables: Sequence[Table]) -> Table:
    """Issues with the shape of their first row as geometry."""
    shapes = None
    for t in tables:
        rows = t.rows.select(F.lit(t.name).alias("_tab"), F.col(t.oid).cast("bigint").alias("_oid"), F.col(t.geom).alias("place"))
        shapes = rows if shapes is None else shapes.unionByName(rows)
    numbered = found.withColumn("issue", F.xxhash64("issue_code", F.to_json("involved"), F.coalesce("description", F.lit(""))))
    first = F.get("involved", F.lit(0))
    return Table(numbered.join(shapes, (first["tab"] == F.col("_tab")) & (first["oid"] == F.col("_oid")), "left").drop("_tab", "_oid"), "issues", "issue", "place")


def related_shapes(table: Table, feature: Table, key: str, feature_key: str) -> Table:
    """A table without geometry, with the shapes of its related features as one geometry (of the kind most of them have); rows without
    related features stay without. With it, issues of table rows get a place, and areas can filter them."""
    g = F.col(feature.geom)
    rows = feature.rows.where(~G.is_empty(g)).select(F.col(feature_key).cast("string").alias("_key"), g["kind"].alias("_kind"), g["parts"].alias("_parts"))
    own = table.rows.select(F.col(table.oid).alias("_oid"), F.col(key).cast("string").alias("_own"))
    met = own.join(rows, F.col("_own") == F.col("_key")).groupBy("_oid", "_kind").agg(F.count("*").alias("n"), F.flatten(F.collect_list("_parts")).alias("_parts"))
    best = met.groupBy("_oid").agg(F.max_by(F.struct(F.col("_kind").alias("kind"), F.col("_parts").alias("parts")), F.struct("n", "_kind")).alias("related"))
    out = table.rows.join(best, F.col(table.oid) == F.col("_oid"), "left").withColumn("related", F.col("related").cast(G.GEOMETRY)).drop("_oid")
    return Table(out, table.name, table.oid, "related")


def if_all(found: DataFrame, suppress: bool = True) -> DataFrame:
    return found.where(F.lit(not suppress))


def _if(placed: Table, other: Table, relation: str) -> DataFrame:
    """Issues without a place are never suppressed."""
    hits = _meeting(placed, other, relation)
    return placed.df.join(hits, F.col(placed.oid) == F.col("_hit"), "left_anti")


def if_intersecting(placed: Table, other: Table) -> DataFrame:
    return _if(placed, other, "intersects")


def if_within(placed: Table, other: Table) -> DataFrame:
    return _if(placed, other, "covered_by")


def if_near(placed: Table, other: Table, near: float) -> DataFrame:
    """Without the issues whose place is near features: points nearer than near to one, lines covered by their near surroundings."""
    from plumbline.operators.proximity import _STRETCH, merged, near_stretches

    pairs = S.other_pairs([placed], [other], (), (), near)
    near_points = S.distances(pairs.where("a.geom.kind = 'point'"), "d").where(F.col("d") < near).select(F.col("a.oid").alias("_hit"))
    rest = S.with_function(pairs.where("a.geom.kind <> 'point'"), "found", _STRETCH, lambda a, b: near_stretches(a, b, near))
    runs = merged(rest.select(F.col("a.oid").alias("oid"), F.explode("found").alias("f")).select("oid", "f.*"), ["oid", "part"])
    covered = runs.groupBy("oid").agg(F.sum(F.col("high") - F.col("low")).alias("c"))
    whole = placed.df.select(F.col(placed.oid).alias("oid"), G.length(F.col(placed.geom)).alias("len"))
    hits = near_points.unionByName(covered.join(whole, "oid").where("c >= len - 1e-6").select(F.col("oid").alias("_hit"))).distinct()
    return placed.df.join(hits, F.col(placed.oid) == F.col("_hit"), "left_anti")


def if_involved_rows(found: DataFrame, constraint: str, tables: Sequence[Table]) -> DataFrame:
    """Without the issues of which any involved row of the tables fulfils the constraint."""
    hits = None
    for t in tables:
        rows = t.rows.where(holds(constraint, names_of(t.df))).select(F.lit(t.name).alias("_tab"), F.col(t.oid).cast("bigint").alias("_oid"))
        hits = rows if hits is None else hits.unionByName(rows)
    key = F.xxhash64("issue_code", F.to_json("involved"), F.coalesce("description", F.lit("")))
    numbered = found.withColumn("_issue", key)
    parts = numbered.select("_issue", F.explode("involved").alias("r")).join(hits, (F.col("r.tab") == F.col("_tab")) & (F.col("r.oid") == F.col("_oid")), "left_semi").select("_issue").distinct()
    return numbered.join(parts, "_issue", "left_anti").drop("_issue")


__all__ = [n for n in dir() if n.startswith(("tr_", "if_", "rf_"))] + ["related_shapes", "with_place"]
