"""Checks of line networks by their nodes, and graph operators: components, polygons, shortest paths.

A node is an end point snapped to a grid of the tolerance (exact coordinates without one). Snapping to a grid is
deterministic, unlike a sweep in which the first point claims its neighbours; two ends on either side of a grid line can stay apart.
"""

import math
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.functions import planar
from plumbline.functions.expressions import Value, holds, names_of, projection
from plumbline.issues import Table, issues
from plumbline.operators import spatial as S
from plumbline.session import materialize

Tables = Sequence[Table]
ROW = "array<struct<tab:string,oid:bigint>>"


def snapped(c: Column, tolerance: float) -> Column:
    return F.round(c / tolerance).cast("bigint").cast("double") * tolerance if tolerance > 0 else c


def node_table(tables: Tables, tolerance: float = 0.0, keep: Sequence[str] = ()) -> DataFrame:
    """(x, y, tab, oid, kind, is_start, ax, ay, m, z, kept fields): one row an end of a line or a point; (ax, ay) is the next vertex."""
    out = None
    for t in tables:
        rows = t.rows.where(~G.is_empty(F.col(t.geom)))
        extra = [F.col(k) if k in rows.columns else F.lit(None).cast("string").alias(k) for k in keep]
        parts = rows.select(F.lit(t.name).alias("tab"), F.col(t.oid).cast("bigint").alias("oid"), F.col(f"{t.geom}.kind").alias("kind"), *extra, F.explode(f"{t.geom}.parts").alias("p"))
        first, last = F.col("p")[0], F.element_at("p", -1)
        ends = F.when(F.col("kind") == "point", F.array(F.struct(first.alias("at"), first.alias("next"), F.lit(True).alias("is_start")))).otherwise(
            F.array(F.struct(first.alias("at"), F.get("p", F.lit(1)).alias("next"), F.lit(True).alias("is_start")), F.struct(last.alias("at"), F.get("p", F.size("p") - 2).alias("next"), F.lit(False).alias("is_start")))
        )
        made = parts.select("tab", "oid", "kind", *keep, F.explode(ends).alias("e")).select(
            "tab", "oid", "kind", *keep, snapped(F.col("e.at.x"), tolerance).alias("x"), snapped(F.col("e.at.y"), tolerance).alias("y"), F.col("e.at.z").alias("z"), F.col("e.at.m").alias("m"), F.col("e.next.x").alias("ax"), F.col("e.next.y").alias("ay"), F.col("e.is_start").alias("is_start")
        )
        out = made if out is None else out.unionByName(made)
    return out


def _wkt() -> Column:
    return F.concat(F.lit("POINT("), F.col("x").cast("string"), F.lit(" "), F.col("y").cast("string"), F.lit(")"))


def degrees(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("x", "y").agg(F.count_if(F.col("kind") != "point").alias("n_lines"), F.count_if(F.col("kind") == "point").alias("n_points"))


def qa_dangle_count(tables: Tables, expressions: str | Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """Features whose number of dangling ends does not fulfil the expression over _DangleCount."""
    expressions = [expressions] * len(tables) if isinstance(expressions, str) else list(expressions)
    nodes = node_table(tables, tolerance)
    dangling = nodes.join(degrees(nodes), ["x", "y"]).where("n_lines = 1 and n_points = 0")
    counts = dangling.groupBy("tab", "oid").agg(F.count("*").alias("_DangleCount"))
    rows = nodes.select("tab", "oid").distinct().join(counts, ["tab", "oid"], "left").withColumn("_DangleCount", F.coalesce("_DangleCount", F.lit(0)))
    names = {"_danglecount": Value(F.col("_DangleCount"), "number")}
    met = F.lit(True)
    for t, e in zip(tables, expressions, strict=True):
        met = met & ((F.col("tab") != t.name) | holds(e, names))
    return issues(rows.where(~met), "DangleCount.DangleCountNotExpected", F.array(F.struct("tab", "oid")), values=[F.col("_DangleCount")])


def qa_dangles(tables: Tables, tolerance: float = 0.0) -> DataFrame:
    """Nodes where one line end stands alone."""
    return issues(degrees(node_table(tables, tolerance)).where("n_lines = 1"), "Connections.Dangle", F.array().cast(ROW), geom=_wkt())


def qa_orphan_node(points: Tables, lines: Tables, mode: str = "both", tolerance: float = 0.0) -> DataFrame:
    """Points without a line end (orphans), and line ends without a point (missing nodes)."""
    nodes = node_table([*points, *lines], tolerance)
    found = nodes.join(degrees(nodes), ["x", "y"])
    orphans = issues(found.where("kind = 'point' and n_lines = 0"), "OrphanNode.OrphanNode", F.array(F.struct("tab", "oid")))
    missing = issues(found.where("kind <> 'point' and n_points = 0"), "OrphanNode.MissingNode", F.array(F.struct("tab", "oid")))
    return {"both": orphans.unionByName(missing), "orphans": orphans, "missing": missing}[mode]


def qa_pseudo_nodes(tables: Tables, compared: Sequence[str], valid: Tables = (), tolerance: float = 0.0, ignore_loops: bool = True) -> DataFrame:
    """Nodes where exactly two line ends with equal compared fields meet, and no point or valid pseudo node is."""
    nodes = node_table([*tables, *valid], tolerance, compared)
    per = nodes.groupBy("x", "y").agg(
        F.count_if(F.col("kind") != "point").alias("n_lines"), F.count_if(F.col("kind") == "point").alias("n_points"),
        F.min(F.struct("tab", "oid", *compared)).alias("a"), F.max(F.struct("tab", "oid", *compared)).alias("b"),
    )
    same = F.lit(True)
    for c in compared:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    loop = (F.col("a.tab") == F.col("b.tab")) & (F.col("a.oid") == F.col("b.oid"))
    bad = per.where((F.col("n_lines") == 2) & (F.col("n_points") == 0) & same & (~loop if ignore_loops else F.lit(True)))
    return issues(bad, "PseudoNodes.PseudoNode", F.array(F.struct("a.tab", "a.oid"), F.struct("b.tab", "b.oid")))


def qa_flow_logic(tables: Tables, flip: str | None = None, allow_multiple: bool = False, tolerance: float = 0.0) -> DataFrame:
    """Nodes without exactly one outgoing line."""
    flagged = [Table(t.df.withColumn("_flip", holds(flip, names_of(t.df), default=False)), t.name, t.oid, t.geom, t.where) for t in tables]
    nodes = node_table(flagged, tolerance, ["_flip"])
    out = nodes.groupBy("x", "y").agg(F.count_if(F.col("is_start") != F.col("_flip")).alias("n"))
    code = F.when(F.col("n") == 0, F.lit("FlowLogic.NoOutgoingLine")).when((F.col("n") > 1) & F.lit(not allow_multiple), F.lit("FlowLogic.MultipleOutgoingLines"))
    return issues(out.withColumn("_code", code).where("_code is not null"), F.col("_code"), F.array().cast(ROW), geom=_wkt())


def qa_connections(tables: Tables, rules: Sequence[Sequence[str | None]], tolerance: float = 0.0, fields: Sequence[str] = ()) -> DataFrame:
    """Nodes at which no rule holds: a rule has one condition per table (None: its elements may not be there; empty: all may).

    Conditions see the fields and _StartsIn, whether a line starts at the node.
    """
    nodes = node_table(tables, tolerance, fields)
    names = names_of(nodes) | {"_startsin": Value(F.col("is_start"), "boolean")}
    flags = []
    for k, rule in enumerate(rules):
        met = F.lit(False)
        for t, condition in zip(tables, rule, strict=True):
            if condition is not None:
                met = met | ((F.col("tab") == t.name) & holds(condition, names))
        flags.append(met.alias(f"_r{k}"))
    per = nodes.select("x", "y", *flags).groupBy("x", "y").agg(*[F.bool_and(f"_r{k}").alias(f"_r{k}") for k in range(len(rules))])
    some = F.lit(False)
    for k in range(len(rules)):
        some = some | F.col(f"_r{k}")
    return issues(per.where(~some), "Connections.NoRuleFulfilled", F.array().cast(ROW), geom=_wkt())


def qa_line_connection_field_values(lines: Tables, field: str, points: Tables = (), point_field: str | None = None, mode: str = "all_equal", tolerance: float = 0.0) -> DataFrame:
    """Nodes of two or more line ends whose values break the rule: all_equal, at_least_two_equal, unique; with points, the point's value
    must be the most frequent one of its lines."""
    named = [Table(t.df.withColumn("_v", F.col(field).cast("string")), t.name, t.oid, t.geom, t.where) for t in lines]
    nodes = node_table(named, tolerance, ["_v"])
    counts = nodes.groupBy("x", "y", "_v").count().groupBy("x", "y").agg(F.sum("count").alias("n"), F.count("*").alias("kinds"), F.max("count").alias("most"), F.max_by("_v", F.struct("count", "_v")).alias("mode"))
    bad = {"all_equal": F.col("kinds") > 1, "at_least_two_equal": F.col("most") < 2, "unique": F.col("most") > 1}[mode]
    found = issues(counts.where((F.col("n") > 1) & bad), f"LineConnectionFieldValues.{mode}", F.array().cast(ROW), geom=_wkt())
    if points and point_field:
        p = node_table([Table(t.df.withColumn("_p", F.col(point_field).cast("string")), t.name, t.oid, t.geom, t.where) for t in points], tolerance, ["_p"])
        wrong = p.join(counts, ["x", "y"]).where(~F.col("_p").eqNullSafe(F.col("mode")))
        found = found.unionByName(issues(wrong, "LineConnectionFieldValues.PointValueNotMostFrequent", F.array(F.struct("tab", "oid"))))
    return found


def qa_min_angle(tables: Tables, limit: float, tolerance: float = 0.0) -> DataFrame:
    """Pairs of line ends at a node that enclose less than limit (radians).

    Ends meet only where their azimuths fall into the same sector or one beside it, sectors being as wide as limit: the rows made at a
    hub follow those found there, and not the square of its ends.
    """
    nodes = node_table(tables, tolerance).where("kind = 'line'").withColumn("az", F.atan2(F.col("ay") - F.col("y"), F.col("ax") - F.col("x")))
    sectors = max(1, int(2 * math.pi / limit)) if limit > 0 else 1
    sectors = sectors if sectors > 3 else 1
    nodes = nodes.withColumn("sector", F.pmod(F.floor((F.col("az") + math.pi) * sectors / (2 * math.pi)), F.lit(sectors)))
    around = F.array_distinct(F.array(*[F.pmod(F.col("sector") + k, F.lit(sectors)) for k in (-1, 0, 1)]))
    a, b = nodes.alias("a"), nodes.withColumn("sector", F.explode(around)).alias("b")
    order = F.struct("a.tab", "a.oid", "a.is_start") < F.struct("b.tab", "b.oid", "b.is_start")
    pairs = a.join(b, (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y")) & (F.col("a.sector") == F.col("b.sector")) & order)
    turn = F.abs(F.atan2(F.sin(F.col("a.az") - F.col("b.az")), F.cos(F.col("a.az") - F.col("b.az"))))
    found = pairs.select(F.struct("a.tab", "a.oid").alias("p"), F.struct("b.tab", "b.oid").alias("q"), turn.alias("v")).where(F.col("v") < limit)
    return issues(found, "MinAngle.AngleTooSmall", F.array("p", "q"), values=[F.round("v", 9)])


def qa_min_node_distance(tables: Tables, near: float, tolerance: float = 0.0) -> DataFrame:
    """Pairs of nodes of different features closer than near and farther than tolerance: a join of cells with their neighbours."""
    nodes = node_table(tables).select("tab", "oid", "is_start", "x", "y").distinct()
    own = nodes.withColumn("cx", F.floor(F.col("x") / near)).withColumn("cy", F.floor(F.col("y") / near))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    wide = own.withColumn("s", around).withColumn("cx", F.col("cx") + F.col("s.i")).withColumn("cy", F.col("cy") + F.col("s.j"))
    a, b = own.alias("a"), wide.alias("b")
    apart = F.sqrt((F.col("a.x") - F.col("b.x")) ** 2 + (F.col("a.y") - F.col("b.y")) ** 2)
    order = F.struct("a.tab", "a.oid") < F.struct("b.tab", "b.oid")
    pairs = a.join(b, (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & order).withColumn("v", apart).where((F.col("v") < near) & (F.col("v") > tolerance))
    return issues(pairs, "MinNodeDistance.NodeDistanceTooSmall", F.array(F.struct("a.tab", "a.oid"), F.struct("b.tab", "b.oid")), values=[F.round("v", 9)])


# graphs


def connected(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """(node, comp): the smallest node reachable over edges (a, b), by label propagation with pointer jumping; lineage is cut each round.

    Joins are merged: written labels are small files of many rows, too many to broadcast.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.col("a")).alias("comp")), "labels")
    while True:
        near = both.hint("merge").join(labels, both.b == labels.n).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.hint("merge").join(near, labels.n == near.a).select("n", "comp", F.least("comp", "near").alias("new"))
        root = labels.select(F.col("n").alias("r"), F.col("comp").alias("up"))
        step = materialize(step.join(root.hint("merge"), step.new == root.r, "left").select("n", "comp", F.least("new", F.coalesce("up", "new")).alias("new")), "labels")
        changed = step.where("new < comp").limit(1).count()
        labels = step.select("n", F.col("new").alias("comp"))
        if not changed:
            return nodes.join(labels.hint("merge"), nodes[node] == labels.n, "left").select(nodes[node], F.coalesce("comp", nodes[node]).alias("comp"))


def qa_gdb_topology(errors: DataFrame) -> DataFrame:
    """The stored results of topology rules (tab, oid, rule, dirty) as issues; a dirty area is an issue of its own."""
    code = F.when(F.col("dirty"), F.lit("GdbTopology.DirtyArea")).otherwise(F.lit("GdbTopology.RuleViolated"))
    return issues(errors, code, F.array(F.struct("tab", "oid")), F.col("rule"))


def clusters(points: Table, distance: float) -> DataFrame:
    """(oid, cluster): points linked over chains of steps of at most distance, named by their smallest oid.

    Merging the nearest clusters until all are farther apart gives these very groups, without comparing all pairs.
    """
    rows = [S.shapes(points, (), g) for g in (0.0, distance)]
    d = F.hypot(F.col("a.geom.parts")[0][0]["x"] - F.col("b.geom.parts")[0][0]["x"], F.col("a.geom.parts")[0][0]["y"] - F.col("b.geom.parts")[0][0]["y"])
    links = S.candidate_pairs(*rows, same=True).where(d <= distance).select(F.col("a.oid").alias("a"), F.col("b.oid").alias("b"))
    return connected(rows[0].select("oid"), links, "oid").withColumnRenamed("comp", "cluster")


def qa_group_connected(table: Table, group_by: Sequence[str], separator: str | None = None, tolerance: float = 0.0) -> DataFrame:
    """Groups of lines that are not one connected whole; with a separator, a row belongs to each of its field's values."""
    key = F.concat_ws("\x1f", *[F.coalesce(F.col(g).cast("string"), F.lit("")) for g in group_by])
    nodes = node_table([Table(table.df.withColumn("_g", key), table.name, table.oid, table.geom, table.where)], tolerance, ["_g"])
    if separator:
        nodes = nodes.withColumn("_g", F.explode(F.split("_g", separator, -1))).withColumn("_g", F.trim("_g"))
    # nodes of the graph are line numbers; ends at one place of one group are linked in a chain
    ids = nodes.withColumn("id", F.xxhash64("_g", "oid"))
    w = Window.partitionBy("_g", "x", "y").orderBy("id")
    links = ids.withColumn("b", F.lead("id").over(w)).where("b is not null").select(F.col("id").alias("a"), "b")
    lines = ids.select("_g", "oid", "id").distinct()
    comps = connected(lines.select("id"), links, "id")
    parts = lines.join(comps, "id").groupBy("_g").agg(F.count_distinct("comp").alias("n")).where("n > 1")
    return issues(parts, "GroupConnected.GroupNotConnected", F.array().cast(ROW), values=[F.col("_g"), F.col("n")])


def qa_line_group_constraints(table: Table, group_by: Sequence[str], min_group_length: float, min_dangle_length: float = 0.0, tolerance: float = 0.0) -> DataFrame:
    """Connected groups of lines shorter than min_group_length, and dangling lines shorter than min_dangle_length.

    Gap minima are not part of this: the length rules only.
    """
    key = F.concat_ws("\x1f", *[F.coalesce(F.col(g).cast("string"), F.lit("")) for g in group_by])
    own = Table(table.rows.withColumn("_g", key).withColumn("_len", G.length(F.col(table.geom))), table.name, table.oid, table.geom)
    nodes = node_table([own], tolerance, ["_g", "_len"]).withColumn("id", F.xxhash64("_g", "oid"))
    w = Window.partitionBy("_g", "x", "y").orderBy("id")
    links = nodes.withColumn("b", F.lead("id").over(w)).where("b is not null").select(F.col("id").alias("a"), "b")
    lines = nodes.select("_g", "oid", "_len", "id").distinct()
    comps = connected(lines.select("id"), links, "id")
    short = lines.join(comps, "id").groupBy("_g", "comp").agg(F.sum("_len").alias("v"), F.min("oid").alias("oid")).where(F.col("v") < min_group_length)
    found = issues(short, "LineGroupConstraints.GroupTooShort", [(table.name, "oid")], values=[F.round("v", 6)])
    alone = nodes.groupBy("_g", "x", "y").agg(F.count("*").alias("n"), F.min("oid").alias("oid"), F.min("_len").alias("v")).where((F.col("n") == 1) & (F.col("v") < min_dangle_length))
    return found.unionByName(issues(alone, "LineGroupConstraints.DangleTooShort", [(table.name, "oid")], values=[F.round("v", 6)]))


def polygons_of_lines(table: Table, tolerance: float = 0.0) -> DataFrame:
    """(comp, ring): the faces that connected lines enclose, clockwise, as arrays of struct<x, y>."""
    nodes = node_table([table], tolerance)
    w = Window.partitionBy("x", "y").orderBy("oid")
    links = nodes.withColumn("b", F.lead("oid").over(w)).where("b is not null").select(F.col("oid").alias("a"), "b")
    rows = S.shapes(table).select("oid", S.packed(F.col("geom")).alias("own"))
    comps = connected(rows.select("oid"), links, "oid")

    def faces(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        paths = [p for x in part["own"] for p in S.unpacked(x)[1]]
        rings = planar.polygonize(paths)
        axis = lambda k: pd.Series([[p[k] for p in r] for r in rings], dtype="object")
        return pd.DataFrame({"comp": pd.Series([key[0]] * len(rings), dtype="int64"), "x": axis(0), "y": axis(1)})

    found = rows.join(comps, "oid").groupBy("comp").applyInPandas(faces, "comp long, x array<double>, y array<double>")
    return found.select("comp", F.arrays_zip("x", "y").alias("ring"))


def qa_centroids(lines: Table, points: Table, tolerance: float = 0.0) -> DataFrame:
    """Faces of lines without exactly one point inside."""
    faces = polygons_of_lines(lines, tolerance).withColumn("face", F.xxhash64("comp", "ring"))
    geom = G.polygon(F.array(F.transform("ring", lambda p: G.vertex(p["x"], p["y"]))))
    areas = Table(faces.select("face", geom.alias("geom")), "faces", "face", "geom")
    pairs = S.related(S.other_pairs([points], [areas]), "intersects")
    border = pairs.where("substring(matrix, 1, 1) = 'F'")
    inside = pairs.where("substring(matrix, 1, 1) <> 'F'").groupBy(F.col("b.oid").alias("face")).agg(F.count("*").alias("n"))
    rows = faces.join(inside, "face", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    code = F.when(F.col("n") == 0, F.lit("Centroids.NoCentroid")).when(F.col("n") > 1, F.lit("Centroids.MultipleCentroids"))
    found = issues(rows.withColumn("_code", code).where("_code is not null"), F.col("_code"), F.array().cast(ROW), values=[F.col("n")])
    return found.unionByName(issues(border, "Centroids.CentroidLiesOnBorder", [(points.name, "a.oid")], values=[F.lit(None)]))


def qa_border_sense(table: Table, clockwise: bool = True, tolerance: float = 0.0) -> DataFrame:
    """Closed chains of lines that run the wrong way or change direction, and ends that close nothing."""
    nodes = node_table([table], tolerance)
    w = Window.partitionBy("x", "y").orderBy("oid")
    links = nodes.withColumn("b", F.lead("oid").over(w)).where("b is not null").select(F.col("oid").alias("a"), "b")
    rows = S.shapes(table).select("oid", S.packed(F.col("geom")).alias("own"))
    comps = connected(rows.select("oid"), links, "oid")

    def sense(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        paths = [p for x in part["own"] for p in S.unpacked(x)[1]]
        starts, ends = [p[0] for p in paths], [p[-1] for p in paths]
        codes = []
        once = [p for p, n in Counter([*starts, *ends]).items() if n == 1]
        if once:
            codes.append("BorderSense.IncompleteLine" if len(once) > 1 else "BorderSense.DanglingLine")
        elif sorted(starts) != sorted(ends):
            codes.append("BorderSense.InconsistentOrientation")
        else:
            turned = sum(planar.ring_area([(0.0, 0.0), *p, (0.0, 0.0)]) for p in paths)
            if turned == 0:
                codes.append("BorderSense.EmptyPolygonCreated")
            elif (turned > 0) != clockwise:
                codes.append("BorderSense.InvertedOrientation")
        return pd.DataFrame({"oid": pd.Series([int(part["oid"].min())] * len(codes), dtype="int64"), "code": pd.Series(codes, dtype="object")})

    found = rows.join(comps, "oid").groupBy("comp").applyInPandas(sense, "oid long, code string")
    return issues(found, F.col("code"), [(table.name, "oid")])


def shortest_paths(edges: DataFrame, source: int, rounds: int = 10_000, goal: int | None = None, heuristic: DataFrame | None = None) -> DataFrame:
    """(node, cost): least cost from source over edges (a, b, cost) in both directions, relaxed until nothing changes.

    With a goal, ways that cannot become cheaper than the best one to it are given up: their cost, and what heuristic (node, h: at most
    the rest of the way, no row counts as 0) adds, reaches that of the goal. Costs of nodes beyond are then upper bounds or left out;
    the goal's own is exact.
    """
    both = materialize(edges.select("a", "b", "cost").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "cost")), "edges")
    spark = edges.sparkSession
    best = materialize(spark.range(1).select(F.lit(source).cast("bigint").alias("node"), F.lit(0.0).alias("cost")), "paths")
    fresh = best
    for _ in range(rounds):
        reached = fresh.join(both.withColumnRenamed("cost", "step"), fresh.node == both.a).select(F.col("b").alias("node"), (F.col("cost") + F.col("step")).alias("cost"))
        offered = reached.groupBy("node").agg(F.min("cost").alias("cost"))
        old = best.select("node", F.col("cost").alias("old"))
        better = offered.join(old, "node", "left").where("old is null or cost < old - 1e-12").select("node", "cost")
        if goal is not None:
            reached_goal = best.where(F.col("node") == goal).select("cost").first()
            if reached_goal:
                rest = heuristic.select(F.col("node").alias("_h"), "h") if heuristic is not None else None
                better = better.withColumn("h", F.lit(0.0)) if rest is None else better.join(rest, F.col("node") == F.col("_h"), "left").drop("_h")
                better = better.where((F.col("cost") + F.coalesce("h", F.lit(0.0)) < reached_goal["cost"]) | (F.col("node") == goal)).drop("h")
        better = materialize(better, "paths")
        if not better.limit(1).count():
            return best
        best = materialize(best.join(better.select("node"), "node", "left_anti").unionByName(better), "paths")
        fresh = better
    raise RuntimeError("the paths are longer than the number of rounds allows")


def tr_get_nodes(table: Table, attributes: Sequence[str] = (), tolerance: float = 0.0) -> DataFrame:
    """Distinct end points with aggregate attributes; node_oid is twice the smallest oid, plus one if that line ends there."""
    fields = [c for c in table.df.columns if c not in (table.oid, table.geom)]
    nodes = node_table([table], tolerance, fields)
    names = names_of(nodes)
    made = [column.alias(name) for name, column in (projection(a, names) for a in attributes)]
    number = F.min(F.col("oid") * 2 + F.when(F.col("is_start"), 0).otherwise(1)).alias("node_oid")
    return nodes.groupBy("x", "y").agg(number, F.count("*").alias("n_ends"), *made)

