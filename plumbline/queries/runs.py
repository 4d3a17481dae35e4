"""Queries of schema checks, solids, surfaces, edge matching, specifications, sources and streams."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from plumbline import session
from plumbline.functions import geometry as G
from plumbline.issues import Table
from plumbline.operators import attributes as A
from plumbline.operators import schema as C
from plumbline.operators import solids as M
from plumbline.plans import documents as D
from plumbline.plans import specification as P
from plumbline.queries.base import Query, flat, table
from plumbline.queries.shapes import E, event_lines
from plumbline.queries.space import PD, PON, W, boxes, lines, points
from plumbline.sources import tables as O
from plumbline.streaming import incremental as K


def _described(s, d) -> Table:
    """The nation table with aliases, domains and lengths in its fields' metadata."""
    df = table(s, d, "nation").df
    meta = {"n_nationkey": {"alias": "Key", "domain": "dom_key"}, "n_name": {"alias": "NAME", "domain": "dom_n_name", "length": 25}, "n_regionkey": {"alias": "name", "domain": "Region"}}
    return Table(df.select(*[F.col(c).alias(c, metadata=meta[c]) for c in df.columns]), "nation", "oid")


CODED = {"dom_n_name": {1: "one", 2: "", 3: "one", 4: "much too long a name"}, "Region": {0: "0"}}


def _words(s, *rows: str, fields: str = "name string"):
    values = ", ".join(f"({r})" for r in rows)
    names = ", ".join(f.split()[0] for f in fields.split(","))
    return Table(s.sql(f"select * from values {values} as t({names})"), "words")


def houses(s, d) -> Table:
    """A solid of three faces per part, ten apart from each other: the floor, a wall that leans by its size, and a bent face."""
    p = table(s, d, "part").df
    v = lambda x, y, z, i: G.vertex(x + F.col("p_partkey") * 10.0, y, z, None, i)
    k, lean = F.col("p_partkey"), F.col("p_size") / 50.0
    zero, one = F.lit(0.0), F.lit(1.0)
    floor = F.array(v(zero, zero, zero, 1), v(zero, one, zero, 1), v(one, one, zero, 1), v(one, zero, zero, 1), v(zero, zero, zero, 1))
    wall = F.array(v(zero, zero, zero, 2), v(one, zero, zero, 2), v(one, lean, one, 2), v(zero, lean, one, F.when(k % 3 == 0, 3).otherwise(2)), v(zero, zero, zero, 2))
    far = F.when(k % 4 == 0, F.lit(3.0)).otherwise(F.lit(1.0))
    bent = F.array(v(far, zero, one, 4), v(far, one, one, 4), v(far + 1, one, F.when(k % 2 == 0, 1.5).otherwise(1.0), 4), v(far + 1, zero, one, 4), v(far, zero, one, 4))
    return Table(p.select(k.alias("oid"), G.geometry("multipatch", F.array(floor, wall, bent)).alias("geom"), F.array(F.lit("ring"), F.when(k % 5 == 0, F.lit("triangle_fan")).otherwise(F.lit("ring"))).alias("types")), "houses", "oid", "geom")


def _cells(s, d):
    """Surface heights (ix * 7 + iy * 3) % 11 under the points and lines of customers, block by block of 500; one column of each is missing."""
    blocks = table(s, d, "customer").df.select(F.floor(F.col("c_custkey") / 500).alias("b")).distinct()
    cells = blocks.select("b", F.explode(F.sequence(F.lit(0), F.lit(46))).alias("i")).where("i <> 5").select((F.col("b") * 100 + F.col("i")).alias("ix"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("iy"))
    return cells.withColumn("z", (F.col("ix") * 7 + F.col("iy") * 3) % 11)


def _tiles(s, d):
    return M.raster_tiles(_cells(s, d), 16)


def _event_tiles(s, d):
    """The same heights on 80 by 80 cells: event lines run over them side by side, however many there are."""
    cells = s.range(6400).select((F.col("id") % 80).alias("ix"), F.floor(F.col("id") / 80).alias("iy"))
    return M.raster_tiles(cells.withColumn("z", (F.col("ix") * 7 + F.col("iy") * 3) % 11), 16)


def courtyards(s, d) -> Table:
    """Four floors round a yard per part; the last one is missing but for each third."""
    p = table(s, d, "part").df
    v = lambda x, y: G.vertex(x + F.col("p_partkey") * 10.0, F.lit(float(y)), F.lit(0.0))
    face = lambda x0, y0, x1, y1: F.array(*[v(F.lit(float(x)), y) for x, y in ((x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0))])
    last = F.when(F.col("p_partkey") % 3 == 0, face(2, 1, 3, 2))
    return Table(p.select(F.col("p_partkey").alias("oid"), G.geometry("multipatch", F.array_compact(F.array(face(0, 0, 3, 1), face(0, 2, 3, 3), face(0, 1, 1, 2), last))).alias("geom")), "courtyards", "oid", "geom")


def leaning(s, d) -> Table:
    """A horizontal parallelogram per part that leans by the key modulo 5, in 64ths."""
    p = table(s, d, "part").df
    lean, one, zero = (F.col("p_partkey") % 5) / 64.0, F.lit(1.0), F.lit(0.0)
    v = lambda x, y: G.vertex(x + F.col("p_partkey") * 10.0, y, zero)
    return Table(p.select(F.col("p_partkey").alias("oid"), G.geometry("multipatch", F.array(F.array(v(zero, zero), v(one, zero), v(one + lean, one), v(lean, one), v(zero, zero)))).alias("geom")), "leaning", "oid", "geom")


def _border(s, d) -> Table:
    """The border y = 20 along all customers, cut into stretches of 100."""
    stretches = table(s, d, "customer").df.select(F.explode(F.sequence(F.floor(F.col("c_custkey") * 4 / 100) - 1, F.floor(F.col("c_custkey") * 4 / 100) + 1)).alias("id")).distinct()
    rows = stretches.select("id", F.col("id").alias("stretch"), G.segment(F.col("id") * 100.0, F.lit(20.0), F.col("id") * 100.0 + 100, F.lit(20.0)).alias("geom"))
    return Table(rows, "border", "id", "geom")


def _both_sides(s, d):
    c = table(s, d, "customer").df
    x = F.expr("c_custkey * 4.0")
    below = G.line(F.array(G.vertex(x, F.lit(19.0)), G.vertex(x, F.lit(20.0))))
    off = F.when(F.col("c_custkey") % 3 == 0, 0.25).otherwise(0.0)
    above = G.line(F.array(G.vertex(x + off, F.lit(20.0)), G.vertex(x, F.lit(21.0))))
    grade = F.col("c_custkey") % 5
    one = Table(c.select(F.col("c_custkey").alias("oid"), below.alias("geom"), grade.alias("grade")), "below", "oid", "geom")
    two = Table(c.where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("oid"), above.alias("geom"), F.when(F.col("c_custkey") % 11 == 0, 9).otherwise(grade).alias("grade")), "above", "oid", "geom")
    return one, two


def _edge_points(s, d):
    one, two = _both_sides(s, d)
    pts = lambda t, k: Table(t.df.withColumn("geom", G.geometry("point", F.array(F.array(t.df.geom["parts"][0][k])))), t.name, "oid", "geom")
    return pts(one, 1), pts(two, 0)


def _areas(s, d):
    """Boxes below and above the border; each third one above is only half as wide, each seventh is missing."""
    c = table(s, d, "customer").df
    x = F.expr("c_custkey * 4.0")
    one = c.select(F.col("c_custkey").alias("oid"), G.box(x, F.lit(19.0), x + 2, F.lit(20.0)).alias("geom"))
    two = c.where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("oid"), G.box(x, F.lit(20.0), x + F.when(F.col("c_custkey") % 3 == 0, 1.0).otherwise(2.0), F.lit(21.0)).alias("geom"))
    return Table(one, "below", "oid", "geom"), Table(two, "above", "oid", "geom")


def _edge_lines(s, d):
    """Lines along the border from below and above."""
    one, two = _areas(s, d)
    along = lambda t, y: Table(t.df.withColumn("geom", G.segment(G.lowest(t.df.geom, "x"), F.lit(20.0), G.highest(t.df.geom, "x"), F.lit(20.0))), t.name, "oid", "geom")
    return along(one, 20), along(two, 20)


SPEC = {
    "name": "orders and items",
    "conditions": [
        {"name": "price", "check": "qa_constraint", "tables": {"table": "orders"}, "parameters": {"constraints": "o_totalprice < 250000"}, "stop": True},
        {"name": "status", "check": "qa_constraint", "tables": {"table": "orders"}, "parameters": {"constraints": "o_orderstatus <> 'P'"}, "severity": "warning"},
        {"name": "customer", "check": "qa_foreign_key", "tables": {"table": "orders", "referenced": "customer"}, "filters": {"customer": "c_acctbal > 0"}, "parameters": {"keys": ["o_custkey"], "referenced_keys": ["c_custkey"]}},
        {"name": "items", "check": "qa_unique", "tables": {"tables": "lineitem"}, "parameters": {"fields": ["l_orderkey", "l_partkey"]}, "issue_filter": "involved_oid % 2 = 0"},
    ],
}
XML = """<QualitySpecification name="dates"><Condition name="days" check="qa_valid_date_values" severity="warning"><Table parameter="table" name="orders" filter="o_orderstatus = 'F'"/>
<Parameter name="minimum">"1993-01-01"</Parameter><Parameter name="maximum">"1996-01-01"</Parameter></Condition></QualitySpecification>"""


def specification(s, d):
    spec = P.from_json(json.dumps(SPEC))
    return P.run(spec, {n: table(s, d, n) for n in ("orders", "customer", "lineitem")})


DOCUMENT = """<DataQuality xmlns="urn:quality-specifications-3.0">
<QualitySpecifications><QualitySpecification name="boxes and orders"><Elements><Element qualityCondition="small boxes"/><Element qualityCondition="poor customers" allowErrors="True"/><Element qualityCondition="names"/></Elements></QualitySpecification></QualitySpecifications>
<QualityConditions>
 <QualityCondition name="small boxes" testDescriptor="min area"><Parameters><Dataset parameter="polygonClass" value="boxes" where="p_size &gt; 3" workspace="w"/><Scalar parameter="limit" value="3"/></Parameters>
  <Filters><Filter issueFilterName="at a point"/><Filter issueFilterName="brand"/></Filters><FilterExpression expression="[at a point] AND NOT brand"/></QualityCondition>
 <QualityCondition name="names" testDescriptor="field names"><Parameters><Dataset parameter="table" value="orders" workspace="w"/><Scalar parameter="maximumLength" value="11"/></Parameters></QualityCondition>
</QualityConditions>
<Transformers><Transformer name="orders of customers" transformerDescriptor="join"><Parameters><Dataset parameter="t0" value="orders" where="o_orderstatus = 'F'" workspace="w"/><Dataset parameter="t1" value="customer" workspace="w"/><Scalar parameter="leftKey" value="o_custkey"/><Scalar parameter="rightKey" value="c_custkey"/></Parameters></Transformer></Transformers>
<IssueFilters><IssueFilter name="at a point" issueFilterDescriptor="intersecting"><Parameters><Dataset parameter="featureClass" value="points" workspace="w"/></Parameters></IssueFilter>
 <IssueFilter name="brand" issueFilterDescriptor="rows"><Parameters><Scalar parameter="constraint" value="p_brand LIKE '%1'"/></Parameters></IssueFilter></IssueFilters>
<Categories><Category name="attributes"><SubCategories><Category name="orders"><QualityConditions>
 <QualityCondition name="poor customers" testDescriptor="constraint"><Parameters><Dataset parameter="table" transformerName="orders of customers"/><Scalar parameter="constraint" value="c_acctbal &gt; 0 OR o_totalprice &lt; 100000"/></Parameters></QualityCondition>
</QualityConditions></Category></SubCategories></Category></Categories>
<TestDescriptors><TestDescriptor name="min area" stopOnError="False" allowErrors="False"><TestClass type="quality.tests.QaMinArea" constructorIndex="0"/></TestDescriptor><TestDescriptor name="constraint"><TestClass type="quality.tests.QaConstraint" constructorIndex="0"/></TestDescriptor>
 <TestDescriptor name="field names"><TestClass type="quality.tests.schema.QaSchemaFieldNames" constructorIndex="0"/></TestDescriptor></TestDescriptors>
<TransformerDescriptors><TransformerDescriptor name="join"><TransformerClass type="quality.tests.transformers.TrTableJoin" constructorIndex="0"/></TransformerDescriptor></TransformerDescriptors>
<IssueFilterDescriptors><IssueFilterDescriptor name="intersecting"><IssueFilterClass type="quality.tests.filters.IfIntersecting" constructorIndex="0"/></IssueFilterDescriptor><IssueFilterDescriptor name="rows"><IssueFilterClass type="quality.tests.filters.IfInvolvedRows" constructorIndex="0"/></IssueFilterDescriptor></IssueFilterDescriptors>
<Workspaces><Workspace id="w" modelName="model" catalogPath="/data"/></Workspaces></DataQuality>"""


def quality_document(s, d):
    """A data quality document with categories, a transformer, issue filters, a schema check and overridden severities, run over tables."""
    spec = D.from_document(DOCUMENT).specifications["boxes and orders"]
    tables = {"boxes": boxes(s, d), "points": points(s, d), "orders": table(s, d, "orders"), "customer": table(s, d, "customer")}
    return P.run(spec, tables).select("condition", "severity", "issue_code", F.get("involved", F.lit(0))["oid"].alias("oid"), F.get("involved", F.lit(0))["tab"].alias("tab"), "component")


def _stored(s, d):
    path = session.new_path(s, "issues")
    O.write_issues(A.qa_constraint(table(s, d, "orders"), "o_totalprice < 300000"), path)
    return O.read_issues(s, path).groupBy("shape", "issue_code").agg(F.count("*").alias("n"))


def _exported(s, d):
    path = session.new_path(s, "export")
    written = O.export_tables([table(s, d, "nation", "n_regionkey = 1"), table(s, d, "region")], path, {"nation": "n_nationkey % 2"})
    return s.read.parquet(written[0]).select("n_name", F.col("tile_id").cast("int").alias("tile_id"))


def _csv(s, d):
    path = session.new_path(s, "csv")
    table(s, d, "nation").df.write.option("header", True).csv(path)
    return O.scan(s, path, "csv", ["n_name"], "n_regionkey = 2", "n_nationkey int, n_name string, n_regionkey int")


def _external(s, d):
    def call(batches):
        import pyarrow as pa

        for b in batches:
            keys = [k for k in b.column("n_nationkey").to_pylist() if k % 2]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())], names=["oid"])

    return O.external_service([table(s, d, "nation")], call, "oid long")


def _stream(s, d):
    """The stream read to its end, each batch appended to the shared folder."""
    out, state = session.new_path(s, "stream"), session.new_path(s, "state")
    found = K.violations(K.stream_of(s, f"{d}/events.parquet"), "value < 90").select("event_id", "value")
    query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return s.read.schema("event_id long, value double").parquet(out)


QUERIES: dict[str, Query] = {
    "qa_schema_field_names": lambda s, d: C.qa_schema_field_names(table(s, d, "orders"), 11, "lower", 5),
    "qa_schema_field_aliases": lambda s, d: C.qa_schema_field_aliases(_described(s, d), 10, "upper", True, True),
    "qa_schema_field_name_regex": lambda s, d: C.qa_schema_field_name_regex(table(s, d, "nation"), "key$"),
    "qa_schema_field_properties": lambda s, d: C.qa_schema_field_properties(_described(s, d), "n_name", "int", 30, "Name", "dom_name"),
    "qa_schema_field_properties_from_table": lambda s, d: C.qa_schema_field_properties_from_table(_described(s, d), _words(s, "'n_name', 'int', true", "'n_gone', 'int', false", fields="name string, type string, optional boolean")),
    "qa_schema_reserved_field_names": lambda s, d: C.qa_schema_reserved_field_names(table(s, d, "nation"), _words(s, "'N_NAME', 'taken'", "' ', ''", fields="name string, reason string"), reason_field="reason"),
    "qa_schema_reserved_field_name_properties": lambda s, d: C.qa_schema_reserved_field_name_properties(_described(s, d), _words(s, "'n_name'"), _words(s, "'n_name', 'int'", "'n_regionkey', 'string'", fields="name string, type string")),
    "qa_schema_field_domains": lambda s, d: C.qa_schema_field_domains(_described(s, d), {"dom_key": "int", "dom_n_name": "int"}),
    "qa_schema_field_domain_names": lambda s, d: C.qa_schema_field_domain_names(_described(s, d), "dom_", 9, True),
    "qa_schema_field_domain_name_regex": lambda s, d: C.qa_schema_field_domain_name_regex(_described(s, d), "^dom_"),
    "qa_schema_field_domain_descriptions": lambda s, d: C.qa_schema_field_domain_descriptions(_described(s, d), 8, True, {"dom_key": "Same", "Region": "same", "dom_n_name": "description"}),
    "qa_schema_field_domain_coded_values": lambda s, d: C.qa_schema_field_domain_coded_values(_described(s, d), CODED, 10, "exact", 2),
    "qa_schema_spatial_reference": lambda s, d: C.qa_schema_spatial_reference(Table(points(s, d).df.select("oid", F.col("geom").alias("geom", metadata={"srid": 2056, "xyTolerance": 0.001})), "points", "oid", "geom"), {"srid": 2056, "xyTolerance": 0.01}),
    "qa_gdb_release": lambda s, d: C.qa_gdb_release(table(s, d, "nation"), "10.2", "10.4", "11.0"),
    "qa_gdb_constraint_factory": lambda s, d: flat(A.qa_constraint(Table(_described(s, d).df, "nation", "n_nationkey"), C.domain_constraints(_described(s, d), {"Region": {0: "a", 1: "b", 2: "c"}}, {"dom_key": (0, 20)})), "description"),
    "qa_mp_allowed_part_types": lambda s, d: flat(M.qa_mp_allowed_part_types(houses(s, d), "types", ["ring"]), "value"),
    "qa_mp_constant_point_ids_per_ring": lambda s, d: flat(M.qa_mp_constant_point_ids_per_ring(houses(s, d)), "value"),
    "qa_mp_vertical_faces": lambda s, d: flat(M.qa_mp_vertical_faces(houses(s, d), 0.5, 0.1), "value"),
    "qa_coplanar_rings": lambda s, d: flat(M.qa_coplanar_rings(houses(s, d), 0.05), "value"),
    "qa_mp_horizontal_heights": lambda s, d: flat(M.qa_mp_horizontal_heights(event_lines(s, d), 1.0, 0.5), "value"),
    "qa_mp_horizontal_azimuths": lambda s, d: flat(M.qa_mp_horizontal_azimuths(event_lines(s, d), 0.001, 0.0005, 0.5), "value").withColumn("value", F.round(F.col("value").cast("double"), 6)),
    "qa_mp_horizontal_perpendicular": lambda s, d: flat(M.qa_mp_horizontal_perpendicular(leaning(s, d), 0.05, 0.001), "value"),
    "qa_mp_footprint_holes": lambda s, d: flat(M.qa_mp_footprint_holes(courtyards(s, d)), "value"),
    "qa_mp_single_part_footprint": lambda s, d: flat(M.qa_mp_single_part_footprint(houses(s, d)), "value"),
    "qa_mp_non_intersecting_ring_footprints": lambda s, d: flat(M.qa_mp_non_intersecting_ring_footprints(houses(s, d))),
    "qa_mp_vertex_not_near_face": lambda s, d: flat(M.qa_mp_vertex_not_near_face(houses(s, d), houses(s, d), 0.6, 0.6), "other_oid"),
    "qa_surface_vertex": lambda s, d: flat(M.qa_surface_vertex(event_lines(s, d), _event_tiles(s, d), 16, 1.0, 3.0), "value"),
    "qa_surface_pipe": lambda s, d: flat(M.qa_surface_pipe(lines(s, d), _tiles(s, d), 16, 1.0, 5.0, "within", 0.5)),
    "qa_surface_spikes": lambda s, d: flat(M.qa_surface_spikes(_cells(s, d), 1.0, 0.5, 2.5), "no_oid", "value", "value2"),
    "tr_z_assign": lambda s, d: M.tr_z_assign(points(s, d), _tiles(s, d), 16, 1.0).select("oid", F.col("geom.parts")[0][0]["z"].alias("z")),
    "qa_edge_match_bordering_points": lambda s, d: (lambda p: flat(M.qa_edge_match_bordering_points([p[0]], _border(s, d), [p[1]], _border(s, d), 0.5, bordering_point_attribute_constraint="POINT1.grade = POINT2.grade"), "other_oid", "tab", "value"))(_edge_points(s, d)),
    "qa_edge_match_bordering_points_options": lambda s, d: (lambda p: flat(M.qa_edge_match_bordering_points([p[0]], _border(s, d), [p[1]], _border(s, d), 8.0, bordering_point_match_condition="POINT1.grade <> 4 AND POINT2.grade <> 4", point_class_2_border_match_condition="POINT.grade <> 3 OR BORDER.stretch % 2 = 0",
        bordering_point_equal_attributes="grade", bordering_point_equal_attribute_options=["grade:allowedDifferenceCondition=G1._VALUE = 9"], coincidence_tolerance=0.25, allow_disjoint_candidate_feature_if_attribute_constraints_are_fulfilled=True), "other_oid", "tab", "component"))(_edge_points(s, d)),
    "qa_edge_match_crossing_lines": lambda s, d: (lambda p: flat(M.qa_edge_match_crossing_lines([p[0]], _border(s, d), [p[1]], _border(s, d), 0.5, constraint="G1.grade = G2.grade")))(_both_sides(s, d)),
    "qa_edge_match_bordering_lines": lambda s, d: (lambda p: flat(M.qa_edge_match_bordering_lines([p[0]], _border(s, d), [p[1]], _border(s, d)), "value"))(_edge_lines(s, d)),
    "qa_edge_match_crossing_areas": lambda s, d: (lambda p: flat(M.qa_edge_match_crossing_areas([p[0]], _border(s, d), [p[1]], _border(s, d)), "value"))(_areas(s, d)),
    "quality_specification": lambda s, d: specification(s, d).select("condition", "severity", "issue_code", F.col("involved")[0]["oid"].alias("oid")),
    "specification_report": lambda s, d: P.report(specification(s, d)),
    "xml_specification": lambda s, d: P.run(D.from_xml(XML), {"orders": table(s, d, "orders")}).select("condition", "severity", "issue_code", F.col("involved")[0]["oid"].alias("oid")),
    "quality_document": quality_document,
    "issue_store": _stored,
    "qa_export_tables": _exported,
    "csv_source": _csv,
    "qa_external_service": _external,
    "qa_external_graphic_conflict": lambda s, d: O.external_graphic_conflict(points(s, d), boxes(s, d), 0.001, 500.0),
    "in_list_scan": lambda s, d: O.keyed_scan(table(s, d, "orders").df, "o_custkey", table(s, d, "customer", "c_acctbal < 0").rows, "c_custkey").select("o_orderkey"),
    "stream_violations": _stream,
    "windowed_counts": lambda s, d: K.windowed_counts(table(s, d, "events").df, "ts", "1 hour", "2 hours", "event_type"),
    "session_windows": lambda s, d: K.sessions(table(s, d, "events").df, "ts", "30 minutes", "2 hours", "user_id"),
}

def _named(*rows: tuple[str, str, str]) -> str:
    return f"SELECT * FROM (VALUES {', '.join(str(r) for r in rows)}) t(issue_code, component, description)"


C_ = "SELECT c_custkey AS k FROM customer"
CELLS_ = "WITH g AS (SELECT DISTINCT floor(c_custkey / 500) AS b FROM customer), c AS (SELECT 100 * b + a.i AS i, t.j, (((100 * b + a.i) * 7 + t.j * 3) % 11)::BIGINT AS z FROM g, generate_series(0, 46) a(i), generate_series(0, 23) t(j) WHERE a.i <> 5)"
ORACLES: dict[str, str] = {
    "qa_gdb_constraint_factory": """SELECT 'Constraints.ConstraintNotFulfilled' AS issue_code, CAST(n_nationkey AS BIGINT) AS oid, d AS description FROM nation, LATERAL (VALUES
        ('n_nationkey >= 0 AND n_nationkey <= 20 OR n_nationkey IS NULL', n_nationkey BETWEEN 0 AND 20), ('n_regionkey IN (0, 1, 2) OR n_regionkey IS NULL', n_regionkey IN (0, 1, 2))) v(d, met) WHERE NOT met""",
    "qa_mp_allowed_part_types": "SELECT 'MpAllowedPartTypes.PartTypeNotAllowed' AS issue_code, p_partkey AS oid, '1' AS value FROM part WHERE p_partkey % 5 = 0",
    "qa_mp_constant_point_ids_per_ring": "SELECT 'MpConstantPointIdsPerRing.DifferentIds' AS issue_code, p_partkey AS oid, '1' AS value FROM part WHERE p_partkey % 3 = 0",
    "qa_mp_vertical_faces": "SELECT 'MpVerticalFaces.FaceNotVertical' AS issue_code, p_partkey AS oid, '1' AS value FROM part WHERE atan(p_size / 50.0) <= 0.5 AND atan(p_size / 50.0) > 0.1",
    "qa_coplanar_rings": "SELECT 'CoplanarRings.FaceNotCoplanar' AS issue_code, p_partkey AS oid, '2' AS value FROM part WHERE p_partkey % 2 = 0",
    "qa_mp_single_part_footprint": "SELECT 'MpSinglePartFootprint.MultipleParts' AS issue_code, p_partkey AS oid, '2' AS value FROM part WHERE p_partkey % 4 = 0",
    "qa_mp_non_intersecting_ring_footprints": "SELECT 'MpNonIntersectingRingFootprints.RingFootprintsIntersect' AS issue_code, p_partkey AS oid FROM part WHERE p_size > 0",
    "qa_mp_footprint_holes": "SELECT 'MpFootprintHoles.InnerRing' AS issue_code, p_partkey AS oid, '1' AS value FROM part WHERE p_partkey % 3 = 0",
    "qa_mp_horizontal_perpendicular": "SELECT 'MpHorizontalPerpendicular.NearlyPerpendicular' AS issue_code, p_partkey AS oid, '0.0' AS value FROM (SELECT p_partkey, abs(atan2(1, p_partkey % 5 / 64e0) - pi() / 2) AS off FROM part) WHERE off > 0.001 AND off <= 0.05",
    "qa_mp_horizontal_azimuths": f"""{E}, a AS (SELECT DISTINCT oid, round(CASE WHEN t < 0 THEN t + pi() ELSE t END, 12) AS az FROM (SELECT oid, atan2(y1 - y0, 1) AS t FROM s WHERE y1 IS NOT NULL AND abs(z1 - z0) <= 0.5)),
        l AS (SELECT oid, az, lead(az) OVER (PARTITION BY oid ORDER BY az) AS nz FROM a) SELECT 'MpHorizontalAzimuths.AzimuthsNearlyEqual' AS issue_code, oid, round(az, 6) AS value FROM l WHERE nz - az <= 0.001 AND nz - az > 0.0005""",
    # the planes of the three faces of a house, each over a rectangle
    "qa_mp_vertex_not_near_face": """WITH h AS (SELECT p_partkey AS k, p_size / 50e0 AS l, CASE WHEN p_partkey % 4 = 0 THEN 3e0 ELSE 1e0 END AS f, CASE WHEN p_partkey % 2 = 0 THEN 1.5e0 ELSE 1e0 END AS c FROM part),
        v AS (SELECT k, unnest([(0, 0, 0), (0, 1, 0), (1, 1, 0), (1, 0, 0), (0, 0, 0), (0, 0, 0), (1, 0, 0), (1, l, 1), (0, l, 1), (0, 0, 0), (f, 0, 1), (f, 1, 1), (f + 1, 1, c), (f + 1, 0, 1), (f, 0, 1)]) AS p FROM h),
        p AS (SELECT k, 0e0 AS x0, 1e0 AS x1, 1e0 AS y1, 0e0 AS a, 0e0 AS b, 0e0 AS z0 FROM h UNION ALL SELECT k, 0, 1, l, 0, 1 / l, 0 FROM h UNION ALL SELECT k, f, f + 1, 1, (c - 1) / 2, (c - 1) / 2, 1 FROM h),
        n AS (SELECT v.k, v.p[3] - (z0 + a * (v.p[1] - x0) + b * v.p[2]) AS dz FROM v JOIN p ON v.k = p.k AND v.p[1] BETWEEN x0 AND x1 AND v.p[2] BETWEEN 0 AND y1)
        SELECT 'MpVertexNotNearFace.VertexTooCloseToFace' AS issue_code, k AS oid, k AS other_oid FROM n WHERE abs(dz) > 1e-9 AND abs(dz) < 0.6""",
    "qa_surface_pipe": f"""{CELLS_}, l AS (SELECT c_custkey AS oid, c_custkey % 7 AS z, unnest(CASE WHEN c_custkey % 2 = 0 THEN [(x + 1, y), (x + 2, y)] ELSE [(x, y + 1), (x, y + 2)] END) AS p
            FROM (SELECT c_custkey, c_custkey % 40 + 100 * floor(c_custkey / 500) AS x, c_nationkey % 20 AS y FROM customer)),
        d AS (SELECT oid, CASE WHEN c.z IS NULL THEN 'SurfacePipe.NoTerrainData' WHEN abs(l.z - c.z) > 5 THEN 'SurfacePipe.ZOffset.within' END AS code FROM l LEFT JOIN c ON c.i = l.p[1] AND c.j = l.p[2])
        SELECT min(code) AS issue_code, oid FROM d WHERE code IS NOT NULL GROUP BY oid""",
    "qa_schema_field_names": _named(("SchemaFieldNames.NameTooLong", "o_orderstatus", "o_orderstatus"), ("SchemaFieldNames.NameTooLong", "o_totalprice", "o_totalprice"), ("SchemaFieldNames.NameTooLong", "o_orderpriority", "o_orderpriority"),
        *(("SchemaFieldNames.NotUniqueSubstring", c, c) for c in ("o_orderstatus", "o_orderdate", "o_orderpriority"))),
    "qa_schema_field_aliases": _named(("SchemaFieldAliases.UnexpectedCase", "n_nationkey", "Key"), ("SchemaFieldAliases.UnexpectedCase", "n_regionkey", "name"), ("SchemaFieldAliases.NotUnique", "n_name", "NAME"), ("SchemaFieldAliases.NotUnique", "n_regionkey", "name")),
    "qa_schema_field_name_regex": _named(("SchemaFieldNameRegex.DoesNotMatchPattern", "n_name", "n_name")),
    "qa_schema_field_properties": _named(("SchemaFieldProperties.UnexpectedFieldType", "n_name", "string"), ("SchemaFieldProperties.UnexpectedFieldLength", "n_name", "25"), ("SchemaFieldProperties.UnexpectedAlias", "n_name", "NAME"), ("SchemaFieldProperties.UnexpectedDomain", "n_name", "dom_n_name")),
    "qa_schema_field_properties_from_table": _named(("SchemaFieldProperties.UnexpectedFieldType", "n_name", "string"), ("SchemaFieldProperties.FieldMissing", "n_gone", "")),
    "qa_schema_reserved_field_names": _named(("SchemaReservedFieldNames.ReservedName", "n_name", "taken")),
    "qa_schema_reserved_field_name_properties": _named(("SchemaFieldProperties.UnexpectedFieldType", "n_name", "string")),
    "qa_schema_field_domains": _named(("SchemaFieldDomains.DomainTypeDiffers", "n_name", "dom_n_name")),
    "qa_schema_field_domain_names": _named(("SchemaFieldDomainNames.NameTooLong", "n_name", "dom_n_name"), ("SchemaFieldDomainNames.UnexpectedPrefix", "n_regionkey", "Region"), ("SchemaFieldDomainNames.FieldNameNotContained", "n_nationkey", "dom_key"), ("SchemaFieldDomainNames.FieldNameNotContained", "n_regionkey", "Region")),
    "qa_schema_field_domain_name_regex": _named(("SchemaFieldDomainNameRegex.DoesNotMatchPattern", "n_regionkey", "Region")),
    "qa_schema_field_domain_descriptions": _named(("SchemaFieldDomainDescriptions.DescriptionTooLong", "dom_n_name", "description"), ("SchemaFieldDomainDescriptions.NotUnique", "dom_key", "Same"), ("SchemaFieldDomainDescriptions.NotUnique", "Region", "same")),
    "qa_schema_field_domain_coded_values": _named(("SchemaFieldDomainCodedValues.NameEmpty", "n_name", "2"), ("SchemaFieldDomainCodedValues.NameTooLong", "n_name", "much too long a name"), ("SchemaFieldDomainCodedValues.NameNotUnique", "n_name", "one"), ("SchemaFieldDomainCodedValues.NameNotUnique", "n_name", "one"), ("SchemaFieldDomainCodedValues.TooFewValues", "n_regionkey", "1")),
    "qa_schema_spatial_reference": _named(("SchemaSpatialReference.xyToleranceDiffers", "geom", "0.001")),
    "qa_gdb_release": _named(("GdbRelease.ReleaseTooOld", "nation", "10.2")),
    "qa_mp_horizontal_heights": f"""{E}, d AS (SELECT DISTINCT oid, z0 AS z FROM s WHERE z0 = z1), l AS (SELECT oid, z, lead(z) OVER (PARTITION BY oid ORDER BY z) AS nz FROM d)
        SELECT 'MpHorizontalHeights.HeightsNearlyEqual' AS issue_code, oid, CAST(CAST(z AS DOUBLE) AS VARCHAR) AS value FROM l WHERE nz - z <= 1 AND nz - z > 0.5""",
    "qa_surface_vertex": f"""{E}, d AS (SELECT oid, CASE WHEN i < 80 AND y < 80 THEN z - CAST((i * 7 + floor(y) * 3) % 11 AS BIGINT) END AS dz FROM v)
        SELECT CASE WHEN dz IS NULL THEN 'SurfaceVertex.NoTerrainData' ELSE 'SurfaceVertex.ZOffset.within' END AS issue_code, oid, CAST(CAST(dz AS DOUBLE) AS VARCHAR) AS value FROM d WHERE dz IS NULL OR abs(dz) > 3""",
    "qa_surface_spikes": f"""{CELLS_}, n AS (SELECT c.i, c.j, c.z, min(o.z) AS low, max(o.z) AS high FROM c JOIN c o ON abs(c.i - o.i) + abs(c.j - o.j) = 1 GROUP BY 1, 2, 3 HAVING count(*) = 4)
        SELECT 'SurfaceSpikes.Spike' AS issue_code, CAST(CAST(i AS BIGINT) AS VARCHAR) AS value, CAST(j AS VARCHAR) AS value2 FROM n WHERE greatest(z - high, low - z) > 2.5""",
    "tr_z_assign": "SELECT c_custkey AS oid, CASE WHEN floor(x) % 100 <> 5 THEN CAST((floor(x) * 7 + y * 3) % 11 AS DOUBLE) END AS z FROM (SELECT c_custkey, c_custkey % 40 + 0.5 * (c_nationkey % 2) + 100 * floor(c_custkey / 500) AS x, c_nationkey % 20 AS y FROM customer)",
    "qa_edge_match_bordering_points": f"""SELECT 'BorderingPoints.' || CASE WHEN k % 7 = 0 THEN 'NoMatch.NoCandidate' WHEN k % 3 = 0 THEN 'NoMatch.CandidateExists.Constraints' || CASE WHEN k % 11 = 0 THEN 'NotFulfilled' ELSE 'Fulfilled' END ELSE 'Match.ConstraintsNotFulfilled' END AS issue_code, k AS oid,
        CASE WHEN k % 7 <> 0 THEN k END AS other_oid, 'below' AS tab, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 3 = 0 THEN '0.25' ELSE '0.0' END AS value FROM ({C_}) WHERE k % 7 = 0 OR k % 3 = 0 OR k % 11 = 0""",
    "qa_edge_match_bordering_points_options": f"""WITH one AS (SELECT k, k * 4.0 AS x, k % 5 AS g FROM ({C_})), two AS (SELECT k, x, CASE WHEN k % 11 = 0 THEN 9 ELSE g END AS g, floor(x / 100) AS b FROM (SELECT k, k * 4.0 + CASE WHEN k % 3 = 0 THEN 0.25 ELSE 0 END AS x, k % 5 AS g FROM ({C_}) WHERE k % 7 <> 0)),
        -- a point of side 2 needs an even stretch of the border if its grade is 3; a place where two stretches meet is on both
        two_on AS (SELECT * FROM two WHERE g <> 3 OR b % 2 = 0 OR x % 100 = 0),
        pair AS (SELECT a.k AS p, c.k AS n, abs(a.x - c.x) AS d, a.g = c.g OR a.g = 9 OR c.g = 9 AS same, c.g <> 3 OR floor(a.x / 100) % 2 = 0 OR a.x % 100 = 0 AS together FROM one a JOIN two_on c ON abs(a.x - c.x) <= 8 WHERE a.g <> 4 AND c.g <> 4),
        best AS (SELECT p, bool_or(d <= 0.25 AND same) AS matched, min(n) FILTER (d <= 0.25) AS first FROM pair GROUP BY p),
        told AS (SELECT pair.* FROM pair JOIN best USING (p) WHERE NOT matched AND (first IS NULL OR first = n)),
        back AS (SELECT n AS p, bool_or(d <= 0.25 AND same) AS matched, min(p) FILTER (d <= 0.25) AS first FROM pair GROUP BY n),
        told2 AS (SELECT pair.n AS p, pair.p AS n, d, same, together FROM pair JOIN back ON pair.n = back.p WHERE NOT matched AND (first IS NULL OR first = pair.p) AND pair.n NOT IN (SELECT n FROM told)),
        every AS (SELECT *, 'below' AS tab FROM told UNION ALL SELECT *, 'above' FROM told2)
        SELECT 'BorderingPoints.' || CASE WHEN d <= 0.25 THEN 'Match.ConstraintsNotFulfilled' ELSE 'NoMatch.CandidateExists.' || CASE WHEN together THEN '' ELSE 'BordersNotCoincident+' END || 'ConstraintsNotFulfilled' END AS issue_code, p AS oid, n AS other_oid, tab, 'GRADE' AS component FROM every WHERE NOT same
        UNION ALL SELECT 'BorderingPoints.NoMatch.NoCandidate', k, NULL, 'below', NULL FROM one WHERE k NOT IN (SELECT p FROM pair)
        UNION ALL SELECT 'BorderingPoints.NoMatch.NoCandidate', k, NULL, 'above', NULL FROM two_on WHERE k NOT IN (SELECT n FROM pair)""",
    "qa_edge_match_crossing_lines": f"""SELECT CASE WHEN k % 7 = 0 THEN 'EdgeMatchCrossingLines.NoCandidate' WHEN k % 3 = 0 THEN 'EdgeMatchCrossingLines.CandidateNotCoincident' ELSE 'EdgeMatchCrossingLines.AttributesNotFulfilled' END AS issue_code, k AS oid
        FROM ({C_}) WHERE k % 7 = 0 OR k % 3 = 0 OR k % 11 = 0""",
    "qa_edge_match_bordering_lines": f"SELECT CASE WHEN k % 7 = 0 THEN 'EdgeMatchBorderingLines.NoCandidate' ELSE 'EdgeMatchBorderingLines.PartlyMatched' END AS issue_code, k AS oid, CASE WHEN k % 7 = 0 THEN '0.0' ELSE '1.0' END AS value FROM ({C_}) WHERE k % 7 = 0 OR k % 3 = 0",
    "qa_edge_match_crossing_areas": f"SELECT CASE WHEN k % 7 = 0 THEN 'EdgeMatchCrossingAreas.NoCandidate' ELSE 'EdgeMatchCrossingAreas.PartlyMatched' END AS issue_code, k AS oid, CASE WHEN k % 7 = 0 THEN '0.0' ELSE '1.0' END AS value FROM ({C_}) WHERE k % 7 = 0 OR k % 3 = 0",
    "quality_specification": """SELECT 'price' AS condition, 'error' AS severity, 'Constraints.ConstraintNotFulfilled' AS issue_code, o_orderkey AS oid FROM orders WHERE NOT o_totalprice < 250000
        UNION ALL SELECT 'status', 'warning', 'Constraints.ConstraintNotFulfilled', o_orderkey FROM orders WHERE o_totalprice < 250000 AND o_orderstatus = 'P'
        UNION ALL SELECT 'customer', 'error', 'ForeignKeys.NoReferencedRow', o_orderkey FROM orders WHERE o_totalprice < 250000 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
        UNION ALL SELECT DISTINCT 'items', 'error', 'Unique.NotUnique', oid FROM (SELECT l_orderkey * 10 + l_linenumber AS oid FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_partkey) > 1) WHERE oid % 2 = 1""",
    "specification_report": """SELECT condition, severity, issue_code, count(*) AS n_issues FROM (SELECT 'price' AS condition, 'error' AS severity, 'Constraints.ConstraintNotFulfilled' AS issue_code FROM orders WHERE NOT o_totalprice < 250000
        UNION ALL SELECT 'status', 'warning', 'Constraints.ConstraintNotFulfilled' FROM orders WHERE o_totalprice < 250000 AND o_orderstatus = 'P'
        UNION ALL SELECT 'customer', 'error', 'ForeignKeys.NoReferencedRow' FROM orders WHERE o_totalprice < 250000 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
        UNION ALL SELECT 'items', 'error', 'Unique.NotUnique' FROM (SELECT DISTINCT oid FROM (SELECT l_orderkey * 10 + l_linenumber AS oid FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_partkey) > 1) WHERE oid % 2 = 1)) GROUP BY ALL""",
    "xml_specification": """SELECT 'days' AS condition, 'warning' AS severity, CASE WHEN o_orderdate < TIMESTAMP '1993-01-01' THEN 'ValidDateValues.DateBeforeMinimum' ELSE 'ValidDateValues.DateAfterMaximum' END AS issue_code, o_orderkey AS oid
        FROM orders WHERE o_orderstatus = 'F' AND (o_orderdate < TIMESTAMP '1993-01-01' OR o_orderdate > TIMESTAMP '1996-01-01')""",
    "quality_document": f"""{W} SELECT 'small boxes' AS condition, 'error' AS severity, 'MinArea.AreaTooSmall' AS issue_code, oid, 'boxes' AS tab, NULL AS component FROM bx b WHERE p_size > 3 AND (x1 - x0) * (y1 - y0) < 3
            AND NOT (EXISTS (SELECT 1 FROM pt p WHERE {PON}) AND NOT p_brand LIKE '%1')
        UNION ALL SELECT 'poor customers', 'warning', 'Constraints.ConstraintNotFulfilled', o_orderkey, 'orders of customers', NULL FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND NOT (c_acctbal > 0 OR o_totalprice < 100000)
        UNION ALL SELECT 'names', 'error', 'SchemaFieldNames.NameTooLong', NULL, NULL, c FROM (VALUES ('o_orderstatus'), ('o_totalprice'), ('o_orderpriority')) t(c)""",
    "issue_store": "SELECT 'none' AS shape, 'Constraints.ConstraintNotFulfilled' AS issue_code, count(*) AS n FROM orders WHERE NOT o_totalprice < 300000",
    "qa_export_tables": "SELECT n_name, n_nationkey % 2 AS tile_id FROM nation WHERE n_regionkey = 1",
    "csv_source": "SELECT n_name FROM nation WHERE n_regionkey = 2",
    "qa_external_service": "SELECT CAST(n_nationkey AS BIGINT) AS oid FROM nation WHERE n_nationkey % 2 = 1",
    "qa_external_graphic_conflict": f"{W} SELECT p.oid, b.oid AS other FROM pt p JOIN bx b ON {PD} <= 0.5",
    "in_list_scan": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "stream_violations": "SELECT event_id, value FROM events WHERE NOT coalesce(value < 90, false)",
    "windowed_counts": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "session_windows": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        r AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT min(ts) AS start, user_id, count(*) AS n FROM r GROUP BY user_id, run""",
}
