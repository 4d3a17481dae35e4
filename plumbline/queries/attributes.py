"""Queries of the attribute checks, and the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.issues import Table
from plumbline.operators import attributes as A
from plumbline.queries.base import Query, flat, table

LINE = "l_orderkey * 10 + l_linenumber"

QUERIES: dict[str, Query] = {
    "qa_constraint": lambda s, d: flat(A.qa_constraint(table(s, d, "lineitem"), "l_discount < 0.05 AND l_quantity >= 10")),
    "qa_constraint_tree": lambda s, d: flat(A.qa_constraint(table(s, d, "lineitem"), A.constraint_tree(["l_returnflag = 'r'", "+l_tax < 0.02", "+l_quantity < 25", "++l_discount > 0.03", "l_linestatus IN ('o', 'f') AND l_shipdate > #1993-01-01#"])), "description"),
    "qa_dataset_constraint_factory": lambda s, d: flat(A.qa_constraint(table(s, d, "orders"), A.constraint_tree(["o_totalprice > 1000", "o_orderstatus = 'O'", "+o_orderpriority LIKE '1*' OR o_totalprice < 100000"])), "description"),
    "qa_relation_constraint": lambda s, d: flat(A.qa_constraint(_orders_with_customer(s, d), "c_acctbal > 0 OR o_totalprice < 50000")),
    "qa_unique": lambda s, d: flat(A.qa_unique(table(s, d, "lineitem"), ["l_orderkey", "l_partkey"])),
    "qa_unique_tables": lambda s, d: flat(A.qa_unique([_renamed(table(s, d, "customer"), "c_nationkey", "c_acctbal"), _renamed(table(s, d, "supplier"), "s_nationkey", "s_acctbal")], ["k", "v"]), "tab"),
    "qa_foreign_key": lambda s, d: flat(A.qa_foreign_key(table(s, d, "labels"), ["doc_id"], table(s, d, "documents", "lang = 'en'"), ["doc_id"])),
    "qa_foreign_key_tuple": lambda s, d: flat(A.qa_foreign_key(table(s, d, "lineitem"), ["l_partkey", "l_suppkey"], table(s, d, "lineitem", "l_returnflag = 'R'"), ["l_partkey", "l_suppkey"])),
    "qa_foreign_key_error": lambda s, d: flat(A.qa_foreign_key(table(s, d, "orders"), ["o_custkey"], table(s, d, "customer", "c_acctbal < 0"), ["c_custkey"], reference_is_error=True)),
    "qa_unreferenced_rows": lambda s, d: flat(A.qa_unreferenced_rows(table(s, d, "customer"), [table(s, d, "orders", "o_totalprice > 200000")], ["c_custkey,o_custkey"])),
    "qa_group_constraints": lambda s, d: flat(A.qa_group_constraints(table(s, d, "part"), "SUBSTRING(p_brand, 1, 8)", "p_type", 3, 2), "no_oid", "value", "value2"),
    "qa_group_constraints_exists": lambda s, d: flat(A.qa_group_constraints(table(s, d, "customer"), "c_nationkey", "c_mktsegment", 4, 0, ["c_acctbal < 0"]), "no_oid", "value", "value2"),
    "qa_regular_expression": lambda s, d: flat(A.qa_regular_expression(table(s, d, "documents"), r"[0-9]{3}-[0-9]{4}", ["text", "source"], match_is_error=True), "component"),
    "qa_required_fields": lambda s, d: flat(A.qa_required_fields(_with_nulls(s, d)), "component"),
    "qa_trimmed_text_fields": lambda s, d: flat(A.qa_trimmed_text_fields(_padded(s, d), ["t"]), "component"),
    "qa_empty_not_null_text_fields": lambda s, d: flat(A.qa_empty_not_null_text_fields(_with_nulls(s, d), ["seg"]), "component"),
    "qa_value": lambda s, d: flat(A.qa_value(_texts(s, d), {"num": "int", "word": "int"}), "component"),
    "qa_date_fields_without_time": lambda s, d: flat(A.qa_date_fields_without_time(table(s, d, "events")), "component"),
    "qa_valid_date_values": lambda s, d: flat(A.qa_valid_date_values(table(s, d, "orders"), "1993-06-01", "-800 days", now="1998-12-01"), "component"),
    "qa_attribute_dependency": lambda s, d: flat(A.qa_attribute_dependency(table(s, d, "lineitem"), ["l_returnflag"], ["l_linestatus"], [(["R"], ["F"]), (["A"], ["F"]), (["X"], ["*"])])),
    "qa_row_count": lambda s, d: flat(A.qa_row_count(table(s, d, "orders"), 1, 10), "no_oid", "value"),
    "qa_row_count_reference": lambda s, d: flat(A.qa_row_count(table(s, d, "lineitem"), references=[table(s, d, "orders"), table(s, d, "customer")], minimum_offset="+10%", maximum_offset="+50"), "no_oid", "value"),
    "qa_valid_urls": lambda s, d: flat(A.qa_valid_urls(_urls(s, d), "u")),
    "qa_valid_coordinate_fields": lambda s, d: flat(A.qa_valid_coordinate_fields(_coordinates(s, d), F.col("px"), F.col("py"), "x", "y", 0.25)),
    "qa_gdb_constraint": lambda s, d: flat(A.qa_gdb_constraint(table(s, d, "orders"), [("price", "o_totalprice >= 50000", None), ("status", "o_orderstatus <> 'P'", "o_totalprice > 100000")]), "component"),
    "qa_constraints_list_factory": lambda s, d: flat(A.constraints_list(table(s, d, "nation"), s.createDataFrame([("LENGTH (n_name) < 9", 1), ("n_regionkey = 1", 2), ("  ", 3)], "rule string, rank int"), "rule", expression_is_error=True), "description"),
    "equal_field_values_options": lambda s, d: _nearly_same_orders(s, d),
    "equal_field_values": lambda s, d: _same_orders(s, d),
}


def _orders_with_customer(s, d) -> Table:
    o, c = table(s, d, "orders"), table(s, d, "customer")
    return Table(o.df.join(c.df, o.df.o_custkey == c.df.c_custkey), "orders_customer", "o_orderkey")


def _renamed(t: Table, k: str, v: str) -> Table:
    return Table(t.df.select(F.col(t.oid).alias("oid"), F.col(k).alias("k"), F.floor(F.col(v) / 100).alias("v")), t.name)


def _with_nulls(s, d) -> Table:
    c = table(s, d, "customer").df
    return Table(c.select(F.col("c_custkey").alias("oid"), F.expr("case when c_custkey % 7 = 0 then null when c_custkey % 11 = 0 then '' else c_mktsegment end as seg"), F.expr("case when c_custkey % 5 = 0 then null else c_acctbal end as bal")), "customer")


def _padded(s, d) -> Table:
    p = table(s, d, "part").df
    return Table(p.select(F.col("p_partkey").alias("oid"), F.expr("case p_partkey % 5 when 0 then concat(' ', p_name) when 1 then concat(p_name, '\\t') when 2 then concat('\\n', p_name, ' ') when 3 then '  ' else p_name end as t")), "part")


def _texts(s, d) -> Table:
    p = table(s, d, "part").df
    return Table(p.select(F.col("p_partkey").alias("oid"), F.expr("cast(p_size as string) as num"), F.expr("case when p_partkey % 3 = 0 then p_brand else cast(p_partkey as string) end as word")), "part")


def _urls(s, d) -> Table:
    p = table(s, d, "pages").df
    return Table(p.select(F.col("page_id").alias("oid"), F.expr("case page_id % 4 when 0 then substring(url, 9) when 1 then ' ' else url end as u")), "pages")


def _coordinates(s, d) -> Table:
    e = table(s, d, "embeddings").df
    x, y = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    made = e.select(F.col("vec_id").alias("oid"), x.alias("px"), y.alias("py"), F.expr("case when vec_id % 10 = 0 then null when vec_id % 10 = 1 then 'east' else cast(cast(embedding[0] as double) + (vec_id % 4) * 0.125 as string) end as x"), F.expr("case when vec_id % 10 = 0 then null else cast(cast(embedding[1] as double) as string) end as y"))
    return Table(made, "embeddings")


def _same_orders(s, d):
    n = table(s, d, "nation").df.select(F.col("n_nationkey").alias("oid"), F.col("n_regionkey").alias("r"), F.expr("concat_ws('|', array_sort(array(substring(n_name, 1, 1), substring(n_name, 2, 1)))) as v"), F.expr("n_nationkey % 2 as p"))
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, (F.col("a.r") == F.col("b.r")) & (F.col("a.oid") < F.col("b.oid")) & A.equal_values_condition("p,v:|")).select(F.col("a.oid").alias("oid"), F.col("b.oid").alias("other_oid"))


def _nearly_same_orders(s, d):
    """Orders of one customer whose clerk (without its number), priority (if not urgent) and price (within a tenth) agree."""
    o = table(s, d, "orders").df.select(F.col("o_orderkey").alias("oid"), "o_custkey", "o_orderpriority", "o_totalprice", "o_orderstatus")
    a, b = o.alias("a"), o.alias("b")
    options = ["o_orderpriority:ignore=^[0-9]-", "o_orderpriority:ignoreCondition=_VALUE = 'urgent' OR o_orderstatus = 'P'", "o_totalprice:allowedDifferenceCondition=G1._VALUE >= G2._VALUE AND G1._VALUE <= G2._VALUE * 1.1 AND G1.o_orderstatus = G2.o_orderstatus"]
    same = A.equal_values_condition("o_orderpriority;o_totalprice", options=options, rows=(o, o), sensitive=False)
    return a.join(b, (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.oid") < F.col("b.oid")) & same).select(F.col("a.oid").alias("oid"), F.col("b.oid").alias("other_oid"))


ORACLES: dict[str, str] = {
    "equal_field_values_options": """WITH o AS (SELECT o_orderkey AS oid, o_custkey AS c, o_totalprice AS t, o_orderstatus AS s, CASE WHEN o_orderpriority LIKE '%URGENT' OR o_orderstatus = 'P' THEN NULL ELSE regexp_replace(o_orderpriority, '^[0-9]-', '') END AS p FROM orders)
        SELECT a.oid, b.oid AS other_oid FROM o a JOIN o b ON a.c = b.c AND a.oid < b.oid AND a.p IS NOT DISTINCT FROM b.p AND (a.t = b.t OR a.s = b.s AND greatest(a.t, b.t) <= least(a.t, b.t) * 1.1)""",
    "qa_constraint": f"SELECT 'Constraints.ConstraintNotFulfilled' AS issue_code, {LINE} AS oid FROM lineitem WHERE NOT coalesce(l_discount < 0.05 AND l_quantity >= 10, false)",
    "qa_constraint_tree": f"""SELECT 'Constraints.ConstraintNotFulfilled' AS issue_code, {LINE} AS oid, description FROM lineitem, LATERAL (VALUES
        ('l_tax < 0.02', l_returnflag = 'R' AND NOT l_tax < 0.02),
        ('l_discount > 0.03', l_returnflag = 'R' AND l_quantity < 25 AND NOT l_discount > 0.03),
        ('l_linestatus IN (''o'', ''f'') AND l_shipdate > #1993-01-01#', NOT (l_linestatus IN ('O', 'F') AND l_shipdate > TIMESTAMP '1993-01-01'))) v(description, broken) WHERE broken""",
    "qa_dataset_constraint_factory": """SELECT 'Constraints.ConstraintNotFulfilled' AS issue_code, o_orderkey AS oid, description FROM orders, LATERAL (VALUES
        ('o_totalprice > 1000', NOT o_totalprice > 1000),
        ('o_orderpriority LIKE ''1*'' OR o_totalprice < 100000', o_orderstatus = 'O' AND NOT (o_orderpriority LIKE '1%' OR o_totalprice < 100000))) v(description, broken) WHERE broken""",
    "qa_relation_constraint": "SELECT 'Constraints.ConstraintNotFulfilled' AS issue_code, o_orderkey AS oid FROM orders JOIN customer ON o_custkey = c_custkey WHERE NOT coalesce(c_acctbal > 0 OR o_totalprice < 50000, false)",
    "qa_unique": f"SELECT 'Unique.NotUnique' AS issue_code, {LINE} AS oid FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_partkey) > 1",
    "qa_unique_tables": """SELECT 'Unique.NotUnique' AS issue_code, oid, tab FROM (SELECT 'customer' AS tab, c_custkey AS oid, c_nationkey AS k, floor(c_acctbal / 100) AS v FROM customer
        UNION ALL SELECT 'supplier', s_suppkey, s_nationkey, floor(s_acctbal / 100) FROM supplier) QUALIFY count(*) OVER (PARTITION BY k, v) > 1""",
    "qa_foreign_key": "SELECT 'ForeignKeys.NoReferencedRow' AS issue_code, doc_id AS oid FROM labels WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')",
    "qa_foreign_key_tuple": f"SELECT 'ForeignKeys.NoReferencedRow' AS issue_code, {LINE} AS oid FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_returnflag = 'R' AND a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey)",
    "qa_foreign_key_error": "SELECT 'ForeignKeys.UnexpectedReferencedRow' AS issue_code, o_orderkey AS oid FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "qa_unreferenced_rows": "SELECT 'UnreferencedRows.ValueNotReferenced' AS issue_code, c_custkey AS oid FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000 AND o_custkey IS NOT NULL)",
    "qa_group_constraints": """SELECT CASE WHEN n < 2 THEN 'GroupConstraints.TooFewDistinctValues' ELSE 'GroupConstraints.TooManyDistinctValues' END AS issue_code, g AS value, CAST(n AS VARCHAR) AS value2
        FROM (SELECT substring(p_brand, 1, 8) AS g, count(DISTINCT coalesce(p_type, '')) AS n FROM part GROUP BY 1) WHERE n < 2 OR n > 3""",
    "qa_group_constraints_exists": """SELECT 'GroupConstraints.TooManyDistinctValues' AS issue_code, CAST(c_nationkey AS VARCHAR) AS value, CAST(count(DISTINCT c_mktsegment) AS VARCHAR) AS value2
        FROM customer GROUP BY c_nationkey HAVING count(DISTINCT c_mktsegment) > 4 AND bool_or(c_acctbal < 0)""",
    "qa_regular_expression": """SELECT 'RegularExpression.FieldValueMatchesRegularExpression' AS issue_code, doc_id AS oid, component FROM documents, LATERAL (VALUES ('text', text), ('source', source)) v(component, x)
        WHERE regexp_matches(x, '[0-9]{3}-[0-9]{4}')""",
    "qa_required_fields": """SELECT code AS issue_code, c_custkey AS oid, component FROM customer, LATERAL (VALUES
        ('seg', CASE WHEN c_custkey % 7 = 0 THEN 'RequiredFields.NullValue' WHEN c_custkey % 11 = 0 OR c_mktsegment = '' THEN 'RequiredFields.EmptyString' END),
        ('bal', CASE WHEN c_custkey % 5 = 0 OR c_acctbal IS NULL THEN 'RequiredFields.NullValue' END)) v(component, code) WHERE code IS NOT NULL""",
    "qa_trimmed_text_fields": """SELECT CASE p_partkey % 5 WHEN 0 THEN 'TrimmedText.LeadingWhiteSpace' WHEN 1 THEN 'TrimmedText.TrailingWhiteSpace' WHEN 2 THEN 'TrimmedText.LeadingAndTrailingWhiteSpace' ELSE 'TrimmedText.WhiteSpaceOnly' END AS issue_code,
        p_partkey AS oid, 't' AS component FROM part WHERE p_partkey % 5 < 4""",
    "qa_empty_not_null_text_fields": """SELECT CASE WHEN c_custkey % 7 = 0 THEN 'EmptyNotNullTextFields.ValueIsNull' ELSE 'EmptyNotNullTextFields.EmptyText' END AS issue_code, c_custkey AS oid, 'seg' AS component
        FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 11 = 0""",
    "qa_value": "SELECT 'Value.InvalidFieldValue' AS issue_code, p_partkey AS oid, 'word' AS component FROM part WHERE p_partkey % 3 = 0 AND try_cast(p_brand AS INT) IS NULL",
    "qa_date_fields_without_time": "SELECT 'DateFieldsWithoutTime.HasTimePart' AS issue_code, event_id AS oid, 'ts' AS component FROM events WHERE ts <> date_trunc('day', ts)",
    "qa_valid_date_values": """SELECT CASE WHEN o_orderdate < TIMESTAMP '1993-06-01' THEN 'ValidDateValues.DateBeforeMinimum' ELSE 'ValidDateValues.DateAfterMaximum' END AS issue_code, o_orderkey AS oid, 'o_orderdate' AS component
        FROM orders WHERE o_orderdate < TIMESTAMP '1993-06-01' OR o_orderdate > TIMESTAMP '1998-12-01' - INTERVAL 800 DAY""",
    "qa_attribute_dependency": f"""SELECT CASE WHEN l_returnflag IN ('R', 'A') THEN 'AttributeDependency.TargetNotAllowed' ELSE 'AttributeDependency.SourceNotConfigured' END AS issue_code, {LINE} AS oid
        FROM lineitem WHERE NOT (l_returnflag IN ('R', 'A') AND l_linestatus = 'F')""",
    "qa_row_count": "SELECT 'RowCount.TooManyRows' AS issue_code, CAST(count(*) AS VARCHAR) AS value FROM orders HAVING count(*) > 10",
    "qa_row_count_reference": """SELECT CASE WHEN n < ceil(c * 1.1) THEN 'RowCount.TooFewRows' ELSE 'RowCount.TooManyRows' END AS issue_code, CAST(n AS VARCHAR) AS value
        FROM (SELECT (SELECT count(*) FROM lineitem) AS n, (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) AS c) WHERE n < ceil(c * 1.1) OR n > c + 50""",
    "qa_valid_urls": "SELECT 'ValidUrls.InvalidUrlFormat' AS issue_code, page_id AS oid FROM pages WHERE page_id % 4 = 0 AND trim(substring(url, 9)) <> '' AND NOT regexp_matches(substring(url, 9), '^[A-Za-z][A-Za-z0-9+.-]*://[^ /?#]+')",
    "qa_valid_coordinate_fields": """SELECT CASE vec_id % 10 WHEN 0 THEN 'ValidCoordinateFields.MissingCoordinates' WHEN 1 THEN 'ValidCoordinateFields.InvalidCoordinate' ELSE 'ValidCoordinateFields.XYFieldCoordinateTooFarFromShape' END AS issue_code, vec_id AS oid
        FROM embeddings WHERE vec_id % 10 IN (0, 1) OR (vec_id % 4) * 0.125 > 0.3""",
    "qa_gdb_constraint": """SELECT 'GdbConstraint.InvalidRow' AS issue_code, o_orderkey AS oid, CASE WHEN o_totalprice < 50000 THEN 'price' ELSE 'status' END AS component FROM orders
        WHERE o_totalprice < 50000 OR (o_totalprice > 100000 AND o_orderstatus = 'P')""",
    "qa_constraints_list_factory": """SELECT 'Constraints.ConstraintNotFulfilled' AS issue_code, CAST(n_nationkey AS BIGINT) AS oid, description FROM nation, LATERAL (VALUES
        ('NOT (LEN(n_name) < 9)', length(n_name) < 9), ('NOT (n_regionkey = 1)', n_regionkey = 1)) v(description, broken) WHERE broken""",
    "equal_field_values": """WITH n AS (SELECT n_nationkey AS oid, n_regionkey AS r, list_sort([substring(n_name, 1, 1), substring(n_name, 2, 1)]) AS v, n_nationkey % 2 AS p FROM nation)
        SELECT a.oid, b.oid AS other_oid FROM n a JOIN n b ON a.r = b.r AND a.oid < b.oid AND a.p = b.p AND a.v = b.v""",
}
