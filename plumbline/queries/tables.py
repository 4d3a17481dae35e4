"""Queries of table transformers, joins, aggregates and expressions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline import issues as I
from plumbline.functions import evaluator, expressions
from plumbline.issues import Table
from plumbline.operators import attributes as A
from plumbline.operators import transformers as T
from plumbline.queries.base import Query, flat, table

LINE = "l_orderkey * 10 + l_linenumber"


def _predicates(s, d):
    o = table(s, d, "orders").df
    names = expressions.names_of(o)
    made = ["o_totalprice % 7 < 3 AND NOT (o_orderstatus = 'f')", "o_orderpriority LIKE '*urgent'", "LEN(TRIM(o_orderpriority)) = 5 OR o_custkey IN (1, 2, 3)", "IIF(o_totalprice > 100000, 'big', 'small') = 'BIG'", "o_orderstatus = 'o'##CASESENSITIVE", "ISNULL(CONVERT(o_orderstatus, 'System.Int32'), 5) = 5 AND SUBSTRING(o_orderpriority, 1, 1) >= '3'"]
    return o.select("o_orderkey", *[expressions.holds(e, names).alias(f"p{i}") for i, e in enumerate(made)])


def _scalars(s, d):
    p = table(s, d, "part").df
    made = {
        "a": "ROUND(p_retailprice / 100, 1)", "b": "p_size > 25 ? 'large' : 'small'", "c": "TRUNC(-p_size / 7)", "e": "LPAD(p_size, 4, '0') + '/' + SUBSTR(p_brand, -2, 4)",
        "f": "10 < p_size <= 20", "g": "DECODE(p_size % 3, 0, 'zero', 1, 'one', 'more')", "h": "WHEN(p_size < 10, 1, p_size < 20, 2, 3)", "i": "MAX(p_size, 10, p_partkey % 50)", "j": "REGEX('[0-9]$', p_brand) and p_size not in (1, 2, 3)",
        "k": "CONCAT(UCASE(p_brand), null, LENGTH(p_name))", "l": "null ?? FLOOR(p_retailprice)",
    }
    names = expressions.names_of(p)
    return p.select("p_partkey", *[evaluator.evaluate(e, names).alias(k) for k, e in made.items()])


def _join(s, d):
    return T.tr_table_join(table(s, d, "orders"), table(s, d, "customer", "c_acctbal > 0"), "o_custkey", "c_custkey", "left").df.select("o_orderkey", "c_name", F.size("base_rows").alias("n_base"))


def _bridge(s, d):
    out = T.tr_table_join(table(s, d, "orders", "o_orderstatus = 'P'"), table(s, d, "part"), "o_orderkey", "p_partkey", "inner", table(s, d, "lineitem"), "l_orderkey", "l_partkey")
    return out.df.select("o_orderkey", "p_partkey", F.col("lineitem_oid").alias("oid"))


RELATIONS = {"nation_region": T.Relation("nation", "n_regionkey", "region", "r_regionkey"), "customer_nation": T.Relation("customer", "c_nationkey", "nation", "n_nationkey")}


def _relation(s, d, name, *tables, where=None):
    joined = T.tr_table_join_by_name({t: table(s, d, t) for t in tables}, RELATIONS, name)
    return Table(joined.df, joined.name, joined.oid, where=where)


def _append(s, d):
    a, b = table(s, d, "customer"), table(s, d, "supplier")
    return T.tr_table_append([Table(a.df.withColumnRenamed("c_name", "name"), "customer", "c_custkey"), Table(b.df.withColumnRenamed("s_name", "name"), "supplier", "s_suppkey")]).df.select("appended_oid", "name", "c_acctbal", "s_acctbal")


def _issue_run(s, d):
    found = _all_issues(s, d)
    allowed = found.where("condition = 'prices' and involved[0].oid % 3 = 0").select("condition", F.lit(None).cast("string").alias("issue_code"), "involved")
    return I.statistics(I.without_exceptions(I.distinct(found), allowed), ["condition", "issue_code"])


def _all_issues(s, d):
    prices = A.qa_constraint(table(s, d, "orders"), "o_totalprice < 300000").withColumn("condition", F.lit("prices"))
    dates = A.qa_valid_date_values(table(s, d, "orders"), "1996-01-01", None).withColumn("condition", F.lit("dates"))
    return prices.unionByName(dates).unionByName(prices)


QUERIES: dict[str, Query] = {
    "row_predicates": _predicates,
    "scalar_evaluator": _scalars,
    "field_assignment": lambda s, d: evaluator.assign(table(s, d, "nation").df, "n_regionkey = n_nationkey; n_nationkey = n_regionkey").select("n_name", F.col("n_regionkey").cast("int").alias("r"), F.col("n_nationkey").cast("int").alias("n")),
    "named_values_condition": lambda s, d: (lambda o: o.where(expressions.named_values_condition("o_orderstatus=O,P; o_orderpriority=1-URGENT", expressions.names_of(o))).select("o_orderkey"))(table(s, d, "orders").df),
    "filter_name_expression": lambda s, d: (lambda n: n.where(expressions.any_of_filters({"cold": F.col("n_regionkey") > 2, "odd": F.col("n_nationkey") % 2 == 1}, "cold AND NOT odd")).select("n_name"))(table(s, d, "nation").df),
    "pair_condition": lambda s, d: _pairs(s, d),
    "tr_table_join_in_memory": _join,
    "tr_table_join_bridge": _bridge,
    "tr_table_join": lambda s, d: _relation(s, d, "nation_region", "nation", "region").df.select("n_name", "r_name"),
    "tr_table_append": _append,
    "tr_make_table": lambda s, d: T.tr_make_table(s, {"o": table(s, d, "orders")}, "select o_custkey as oid, count(*) as n, sum(o_totalprice) as total from {o} group by o_custkey", "oid").df.select("oid", "n", F.round("total", 2).alias("total")),
    "tr_attributes": lambda s, d: T.tr_attributes(table(s, d, "part"), ["p_size * 2 AS twice", "p_brand"]).df.select("p_partkey", "twice", "p_brand"),
    "group_expressions": lambda s, d: T.grouped(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["SUM(l_quantity) AS qty", "COUNT(*) AS n", "MAX(l_tax) AS tax", "AVG(l_discount) AS disc"]).select("l_returnflag", "l_linestatus", "n", "tax", F.round("qty", 2).alias("qty"), F.round("disc", 6).alias("disc")),
    "qa_rel_constraint": lambda s, d: flat(A.qa_constraint(_relation(s, d, "customer_nation", "customer", "nation", where="n_regionkey <> 0"), A.constraint_tree(["c_acctbal < 5000", "+n_regionkey IN (1, 2)"]))),
    "qa_rel_unique": lambda s, d: flat(A.qa_unique(_relation(s, d, "customer_nation", "customer", "nation"), ["n_name", "c_mktsegment", "c_nationkey"])),
    "qa_rel_group_constraints": lambda s, d: flat(A.qa_group_constraints(_relation(s, d, "customer_nation", "customer", "nation"), "n_regionkey", "c_mktsegment", 3), "no_oid", "value", "value2"),
    "qa_rel_regular_expression": lambda s, d: flat(A.qa_regular_expression(_relation(s, d, "customer_nation", "customer", "nation"), "^[A-M]", ["n_name"])),
    "issue_statistics": _issue_run,
    "distinct_values": lambda s, d: table(s, d, "orders").df.groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("n_distinct"), F.count_if(F.col("o_custkey").isNull()).alias("n_null")),
    "most_frequent_value": lambda s, d: table(s, d, "part").df.groupBy("p_brand", "p_size").count().groupBy("p_brand").agg(F.max_by("p_size", F.struct("count", -F.col("p_size"))).alias("mode")),
    "top_k": lambda s, d: table(s, d, "orders").df.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice"),
    "interval_merge": lambda s, d: _merged(s, d),
    "range_join": lambda s, d: _overlaps(s, d),
}


def _pairs(s, d):
    n = table(s, d, "nation").df
    a, b = n.alias("G1"), n.alias("G2")
    met = expressions.pair_condition("G1.n_name < G2.n_name AND G1.n_regionkey = G2.n_regionkey", n, n, undirected=True)
    same = F.col("G1.n_regionkey") == F.col("G2.n_regionkey")
    return a.join(b, same & met & (F.col("G1.n_nationkey") < F.col("G2.n_nationkey"))).select(F.col("G1.n_nationkey").alias("a"), F.col("G2.n_nationkey").alias("b"))


def _merged(s, d):
    """Union of intervals by group, gaps up to 5 closed, merged runs shorter than 12 dropped."""
    rows = table(s, d, "lineitem").df.select("l_orderkey", F.col("l_quantity").alias("low"), (F.col("l_quantity") + F.col("l_discount") * 50).alias("high"))
    w = Window.partitionBy("l_orderkey").orderBy("low", "high")
    before = F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = rows.withColumn("new", F.when(before.isNull() | (F.col("low") > before + 5), 1).otherwise(0)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("l_orderkey", "run").agg(F.min("low").alias("low"), F.round(F.max("high"), 6).alias("high")).where("high - low >= 12").drop("run")


def _overlaps(s, d):
    """Pairs of overlapping intervals of a route: each interval meets the buckets it covers, and a pair counts in one only."""
    width = 5.0
    e = table(s, d, "events").df.select("event_id", "user_id", F.col("value").alias("low"), (F.col("value") + 2).alias("high"))
    bucketed = e.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))))
    a, b = bucketed.alias("a"), bucketed.alias("b")
    met = (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.event_id") < F.col("b.event_id")) & (F.col("a.low") <= F.col("b.high")) & (F.col("b.low") <= F.col("a.high"))
    once = F.col("a.bucket") == F.greatest(F.floor(F.col("a.low") / width), F.floor(F.col("b.low") / width))
    return a.join(b, met & once).select(F.col("a.event_id").alias("a"), F.col("b.event_id").alias("b"))


ORACLES: dict[str, str] = {
    "row_predicates": """SELECT o_orderkey, fmod(o_totalprice, 7) < 3 AND lower(o_orderstatus) <> 'f' AS p0, lower(o_orderpriority) LIKE '%urgent' AS p1, length(trim(o_orderpriority)) = 5 OR o_custkey IN (1, 2, 3) AS p2,
        o_totalprice > 100000 AS p3, o_orderstatus = 'o' AS p4, substring(o_orderpriority, 1, 1) >= '3' AS p5 FROM orders""",
    "scalar_evaluator": """SELECT p_partkey, round_even(p_retailprice / 100 * 10, 0) / 10.0 AS a, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS b, trunc(-p_size / 7.0) + 0.0 AS c,
        lpad(CAST(p_size AS VARCHAR), 4, '0') || '/' || substring(p_brand, 1, 2) AS e, 10 < p_size AND p_size <= 20 AS f, CASE p_size % 3 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'more' END AS g,
        CASE WHEN p_size < 10 THEN 1e0 WHEN p_size < 20 THEN 2e0 ELSE 3e0 END AS h, CAST(greatest(p_size, 10, p_partkey % 50) AS DOUBLE) AS i, regexp_matches(p_brand, '[0-9]$') AND p_size NOT IN (1, 2, 3) AS j,
        upper(p_brand) || length(p_name) AS k, floor(p_retailprice) AS l FROM part""",
    "field_assignment": "SELECT n_name, n_nationkey AS r, n_regionkey AS n FROM nation",
    "named_values_condition": "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority = '1-URGENT'",
    "filter_name_expression": "SELECT n_name FROM nation WHERE n_regionkey > 2 AND n_nationkey % 2 = 0",
    "pair_condition": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey AND lower(a.n_name) <> lower(b.n_name)",
    "tr_table_join_in_memory": "SELECT o_orderkey, c_name, CASE WHEN c_custkey IS NULL THEN 1 ELSE 2 END AS n_base FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey",
    "tr_table_join_bridge": f"SELECT o_orderkey, p_partkey, {LINE} AS oid FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'P'",
    "tr_table_join": "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "tr_table_append": "SELECT c_custkey * 2 AS appended_oid, c_name AS name, c_acctbal, NULL AS s_acctbal FROM customer UNION ALL SELECT s_suppkey * 2 + 1, s_name, NULL, s_acctbal FROM supplier",
    "tr_make_table": "SELECT o_custkey AS oid, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
    "tr_attributes": "SELECT p_partkey, p_size * 2 AS twice, p_brand FROM part",
    "group_expressions": "SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_tax) AS tax, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc FROM lineitem GROUP BY 1, 2",
    "qa_rel_constraint": "SELECT 'Constraints.ConstraintNotFulfilled' AS issue_code, c_custkey AS oid FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 0 AND c_acctbal < 5000 AND n_regionkey NOT IN (1, 2)",
    "qa_rel_unique": "SELECT 'Unique.NotUnique' AS issue_code, c_custkey AS oid FROM customer JOIN nation ON c_nationkey = n_nationkey QUALIFY count(*) OVER (PARTITION BY n_name, c_mktsegment, c_nationkey) > 1",
    "qa_rel_group_constraints": """SELECT 'GroupConstraints.TooManyDistinctValues' AS issue_code, CAST(n_regionkey AS VARCHAR) AS value, CAST(count(DISTINCT c_mktsegment) AS VARCHAR) AS value2
        FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey HAVING count(DISTINCT c_mktsegment) > 3""",
    "qa_rel_regular_expression": "SELECT 'RegularExpression.FieldValueDoesNotMatchRegularExpression' AS issue_code, c_custkey AS oid FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE NOT regexp_matches(n_name, '^[A-M]')",
    "issue_statistics": """SELECT 'prices' AS condition, 'Constraints.ConstraintNotFulfilled' AS issue_code, count(*) AS n_issues FROM orders WHERE NOT o_totalprice < 300000 AND o_orderkey % 3 <> 0
        UNION ALL SELECT 'dates', 'ValidDateValues.DateBeforeMinimum', count(*) FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'""",
    "distinct_values": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n_distinct, count(*) - count(o_custkey) AS n_null FROM orders GROUP BY 1",
    "most_frequent_value": "SELECT p_brand, p_size AS mode FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size) = 1",
    "top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "interval_merge": """WITH r AS (SELECT l_orderkey, l_quantity AS low, l_quantity + l_discount * 50 AS high FROM lineitem),
        a AS (SELECT *, max(high) OVER (PARTITION BY l_orderkey ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
        b AS (SELECT *, sum(CASE WHEN before IS NULL OR low > before + 5 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS run FROM a)
        SELECT l_orderkey, min(low) AS low, round(max(high), 6) AS high FROM b GROUP BY l_orderkey, run HAVING round(max(high), 6) - min(low) >= 12""",
    "range_join": "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.value <= b.value + 2 AND b.value <= a.value + 2",
}
