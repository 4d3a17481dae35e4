"""Checks on small hand-made rows: nulls, duplicates, conversions, trees, runs."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline import issues as I
from plumbline.issues import Table
from plumbline.operators import attributes as A
from plumbline.operators import transformers as T
from plumbline.plans import specification as P


def oids(found):
    return sorted(r[0] for r in found.select(F.col("involved")[0]["oid"]).collect())


def codes(found):
    return sorted(r[0] for r in found.select("issue_code").collect())


def make(spark, rows, schema, name="t", **more):
    return Table(spark.createDataFrame(rows, schema), name, "oid", **more)


def test_unique_counts_null_keys_as_equal(spark):
    t = make(spark, [(1, "a"), (2, None), (3, "a"), (4, None), (5, "A")], "oid long, k string")
    assert oids(A.qa_unique(t, ["k"])) == [1, 2, 3, 4]


def test_foreign_key_conversion_and_tuples(spark):
    keys = make(spark, [(1, 1000, "AAA"), (2, 2000, None)], "oid long, k int, c string", "keys")
    refs = make(spark, [(1, "1000", "AAA"), (2, "3000", "AAA"), (3, "x", None), (4, None, None), (5, "2000", None)], "oid long, f string, g string")
    assert codes(A.qa_foreign_key(refs, ["f"], keys, ["k"])) == ["ForeignKeys.NoReferencedRow", "ForeignKeys.UnableToConvertFieldValue"]
    assert oids(A.qa_foreign_key(refs, ["f", "g"], keys, ["k", "c"])) == [2, 3]
    assert oids(A.qa_foreign_key(refs, ["f"], keys, ["k"], reference_is_error=True).where("issue_code like '%Unexpected%'")) == [1, 5]


def test_unreferenced_rows_over_types(spark):
    t = make(spark, [(k, k) for k in range(1, 7)], "oid long, pk int")
    u, v = make(spark, [(1, "1"), (2, "3"), (3, None)], "oid long, fk string"), make(spark, [(1, 2), (2, 4)], "oid long, fk long")
    assert oids(A.qa_unreferenced_rows(t, [u, v], ["pk,fk", "pk;fk"])) == [5, 6]


def test_group_constraints(spark):
    t = make(spark, [(1, "123456-10"), (2, "123456-11"), (3, "123456-11"), (4, "023456-10"), (5, None), (6, "")], "oid long, k string")
    found = A.qa_group_constraints(t, "IIF(LEN(k) >= 6, SUBSTRING(k, 1, 6), '')", "SUBSTRING(k, 8, 9)", 1)
    assert [r["values"][0] for r in found.collect()] == ["123456"]


def test_constraint_tree_reports_leaves(spark):
    t = make(spark, [(1, 5, None), (2, 5, 1), (3, 9, 1)], "oid long, a int, b int")
    found = A.qa_constraint(t, A.constraint_tree(["a = 5", "+b = 1", "a < 9"]))
    assert sorted((r.involved[0].oid, r.description) for r in found.collect()) == [(1, "b = 1"), (3, "a < 9")]


@pytest.mark.parametrize(("low", "high", "n", "code"), [(1000, 2000, 2001, "RowCount.TooManyRows"), (1000, 2000, 999, "RowCount.TooFewRows"), (0, -1, 7, None)])
def test_row_count(spark, low, high, n, code):
    t = Table(spark.range(n).withColumnRenamed("id", "oid"), "t")
    assert codes(A.qa_row_count(t, low, high)) == ([code] if code else [])


def test_trimmed_text_sees_all_white_space(spark):
    t = make(spark, [(1, " a"), (2, "a "), (3, "\ta\n"), (4, "a"), (5, None), (6, "  "), (7, "")], "oid long, t string")
    assert oids(A.qa_trimmed_text_fields(t)) == [1, 2, 3, 6]
    assert oids(A.qa_trimmed_text_fields(t, allowed_blanks=2)) == [1, 2, 3]


def test_join_drops_null_keys_and_prefixes_names(spark):
    a, b = make(spark, [(1, None), (2, 7)], "oid long, k int", "a"), make(spark, [(5, "7"), (6, None)], "oid long, k string", "b")
    inner = T.tr_table_join(a, b, "k", "k").df.collect()
    assert [(r.oid, r.b_oid, len(r.base_rows)) for r in inner] == [(2, 5, 2)]
    assert T.tr_table_join(a, b, "k", "k", "left").df.count() == 2
    with pytest.raises(NotImplementedError):
        T.tr_table_join(a, b, "k", "k", "right")
    with pytest.raises(ValueError):
        T.tr_table_join(a, b, "k", "k", bridge=a)


def test_append_keeps_missing_fields_null(spark):
    a, b = make(spark, [(1, "x")], "oid long, p string", "a"), make(spark, [(1, 2)], "oid long, q int", "b")
    out = T.tr_table_append([a, b]).df.orderBy("appended_oid").collect()
    assert [(r.appended_oid, r.p, r.q) for r in out] == [(2, "x", None), (3, None, 2)]


def test_run_stops_filters_and_forgives(spark):
    t = make(spark, [(k, k) for k in range(1, 9)], "oid long, v int", "t")
    spec = {
        "name": "s",
        "conditions": [
            {"name": "stop", "check": "qa_constraint", "tables": {"table": "t"}, "parameters": {"constraints": "v < 7"}, "stop": True},
            {"name": "big", "check": "qa_constraint", "tables": {"table": "t"}, "filters": {"t": "v > 1"}, "parameters": {"constraints": "v < 3"}, "severity": "warning", "issue_filter": "involved_oid = 4"},
        ],
    }
    s = P.from_json(json.dumps(spec))
    assert P.from_json(P.to_json(s)) == s
    found = P.run(s, {"t": t})
    assert sorted((r.condition, r.involved[0].oid) for r in found.collect()) == [("big", 3), ("big", 5), ("big", 6), ("stop", 7), ("stop", 8)]
    allowed = found.where("condition = 'big' and involved[0].oid = 5").select("condition", "issue_code", "involved")
    left = P.run(s, {"t": t}, allowed)
    assert sorted((r.condition, r.n_issues) for r in P.report(left).collect()) == [("big", 2), ("stop", 2)]
    assert "<td>big</td>" in P.html_report(left, "a <b>")


def test_empty_tables(spark):
    t = make(spark, [], "oid long, k string, v int")
    assert A.qa_unique(t, ["k"]).count() == A.qa_constraint(t, "v > 1").count() == A.qa_group_constraints(t, "k", "v", 1).count() == 0
    assert I.distinct(A.qa_constraint(t, "v > 1")).count() == 0
