"""The two expression languages on rows with nulls."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plumbline.functions import evaluator
from plumbline.functions.expressions import ExpressionError, compile_expression, holds, named_values, names_of, projection, replace_table_names


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, None, "AAA", None), (2, 3, " b\t", 2.5), (3, 6, None, -2.5)], "id int, n int, t string, d double").orderBy("id").coalesce(1)


def values(rows, column):
    return [r[0] for r in rows.select(column.alias("v"), "id").orderBy("id").collect()]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("n > 5", [None, False, True]), ("t = 'aaa'", [True, False, None]), ("t = 'aaa'##CASESENSITIVE", [False, False, None]), ("t LIKE 'a*'", [True, False, None]), ("n IS NULL OR n IN (3)", [True, True, False]),
        ("NOT (n = 3)", [None, False, True]), ("LEN(TRIM(t))", [3, 1, None]), ("IIF(n > 3, 'x', 'y')", ["y", "y", "x"]), ("ISNULL(n, -1) + 1", [0, 4, 7]), ("SUBSTRING(t, 1, 2)", ["AA", " b", None]), ("n / 0", [None, None, None]),
        ("CONVERT(t, 'System.Int32')", [None, None, None]), ("n BETWEEN 3 AND 5", [None, True, False]), ("[n] % 4 = 3", [None, True, False]), ("t + 'x'", ["AAAx", " b\tx", None]),
    ],
)
def test_row_expressions(rows, text, expected):
    assert values(rows, compile_expression(text, names_of(rows))) == expected


def test_unknown_is_not_met(rows):
    assert values(rows, holds("n > 5", names_of(rows))) == [False, False, True]
    assert values(rows, holds(None, names_of(rows), default=False)) == [False] * 3


@pytest.mark.parametrize("text", ["n >", "nosuch = 1", "n LIKE 'a*b*'", "(n", "n NOT 3", "FOO(n)", "n ?? 1"])
def test_errors(rows, text):
    with pytest.raises(ExpressionError):
        compile_expression(text, names_of(rows))


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("n > 4 ? 'big' : 'small'", [None, "small", "big"]), ("n ?? -1", [-1.0, 3.0, 6.0]), ("ROUND(d)", [None, 2.0, -2.0]), ("TRUNC(d)", [None, 2.0, -2.0]), ("1 < n <= 3", [None, True, False]), ("n in (3, null)", [False, True, False]),
        ("n not in ()", [True, True, True]), ("t is text", [True, True, False]), ("n is null", [True, False, False]), ("MIN(n, d)", [None, 2.5, -2.5]), ("LPAD(id, 3, '0x')", ["001", "002", "003"]), ("RPAD(t, 2)", ["AAA", " b\t", None]),
        ("SUBSTR('hello', -1, 3)", ["he"] * 3), ("SUBSTR('hello', 9)", [""] * 3), ("CONCAT(t, n)", ["AAA", " b\t3", "6"]), ("DECODE(n, null, 'none', 3, 'three', 'other')", ["none", "three", "other"]), ("WHEN(n > 4, 1, d > 0, 2, 3)", [3.0, 2.0, 1.0]),
        ("REGEX('b', t)", [False, True, None]), ("REGEX('A', t, 'x')", ["xxx", " b\t", None]), ("not (n > 4)", [None, True, False]), ("'a' > 5", [True] * 3), ("TRIM(t)", ["AAA", "b", None]), ("-d + 1", [None, -1.5, 3.5]),
    ],
)
def test_evaluator(rows, text, expected):
    kinds = evaluator.evaluate(text, names_of(rows))
    assert values(rows, kinds) == expected


def test_division_by_zero(rows):
    with pytest.raises(PySparkException):
        rows.select(evaluator.evaluate("n / 0", names_of(rows))).collect()


def test_assignment_sees_old_values(rows):
    out = evaluator.assign(rows, "n = id; id = n").orderBy("d").select("id", "n").collect()
    assert {tuple(r) for r in out} == {(None, 1), (3, 2), (6, 3)}


def test_register(rows):
    from plumbline.functions.expressions import Value

    evaluator.register("TWICE", lambda x: Value(x.column * 2, "number"))
    assert values(rows, evaluator.evaluate("TWICE(n)", names_of(rows))) == [None, 6, 12]


def test_helpers(rows):
    assert named_values("a=1,2; b = x") == {"a": ["1", "2"], "b": ["x"]}
    assert replace_table_names("A.x = 'A.y' AND b.z > 1", {"a": "s.A1"}) == "s.A1.x = 'A.y' AND b.z > 1"
    name, column = projection("n * 2 AS twice", names_of(rows))
    assert name == "twice" and values(rows, column) == [None, 6, 12]
    assert values(rows, F.coalesce(projection("n", names_of(rows))[1], F.lit(0))) == [0, 3, 6]


def test_random_values_stay_in_bounds(rows):
    names = names_of(rows)
    out = rows.select(*[evaluator.evaluate(t, names).alias(k) for k, t in {"a": "RAND()", "b": "RAND(5)", "c": "RAND(3, 4)", "d": "RANDPICK('x', 'y')"}.items()]).collect()
    assert all(0 <= r.a < 1 and r.b in range(5) and r.c == 3 and r.d in "xy" for r in out)
