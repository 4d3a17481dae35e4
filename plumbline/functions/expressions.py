"""Row expressions in the dialect of in-memory data tables, compiled to Catalyst columns.

``AND OR NOT``, comparisons, ``IN``, ``LIKE`` (wildcards ``*`` and ``%`` at the ends), ``IS [NOT] NULL``, arithmetic, and the
functions CONVERT, LEN, ISNULL, IIF, TRIM, SUBSTRING; names may be bracketed or qualified, dates are ``#2020-01-31#``. Strings
compare without regard to case unless the caller or a trailing ``##CASESENSITIVE`` says otherwise (``##IGNORECASE`` the
reverse). A condition that is unknown counts as not met: use :func:`holds`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""\s*(?:(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)
    |(?P<string>'(?:[^']|'')*')
    |(?P<date>\#[^\#]+\#)
    |(?P<name>\[[^\]]+\]|[^\W\d][\w$]*|\$\w+)
    |(?P<op><>|<=|>=|!=|==|[=<>+\-*/%(),.])
    )""",
    re.X,
)
_HINT = re.compile(r"\s*##(CASESENSITIVE|IGNORECASE)\s*$", re.I)
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max, "COUNT": F.count, "STDEV": F.stddev, "VAR": F.variance,
}
_CONVERT = {"STRING": "string", "INT16": "smallint", "INT32": "int", "INT64": "bigint", "DOUBLE": "double", "SINGLE": "float", "BOOLEAN": "boolean", "DATETIME": "timestamp", "DECIMAL": "decimal(38,10)"}


class ExpressionError(ValueError):
    """An expression that does not parse or names an unknown field."""


@dataclass(frozen=True)
class Value:
    """A compiled sub-expression and its kind: text, number, boolean, date or null."""

    column: Column
    kind: str


def kind_of(dtype: str) -> str:
    if dtype.startswith(("string", "char", "varchar")):
        return "text"
    if dtype.startswith(("timestamp", "date")):
        return "date"
    return "boolean" if dtype == "boolean" else "number"


Names = Mapping[str, Value]


def names_of(df: DataFrame, alias: str = "") -> dict[str, Value]:
    """The fields of df by lower-case name, and by alias.name if there is an alias."""
    out = {}
    for name, dtype in df.dtypes:
        column = F.col(f"`{alias}`.`{name}`" if alias else f"`{name}`")
        value = Value(column, kind_of(dtype))
        out[f"{alias}.{name}".lower() if alias else name.lower()] = value
        if alias:
            out.setdefault(name.lower(), value)
    return out


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"cannot read {text[at:]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class Parser:
    def __init__(self, text: str, names: Names, sensitive: bool):
        self.tokens, self.at, self.names, self.sensitive, self.text = tokens(text), 0, names, sensitive, text

    def peek(self) -> str:
        return self.tokens[self.at][1].upper() if self.at < len(self.tokens) else ""

    def take(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.peek() in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1].upper()
        return None

    def expect(self, wanted: str) -> None:
        if not self.take(wanted):
            raise ExpressionError(f"expected {wanted} in {self.text!r}")

    def parse(self) -> Value:
        out = self.either()
        if self.at < len(self.tokens):
            raise ExpressionError(f"unexpected {self.tokens[self.at][1]!r} in {self.text!r}")
        return out

    def either(self) -> Value:
        left = self.both()
        while self.take("OR"):
            left = Value(left.column | self.both().column, "boolean")
        return left

    def both(self) -> Value:
        left = self.negated()
        while self.take("AND"):
            left = Value(left.column & self.negated().column, "boolean")
        return left

    def negated(self) -> Value:
        return Value(~self.negated().column, "boolean") if self.take("NOT") else self.comparison()

    def _folded(self, *values: Value) -> list[Column]:
        fold = not self.sensitive and any(v.kind == "text" for v in values)
        return [F.lower(v.column) if fold and v.kind == "text" else v.column for v in values]

    def comparison(self) -> Value:
        left = self.sum()
        if op := self.take("=", "==", "<>", "!=", "<", "<=", ">", ">="):
            right = self.sum()
            if {left.kind, right.kind} == {"text", "number"}:  # the text side is read as a number
                left, right = (Value(v.column.try_cast("double"), "number") if v.kind == "text" else v for v in (left, right))
            if {left.kind, right.kind} == {"text", "date"}:
                left, right = (Value(v.column.try_cast("timestamp"), "date") if v.kind == "text" else v for v in (left, right))
            a, b = self._folded(left, right)
            made = {"=": a == b, "==": a == b, "<>": a != b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}
            return Value(made[op], "boolean")
        if self.take("IS"):
            no = self.take("NOT")
            self.expect("NULL")
            return Value(left.column.isNotNull() if no else left.column.isNull(), "boolean")
        no = self.take("NOT")
        if self.take("IN"):
            self.expect("(")
            found: Column | None = None
            while not self.take(")"):
                a, b = self._folded(left, self.sum())
                found = a == b if found is None else found | (a == b)
                self.take(",")
            out = F.lit(False) if found is None else found
        elif self.take("LIKE"):
            out = self.like(left)
        elif self.take("BETWEEN"):
            low = self.sum()
            self.expect("AND")
            a, b, c = self._folded(left, low, self.sum())
            out = a.between(b, c)
        elif no:
            raise ExpressionError(f"NOT without IN, LIKE or BETWEEN in {self.text!r}")
        else:
            return left
        return Value(~out if no else out, "boolean")

    def like(self, left: Value) -> Column:
        kind, pattern = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind != "string":
            raise ExpressionError("LIKE needs a string literal")
        self.at += 1
        pattern = pattern[1:-1].replace("''", "'")
        head, tail = pattern[:1] in ("*", "%"), len(pattern) > 1 and pattern[-1:] in ("*", "%")
        core = pattern[head : len(pattern) - tail]
        if "*" in core or "%" in core:
            raise ExpressionError("wildcards stand at the ends of a pattern only")
        text, core = (left.column, core) if self.sensitive else (F.lower(left.column), core.lower())
        if head and tail:
            return text.contains(core)
        return text.endswith(core) if head else text.startswith(core) if tail else text == core

    def sum(self) -> Value:
        left = self.product()
        while op := self.take("+", "-"):
            right = self.product()
            if op == "+" and "text" in (left.kind, right.kind):
                left = Value(F.concat(left.column.cast("string"), right.column.cast("string")), "text")
            else:
                left = Value(left.column + right.column if op == "+" else left.column - right.column, left.kind)
        return left

    def product(self) -> Value:
        left = self.unary()
        while op := self.take("*", "/", "%"):
            right = self.unary()
            made = {"*": lambda a, b: a * b, "/": F.try_divide, "%": F.try_mod}[op](left.column, right.column)
            left = Value(made, "number")
        return left

    def unary(self) -> Value:
        if self.take("-"):
            return Value(-self.unary().column, "number")
        self.take("+")
        return self.primary()

    def primary(self) -> Value:
        if self.at >= len(self.tokens):
            raise ExpressionError(f"unexpected end of {self.text!r}")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return Value(F.lit(float(text) if re.search(r"[.eE]", text) else int(text)), "number")
        if kind == "string":
            return Value(F.lit(text[1:-1].replace("''", "'")), "text")
        if kind == "date":
            return Value(F.lit(text[1:-1]).cast("timestamp"), "date")
        if text == "(":
            out = self.either()
            self.expect(")")
            return out
        if kind != "name":
            raise ExpressionError(f"unexpected {text!r} in {self.text!r}")
        if self.peek() == "(" and not text.startswith("["):
            return self.call(text.upper())
        if (word := text.upper()) in ("TRUE", "FALSE") and text.lower() not in self.names:
            return Value(F.lit(word == "TRUE"), "boolean")
        if word == "NULL":
            return Value(F.lit(None), "null")
        name = text.strip("[]")
        while self.take("."):
            name += "." + self.tokens[self.at][1].strip("[]")
            self.at += 1
        found = self.names.get(name.lower()) or self.names.get(name.lower().rpartition(".")[2])
        if found is None:
            raise ExpressionError(f"unknown field {name!r} in {self.text!r}")
        return found

    def call(self, name: str) -> Value:
        self.expect("(")
        args: list[Value] = []
        if name == "COUNT" and self.take("*"):
            args = [Value(F.lit(1), "number")]
        while not self.take(")"):
            args.append(self.either())
            self.take(",")
        columns = [a.column for a in args]
        if name in AGGREGATES and len(args) == 1:
            return Value(AGGREGATES[name](columns[0]), args[0].kind if name in ("MIN", "MAX") else "number")
        match name, len(args):
            case "LEN", 1:
                return Value(F.length(columns[0]), "number")
            case "TRIM", 1:
                return Value(trimmed(columns[0]), "text")
            case "ISNULL", 2:
                return Value(F.coalesce(*columns), args[0].kind if args[0].kind != "null" else args[1].kind)
            case "IIF", 3:
                return Value(F.when(columns[0], columns[1]).otherwise(columns[2]), args[1].kind if args[1].kind != "null" else args[2].kind)
            case "SUBSTRING", 3:
                return Value(F.substring(columns[0], columns[1].cast("int"), columns[2].cast("int")), "text")
            case "CONVERT", 2:
                wanted = self.tokens[self.at - 2][1].strip("'").rpartition(".")[2].upper()
                if wanted not in _CONVERT:
                    raise ExpressionError(f"unknown type {wanted!r}")
                return Value(columns[0].try_cast(_CONVERT[wanted]), kind_of(_CONVERT[wanted]))
        raise ExpressionError(f"unknown function {name} with {len(args)} arguments")


def trimmed(text: Column) -> Column:
    """Without leading and trailing white space of any kind (Spark's trim takes spaces only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def compile_value(text: str, names: Names, sensitive: bool = False) -> Value:
    if hint := _HINT.search(text):
        text, sensitive = text[: hint.start()], hint[1].upper() == "CASESENSITIVE"
    return Parser(text, names, sensitive).parse()


def compile_expression(text: str, names: Names, sensitive: bool = False) -> Column:
    return compile_value(text, names, sensitive).column


def holds(text: str | None, names: Names, sensitive: bool = False, default: bool = True) -> Column:
    """The condition as a column that is never null: unknown is false; no condition is default."""
    if text is None or not text.strip():
        return F.lit(default)
    return F.coalesce(compile_expression(text, names, sensitive).cast("boolean"), F.lit(False))


def projection(text: str, names: Names) -> tuple[str, Column]:
    """(name, column) of ``expr AS name`` or of a bare field."""
    m = re.fullmatch(r"\s*(.+?)\s+AS\s+(\[[^\]]+\]|\w+)\s*", text, re.I | re.S)
    expression, name = (m[1], m[2].strip("[]")) if m else (text.strip(), text.strip().rpartition(".")[2].strip("[]"))
    return name, compile_expression(expression, names)


def pair_condition(text: str | None, left: DataFrame, right: DataFrame, aliases: tuple[str, str] = ("G1", "G2"), undirected: bool = False, default: bool = False, sensitive: bool = False) -> Column:
    """A condition on aliased rows; undirected: it holds for (a, b) or (b, a). No condition is default."""
    if not text or not text.strip():
        return F.lit(default)

    def names(one: str, two: str) -> dict[str, Value]:
        return names_of_alias(left, aliases[0], one) | names_of_alias(right, aliases[1], two)

    straight = holds(text, names(*aliases), sensitive)
    return straight | holds(text, names_of_alias(right, aliases[1], aliases[0]) | names_of_alias(left, aliases[0], aliases[1]), sensitive) if undirected else straight


def names_of_alias(df: DataFrame, alias: str, called: str) -> dict[str, Value]:
    """The fields of the DataFrame aliased as alias, under the name that an expression calls it by."""
    return {f"{called}.{n}".lower(): Value(F.col(f"`{alias}`.`{n}`"), kind_of(t)) for n, t in df.dtypes}


def replace_table_names(text: str, names: Mapping[str, str]) -> str:
    """table.field tokens with each table's name replaced, string literals untouched."""
    lower = {k.lower(): v for k, v in names.items()}
    return re.sub(r"('(?:[^']|'')*')|\b([\w.]+)\.(?=\w+\b)", lambda m: m[0] if m[1] else f"{lower.get(m[2].lower(), m[2])}.", text)


def named_values(text: str) -> dict[str, list[str]]:
    """``a=1,2;b=x`` as {a: [1, 2], b: [x]}."""
    out = {}
    for part in filter(None, (p.strip() for p in re.split(r"[;\n]", text))):
        name, found, values = part.partition("=")
        if not found or not name.strip():
            raise ExpressionError(f"expected name=values, not {part!r}")
        out[name.strip()] = [v.strip() for v in values.split(",")]
    return out


def named_values_condition(text: str, names: Names) -> Column:
    out = F.lit(True)
    for name, values in named_values(text).items():
        out = out & F.coalesce(names[name.lower()].column.cast("string").isin(values), F.lit(False))
    return out


def any_of_filters(flags: Mapping[str, Column], expression: str | None = None) -> Column:
    """A boolean expression over named filters; without one, any filter that is met will do."""
    if expression and expression.strip():
        return holds(expression, {k.lower(): Value(v, "boolean") for k, v in flags.items()})
    out = F.lit(False)
    for flag in flags.values():
        out = out | F.coalesce(flag, F.lit(False))
    return out
