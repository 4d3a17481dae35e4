"""The field-assignment language, compiled to Catalyst columns.

Precedence, tightest first: call, unary ``+ - not``, ``* / %``, ``+ -``, relations (chained ones are a conjunction) with ``is`` and
``in``, ``and``, ``or``, ``??``, ``? :``. Logic has three values, arithmetic is in doubles, null propagates, division by zero is an
error even for a null dividend, a null condition of ``? :`` gives null, and ROUND rounds half to even.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expressions import ExpressionError, Value, names_of, trimmed

_TOKEN = re.compile(r"""\s*(?:(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(?P<string>'(?:[^']|'')*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<op>\?\?|<>|!=|<=|>=|==|[=<>+\-*/%(),.?:;]))""")


def _number(v: Value) -> Column:
    return v.column.cast("double")


def _truth(v: Value) -> Column:
    """Values that are neither null nor boolean count as true."""
    return v.column if v.kind in ("boolean", "null") else F.when(v.column.isNotNull(), F.lit(True))


def _unknown(*columns: Column) -> Column:
    return reduce(lambda a, b: a | b, [c.isNull() for c in columns])


def _extreme(make: Callable[..., Column]) -> Callable[..., Value]:
    def run(*args: Value) -> Value:
        columns = [a.column for a in args]
        found = make(*columns) if len(columns) > 1 else columns[0]
        return Value(F.when(~_unknown(*columns), found), args[0].kind)

    return run


def _pad(left: bool) -> Callable[..., Value]:
    def run(text: Value, size: Value, fill: Value | None = None) -> Value:
        c, n = text.column.cast("string"), size.column.cast("int")
        char = F.substring(fill.column, 1, 1) if fill else F.lit(" ")
        space = F.repeat(char, n - F.length(c))
        return Value(F.when(F.length(c) >= n, c).otherwise(F.concat(space, c) if left else F.concat(c, space)), "text")

    return run


def _substr(text: Value, start: Value, size: Value | None = None) -> Value:
    """From position 0 on; a negative start takes from the length."""
    c, i = text.column.cast("string"), start.column.cast("int")
    n = size.column.cast("int") if size else F.length(c)
    n = F.greatest(n + F.least(i, F.lit(0)), F.lit(0))
    return Value(F.when(~_unknown(c, i, n), F.substring(c, F.greatest(i, F.lit(0)) + 1, n)), "text")


def _decode(value: Value, *rest: Value) -> Value:
    pairs, default = list(zip(rest[::2], rest[1::2], strict=False)), rest[-1].column if len(rest) % 2 else F.lit(None)
    out = F.when(F.lit(False), pairs[0][1].column)
    for case, result in pairs:
        out = out.when(value.column.eqNullSafe(case.column), result.column)
    return Value(out.otherwise(default), pairs[0][1].kind)


def _when(*args: Value) -> Value:
    out = F.when(_truth(args[0]), args[1].column)
    for case, result in zip(args[2:-1:2], args[3::2], strict=False):
        out = out.when(_truth(case), result.column)
    return Value(out.otherwise(args[-1].column) if len(args) % 2 else out, args[1].kind)


def _round(x: Value, digits: Value | None = None) -> Value:
    if digits is None:
        return Value(F.rint(_number(x)), "number")
    scale = F.pow(F.lit(10.0), F.coalesce(digits.column, F.lit(0)))
    return Value(F.rint(_number(x) * scale) / scale, "number")


def _trim(text: Value, chars: Value | None = None) -> Value:
    return Value(F.btrim(text.column, chars.column) if chars else trimmed(text.column), "text")


def _rand(*bounds: Value) -> Value:
    """From 0 to 1, a whole number below one bound, or from the first bound to below the second."""
    if not bounds:
        return Value(F.rand(), "number")
    low, high = (F.lit(0.0), _number(bounds[0])) if len(bounds) == 1 else (_number(bounds[0]), _number(bounds[1]))
    return Value(low + F.floor(F.rand() * (high - low)), "number")


#: name -> function of compiled arguments; register() adds to it.
FUNCTIONS: dict[str, Callable[..., Value]] = {
    "ABS": lambda x: Value(F.abs(_number(x)), "number"),
    "CEIL": lambda x: Value(F.ceil(_number(x)).cast("double"), "number"),
    "FLOOR": lambda x: Value(F.floor(_number(x)).cast("double"), "number"),
    "TRUNC": lambda x: Value(F.when(_number(x) < 0, F.ceil(_number(x))).otherwise(F.floor(_number(x))).cast("double"), "number"),
    "ROUND": _round,
    "MIN": _extreme(F.least),
    "MAX": _extreme(F.greatest),
    "TRIM": _trim,
    "UCASE": lambda x: Value(F.upper(x.column), "text"),
    "LCASE": lambda x: Value(F.lower(x.column), "text"),
    "LPAD": _pad(True),
    "RPAD": _pad(False),
    "SUBSTR": _substr,
    "CONCAT": lambda *args: Value(F.concat_ws("", *[a.column.cast("string") for a in args]), "text"),
    "LENGTH": lambda x: Value(F.length(x.column.cast("string")), "number"),
    "DECODE": _decode,
    "WHEN": _when,
    "REGEX": lambda p, t, r=None: Value(F.regexp_like(t.column, p.column) if r is None else F.regexp_replace(t.column, p.column, r.column), "boolean" if r is None else "text"),
    "RAND": _rand,
    "RANDPICK": lambda *a: Value(F.array(*[x.column for x in a])[F.floor(F.rand() * len(a)).cast("int")], a[0].kind),
}


def register(name: str, function: Callable[..., Value]) -> None:
    FUNCTIONS[name.upper()] = function


class Compiler:
    def __init__(self, text: str, names: dict[str, Value]):
        self.names, self.text, self.tokens, at = names, text, [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ExpressionError(f"cannot read {text[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def take(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens):
            kind, text = self.tokens[self.at]
            if kind != "string" and text.lower() in wanted:
                self.at += 1
                return text.lower()
        return None

    def expect(self, wanted: str) -> None:
        if not self.take(wanted):
            raise ExpressionError(f"expected {wanted} in {self.text!r}")

    def whole(self) -> Value:
        out = self.choice()
        if self.at < len(self.tokens):
            raise ExpressionError(f"unexpected {self.tokens[self.at][1]!r} in {self.text!r}")
        return out

    def choice(self) -> Value:
        test = self.either_value()
        if not self.take("?"):
            return test
        yes = self.choice()
        self.expect(":")
        no = self.choice()
        truth = _truth(test)
        return Value(F.when(truth, yes.column).when(~truth, no.column), yes.kind if yes.kind != "null" else no.kind)

    def either_value(self) -> Value:
        left = self.disjunction()
        while self.take("??"):
            right = self.unary()
            left = Value(F.coalesce(left.column, right.column), left.kind if left.kind != "null" else right.kind)
        return left

    def disjunction(self) -> Value:
        left = self.conjunction()
        while self.take("or"):
            left = Value(_truth(left) | _truth(self.conjunction()), "boolean")
        return left

    def conjunction(self) -> Value:
        left = self.relation()
        while self.take("and"):
            left = Value(_truth(left) & _truth(self.relation()), "boolean")
        return left

    def relation(self) -> Value:
        left = self.sum()
        out: Column | None = None
        while True:
            if op := self.take("=", "==", "<>", "!=", "<", "<=", ">", ">="):
                right = self.sum()
                part = self.compare(op, left, right)
                out, left = part if out is None else out & part, right
            elif self.take("is"):
                no = self.take("not")
                what = self.take("null", "boolean", "text", "number")
                if not what:
                    raise ExpressionError(f"expected a type after is in {self.text!r}")
                part = left.column.isNull() if what == "null" else F.lit(left.kind == what) & left.column.isNotNull()
                return Value(~part if no else part, "boolean")
            elif self.at + 1 < len(self.tokens) and self.tokens[self.at][1].lower() == "not" and self.tokens[self.at + 1][1].lower() == "in" or self.tokens[self.at : self.at + 1] == [("name", "in")]:
                no = self.take("not")
                self.expect("in")
                self.expect("(")
                part = F.lit(False)
                while not self.take(")"):
                    part = part | F.coalesce(self.compare("=", left, self.choice()), F.lit(False))
                    self.take(",")
                return Value(~part if no else part, "boolean")
            else:
                return left if out is None else Value(out, "boolean")

    def compare(self, op: str, a: Value, b: Value) -> Column:
        order = {"boolean": 0, "number": 1, "text": 2}
        if a.kind != b.kind and a.kind in order and b.kind in order:  # boolean < number < text
            met = {"=": 0, "==": 0, "<>": 1, "!=": 1, "<": order[a.kind] < order[b.kind], "<=": order[a.kind] < order[b.kind], ">": order[a.kind] > order[b.kind], ">=": order[a.kind] > order[b.kind]}
            return F.when(~_unknown(a.column, b.column), F.lit(bool(met[op])))
        x, y = (_number(a), _number(b)) if a.kind == b.kind == "number" else (a.column, b.column)
        return {"=": x == y, "==": x == y, "<>": x != y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    def sum(self) -> Value:
        left = self.product()
        while op := self.take("+", "-"):
            right = self.product()
            if op == "+" and "text" in (left.kind, right.kind):
                left = Value(F.concat(left.column.cast("string"), right.column.cast("string")), "text")
            else:
                left = Value(_number(left) + _number(right) if op == "+" else _number(left) - _number(right), "number")
        return left

    def product(self) -> Value:
        left = self.unary()
        while op := self.take("*", "/", "%"):
            right = self.unary()
            x, y = _number(left), _number(right)
            made = x * y if op == "*" else F.when(y == 0, F.raise_error(F.lit("division by zero")).cast("double")).otherwise(x / y if op == "/" else x % y)
            left = Value(made, "number")
        return left

    def unary(self) -> Value:
        if self.take("-"):
            return Value(-_number(self.unary()), "number")
        if self.take("+"):
            return Value(_number(self.unary()), "number")
        if self.take("not"):
            return Value(~_truth(self.unary()), "boolean")
        return self.primary()

    def primary(self) -> Value:
        if self.at >= len(self.tokens):
            raise ExpressionError(f"unexpected end of {self.text!r}")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return Value(F.lit(float(text)), "number")
        if kind == "string":
            inner = text[1:-1].replace("''", "'") if text[0] == "'" else re.sub(r"\\(.)", r"\1", text[1:-1])
            return Value(F.lit(inner), "text")
        if text == "(":
            out = self.choice()
            self.expect(")")
            return out
        if text.lower() in ("true", "false", "null"):
            return Value(F.lit({"true": True, "false": False, "null": None}[text.lower()]), "null" if text.lower() == "null" else "boolean")
        if kind == "name":
            if self.take("("):
                args = []
                while not self.take(")"):
                    args.append(self.choice())
                    self.take(",")
                if text.upper() not in FUNCTIONS:
                    raise ExpressionError(f"unknown function {text!r}")
                return FUNCTIONS[text.upper()](*args)
            while self.take("."):
                text += "." + self.tokens[self.at][1]
                self.at += 1
            found = self.names.get(text.lower())
            if found is not None:
                return found
        raise ExpressionError(f"unknown field {text!r} in {self.text!r}")


def evaluate(text: str, names: dict[str, Value]) -> Column:
    return Compiler(text, names).whole().column


def assign(df: DataFrame, text: str) -> DataFrame:
    """``field = expression; field = expression``: all right sides see the old row, then all fields are set."""
    names, made = names_of(df), {}
    for part in filter(None, (p.strip() for p in re.split(r";(?=(?:[^']*'[^']*')*[^']*$)", text))):
        name, _, expression = part.partition("=")
        made[name.strip()] = evaluate(expression, names)
    return df.withColumns(made)
