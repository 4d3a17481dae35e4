"""Attribute checks: row predicates, keys and groups. Every function takes tables and gives issues."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expressions import ExpressionError, Value, compile_expression, holds, kind_of, names_of, trimmed
from plumbline.issues import Table, issues, union

TEXT = "string"
MAX_RULES = 10_000


def qa_constraint(table: Table, constraints: str | Sequence) -> DataFrame:
    """Rows for which a constraint is not true; unknown is not true.

    A constraint is a text or (text, children): children are tested where the parent holds, and only leaves are reported.
    """
    names = names_of(table.df)
    found: list[Column] = []

    def walk(node: str | tuple, reached: Column) -> None:
        text, children = (node, ()) if isinstance(node, str) else (node[0], node[1] if len(node) > 1 else ())
        met = holds(text, names, table.sensitive)
        if children:
            for child in children:
                walk(child, reached & met)
        else:
            found.append(F.when(reached & ~met, F.lit(text)))

    for node in [constraints] if isinstance(constraints, str) else constraints:
        walk(node, F.lit(True))
    # all constraints in one pass over the rows
    failed = table.rows.select(F.col(table.oid).alias("_oid"), F.explode(F.array_compact(F.array(*found))).alias("_failed"))
    return issues(failed, "Constraints.ConstraintNotFulfilled", [(table.name, "_oid")], description=F.col("_failed"))


def constraint_tree(lines: Sequence[str]) -> list[tuple[str, list]]:
    """Nested constraints from lines whose leading + signs give the depth."""
    roots: list[tuple[str, list]] = []
    path: list[tuple[str, list]] = []
    for line in lines:
        depth = len(line) - len(line.lstrip("+"))
        if depth > len(path):
            raise ExpressionError(f"{line!r} is more than one level below its parent")
        node: tuple[str, list] = (line[depth:].strip(), [])
        del path[depth:]
        (path[-1][1] if path else roots).append(node)
        path.append(node)
    return roots


def constraints_list(table: Table, rules: DataFrame, expression_field: str, expression_is_error: bool = False, description_field: str | None = None) -> DataFrame:
    """Constraints read from a table of rules; blank ones are skipped, more than MAX_RULES are refused.

    With expression_is_error each tells what is wrong; the database function LENGTH is read as LEN.
    """
    texts = [r[0].strip() for r in rules.select(expression_field).where(F.col(expression_field).isNotNull()).limit(MAX_RULES + 1).collect()]
    if len(texts) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    texts = [re.sub(r"\bLENGTH\s*\(", "LEN(", t, flags=re.I) for t in texts if t]
    return qa_constraint(table, [f"NOT ({t})" if expression_is_error else t for t in texts])


def qa_unique(tables: Table | Sequence[Table], fields: Sequence[str]) -> DataFrame:
    """Every row of every set of rows with equal key; null equals null, text compares exactly."""
    tables = [tables] if isinstance(tables, Table) else tables
    rows = union([t.rows.select(F.lit(t.name).alias("_tab"), F.col(t.oid).cast("bigint").alias("_oid"), *[F.col(f).alias(f"_k{i}") for i, f in enumerate(fields)]) for t in tables])
    keys = [f"_k{i}" for i in range(len(fields))]
    # counts by key first, with map-side combine: a hot key is one small group, and only repeated keys are joined back
    often = rows.groupBy(*keys).count().where("count > 1").select(*[F.col(k).alias(f"o{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"o{k}")) for k in keys])
    found = rows.join(often, same)
    return issues(found, "Unique.NotUnique", F.array(F.struct(F.col("_tab").alias("tab"), F.col("_oid").alias("oid"))), component=",".join(fields), values=[F.col(k) for k in keys])


def qa_foreign_key(table: Table, keys: Sequence[str], referenced: Table, referenced_keys: Sequence[str], reference_is_error: bool = False) -> DataFrame:
    """Rows without a referenced row. One key: null is fine, and a value that cannot take the referenced type is an issue of its
    own. Several: only all-null keys are fine, and null equals null. reference_is_error turns the test round.
    """
    types = dict(referenced.df.dtypes)
    rows = table.rows.select(F.col(table.oid).alias("_oid"), *[F.col(k).alias(f"_raw{i}") for i, k in enumerate(keys)], *[F.col(k).try_cast(types[r]).alias(f"_k{i}") for i, (k, r) in enumerate(zip(keys, referenced_keys, strict=True))])
    raw, made = [F.col(f"_raw{i}") for i in range(len(keys))], [F.col(f"_k{i}") for i in range(len(keys))]
    given = reduce(lambda a, b: a | b, [c.isNotNull() for c in raw])
    bad = reduce(lambda a, b: a | b, [r.isNotNull() & m.isNull() for r, m in zip(raw, made, strict=True)])
    known = referenced.rows.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(referenced_keys)]).distinct()
    if len(keys) == 1:
        known = known.where("_r0 is not null")
        same = F.col("_k0") == F.col("_r0")
    else:
        same = reduce(lambda a, b: a & b, [m.eqNullSafe(F.col(f"_r{i}")) for i, m in enumerate(made)])
    found = rows.where(given & ~bad).join(known, same, "left_semi" if reference_is_error else "left_anti")
    code = "ForeignKeys.UnexpectedReferencedRow" if reference_is_error else "ForeignKeys.NoReferencedRow"
    component = ",".join(keys)
    return issues(found, code, [(table.name, "_oid")], component, values=raw).unionByName(issues(rows.where(bad), "ForeignKeys.UnableToConvertFieldValue", [(table.name, "_oid")], component, values=raw))


def qa_unreferenced_rows(referenced: Table, referencing: Sequence[Table], relations: Sequence[str]) -> DataFrame:
    """Rows whose key stands in none of the referencing tables; relations are ``key,foreign key``."""
    pairs = [re.split(r"[,;\s]+", r.strip()) for r in relations]
    keys = {p[0].lower() for p in pairs}
    if len(keys) != 1:
        raise ValueError("all relations must name the same referenced key")
    kind = dict(referenced.df.dtypes)[pairs[0][0]]
    used = union([t.rows.select(F.col(fk).try_cast(kind).alias("_used")).where("_used is not null") for t, (_, fk) in zip(referencing, pairs, strict=True)]).distinct()
    found = referenced.rows.join(used, F.col(pairs[0][0]) == F.col("_used"), "left_anti")
    return issues(found, "UnreferencedRows.ValueNotReferenced", [(referenced.name, referenced.oid)], pairs[0][0], values=[F.col(pairs[0][0])])


def qa_group_constraints(tables: Table | Sequence[Table], group_by: str | Sequence[str], distinct: str | Sequence[str], maximum: int = -1, minimum: int = 0, exists: Sequence[str] = ()) -> DataFrame:
    """Groups whose number of distinct values is out of bounds; null and empty text are one value and one group.

    exists: conditions of which each must hold for at least one row of a group, else the group is not tested.
    """
    tables = [tables] if isinstance(tables, Table) else tables
    group_by = [group_by] * len(tables) if isinstance(group_by, str) else group_by
    distinct = [distinct] * len(tables) if isinstance(distinct, str) else distinct
    parts = []
    for t, g, d in zip(tables, group_by, distinct, strict=True):
        names = names_of(t.df)
        flags = [holds(e, names, t.sensitive).alias(f"_e{i}") for i, e in enumerate(exists)]
        parts.append(t.rows.select(F.coalesce(compile_expression(g, names).cast(TEXT), F.lit("")).alias("_group"), F.coalesce(compile_expression(d, names).cast(TEXT), F.lit("")).alias("_value"), *flags))
    groups = union(parts).groupBy("_group").agg(F.count_distinct("_value").alias("_n"), *[F.max(f"_e{i}").alias(f"_e{i}") for i in range(len(exists))])
    for i in range(len(exists)):
        groups = groups.where(f"_e{i}")
    few = issues(groups.where(F.col("_n") < minimum), "GroupConstraints.TooFewDistinctValues", F.array().cast("array<struct<tab:string,oid:bigint>>"), values=[F.col("_group"), F.col("_n")])
    many = issues(groups.where(F.col("_n") > maximum), "GroupConstraints.TooManyDistinctValues", F.array().cast("array<struct<tab:string,oid:bigint>>"), values=[F.col("_group"), F.col("_n")])
    return few if maximum < 0 else few.unionByName(many)


def text_fields(table: Table, fields: Sequence[str] | None, ignored: bool = False) -> list[str]:
    """The listed fields, or with ignored all text fields but them."""
    own = [n for n, t in table.df.dtypes if t == TEXT and n not in (table.oid, table.geom)]
    if not fields:
        return own
    lower = {f.lower() for f in fields}
    return [n for n in own if n.lower() not in lower] if ignored else [n for n in table.df.columns if n.lower() in lower]


def _per_field(table: Table, fields: Sequence[str], code: Sequence[tuple[str, Column]] | None = None, make=None) -> DataFrame:
    """One issue per field for which make(column) gives a code, in one pass over the rows."""
    found = F.array_compact(F.array(*[F.when(make(F.col(f)).isNotNull(), F.struct(F.lit(f).alias("field"), make(F.col(f)).alias("code"), F.col(f).cast(TEXT).alias("value"))) for f in fields]))
    rows = table.rows.select(F.col(table.oid).alias("_oid"), F.explode(found).alias("_f"))
    return issues(rows, F.col("_f.code"), [(table.name, "_oid")], F.col("_f.field"), values=[F.col("_f.value")])


def qa_regular_expression(table: Table, pattern: str, fields: Sequence[str] | None = None, match_is_error: bool = False, ignored: bool = False) -> DataFrame:
    """Fields that do not match a pattern anywhere (or do, with match_is_error); null is fine."""
    code = "RegularExpression.FieldValueMatchesRegularExpression" if match_is_error else "RegularExpression.FieldValueDoesNotMatchRegularExpression"
    return _per_field(table, text_fields(table, fields, ignored), make=lambda c: F.when(c.isNotNull() & (c.cast(TEXT).rlike(pattern) == F.lit(match_is_error)), F.lit(code)))


def qa_required_fields(table: Table, fields: Sequence[str] | None = None, allow_empty: bool = False, allow_missing: bool = False) -> DataFrame:
    """Null fields, and empty ones unless allowed."""
    fields = fields or [f.name for f in table.df.schema if f.nullable and f.name not in (table.oid, table.geom)]
    here = {c.lower(): c for c in table.df.columns}
    if not allow_missing and (gone := [f for f in fields if f.lower() not in here]):
        raise ValueError(f"missing fields: {gone}")
    empty = (lambda c: F.lit(False)) if allow_empty else (lambda c: c.cast(TEXT) == "")
    return _per_field(table, [here[f.lower()] for f in fields if f.lower() in here], make=lambda c: F.when(c.isNull(), F.lit("RequiredFields.NullValue")).when(empty(c), F.lit("RequiredFields.EmptyString")))


def qa_trimmed_text_fields(table: Table, fields: Sequence[str] | None = None, allowed_blanks: int = 0, ignored: bool = False) -> DataFrame:
    """Text with leading or trailing white space of any kind; text of white space only may have allowed_blanks (-1: any)."""

    def code(c: Column) -> Column:
        core = trimmed(c)
        lead, trail = c.rlike(r"(?U)^\s"), c.rlike(r"(?U)\s\z")
        blank = F.lit(False) if allowed_blanks < 0 else F.length(c) > allowed_blanks
        both, first, last = (F.lit(f"TrimmedText.{x}") for x in ("LeadingAndTrailingWhiteSpace", "LeadingWhiteSpace", "TrailingWhiteSpace"))
        return F.when(F.length(core) == 0, F.when((F.length(c) > 0) & blank, F.lit("TrimmedText.WhiteSpaceOnly"))).when(lead & trail, both).when(lead, first).when(trail, last)

    return _per_field(table, text_fields(table, fields, ignored), make=code)


def qa_empty_not_null_text_fields(table: Table, fields: Sequence[str] | None = None) -> DataFrame:
    """Null or empty text in fields that must have text (by default the text fields declared not null)."""
    fields = fields or [f.name for f in table.df.schema if not f.nullable and f.dataType.simpleString() == TEXT]
    if not fields:
        return issues(table.rows.limit(0), "EmptyNotNullTextFields.EmptyText", [(table.name, table.oid)])
    return _per_field(table, fields, make=lambda c: F.when(c.isNull(), F.lit("EmptyNotNullTextFields.ValueIsNull")).when(c == "", F.lit("EmptyNotNullTextFields.EmptyText")))


GUID = r"^\{?[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\}?$"


def qa_value(table: Table, fields: Mapping[str, str]) -> DataFrame:
    """Text fields that cannot take their declared type (int, double, timestamp ..., or guid, which must be upper case)."""
    made = []
    for f, kind in fields.items():
        c = F.col(f)
        bad = F.when(~c.rlike(GUID), F.lit("Value.InvalidGuid")).when(c != F.upper(c), F.lit("Value.GuidNotUpperCase")) if kind == "guid" else F.when(c.isNotNull() & c.try_cast(kind).isNull(), F.lit("Value.InvalidFieldValue"))
        made.append(F.when(bad.isNotNull(), F.struct(F.lit(f).alias("field"), bad.alias("code"), c.cast(TEXT).alias("value"))))
    rows = table.rows.select(F.col(table.oid).alias("_oid"), F.explode(F.array_compact(F.array(*made))).alias("_f"))
    return issues(rows, F.col("_f.code"), [(table.name, "_oid")], F.col("_f.field"), values=[F.col("_f.value")])


def qa_date_fields_without_time(table: Table, fields: Sequence[str] | None = None) -> DataFrame:
    fields = fields or [n for n, t in table.df.dtypes if t.startswith("timestamp")]
    return _per_field(table, fields, make=lambda c: F.when(c != F.date_trunc("day", c), F.lit("DateFieldsWithoutTime.HasTimePart")))


def qa_valid_date_values(table: Table, minimum: str | None, maximum: str | None, fields: Sequence[str] | None = None, now: str | None = None) -> DataFrame:
    """Dates out of bounds. A bound is a date, or an offset to now as an interval (``-3 days``); now is pinned for the run."""
    at = F.lit(now).cast("timestamp") if now else F.current_timestamp()

    def bound(text: str | None) -> Column | None:
        if text is None:
            return None
        if text.strip() == "":
            return at
        return F.lit(text).cast("timestamp") if re.match(r"\s*\d{4}-", text) else at + F.expr(f"interval '{text}'")

    low, high = bound(minimum), bound(maximum)

    def code(c: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        if low is not None:
            out = out.when(c < low, F.lit("ValidDateValues.DateBeforeMinimum"))
        return out.when(c > high, F.lit("ValidDateValues.DateAfterMaximum")) if high is not None else out

    return _per_field(table, fields or [n for n, t in table.df.dtypes if t.startswith(("timestamp", "date"))], make=code)


def qa_attribute_dependency(table: Table, source: Sequence[str], target: Sequence[str], mappings: Sequence[tuple[Sequence, Sequence]], wildcard: str = "*") -> DataFrame:
    """Rows whose source values no mapping has, or whose target values none of the mappings of their source values has."""
    tuple_met = lambda fields, values: reduce(lambda a, b: a & b, [F.lit(True) if v == wildcard else F.col(f).eqNullSafe(F.lit(v)) for f, v in zip(fields, values, strict=True)])
    known = reduce(lambda a, b: a | b, [tuple_met(source, s) for s, _ in mappings], F.lit(False))
    met = reduce(lambda a, b: a | b, [tuple_met(source, s) & tuple_met(target, t) for s, t in mappings], F.lit(False))
    code = F.when(~known, F.lit("AttributeDependency.SourceNotConfigured")).when(~met, F.lit("AttributeDependency.TargetNotAllowed"))
    return issues(table.rows.withColumn("_code", code).where("_code is not null"), F.col("_code"), [(table.name, table.oid)], ",".join([*source, *target]))


def offset(text: str | None, count: Column) -> Column:
    """A reference count with an offset such as +10%, -5 or 5."""
    text = (text or "").strip()
    if not text:
        return count
    number = float(text.rstrip("%"))
    return count * (1 + number / 100) if text.endswith("%") else count + number


def qa_row_count(table: Table, minimum: int = 0, maximum: int = -1, references: Sequence[Table] = (), minimum_offset: str | None = None, maximum_offset: str | None = None) -> DataFrame:
    """One issue if the number of rows is out of bounds, which are numbers or follow the rows of reference tables."""
    rows = table.rows.agg(F.count("*").alias("n")).withColumn("_k", F.lit(1))
    if references:
        total = union([t.rows.agg(F.count("*").alias("c")) for t in references]).agg(F.sum("c").alias("c")).withColumn("_k", F.lit(1))
        rows = rows.join(total, "_k")  # one row each
        low, high = F.ceil(offset(minimum_offset, F.col("c"))), F.floor(offset(maximum_offset, F.col("c")))
    else:
        low, high = F.lit(minimum), F.lit(maximum) if maximum >= 0 else F.lit(None).cast("bigint")
    code = F.when(F.col("n") < low, F.lit("RowCount.TooFewRows")).when(F.col("n") > high, F.lit("RowCount.TooManyRows"))
    return issues(rows.withColumn("_code", code).where("_code is not null"), F.col("_code"), F.array().cast("array<struct<tab:string,oid:bigint>>"), values=[F.col("n")])


def qa_valid_urls(table: Table, expression: str) -> DataFrame:
    """Expressions that are not well-formed URLs; null and blank are fine. Nothing is fetched."""
    c = trimmed(compile_expression(expression, names_of(table.df)))
    bad = c.isNotNull() & (c != "") & ~c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^\s/?#]+[^\s]*$")
    return issues(table.rows.where(bad), "ValidUrls.InvalidUrlFormat", [(table.name, table.oid)], expression, values=[c])


def qa_valid_coordinate_fields(table: Table, x: Column, y: Column, x_field: str, y_field: str, tolerance: float) -> DataFrame:
    """Coordinate attributes (numbers or text) farther than tolerance from the point, undefined or not numbers."""
    a, b = F.col(x_field).try_cast("double"), F.col(y_field).try_cast("double")
    code = (
        F.when(F.col(x_field).isNull() & F.col(y_field).isNull() & x.isNotNull(), F.lit("ValidCoordinateFields.MissingCoordinates"))
        .when((F.col(x_field).isNotNull() & a.isNull()) | (F.col(y_field).isNotNull() & b.isNull()), F.lit("ValidCoordinateFields.InvalidCoordinate"))
        .when(x.isNull() & (a.isNotNull() | b.isNotNull()), F.lit("ValidCoordinateFields.UndefinedShape"))
        .when(F.sqrt((a - x) ** 2 + (b - y) ** 2) > tolerance, F.lit("ValidCoordinateFields.XYFieldCoordinateTooFarFromShape"))
    )
    return issues(table.rows.withColumn("_code", code).where("_code is not null"), F.col("_code"), [(table.name, table.oid)], f"{x_field},{y_field}")


def qa_gdb_constraint(table: Table, rules: Sequence[tuple[str, str, str | None]]) -> DataFrame:
    """Stored rules (name, condition, subtype condition): the first that a row breaks is reported."""
    names = names_of(table.df)
    first = F.coalesce(*[F.when(holds(when, names) & ~holds(rule, names), F.lit(name)) for name, rule, when in rules])
    return issues(table.rows.withColumn("_rule", first).where("_rule is not null"), "GdbConstraint.InvalidRow", [(table.name, table.oid)], F.col("_rule"))


def _field_options(options: Sequence[str]) -> tuple[dict[str, list[tuple[str, str]]], dict[str, str]]:
    """By lower-case field name: what changes values before they are compared, in order, and which differences are allowed."""
    changes: dict[str, list[tuple[str, str]]] = {}
    allowed: dict[str, str] = {}
    for option in filter(str.strip, options):
        field, _, rest = (p.strip() for p in option.partition(":"))
        kind, found, value = rest.partition("=")
        if not field or not found:
            raise ExpressionError(f"expected field:option=value, not {option!r}")
        field = field.lower()
        if kind.lower() == "alloweddifferencecondition":
            if field in allowed:
                raise ExpressionError(f"more than one allowedDifferenceCondition for {field}")
            if value.strip():
                allowed[field] = value
        elif kind in ("ignore", "ignoreCondition"):
            changes.setdefault(field, []).append((kind, value))
        else:
            raise ExpressionError(f"unknown option {kind!r} for {field}")
    return changes, allowed


def equal_values_condition(spec: str, left: str = "a", right: str = "b", options: Sequence[str] = (), rows: tuple[DataFrame, DataFrame] | None = None, sensitive: bool = True) -> Column:
    """``field[:separator],field...``: all fields equal, null equal to null; with a separator, as sets of values. A comma in a
    separator is written ``\\,``.

    options, for one field each: ``field:ignore=regex`` leaves out what matches, ``field:ignoreCondition=condition`` makes a value null
    where a condition over its row and _VALUE holds, ``field:allowedDifferenceCondition=condition`` accepts two values for which a
    condition over G1, G2, G1._VALUE and G2._VALUE holds in either direction. Options need the rows of both sides, for the fields
    that conditions name.
    """
    changes, allowed = _field_options(options)
    names = {side: {n.lower(): Value(F.col(f"{side}.`{n}`"), kind_of(t)) for n, t in df.dtypes} for side, df in zip((left, right), rows or (), strict=False)}
    fold = (lambda c: c) if sensitive else (lambda c: F.lower(c))
    out, seen = F.lit(True), set()
    for part in filter(None, (p.strip() for p in re.split(r"(?<!\\)[,;]", spec))):
        field, _, separator = part.replace("\\", "").partition(":")
        field, key = field.strip(), field.strip().lower()
        if key in seen:
            raise ExpressionError(f"field {field} is named twice")
        seen.add(key)

        def changed(value: Column, side: str, key: str = key) -> Column:
            for kind, wanted in changes.get(key, ()):
                if kind == "ignore":
                    value = F.regexp_replace(value, wanted, "")
                elif wanted.strip():
                    own = names[side] | {"_value": Value(value, names[side][key].kind)}
                    value = F.when(~holds(wanted, own, sensitive), value)
            return value

        plain = [F.col(f"{side}.`{field}`") for side in (left, right)]
        text = bool(separator) or bool(names) and all(names[s][key].kind == "text" for s in (left, right))
        if separator:
            def values(c: Column, side: str, separator: str = separator, changed: Callable = changed) -> Column:
                return F.array_distinct(F.transform(F.split(c, re.escape(separator)), lambda x: fold(changed(F.trim(x), side))))

            sets = [values(c, side) for side, c in zip((left, right), plain, strict=True)]
            # as sets, with a null value as one of the values
            same = F.coalesce(F.array_sort(sets[0]).eqNullSafe(F.array_sort(sets[1])), F.lit(False))
        else:
            a, b = (changed(c, side) for side, c in zip((left, right), plain, strict=True))
            same = fold(a).eqNullSafe(fold(b)) if text else a.eqNullSafe(b)
            if key in allowed:
                for x, y in ((left, right), (right, left)):
                    value = {left: a, right: b}
                    both = {f"g{k}.{n}": v for k, side in ((1, x), (2, y)) for n, v in (names[side] | {"_value": Value(value[side], names[side][key].kind)}).items()}
                    same = same | holds(allowed[key], both, sensitive)
        out = out & (same | plain[0].isNull() & plain[1].isNull())
    if unknown := (set(changes) | set(allowed)) - seen:
        raise ExpressionError(f"options for fields that are not compared: {', '.join(sorted(unknown))}")
    return out


__all__ = [n for n in dir() if n.startswith("qa_")] + ["constraint_tree", "equal_values_condition", "offset", "text_fields"]
