"""Quality specifications: conditions that bind checks to tables, and a run of them as one plan.

A specification is JSON::

    {"name": "...", "conditions": [{"name": "...", "check": "qa_constraint", "tables": {"table": "orders"}, "filters": {"orders": "o_totalprice > 0"},
      "parameters": {"constraints": "o_orderstatus = 'F'"}, "severity": "error", "stop": false, "issue_filter": "involved_oid > 5",
      "issue_filters": ["near", "old"], "filter_expression": "near AND NOT old"}],
     "transformers": [{"name": "joined", "function": "tr_table_join", "tables": {"left": "orders", "right": "customer"}, "parameters": {...}}],
     "issue_filters": [{"name": "near", "function": "if_near", "tables": {"other": "boxes"}, "parameters": {"near": 2.0}}]}

tables maps the parameters of a function to the names of tables or transformers (or lists of them). A transformer's result can be used
wherever a table can, in other transformers too. Issue filters name the issues that they take out; filter_expression combines
them, any of them will do without one. issue_filter is a condition over an issue's fields, involved_oid and involved_table, and takes out an issue
that fulfils it with any of its rows. :mod:`plumbline.plans.documents` reads specifications from XML.

A run evaluates stop conditions first: rows they report are taken out of the inputs of all other conditions. Every condition is a
lazy plan; the union of them is one job. Then issues equal in all keys count once, allowed issues are taken out, and severities and
statistics follow. Nothing is tiled: joins are global.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable, Mapping, Sequence
from typing import Any
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import issues as I
from plumbline.functions.expressions import Value, any_of_filters, holds, names_of
from plumbline.issues import Table
from plumbline.session import materialize

Check = Callable[..., DataFrame]
REGISTRY: dict[str, Check] = {}
#: Functions that give tables, and those that take out issues.
TRANSFORMERS: dict[str, Callable[..., Table | DataFrame]] = {}
FILTERS: dict[str, Callable[..., DataFrame]] = {}


def check(function: Check) -> Check:
    """Make a check known by its name; also the way for plug-ins."""
    REGISTRY[function.__name__] = function
    return function


def _register() -> None:
    from plumbline.operators import attributes, network, proximity, relations, schema, single_geometry, solids, spatial_transformers, transformers

    for module in (attributes, schema, single_geometry, relations, proximity, network, solids, transformers, spatial_transformers):
        for name in dir(module):
            for prefix, known in (("qa_", REGISTRY), ("tr_", TRANSFORMERS), ("rf_", TRANSFORMERS), ("if_", FILTERS)):
                if name.startswith(prefix):
                    known.setdefault(name, getattr(module, name))


def function_of(name: str) -> Callable:
    """A registered check, transformer or issue filter."""
    if not any(name in known for known in (REGISTRY, TRANSFORMERS, FILTERS)):
        _register()
    return next(known for known in (REGISTRY, TRANSFORMERS, FILTERS) if name in known or known is FILTERS)[name]


@dataclasses.dataclass(frozen=True)
class Instance:
    """A configured transformer or issue filter."""

    name: str
    function: str
    tables: Mapping[str, str | Sequence[str]] = dataclasses.field(default_factory=dict)
    parameters: Mapping[str, Any] = dataclasses.field(default_factory=dict)
    filters: Mapping[str, str] = dataclasses.field(default_factory=dict)


@dataclasses.dataclass(frozen=True)
class Condition:
    name: str
    check: str
    tables: Mapping[str, str | Sequence[str]]
    parameters: Mapping[str, Any] = dataclasses.field(default_factory=dict)
    filters: Mapping[str, str] = dataclasses.field(default_factory=dict)
    severity: str = "error"
    stop: bool = False
    issue_filter: str | None = None
    category: str | None = None
    issue_filters: Sequence[str] = ()
    filter_expression: str | None = None


@dataclasses.dataclass(frozen=True)
class Specification:
    name: str
    conditions: tuple[Condition, ...]
    transformers: tuple[Instance, ...] = ()
    issue_filters: tuple[Instance, ...] = ()

    def union(self, other: Specification) -> Specification:
        """All conditions, transformers and filters of both, by name; those of the first win."""
        both = lambda a, b: (*a, *(x for x in b if x.name not in {y.name for y in a}))
        return Specification(f"{self.name} + {other.name}", both(self.conditions, other.conditions), both(self.transformers, other.transformers), both(self.issue_filters, other.issue_filters))


def from_json(text: str) -> Specification:
    data = json.loads(text)
    instances = lambda key: tuple(Instance(**x) for x in data.get(key, ()))
    conditions = (Condition(**c | {"issue_filters": tuple(c.get("issue_filters", ()))}) for c in data["conditions"])
    return Specification(data["name"], tuple(conditions), instances("transformers"), instances("issue_filters"))


def to_json(spec: Specification) -> str:
    return json.dumps(dataclasses.asdict(spec), indent=2)


def _bound(used: Condition | Instance, tables: Callable[[str], Table]) -> dict[str, Any]:
    def one(name: str) -> Table:
        t = tables(name)
        extra = used.filters.get(name)
        where = f"({t.where}) AND ({extra})" if t.where and extra else extra or t.where
        return dataclasses.replace(t, where=where)

    return {p: one(n) if isinstance(n, str) else [one(x) for x in n] for p, n in used.tables.items()}


def _resolver(tables: Mapping[str, Table], transformers: Sequence[Instance]) -> Callable[[str], Table]:
    """Tables by name, made by transformers where there is one of that name; each is made once."""
    known: dict[str, Table] = dict(tables)
    by_name = {t.name: t for t in transformers}
    open_: list[str] = []

    def resolve(name: str) -> Table:
        if name not in known:
            if name in open_:
                raise ValueError(f"transformers use each other: {' > '.join([*open_, name])}")
            if name not in by_name:
                raise KeyError(f"no table or transformer is called {name}")
            open_.append(name)
            made = function_of(by_name[name].function)(**_bound(by_name[name], resolve), **by_name[name].parameters)
            open_.pop()
            if isinstance(made, DataFrame):
                made = Table(made, name, "oid" if "oid" in made.columns else made.columns[0], "geom" if "geom" in made.columns else None)
            known[name] = dataclasses.replace(made, name=name)
        return known[name]

    return resolve


def _full(found: DataFrame) -> DataFrame:
    """Issues of schema checks have no rows, values or place."""
    missing = {"involved": F.array().cast("array<struct<tab:string,oid:bigint>>"), "values": F.array().cast("array<string>"), "geom": F.lit(None).cast("string"), "component": F.lit(None).cast("string"), "description": F.lit(None).cast("string")}
    found = found.withColumns({n: c for n, c in missing.items() if n not in found.columns})
    return found.select("issue_code", "component", "involved", "description", "values", "geom")


def filtered(found: DataFrame, filters: Sequence[Instance], expression: str | None, involved: Sequence[Table], tables: Callable[[str], Table]) -> DataFrame:
    """Without the issues that the filters take out: those that any of them does, or for which the expression over them holds."""
    from plumbline.operators.spatial_transformers import with_place

    key = F.xxhash64("issue_code", F.coalesce("component", F.lit("")), F.to_json("involved"), F.coalesce("description", F.lit("")), F.coalesce("geom", F.lit("")), F.to_json("values"))
    found = materialize(found.withColumn("_key", key), "unfiltered")
    flags, out = {}, found
    for k, f in enumerate(filters):
        bound = _bound(f, tables) | dict(f.parameters)
        if f.function in ("if_all", "if_involved_rows"):
            if f.function == "if_involved_rows":
                bound.setdefault("tables", list(involved))
            left = function_of(f.function)(found, **bound)
        else:
            placed = [t for t in involved if t.geom]  # issues without a place are never taken out
            left = function_of(f.function)(with_place(found, placed), **bound) if placed else found
        left = left.select(F.col("_key").alias(f"_left{k}")).distinct()
        out = out.join(left, F.col("_key") == F.col(f"_left{k}"), "left")
        flags[f.name] = F.col(f"_left{k}").isNull()
    return out.where(~any_of_filters(flags, expression)).select(*found.columns).drop("_key")


def condition_issues(condition: Condition, tables: Mapping[str, Table] | Callable[[str], Table], issue_filters: Sequence[Instance] = ()) -> DataFrame:
    """The issues of one condition, with condition, severity and stop."""
    resolve = tables if callable(tables) else _resolver(tables, ())
    bound = _bound(condition, resolve)
    found = _full(function_of(condition.check)(**bound, **condition.parameters))
    if condition.issue_filter:
        own = names_of(found)
        met = lambda r: holds(condition.issue_filter, own | {"involved_oid": Value(r["oid"], "number"), "involved_table": Value(r["tab"], "text")})
        found = found.where(~F.exists("involved", met))
    if condition.issue_filters:
        by_name = {f.name: f for f in issue_filters}
        involved = [t for x in bound.values() for t in (x if isinstance(x, list) else [x])]
        found = filtered(found, [by_name[n] for n in condition.issue_filters], condition.filter_expression, involved, resolve)
    return found.withColumns({"condition": F.lit(condition.name), "severity": F.lit(condition.severity), "stop": F.lit(condition.stop)})


def run(spec: Specification, tables: Mapping[str, Table], exceptions: DataFrame | None = None, perimeter: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The issues of a specification. exceptions: allowed issues, see issues.without_exceptions(); perimeter: keeps issues inside an area."""
    found_by = lambda stop, known: [condition_issues(c, _resolver(known, spec.transformers), spec.issue_filters) for c in spec.conditions if c.stop == stop]
    first = found_by(True, tables)
    parts = list(first)
    if first:
        stopped = materialize(I.union(first).select(F.explode("involved").alias("r")).select("r.tab", "r.oid").distinct(), "stopped")
        tables = {n: dataclasses.replace(t, df=t.df.join(stopped.where(F.col("tab") == t.name).select(F.col("oid").alias("_stopped")), F.col(t.oid).cast("bigint") == F.col("_stopped"), "left_anti")) for n, t in tables.items()}
    parts += found_by(False, tables)
    found = I.union(parts)
    if perimeter:
        found = perimeter(found)
    found = I.distinct(found)
    return I.without_exceptions(found, exceptions) if exceptions is not None else found


def report(found: DataFrame) -> DataFrame:
    """Counts by condition, severity and code."""
    return I.statistics(found, ["condition", "severity", "issue_code"])


def html_report(found: DataFrame, title: str) -> str:
    """The report as a page: one row for each condition and code, which a specification bounds."""
    from html import escape

    rows = "".join(f"<tr>{''.join(f'<td>{escape(str(v))}</td>' for v in r)}</tr>" for r in report(found).orderBy("condition", "issue_code").toLocalIterator())
    return f"<!DOCTYPE html><title>{escape(title)}</title><h1>{escape(title)}</h1><table><tr><th>condition<th>severity<th>code<th>issues</tr>{rows}</table>"


def xml_report(found: DataFrame, spec: Specification) -> str:
    """The report as XML: each condition of the specification, those without issues too, with its counts by code."""
    counts: dict[str, list] = {}
    for r in report(found).orderBy("condition", "issue_code").toLocalIterator():
        counts.setdefault(r["condition"], []).append(r)
    out = []
    for c in spec.conditions:
        own = counts.get(c.name, [])
        codes = "".join(f"<Issues code={quoteattr(r['issue_code'])} count=\"{r['n_issues']}\"/>" for r in own)
        total = sum(r["n_issues"] for r in own)
        out.append(f"<Condition name={quoteattr(c.name)} test={quoteattr(c.check)} severity={quoteattr(c.severity)} stopOnError=\"{str(c.stop).lower()}\" issueCount=\"{total}\">{codes}</Condition>")
    errors = sum(r["n_issues"] for own in counts.values() for r in own if r["severity"] == "error")
    warnings = sum(r["n_issues"] for own in counts.values() for r in own if r["severity"] != "error")
    return f"<VerificationReport specification={quoteattr(spec.name)} errorCount=\"{errors}\" warningCount=\"{warnings}\" fulfilled=\"{str(not errors).lower()}\">{''.join(out)}</VerificationReport>"
