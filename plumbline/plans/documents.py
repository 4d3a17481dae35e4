"""Specifications from XML: the short form of this engine, and data quality documents.

A data quality document describes workspaces, descriptors (which class a test, transformer or issue filter is), configurations of them
with their parameters, categories that nest, and specifications that list conditions. Element and attribute names follow the
published schema; its namespace is ignored. Class names become function names (``a.b.QaMinLength`` is ``qa_min_length``); parameters
are bound by name without regard to case and underscores, and where a document names one differently, in the order in which it gives them.
"""

from __future__ import annotations

import dataclasses
import inspect
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator, Mapping
from typing import Any

from pyspark.sql import SparkSession

from plumbline.issues import Table
from plumbline.plans.specification import Condition, Instance, Specification, function_of
from plumbline.sources.tables import scan


def from_xml(text: str) -> Specification:
    """``<QualitySpecification name><Condition name check severity stop><Table parameter name filter/><Parameter name>json</Parameter></Condition>``
    and, as further elements of it, ``<Transformer name function>`` and ``<IssueFilter name function>`` of the same content; a condition
    names its issue filters in issueFilters (by spaces) and combines them by filterExpression."""
    root = ET.fromstring(text)

    def content(element: ET.Element) -> tuple[dict[str, Any], dict[str, Any], dict[str, str]]:
        tables: dict[str, Any] = {}
        filters = {}
        for t in element.findall("Table"):
            known = tables.get(t.attrib["parameter"])
            name = t.attrib["name"]
            tables[t.attrib["parameter"]] = name if known is None else [*([known] if isinstance(known, str) else known), name]
            if t.get("filter"):
                filters[name] = t.attrib["filter"]
        return tables, {p.attrib["name"]: json.loads(p.text or "null") for p in element.findall("Parameter")}, filters

    out = []
    for c in root.iter("Condition"):
        tables, parameters, filters = content(c)
        out.append(Condition(c.attrib["name"], c.attrib["check"], tables, parameters, filters, c.get("severity", "error"), c.get("stop", "false").lower() == "true", c.get("issueFilter"), c.get("category"), tuple(c.get("issueFilters", "").split()), c.get("filterExpression")))
    made = {k: tuple(Instance(x.attrib["name"], x.attrib["function"], *content(x)) for x in root.iter(k)) for k in ("Transformer", "IssueFilter")}
    return Specification(root.get("name", ""), tuple(out), made["Transformer"], made["IssueFilter"])


@dataclasses.dataclass(frozen=True)
class Document:
    specifications: dict[str, Specification]
    #: Catalog paths by workspace id.
    workspaces: dict[str, str]
    #: The workspace of each table that a parameter names.
    table_workspaces: dict[str, str]


def function_name(class_name: str) -> str:
    """``a.b.QaMinLength`` as ``qa_min_length``; short forms and digits stay with their word."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", class_name.rpartition(".")[2].removesuffix("Definition")).lower()


def _plain(name: str) -> str:
    return name.replace("_", "").lower()


def _kinds(function: Callable) -> dict[str, str]:
    return {n: str(p.annotation) for n, p in inspect.signature(function).parameters.items()}


def _scalar(values: list[str], kind: str) -> Any:
    """Attribute values as what the parameter's annotation says."""
    def one(value: str) -> Any:
        if "bool" in kind:
            return value.strip().lower() in ("true", "1", "yes")
        for name, made in (("int", int), ("float", float)):
            if re.search(rf"\b{name}\b", kind):
                return made(value)
        return value

    several = len(values) > 1 or kind.startswith(("Sequence", "list", "tuple"))
    return [one(v) for v in values] if several else one(values[0])


def bound(function: Callable, values: list[ET.Element]) -> tuple[dict[str, Any], dict[str, Any], dict[str, str]]:
    """(tables, parameters, filters) for a function from the Dataset and Scalar elements of a configuration."""
    given: dict[bool, dict[str, list[ET.Element]]] = {True: {}, False: {}}
    for v in values:
        if v.get("value") or v.get("transformerName"):
            given[v.tag == "Dataset"].setdefault(v.attrib["parameter"], []).append(v)
    kinds = {n: k for n, k in _kinds(function).items() if n not in ("found", "placed", "spark")}
    tables, parameters, filters = {}, {}, {}
    for dataset, own in given.items():
        free = [n for n, k in kinds.items() if ("Table" in k) == dataset]
        by_plain = {_plain(n): n for n in free}
        named = {p: by_plain[_plain(p)] for p in own if _plain(p) in by_plain}
        rest = iter([n for n in free if n not in named.values()])
        for parameter, elements in own.items():
            name = named.get(parameter) or next(rest, None)
            if name is None:
                raise ValueError(f"{function.__name__} has no parameter for {parameter}")
            if dataset:
                names = [e.get("transformerName") or e.attrib["value"] for e in elements]
                tables[name] = names if len(names) > 1 or "Sequence" in kinds[name] or kinds[name] == "Tables" else names[0]
                filters |= {n: e.attrib["where"] for n, e in zip(names, elements, strict=True) if e.get("where")}
            else:
                parameters[name] = _scalar([e.attrib["value"] for e in elements], kinds[name])
    return tables, parameters, filters


def _override(*values: str | None) -> bool:
    """The first of several settings that is not left open."""
    return next((v.strip().lower() in ("true", "1") for v in values if v and v.strip().lower() not in ("null", "")), False)


def from_document(text: str) -> Document:
    """The specifications of a data quality document."""
    root = ET.fromstring(text)
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2]

    def everywhere(tag: str) -> Iterator[tuple[ET.Element, str | None]]:
        """Elements of the document and of its categories, with the path of the category."""
        def inside(holder: ET.Element, category: str | None) -> Iterator[tuple[ET.Element, str | None]]:
            for kind in (f"{tag}s", tag):
                for group in holder.findall(kind):
                    yield from ((x, category) for x in group.findall(tag))
            for group in (*holder.findall("Categories"), *holder.findall("SubCategories")):
                for c in group.findall("Category"):
                    yield from inside(c, f"{category}/{c.attrib['name']}" if category else c.attrib["name"])

        yield from inside(root, None)

    descriptors = {}
    for tag, classes in (("TestDescriptor", ("TestClass", "TestFactory")), ("TransformerDescriptor", ("TransformerClass",)), ("IssueFilterDescriptor", ("IssueFilterClass",))):
        for d, _ in everywhere(tag):
            made = next(c for c in (d.find(x) for x in classes) if c is not None)
            descriptors[tag, d.attrib["name"]] = (function_name(made.attrib["type"]), d)

    table_workspaces: dict[str, str] = {}

    def values(element: ET.Element) -> list[ET.Element]:
        found = [v for group in element.findall("Parameters") for v in group if v.tag in ("Dataset", "Scalar")]
        for v in found:
            if v.tag == "Dataset" and v.get("workspace") and v.get("value"):
                table_workspaces[v.attrib["value"]] = v.attrib["workspace"]
        return found

    def instances(tag: str, attribute: str) -> dict[str, Instance]:
        out = {}
        for x, _ in everywhere(tag):
            name = descriptors[f"{tag}Descriptor", x.attrib[attribute]][0]
            out[x.attrib["name"]] = Instance(x.attrib["name"], name, *bound(function_of(name), values(x)))
        return out

    transformers = instances("Transformer", "transformerDescriptor")
    filters = instances("IssueFilter", "issueFilterDescriptor")
    conditions = {}
    for q, category in everywhere("QualityCondition"):
        name, descriptor = descriptors["TestDescriptor", q.attrib["testDescriptor"]]
        tables, parameters, where = bound(function_of(name), values(q))
        names = tuple(f.attrib["issueFilterName"] if "issueFilterName" in f.attrib else f.attrib["name"] for f in q.iterfind("Filters/Filter"))
        expression = q.find("FilterExpression")
        conditions[q.attrib["name"]] = (q, descriptor, Condition(q.attrib["name"], name, tables, parameters, where, category=category, issue_filters=names, filter_expression=None if expression is None else expression.get("expression")))

    specifications = {}
    for s, _ in everywhere("QualitySpecification"):
        used = []
        for e in s.iterfind("Elements/Element"):
            q, descriptor, condition = conditions[e.attrib["qualityCondition"]]
            warning = _override(e.get("allowErrors"), q.get("allowErrors"), descriptor.get("allowErrors"))
            stop = _override(e.get("stopOnError"), q.get("stopOnError"), descriptor.get("stopOnError"))
            used.append(dataclasses.replace(condition, severity="warning" if warning else "error", stop=stop))
        specifications[s.attrib["name"]] = Specification(s.attrib["name"], tuple(used), tuple(transformers.values()), tuple(filters.values()))
    return Document(specifications, {w.attrib["id"]: w.get("catalogPath") or w.get("connectionString") or "" for w, _ in everywhere("Workspace")}, table_workspaces)


def open_tables(spark: SparkSession, document: Document, keys: Mapping[str, str], geometries: Mapping[str, str] | None = None, fmt: str = "parquet") -> dict[str, Table]:
    """The tables that a document's parameters name, from its workspaces' catalog paths; keys and geometries name columns by table."""
    out = {}
    for name, workspace in document.table_workspaces.items():
        df = scan(spark, f"{document.workspaces[workspace].rstrip('/')}/{name}.{fmt}", fmt)
        out[name] = Table(df, name, keys[name], (geometries or {}).get(name))
    return out
