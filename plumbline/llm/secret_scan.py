"""Secret scanning with a trigram inverted index, with DataFrame functions only.

Each rule's regular expression is parsed once on the driver, and a Boolean query over lower-case trigrams is derived that
every matching text fulfils: a conjunction of choices between sets of trigrams. The index holds the postings of each trigram
that some rule asks for. It is partitioned by document and bit-sliced: a posting list is a column of bits over the documents
of a partition, so that intersecting and uniting postings is AND and OR of columns, and a candidate's text is at hand where it
is found. Nothing moves: no posting, no list of candidates, and no text has to meet another row.

Rules with a query are verified on their candidates only; rules without a mandatory trigram scan all texts. Queries only rule out
texts that cannot match, so the spans are those of a full scan.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """pattern holds for Java, RE2 and Python alike; the group must have at least least code points, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


RULES = [
    # fixed patterns and lengths of the three base kinds, in their fixed order
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    # further kinds
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35,}"),
]

#: Of a set of trigrams that must all be there, the rarest few are asked for: each costs a pass over every text.
ASKED = 2
#: Fixed: letters from common to rare in running text; other characters count as rarer.
_COMMON = "etaoinsrhldcumfpgwybvkxjqz"
#: A run of text is followed through at most so many alternatives; beyond, it is cut, which weakens the query only.
MAX_ALTERNATIVES = 128

Query = list[frozenset[frozenset[str]]]


def _strings(items) -> tuple[set[str] | None, Query]:
    """(all strings the items can match, or None if not few; the conditions found inside them)."""
    query: Query = []
    run: set[str] = {""}
    whole = True

    def cut() -> None:
        nonlocal run, whole
        choices = frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run)
        if run and all(choices):
            query.append(choices)
        run, whole = {""}, False

    for kind, value in items:
        options: set[str] | None = None
        if kind is op.LITERAL:
            options = {chr(value).lower()}
        elif kind is op.IN and all(k is op.LITERAL for k, _ in value):
            options = {chr(v).lower() for _, v in value}
        elif kind is op.SUBPATTERN:
            options, inner = _strings(value[3])
            query += inner if options is None else []
        elif kind is op.BRANCH:
            parts = [_strings(b)[0] for b in value[1]]
            options = None if None in parts else set().union(*parts)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, body = value
            inside, inner = _strings(body)
            if inside is not None and high == 1:
                options = inside | {""} if low == 0 else inside
            elif inside is not None and low and len(inside) ** low <= 4:
                run = {a + b * low for a in run for b in inside} if len(inside) == 1 else run
                cut()
                continue
            elif low:
                query += inner
        if options is None or len(run) * len(options) > MAX_ALTERNATIVES:
            cut()
            if options is not None and len(options) <= MAX_ALTERNATIVES:
                run = set(options)
        else:
            run = {a + b for a in run for b in options}
    if whole:
        return run, query
    cut()
    return None, query


def trigram_query(pattern: str) -> Query:
    """Conditions that all must hold: each a choice of trigram sets, of which one must be wholly in the text. Empty: none known."""
    strings, query = _strings(parser.parse(pattern))
    if strings is not None:
        choices = frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)
        query = [choices] if all(choices) else []
    rarity = lambda g: (-sum(_COMMON.find(c) if c in _COMMON else 40 for c in g), g)
    # a set that contains another one of the same choice adds nothing
    least = [[a for a in choices if not any(b < a for b in choices)] for choices in query]
    return [frozenset(frozenset(sorted(grams, key=rarity)[:ASKED]) for grams in choices) for choices in least]


def with_postings(docs: DataFrame, grams: list[str], text: str = "text") -> DataFrame:
    """docs with postings, a struct of one bit per gram: whether the document is in that gram's posting list."""
    low = F.lower(F.coalesce(F.col(text).cast("string"), F.lit("")))
    # the lower-cased text is made once a row, not once a gram
    return docs.withColumn("lowered", low).withColumn("postings", F.struct(*[F.contains("lowered", F.lit(g)).alias(f"g{k}") for k, g in enumerate(grams)])).drop("lowered")


def candidate(rule: Rule, grams: list[str]) -> Column:
    """Whether a row's postings fulfil the trigram query of a rule."""
    every = F.lit(True)
    for choices in trigram_query(rule.pattern):
        one = F.lit(False)
        for some in sorted(map(sorted, choices)):
            all_of = F.lit(True)
            for g in some:
                all_of = all_of & F.col("postings")[f"g{grams.index(g)}"]
            one = one | all_of
        every = every & one
    return every


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, kind_no, end, kind>> of a rule's matches that are long enough; positions in code points."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    group = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    between = F.split(text, rule.pattern, -1)
    start = F.lit(0).cast("long")
    none = F.array().cast("array<struct<start:bigint,no:int,end:bigint,kind:string>>")

    def step(acc: Column, x: Column) -> Column:
        at = acc["pos"] + F.length(x["gap"])
        end = at + F.length(x["whole"])
        span = F.struct(at.alias("start"), F.lit(order).alias("no"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("pos"), F.when(F.length(x["grp"]) >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    rows = F.arrays_zip(F.slice(between, F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), group.alias("grp"))
    found = F.aggregate(rows, F.struct(start.alias("pos"), none.alias("spans")), step)["spans"]
    return F.when(F.regexp_like(text, pattern), found).otherwise(none)


def scan(docs: DataFrame, rules: list[Rule] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id and spans, an array of (start, no, end, kind) by start, then rule order.

    Defined results: a null text is empty and has no spans; rows with a repeated or null doc_id are scanned each by itself;
    other columns are ignored; no rows give no rows.
    """
    rules = RULES if rules is None else rules
    indexed = [r for r in rules if trigram_query(r.pattern)]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    grams = sorted({g for r in indexed for choices in trigram_query(r.pattern) for some in choices for g in some})
    if indexed:
        rows = with_postings(rows, grams)
    none = F.array().cast("array<struct<start:bigint,no:int,end:bigint,kind:string>>")
    spans = []
    for k, rule in enumerate(rules):
        own = _spans(F.col("text"), rule, k)
        spans.append(F.when(candidate(rule, grams), own).otherwise(none) if rule in indexed else own)
    return rows.select("doc_id", F.array_sort(F.concat(*spans)).alias("spans"))


def digest(found: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The columns of the registered query from the spans of scan()."""
    base = [r for r in (RULES if rules is None else rules) if r.base]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    own = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in base]))
    return found.select("doc_id", *[count(r.kind) for r in base], F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules: list[Rule] | None = None, mark: str = "[SECRET]", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every rule's matches in the text replaced by a mark, rule by rule; all columns stay, null texts stay null.

    Matches of rules with a least length are replaced whole if the group is long enough.
    """
    rules = RULES if rules is None else rules
    out = F.col(text)
    for rule in rules:
        pattern = rule.pattern
        if rule.group and rule.least > 1:
            pattern = pattern[: pattern.rindex("+)")] + f"{{{rule.least},}})"
        out = F.regexp_replace(out, pattern, mark.replace("\\", "\\\\").replace("$", "\\$"))
    return docs.withColumn(text, out)


def sql(rules: list[Rule] | None = None) -> str:
    """DuckDB SQL for digest(scan(documents))."""
    rules = RULES if rules is None else rules
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for k, r in enumerate(rules):
        parts.append(f"""SELECT n, {k} AS no, '{r.kind}' AS kind, unnest(list_transform(generate_series(1, len(whole)), lambda i: struct_pack(
            s := coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(whole[1:i-1], lambda x: length(x))), 0), w := length(whole[i]), g := length(grp[i])))) AS m
        FROM (SELECT n, regexp_extract_all(text, {quote(r.pattern)}, 0) AS whole, regexp_extract_all(text, {quote(r.pattern)}, {r.group}) AS grp, regexp_split_to_array(text, {quote(r.pattern)}) AS gaps
              FROM d WHERE regexp_matches(text, {quote(r.pattern)}))""")
    least = " ".join(f"WHEN {k} THEN {r.least}" for k, r in enumerate(rules))
    base = ", ".join(quote(r.kind) for r in rules if r.base)
    counts = ", ".join(f"count(kind) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in rules if r.base)
    item = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT)"
    return f"""WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
    f AS (SELECT n, no, kind, m.s AS s, m.s + m.w AS e FROM ({" UNION ALL ".join(parts)}) WHERE m.g >= CASE no {least} END)
    SELECT doc_id, {counts}, sha256(coalesce(string_agg({item}, ',' ORDER BY s, no) FILTER (kind IN ({base})), '')) AS base_sha256,
           coalesce(string_agg({item}, ',' ORDER BY s, no), '') AS spans
    FROM d LEFT JOIN f USING (n) GROUP BY d.n, doc_id"""
