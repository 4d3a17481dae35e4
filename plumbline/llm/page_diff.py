"""Main text of web pages by differencing each page with the page of the nearest URL on its host.

1. Every page is cut into lines, one for each block of its visible text, and each line gets a digest.
2. Pages are put in the order of (host, path); of a page's two neighbours there, the one whose path shares the longer prefix
   is its partner (the one before it, on a tie). Hosts are split over range partitions, so a hot host is no hot task.
3. The two pages' lines are aligned by a longest common subsequence, and the shared lines are deleted: menus, notices and
   footers stand on both pages, an article on one of them. Pages of one host with the same lines are one page in this, so that a
   copy is never its copies' partner, and a page that is wholly contained in its partner keeps its lines.

Markup decides first what it marks: elements of the kinds that are never main text (menus, headers, footers, sidebars, notices, adverts,
forms, comments) go, and of a page that marks its article, only lines in it stay. What such marks leave open is decided
by differencing: all lines of pages that mark no article, and inside articles the blocks whose names leave their kind open
(DOUBTFUL names). With marks=False, differencing decides alone and all marks are ignored.
"""

from __future__ import annotations

import html
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialize, share_code

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)
    |<(?P<raw>script|style|textarea|title|noembed|noframes|iframe|select|template)\b(?:"[^"]*"|'[^']*'|[^'">])*+>.*?(?:</(?P=raw)\s*>|\Z)
    |<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:"[^"]*"|'[^']*'|[^'">])*+)>
    |<[!?/][^>]*>""",
    re.S | re.I | re.X,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr picture q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input audio video source track"
    " object svg tspan noscript math mi mo mn ms mtext mspace mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle semantics annotation".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ARTICLE = frozenset(["article", "main"])
_BOILERPLATE_TAGS = frozenset("nav footer aside form head button dialog menu".split())
_BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
_BOILERPLATE_NAMES = frozenset(
    "nav navbar navigation menu topbar masthead footer sidebar widget cookie cookies consent gdpr notice banner ad ads adbox advert adverts advertisement sponsor sponsored"
    " comment comments disqus respond reply breadcrumb breadcrumbs newsletter subscribe subscription signup login popup modal overlay pagination pager skip".split()
)
#: Names that stand on main text as often as around it.
DOUBTFUL = frozenset("social share sharing related promo promotion more tags meta byline".split())
_CONTENT_NAMES = frozenset("article content post entry story".split())
#: Bits of a table of two pages' lines that are held at once: 64 MB.
LCS_BITS = 1 << 29


@dataclass(slots=True)
class Line:
    text: str
    boilerplate: bool
    article: bool
    content: bool
    doubtful: bool


def _names(attributes: str) -> tuple[set[str], set[str]]:
    names: set[str] = set()
    roles: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        (roles if m[1].lower() == "role" else names).update(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()))
    return names, roles


def lines(page: str | None) -> list[Line]:
    """The blocks of visible text of a page in order; white space is one space, references are decoded."""
    out: list[Line] = []
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # tag, and whether it or one around it is boilerplate, article, content, doubtful
    plain = state = (False,) * 4
    parts: list[str] = []

    def end_block() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append(Line(text, *state))

    page = page or ""
    at = 0
    for m in _MARKUP.finditer(page):
        if m.start() > at:
            parts.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if tag == "br":
            parts.append("\n")
        if m["close"]:
            if any(x[0] == tag for x in stack):
                if tag not in _INLINE:
                    end_block()
                while stack.pop()[0] != tag:
                    pass
                now = stack[-1][1:] if stack else plain
                if now != state:
                    end_block()
                    state = now
            elif tag not in _INLINE:
                end_block()
            continue
        names, roles = _names(m["attributes"]) if m["attributes"] else (set(), set())
        article = state[1] or tag in _ARTICLE or "main" in roles or "article" in roles
        head = (tag == "header" or "header" in names) and not article
        boilerplate = state[0] or head or tag in _BOILERPLATE_TAGS or bool(roles & _BOILERPLATE_ROLES) or bool(names & _BOILERPLATE_NAMES) and tag not in ("body", "html")
        now = (boilerplate, article, state[2] or bool(names & _CONTENT_NAMES), state[3] or bool(names & DOUBTFUL) and tag not in ("body", "html"))
        if tag not in _INLINE or now != state:
            end_block()
        if tag not in _VOID and not m["attributes"].endswith("/"):
            # an open paragraph or item ends where the next block of its kind begins
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
                stack.pop()
                outer = stack[-1][1:] if stack else plain
                now = tuple(own if own != before else around for own, before, around in zip(now, state, outer, strict=True))
            stack.append((tag, *now))
            state = now
    if at < len(page):
        parts.append(html.unescape(page[at:]))
    end_block()
    return out


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """For each prefix of a, the bits j at which the length of its longest common subsequence with b[: j + 1] does not rise."""
    masks: dict[int, int] = {}
    for x, places in _places(b).items():
        bits = bytearray(len(b) // 8 + 1)
        for j in places:
            bits[j >> 3] |= 1 << (j & 7)
        masks[x] = int.from_bytes(bits, "little")
    full = flat = (1 << len(b)) - 1
    for x in a:
        met = flat & masks.get(x, 0)
        flat = ((flat + met) | (flat - met)) & full
        yield flat


def _places(b: list[int]) -> dict[int, list[int]]:
    out = defaultdict(list)
    for j, x in enumerate(b):
        out[x].append(j)
    return out


def _lengths(a: list[int], b: list[int]) -> list[int]:
    """The length of the longest common subsequence of a with b[:j], for each j."""
    flat = (1 << len(b)) - 1
    for flat in _rows(a, b):  # noqa: B007
        pass
    return list(accumulate((c == "0" for c in reversed(f"{flat:0{len(b)}b}")), initial=0)) if b else [0]


def common(a: list[int], b: list[int]) -> list[int]:
    """The places in a of a longest common subsequence of a and b.

    Matching ends are taken off first. The rest is solved with whole rows of the table as bits of one number, however often a line
    repeats; what does not fit into LCS_BITS is halved where the lengths of both halves add up best.
    """
    low = 0
    while low < len(a) and low < len(b) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    own, other = a[low : len(a) - high], b[low : len(b) - high]
    middle: list[int] = []
    if len(own) > 1 and len(own) * len(other) > LCS_BITS:
        half = len(own) // 2
        before, after = _lengths(own[:half], other), _lengths(own[:half - 1 : -1], other[::-1])
        cut = max(range(len(other) + 1), key=lambda j: before[j] + after[len(other) - j])
        middle = common(own[:half], other[:cut]) + [half + i for i in common(own[half:], other[cut:])]
    elif own and other:
        rows, i, j = list(_rows(own, other)), len(own), len(other)
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if own[i] == other[j - 1]:
                    middle.append(i)
                    j -= 1
        middle.reverse()
    return [*range(low), *(low + i for i in middle), *range(len(a) - high, len(a))]


def article_text(found: list[Line], shared: set[int], marks: bool = True) -> str:
    """What stays of a page's lines, of which those numbered in shared stand on its partner as well."""
    if not marks:
        kept = [x.text for i, x in enumerate(found) if i not in shared]
    elif any(x.article and not x.boilerplate for x in found):
        kept = [x.text for i, x in enumerate(found) if x.article and not x.boilerplate and not (x.doubtful and i in shared)]
    else:
        marked = any(x.content and not x.boilerplate for x in found)
        kept = [x.text for i, x in enumerate(found) if not x.boilerplate and (x.content or not marked) and i not in shared]
    return "\n\n".join(kept)


def _url(part: str, url: Column) -> Column:
    host = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
    return F.lower(F.regexp_extract(url, host, 1)) if part == "host" else F.regexp_extract(F.regexp_replace(url, host, ""), r"^[^?#]*", 0)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[xxhash.xxh3_64_intdigest(x.text) - (1 << 63) for x in lines(p.as_py())] for p in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int64()))], names=["key", "host", "path", "lines"])


def partner(path: str, sides: list[tuple[str, list[int]]]) -> list[int]:
    """The lines of the side (path, lines) whose path shares the longest prefix; the first one on a tie."""
    return max(sides, key=lambda x: len(os.path.commonprefix([path, x[0]])))[1]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, sames, out = [], [], []
        for row in batch.to_pylist():
            sides = [(row[f"{k}_path"], row[f"{k}_lines"]) for k in ("previous", "next") if row[f"{k}_lines"] is not None]
            places = common(row["lines"], partner(row["path"], sides))
            if 0 < len(places) < len(row["lines"]):
                hosts.append(row["host"])
                sames.append(row["same"])
                out.append(places)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(sames, pa.int64()), pa.array(out, pa.list_(pa.int32()))], names=["host", "same", "shared"])


def shared_lines(pages: DataFrame) -> DataFrame:
    """(key, shared): the numbers of each page's lines that its partner has too; pages without any are left out.

    pages has key, url and html. Only keys, URLs and line digests move here, never the pages. Pages of a host with the same lines
    are represented by the one that comes first by path and key.
    """
    narrow = pages.select("key", _url("host", F.col("url")).alias("host"), _url("path", F.col("url")).alias("path"), "html")
    narrow = narrow.mapInArrow(_digests, "key long, host string, path string, lines array<long>").withColumn("same", F.xxhash64("lines"))
    narrow = materialize(narrow.where("size(lines) > 0"), "narrow")
    first = narrow.groupBy("host", "same").agg(F.min(F.struct("path", "key", "lines")).alias("page")).select("host", "same", "page.*")
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = first.repartitionByRange(n, "host", "path", "key").sortWithinPartitions("host", "path", "key")
    rows = materialize(rows.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "lines")
    # a running number over all partitions: one row a partition decides where each begins
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    sizes = sizes.selectExpr("part", "coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0) - first as shift")
    rows = rows.join(F.broadcast(sizes), "part").withColumn("rank", F.col("place") + F.col("shift"))
    rows = rows.select("rank", "host", "same", "path", "lines")
    near = {}
    for side, step in (("previous", 1), ("next", -1)):
        near[side] = rows.select((F.col("rank") + step).alias("rank"), F.col("host").alias(f"{side}_host"), F.col("path").alias(f"{side}_path"), F.col("lines").alias(f"{side}_lines"))
    both = rows.join(near["previous"], "rank", "left").join(near["next"], "rank", "left")
    for side in near:
        both = both.withColumn(f"{side}_lines", F.when(F.col(f"{side}_host") == F.col("host"), F.col(f"{side}_lines")))
    both = both.where("previous_lines is not null or next_lines is not null")
    found = both.select("host", "same", "path", "lines", "previous_path", "previous_lines", "next_path", "next_lines").mapInArrow(_shared, "host string, same long, shared array<int>")
    return narrow.select("key", "host", "same").distinct().join(materialize(found, "found"), ["host", "same"]).select("key", "shared")


def _texts(marks: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [article_text(lines(p.as_py()), set(s.as_py() or ()), marks) for p, s in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", marks: bool = True) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Defined results: a null html is empty and gives an empty text; null URLs are one host; rows with a repeated or null
    page_id are pages of their own, pages of a host with the same lines count once in pairing; other
    columns are ignored; no rows give no rows.
    """
    share_code(pages.sparkSession)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(page).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.xxhash64("page_id", F.coalesce("url", F.lit("\0")), "html"))
    shared = materialize(shared_lines(rows.select("key", F.coalesce("url", F.lit("")).alias("url"), "html")), "shared")
    out = rows.join(shared, "key", "left").select("page_id", "url", "html", "shared")
    return out.mapInArrow(_texts(marks), "page_id long, url string, text string, n_chars long")
