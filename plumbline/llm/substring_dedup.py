"""Substring dedup by hashing lines, paragraphs or passages.

A document is cut into units, each unit is normalised (ASCII lower case, words joined by one space) and hashed, and equal
digests are grouped over all documents. The occurrence with the smallest (doc_id, start) stays; the others are removed, by
their offsets in the original text.

Units:

* ``line``: between line feeds;
* ``paragraph``: between runs of two or more line feeds;
* ``passage`` (default): min_words consecutive words from a winnowed place: of every WINNOW places in a row, the one with the
  smallest hash of its three next words. A choice depends on the words in sight only, so a passage that is pasted inside
  longer lines of different documents is met at the same places in each, and every repeat of at least
  min_words + WINNOW - 1 words is found. Lines alone would miss it: the ends of pasted text share a line with what is around it.
  Passages overlap, and what is removed is their union. A repeat can go on for up to WINNOW - 1 words beyond the first and last
  chosen place; so all passages that begin there are hashed too, around the outer hits of each run of hits in any document that
  has the same passage, and what repeats of these is removed as well. A repeat that is met is thereby removed whole.
* ``all``: lines and paragraphs of LINE_WORDS words or more, and passages of min_words. What one kind cannot meet (short lines,
  pasted text) the other does.

Lines and paragraphs of fewer words (min_words, if they are the unit) are left alone. Digests are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.words import LOWER, U, code_points, hash_words, mix, utf8, windows, word_spans
from plumbline.session import dismiss, materialize, share_code

MIN_WORDS = 20
LINE_WORDS = 3
WINNOW = 12


def _runs(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the word sequences [first, last), by a polynomial over word hashes modulo 2**64."""
    base, inverse = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
    n = len(words)
    power, back = np.full(n + 1, U(base)), np.full(n + 1, U(inverse))
    power[0] = back[0] = 1
    power, back = np.cumprod(power, dtype=U), np.cumprod(back, dtype=U)
    total = np.zeros(n + 1, U)
    np.cumsum(words * power[:n], out=total[1:])
    return mix((total[last] - total[first]) * back[first] + (last - first).astype(U))


def winnowed(keys: np.ndarray, places: int, width: int = WINNOW) -> np.ndarray:
    """The places before places that have the smallest key (the last of equal ones) of some width places in a row."""
    places = min(places, len(keys))
    if places <= width:
        return np.array([places - 1 - int(keys[:places][::-1].argmin())])
    rows = np.lib.stride_tricks.sliding_window_view(keys[:places], width)
    return np.unique(np.arange(len(rows)) + width - 1 - rows[:, ::-1].argmin(axis=1))


def units(text: str | None, unit: str, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, digest, is a passage) of a text's units of enough words; offsets in code points, end exclusive."""
    raw = utf8(text)
    start, end = word_spans(raw)
    least = min(LINE_WORDS, min_words) if unit == "all" else min_words
    if len(start) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    words = hash_words(LOWER[raw], start, end)[0]
    first = last = np.zeros(0, np.int64)
    if unit in ("passage", "all") and len(words) >= min_words:
        first = winnowed(windows(words, 3), len(words) - min_words + 1)
        last = first + min_words
    chosen = first
    if unit != "passage":
        feeds = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(raw == 10, out=feeds[1:])
        between = np.append(feeds[start[1:]] - feeds[end[:-1]], 2)  # line feeds after each word
        for kind, n in (("line", 1), ("paragraph", 2)):
            if unit in (kind, "all"):
                ends = np.append(0, np.flatnonzero(between >= n) + 1)
                keep = np.diff(ends) >= least
                first, last = np.append(first, ends[:-1][keep]), np.append(last, ends[1:][keep])
    if unit == "all":  # one unit where kinds coincide
        first, last = np.divmod(np.unique(first * (len(words) + 1) + last), len(words) + 1)
    place = code_points(raw)
    return place[start[first]], place[end[last - 1]], _runs(words, first, last).view(np.int64), (last - first == min_words) & np.isin(first, chosen)


def around(text: str | None, hits: list[tuple[int, bool, bool]], min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, digest) of the passages that begin fewer than WINNOW words before or after hits: (start, before, after)."""
    raw = utf8(text)
    start, end = word_spans(raw)
    place = code_points(raw)
    at = np.searchsorted(place[start], np.array([x for x, _, _ in hits], np.int64))
    steps = np.arange(1, WINNOW)
    before, after = (at[np.array([x[k] for x in hits], bool)] for k in (1, 2))
    first = np.unique(np.concatenate([(before[:, None] - steps).ravel(), (after[:, None] + steps).ravel()]))
    first = first[(first >= 0) & (first <= len(start) - min_words)]
    last = first + min_words
    return place[start[first]], place[end[last - 1]], _runs(hash_words(LOWER[raw], start, end)[0], first, last).view(np.int64)


def _rows(ids: pa.Array, found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    rows = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
    columns = [pa.array(np.concatenate([x[k] for x in found])) for k in range(len(found[0]))]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), columns[0].cast(pa.int32()), columns[1].cast(pa.int32()), *columns[2:]], names=["doc_id", "start", "end", "digest", "passage"][: len(columns) + 1])


def _unit_rows(unit: str, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield _rows(part.column(0), [units(t, unit, min_words) for t in part.column(1).to_pylist()])

    return run


def _around_rows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                hits = [[(h["start"], h["before"], h["after"]) for h in x] for x in part.column(2).to_pylist()]
                yield _rows(part.column(0), [around(t, h, min_words) for t, h in zip(part.column(1).to_pylist(), hits, strict=True)])

    return run


def _repeats(found: DataFrame, name: str) -> DataFrame:
    """The rows of found whose digest stands earlier too, with the doc_id of the first occurrence as keep_doc_id."""
    # the digests alone first: few of them repeat, and only rows of these are looked at again; each step moves about as much
    # as the input, so all are tidy: the shuffle files of one step only are on disk at a time
    groups = found.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start")).alias("keep")).where("n > 1")
    groups = materialize(groups.select("digest", "keep"), name, tidy=True)  # apart from the join, so that a hot digest's rows can be split there
    again = found.join(groups, "digest").where((F.col("doc_id") != F.col("keep.doc_id")) | (F.col("start") != F.col("keep.start")))
    return again.withColumn("keep_doc_id", F.col("keep.doc_id")).drop("keep")


def _with_run(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with run, a number that overlapping and touching rows of the same keys share."""
    by_place = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("new", (F.coalesce(reach, F.lit(-1)) < F.col("start")).cast("int")).withColumn("run", F.sum("new").over(by_place.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def _extended(base: DataFrame, found: DataFrame, spans: DataFrame, min_words: int) -> DataFrame:
    """Repeats among the passages around the outer hits of spans: doc_id, start, end, keep_doc_id. Removes found on its way."""
    # a document that has the same passage must hash around it as well, be it inside a run there or kept
    sides = spans.select(F.explode("firsts").alias("digest"), F.lit(True).alias("before"), F.lit(False).alias("after"))
    sides = sides.unionAll(spans.select(F.explode("lasts").alias("digest"), F.lit(False).alias("before"), F.lit(True).alias("after")))
    sides = materialize(sides.groupBy("digest").agg(F.max("before").alias("before"), F.max("after").alias("after")), "sides", tidy=True)
    hits = found.where("passage").join(sides, "digest").groupBy("doc_id").agg(F.collect_set(F.struct("start", "before", "after")).alias("hits"))
    hits = materialize(hits, "hits", tidy=True)  # apart from the texts, which move in the next step
    dismiss(found)
    more = base.join(hits, "doc_id").select("doc_id", "text", "hits").mapInArrow(_around_rows(min_words), "doc_id long, start int, end int, digest long")
    return _repeats(materialize(more, "around", tidy=True), "more").drop("digest")


def repeated_spans(docs: DataFrame, unit: str = "passage", min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per span to remove: doc_id, start, end (code points, end exclusive), n_units, keep_doc_ids.

    Overlapping and touching units of a document are one span; keep_doc_ids lists, in ascending order, the documents whose
    occurrence stays. A document without repeats has no row.

    Defined results: null and empty texts and null doc_ids have no units; a unit that repeats within a document stays where
    it is first; rows that repeat a doc_id count as one document, and a unit that stands at the same place in two of them is
    one occurrence; other columns are ignored; no rows give no rows.
    """
    share_code(docs.sparkSession)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    found = materialize(base.mapInArrow(_unit_rows(unit, min_words), "doc_id long, start int, end int, digest long, passage boolean"), "units")
    runs = _with_run(_repeats(found, "repeats"), "doc_id", "passage")
    whole = Window.partitionBy("doc_id", "passage", "run")
    runs = runs.withColumn("first_end", F.min("end").over(whole)).withColumn("last_start", F.max("start").over(whole))
    firsts = F.collect_set(F.when(F.col("passage") & (F.col("start") < F.col("first_end")), F.col("digest"))).alias("firsts")
    lasts = F.collect_set(F.when(F.col("passage") & (F.col("end") > F.col("last_start")), F.col("digest"))).alias("lasts")
    spans = runs.groupBy("doc_id", "passage", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_units"), F.collect_set("keep_doc_id").alias("keep"), firsts, lasts)
    spans = materialize(spans, "spans", tidy=True)
    out = spans.select("doc_id", "start", "end", "n_units", "keep")
    if unit in ("passage", "all"):
        more = _extended(base, found, spans, min_words)
        out = out.unionByName(more.select("doc_id", "start", "end", F.lit(1).cast("long").alias("n_units"), F.array("keep_doc_id").alias("keep")))
    out = _with_run(out, "doc_id").groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_units").alias("n_units"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("keep")))).alias("keep_doc_ids"))
    return out.drop("run")


def remove_repeats(docs: DataFrame, unit: str = "passage", min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the repeated spans cut out of the text, and removed, the cut spans as array<struct<start, end>> of original
    offsets (empty where nothing was cut). All other columns and all rows stay.
    """
    spans = repeated_spans(docs, unit, min_words, doc_id, text).groupBy(F.col("doc_id").alias("_cut_id")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    out = docs.join(spans, docs[doc_id].cast("long") == spans["_cut_id"], "left").withColumn("removed", F.coalesce("removed", none)).drop("_cut_id")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("kept"))

    def step(acc, span):
        return F.struct(span["end"].alias("at"), F.concat(acc["kept"], F.substring(F.col(text), acc["at"] + 1, span["start"] - acc["at"])).alias("kept"))

    done = F.aggregate("removed", start, step)
    kept = F.concat(done["kept"], F.substring(F.col(text), done["at"] + 1, F.length(text)))
    return out.withColumn(text, F.when(F.size("removed") > 0, kept).otherwise(F.col(text)))
