"""Exact duplicates by two-pass Bloom filtering, with DataFrame functions only.

Pass 1 sets two slots per text digest in a filter that remembers which slots were set more than once; pass 2 probes it. A
row with a slot that was set once has no equal: it passes straight through. Only the remaining rows shuffle, on their full
SHA-256, which decides; a false positive costs a shuffled row and changes no result.

The filter is blocked: both slots of a digest lie in the same block of BLOCK slots, so that one lookup answers for both.
About 16 slots a row are planned. Pass 1 moves slot numbers, never rows: each task counts the slots that it sets, so that a hot
text is two slot numbers a task, and the repeated ones become bitmaps of 4 KB a block. (Bitmaps merged over tasks would move more:
each task's would be as large as the whole filter, two bytes a row of the table and task.)

Filters of up to FILTER_BITS slots are broadcast, at most FILTER_BITS / 8 bytes, and pass 2 moves nothing. A larger filter has
no size bound, so it is not broadcast: there the rows' digests (never their texts) meet their block in one join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialize

FILTER_BITS = 1 << 29
BLOCK = 32768


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _block(digest: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(blocks))


def _slots(digest: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(digest, F.lit(k)), F.lit(BLOCK)).cast("int") for k in (1, 2)]


def _bit(bitmap: Column, slot: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(slot / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, F.pmod(slot, F.lit(8))), F.lit(0)) == 1


def repeated_slots(rows: DataFrame, blocks: int) -> DataFrame:
    """(block, bitmap): the slots that were set at least twice; blocks without any are left out."""
    digest = F.col("text_sha256")
    first, second = _slots(digest)
    # the two slots of one row may coincide, which is no repetition
    slots = F.array_compact(F.array(first, F.when(second != first, second)))
    set_ = rows.select(_block(digest, blocks).alias("block"), F.explode(slots).alias("slot"))
    often = set_.groupBy("block", "slot").agg(F.count("*").alias("n")).where("n > 1")
    return often.groupBy("block").agg(F.expr("bitmap_construct_agg(slot)").alias("bitmap"))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Defined results: a null text equals an empty one; of equal texts the row with the smallest doc_id stays, a null doc_id
    counts as larger than any other; rows that share the smallest doc_id and the text are one row repeated, all are kept
    (kept = doc_id is keep_id) and each counts in group_size; other columns are ignored; no rows give no rows.
    """
    digests = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.sha2(normalised(F.col(text)), 256).alias("text_sha256"))
    rows = materialize(digests, "digests")
    blocks = max(1, math.ceil(16 * rows.count() / BLOCK))
    side = materialize(repeated_slots(rows, blocks), "filter")
    if blocks * BLOCK <= filter_bits:
        side = F.broadcast(side)
    digest = F.col("text_sha256")
    probed = rows.withColumn("block", _block(digest, blocks)).join(side, "block", "left")
    first, second = _slots(digest)
    # the flag is a byte a row; keeping it spares a second probe
    probed = materialize(probed.select("doc_id", "text_sha256", F.coalesce(_bit(F.col("bitmap"), first) & _bit(F.col("bitmap"), second), F.lit(False)).alias("maybe")), "probed")
    alone = probed.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    maybe = probed.where("maybe").select("doc_id", "text_sha256")
    groups = maybe.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = materialize(groups, "groups")  # apart from the join, so that a hot digest's rows can be split there
    both = maybe.join(groups, "text_sha256").select("doc_id", "keep_id", "group_size", "text_sha256")
    out = alone.unionByName(both)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that exact_duplicates() keeps; all columns stay."""
    gone = exact_duplicates(docs, doc_id, text).where("not kept").select(F.col("doc_id").alias("_gone_id"), F.col("text_sha256").alias("_gone_sha")).distinct()
    same = docs[doc_id].cast("long").eqNullSafe(F.col("_gone_id")) & (F.sha2(normalised(docs[text]), 256) == F.col("_gone_sha"))
    return docs.join(gone, same, "left_anti")


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
