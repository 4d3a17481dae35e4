"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Each source's documents form blocks. Block j (from 0) of a source with weight w (a share of all slots) may not start before slot
floor(j / w) and must be placed before slot ceil((j + 1) / w). While no source has run out, each source's share of the first t
slots then differs from w * t by less than one block at every t. Weights are exact fractions, never rounded.

The schedule repeats after as many slots as the whole weights add up to, so the driver places one period of blocks, or all blocks
of sources that end before (plain integers, bounded by MOST_NUMBERS in all, never by rows); rows find their slot by a join on that table.
Only where the period of the weights and the number of blocks are both too long for the bound, blocks are made larger until their number
fits: weights stay exact, and the deviation stays below one of these blocks.

When a source has placed its last block, a new phase starts with the other sources' weights, so that every document is placed.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialize

BLOCK = 32
MOST_SOURCES = 256
LEAST_CHUNK = 512
#: Slots that the tables of all phases hold together.
MOST_NUMBERS = 1 << 20


def whole_weights(weights: dict[str, float | Fraction]) -> dict[str, int]:
    """Whole numbers in exactly the proportions of the weights; a float counts as the decimal number it is written as."""
    exact = {k: w if isinstance(w, Fraction) else Fraction(str(w)) for k, w in weights.items()}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    out = {k: int(w * scale) for k, w in exact.items()}
    factor = math.gcd(*out.values())
    return {k: w // factor for k, w in out.items()}


def earliest_deadlines(weights: list[int], blocks: list[int], most: int) -> list[list[int]]:
    """The slots of each source's blocks: in every slot, of the blocks released by then, the one with the earliest deadline. It ends
    after most slots, a period, or when a source has placed as many as blocks says."""
    total = sum(weights)
    window = lambda k, j: (j * total // weights[k], -(-(j + 1) * total // weights[k]), k)
    waiting = [window(k, 0) for k in range(len(weights))]
    heapq.heapify(waiting)
    ready: list[tuple[int, int]] = []
    out: list[list[int]] = [[] for _ in weights]
    for slot in range(min(most, total)):
        while waiting and waiting[0][0] <= slot:
            _, deadline, k = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, k))
        deadline, k = heapq.heappop(ready)
        if deadline <= slot:
            raise AssertionError("a deadline was missed; whole weights always leave a slot")
        out[k].append(slot)
        if len(out[k]) == blocks[k]:
            break
        heapq.heappush(waiting, window(k, len(out[k])))
    return out


def schedule(blocks: list[int], weights: list[int], most: int) -> list[tuple[int, int, int, int, int, int, list[int]]]:
    """Phases: (source, first block, end block, first slot, blocks and slots a period, slots of the blocks in a period).

    most bounds the slots of a period that is placed; it must hold the period or all blocks.
    """
    left, done, first_slot, out = {k: n for k, n in enumerate(blocks) if n > 0}, [0] * len(blocks), 0, []
    while left:
        live = list(left)
        factor = math.gcd(*(weights[k] for k in live))
        now = [weights[k] // factor for k in live]
        slots = earliest_deadlines(now, [left[k] for k in live], most)
        length = placed = sum(map(len, slots))
        if placed == sum(now):  # a whole period: the first source ends in this one or a later one
            length = min((left[k] - 1) // w * placed + s[(left[k] - 1) % w] + 1 for k, w, s in zip(live, now, slots, strict=True))
        elif all(len(s) < left[k] for k, s in zip(live, slots, strict=True)):
            raise AssertionError("neither the period nor the blocks fit")
        full, part = divmod(length, placed)
        for k, s in zip(live, slots, strict=True):
            used = full * len(s) + sum(x < part for x in s)
            if used:
                out.append((k, done[k], done[k] + used, first_slot, len(s), placed, s))
                done[k] += used
                left[k] -= used
                if not left[k]:
                    del left[k]
        first_slot += length
    return out


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, doc_id: str = "doc_id", source: str = "source", chunk_rows: int | None = None) -> DataFrame:
    """One row per document: doc_id, source, block, slot, position.

    Order by position to read the mix: position = slot * block + place in the block, so gaps are left only by the short
    last block of a source. Within a source, documents are in a hashed order. weights defaults to equal ones; a source
    without a weight gets the mean weight, a weight of 0 or less is refused.

    Defined results: a null source is a source of its own (named in weights as ""; an empty source name shares it);
    null doc_ids and repeated rows are placed like others, in an arbitrary order among equal ids; other
    columns are ignored (those of rows without a doc_id decide their order); no rows give no rows. More than MOST_SOURCES
    sources raise a ValueError, as do weights that are not positive.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), _hash(docs, doc_id).alias("hash"))
    return _placed(materialize(rows, "mix"), [], weights, block, chunk_rows)


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, doc_id: str = "doc_id", source: str = "source", chunk_rows: int | None = None) -> DataFrame:
    """The rows of docs in the order of the mix, all columns unchanged: sorted over partitions and files, so that rows come in
    mix order when they are read by file and row number.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.struct(*docs.columns).alias("row"), _hash(docs, doc_id).alias("hash"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = _placed(rows, ["row"], weights, block, chunk_rows)
    return placed.repartitionByRange(n, "position").sortWithinPartitions("position").select("row.*")


def _placed(rows: DataFrame, carry: list[str], weights: dict[str, float] | None, block: int, chunk_rows: int | None) -> DataFrame:
    spark = rows.sparkSession
    if weights and min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    rows = rows.withColumn("name", F.coalesce("source", F.lit("")))
    sizes = {r["name"]: r["n"] for r in rows.groupBy("name").agg(F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()}
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    if not sizes:
        return rows.selectExpr("doc_id", "source", "0L block", "0L slot", "0L position", *carry)
    names = sorted(sizes)
    given = {k: w if isinstance(w, Fraction) else Fraction(str(w)) for k, w in (weights or {}).items()}
    mean = sum(given.values()) / len(given) if given else Fraction(1)
    whole = whole_weights({k: given.get(k, mean) for k in names})
    most = max(MOST_NUMBERS // len(names), 2 * len(names))
    if sum(whole.values()) > most:  # then all blocks must fit, the last one of each source being a part of one
        block = max(block, -(-sum(sizes.values()) // (most - len(names))))
    phases = schedule([-(-sizes[k] // block) for k in names], [whole[k] for k in names], most)
    rows_of = ", ".join(f"({k}, {', '.join(f'{x}L' for x in r)}, '{','.join(map(str, slots))}')" for k, *r, slots in phases)
    table = spark.sql(f"select no, from_block, to_block, first_slot, per_blocks, per_slots, cast(split(slots, ',') as array<bigint>) slots from values {rows_of} as t(no, from_block, to_block, first_slot, per_blocks, per_slots, slots)")

    # rank within a source: chunks by hash range, then offsets of chunks
    largest = max(sizes.values())
    # as many chunks as rows in a chunk: both stay small for any source
    chunks = max(1, math.ceil(largest / (chunk_rows or max(LEAST_CHUNK, math.isqrt(largest)))))
    rows = rows.withColumn("chunk", F.pmod(F.shiftrightunsigned("hash", 16), F.lit(chunks)))
    offsets = rows.groupBy("name", "chunk").agg(F.count("*").alias("n"))
    offsets = offsets.selectExpr("name", "chunk", "coalesce(sum(n) over (partition by name order by chunk rows between unbounded preceding and 1 preceding), 0) before")
    ranked = rows.selectExpr("*", "row_number() over (partition by name, chunk order by hash, doc_id) - 1 place")
    ranked = ranked.join(offsets, ["name", "chunk"]).withColumn("rank", F.col("place") + F.col("before"))
    number = F.array_position(F.array(*map(F.lit, names)), F.col("name")) - 1
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / block)).withColumn("number", number)
    # at most one row a source and phase, with MOST_NUMBERS slots in all: bounded, whatever the number of rows
    here = (F.col("number") == F.col("no")) & (F.col("block") >= F.col("from_block")) & (F.col("block") < F.col("to_block"))
    out = ranked.join(F.broadcast(table), here)
    out = out.withColumn("slot", F.expr("first_slot + (block - from_block) div per_blocks * per_slots + slots[cast(pmod(block - from_block, per_blocks) as int)]"))
    return out.select("doc_id", "source", "block", "slot", (F.col("slot") * block + F.pmod("rank", F.lit(block))).alias("position"), *carry)


def _hash(docs: DataFrame, doc_id: str) -> Column:
    """A hash that deals a source's rows out; rows without a doc_id go by all they hold, so that they are no hot key."""
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    key = F.col(doc_id).cast("long")
    return F.when(key.isNull(), F.xxhash64(F.lit(11), *plain)).otherwise(F.xxhash64(key, F.lit(11)))
