"""Near-duplicate documents by min-max hashing.

Every permutation (a keyed multiply of 64-bit shingle hashes) gives two signature values, the minimum and the maximum, so
that a band of r rows costs r/2 hash evaluations. Both extremes agree between two sets with probability J, and they are
hardly correlated, so bands of them collide like bands of plain minima at half the hashing.

Steps, all of which work on one row per distinct shingle set (exact copies meet in an aggregate first):

1. one pass over the texts gives set size, set digest and band keys;
2. in every band bucket each set is paired with the bucket's smallest document only; these pairs are confirmed on the full
   sets, and components are formed;
3. buckets that still hold several components are compared completely across components: small ones as pairs, large ones
   in blocks of bounded size, each of them a task of its own. A pair is tested only if it can change a component, so a
   group of thousands of near copies never gives all its pairs.

Number of bands: the smallest with which a pair at the threshold is missed with probability under ``miss``.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.words import U, mix, windows, word_hashes
from plumbline.operators.network import connected
from plumbline.session import materialize, share_code

ROWS = 6
BLOCK = 256
SMALL_BUCKET = 24


def bands_for(threshold: float, rows: int = ROWS, miss: float = 1e-6) -> int:
    return max(1, math.ceil(math.log(miss) / math.log(1 - threshold**rows)))


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(windows(word_hashes(text)[0], n))


def signature(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each keyed permutation, interleaved; hashes must not be empty."""
    out = np.empty(2 * len(keys), U)
    for i in range(0, len(keys), 16):
        part = (hashes[None, :] ^ keys[i : i + 16, :1]) * keys[i : i + 16, 1:]
        part ^= part >> U(32)
        out[2 * i : 2 * i + 2 * len(part) : 2] = part.min(axis=1)
        out[2 * i + 1 : 2 * i + 2 * len(part) : 2] = part.max(axis=1)
    return out


def permutation_keys(n: int, seed: int = 7) -> np.ndarray:
    keys = np.random.default_rng(seed).integers(0, 1 << 63, (n, 2), dtype=np.int64).astype(U)
    keys[:, 1] = keys[:, 1] << U(1) | U(1)
    return keys


def band_keys(hashes: np.ndarray, keys: np.ndarray, rows: int) -> np.ndarray:
    values = signature(hashes, keys).reshape(-1, rows)
    out = np.arange(len(values), dtype=U) * U(0x9E3779B97F4A7C15)
    for i in range(rows):
        out = mix(out ^ values[:, i])
    return out.view(np.int64)


def _sets(n: int, bands: int, rows: int):
    keys = permutation_keys(bands * rows // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, low, high, out = [], [], [], []
                for text in part.column(1).to_pylist():
                    s = shingles(text, n)
                    sizes.append(len(s))
                    digest = _digest(s)
                    low.append(digest[0])
                    high.append(digest[1])
                    out.append(band_keys(s, keys, rows) if len(s) else np.zeros(0, np.int64))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(sizes, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(out) if out else [], pa.int64()))],
                    names=["doc_id", "text_hash", "n_shingles", "low", "high", "bands"],
                )

    return run


def _digest(s: np.ndarray) -> tuple[int, int]:
    return (int(np.add.reduce(s, dtype=U).view(np.int64)), int(np.bitwise_xor.reduce(mix(s + U(1))).view(np.int64))) if len(s) else (0, 0)


def _shingle_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [shingles(t, n) for t in batch.column(0).slice(at, 256).to_pylist()]
                digests = [_digest(s) for s in sets]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                items = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64) if sets else [], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in sets], pa.int64()), *(pa.array([d[k] for d in digests], pa.int64()) for k in (0, 1)), items], names=["n_shingles", "low", "high", "items"])

    return run


def _confirmed(pairs: DataFrame, items: DataFrame, share: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets have 100 * intersection >= share * union."""
    x, y = items.select(F.col("node").alias("a"), F.col("items").alias("x")), items.select(F.col("node").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(x, "a").join(y, "b").withColumn("both", both).where(100 * F.col("both") >= share * (F.size("x") + F.size("y") - F.col("both"))).select("a", "b")


def _blocks(share: int):
    """Edges that join components among the texts of one pair of blocks."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids, side = rows["node"].to_numpy(), rows["side"].to_numpy()
        sets = [np.asarray(x, dtype=np.int64) for x in rows["items"]]
        size = np.array([len(x) for x in sets])
        leader = {}

        def find(c):
            while (up := leader.get(c, c)) != c:
                leader[c] = leader.get(up, up)
                c = up
            return c

        values, where = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(size)
        order = np.argsort(where, kind="stable")
        owners, cuts = np.repeat(np.arange(len(sets)), size)[order], np.searchsorted(where[order], np.arange(len(values) + 1))
        edges, comp = [], rows["comp"].to_numpy()
        for i in range(len(ids)):
            own = where[ends[i] - size[i] : ends[i]]
            count = cuts[own + 1] - cuts[own]
            at = np.repeat(cuts[own] - np.cumsum(count) + count, count) + np.arange(count.sum())
            common = np.bincount(owners[at], minlength=len(ids))
            near = np.flatnonzero(100 * common >= share * (size + size[i] - common))
            for j in near[near > i]:
                a, b = find(comp[i]), find(comp[j])
                if a != b and (side[i] != side[j] or key[1] == key[2]):
                    leader[max(a, b)] = min(a, b)
                    edges.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        return pd.DataFrame(edges, columns=["a", "b"]).astype("int64")

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, share: int = 80, rows: int = ROWS, miss: float = 1e-6, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, text_hash (xxhash64 of the text, to find the row again).

    share is the least similarity in hundredths. Defined results: a null or empty text has no shingles, links with nothing
    and is kept; every row is a document of its own, also where a doc_id
    repeats (rows of the smallest doc_id of a component are all kept); a null doc_id is linked with nothing, its component_id is null and it is kept; other columns are ignored.
    """
    spark = docs.sparkSession
    share_code(spark)
    bands = bands_for(share / 100, rows, miss)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sets = base.mapInArrow(_sets(shingle, bands, rows), "doc_id long, text_hash long, n_shingles long, low long, high long, bands array<long>")
    sets = materialize(sets, "sets")

    digest = ["n_shingles", "low", "high"]
    keyed = sets.where("n_shingles > 0 and doc_id is not null")
    classes = keyed.groupBy(*digest).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    classes = materialize(classes.withColumn("node", F.xxhash64(*digest)), "classes")
    buckets = classes.select("node", F.explode("bands").alias("bucket"))
    crowded = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
    members = materialize(buckets.join(crowded, "bucket"), "members")
    nodes = materialize(members.select("node").distinct(), "nodes")

    pairs = members.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    wanted = classes.join(nodes, "node", "left_semi").select("rep", "node")
    texts = base.join(wanted.select("rep").distinct(), base.doc_id == F.col("rep"), "left_semi").select("text")
    items = texts.mapInArrow(_shingle_rows(shingle), "n_shingles long, low long, high long, items array<long>")
    items = items.withColumn("node", F.xxhash64(*digest)).groupBy("node").agg(F.first("items").alias("items"))
    items = materialize(items, "items")
    edges = materialize(_confirmed(pairs, items, share), "edges")
    labels = materialize(connected(nodes, edges), "components")

    # what is left: buckets that hold several components
    marked = members.join(labels, "node")
    mixed = marked.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("bucket")
    rest = materialize(marked.join(mixed, "bucket").select("bucket", "n", "node", "comp", "least"), "rest")
    small = rest.where(F.col("n") <= SMALL_BUCKET)
    x = small.select("bucket", F.col("node").alias("a"), F.col("comp").alias("ca"))
    y = small.select("bucket", F.col("node").alias("b"), F.col("comp").alias("cb"), "least")
    more = _confirmed(x.join(y, "bucket").where("a < b and ca <> cb and a <> least").select("a", "b").distinct(), items, share)

    # each row of a large bucket goes to the pairs of blocks that its own block is in; how many there are follows n
    large = rest.where(F.col("n") > SMALL_BUCKET).withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int"))
    large = large.withColumn("side", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = large.select("bucket", "node", "comp", "side", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "node", "comp", "side")
    found = dealt.join(items, "node").groupBy("bucket", "i", "j").applyInPandas(_blocks(share), "a long, b long")
    every = edges.union(more).union(found).distinct()

    labels = connected(nodes, every)
    named = classes.join(labels, "node", "left").select(*digest, "rep", F.coalesce("comp", "node").alias("comp"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "comp").select(*digest, "component_id")
    out = sets.join(named, digest, "left")
    comp = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", "text_hash", F.when(F.col("doc_id").isNotNull(), comp).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))).select("doc_id", "n_shingles", "component_id", "kept", "text_hash")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that near_duplicates() keeps, all columns unchanged. Rows equal in doc_id and text share their fate."""
    found = near_duplicates(docs, doc_id=doc_id, text=text, **options).where("not kept")
    gone = found.select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash")).distinct()
    same = (docs[doc_id].cast("long") == F.col("_gone_id")) & (F.xxhash64(docs[text].cast("string")) == F.col("_gone_hash"))
    return docs.join(gone, same, "left_anti")


#: DuckDB SQL of near_duplicates(documents, 3, 85) without text_hash, by comparing all documents that share a shingle.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (min(a.n) + min(b.n) - count(*))),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.b, r.c FROM r JOIN e ON r.doc_id = e.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1) USING (doc_id)
"""
