"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words; its hash covers the words at the mask's ones only, so that a substituted
word at a zero changes nothing. Masked hashes of the documents are joined with those of the benchmark items; a hit names
a diagonal (document word minus item word), along which words are compared and every long enough region with enough identity is an
overlap. The masks are chosen so that none is missed: however a fifth of the words of a region of MIN_WORDS or more is substituted,
one placement of one mask is untouched (enumerated in the tests). Shorter items have masks over their whole length.

The benchmark is a stated query set: it is dealt into blocks of bounded size, and each block is broadcast and passed over
all documents once. Its size decides the number of blocks, and never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.words import PUNCTUATED, U, code_points, mix, utf8, word_hashes
from plumbline.session import share_code

#: Masks for items of MIN_WORDS words or more. Found by trying all pairs of masks of five ones and up to nine places: however a fifth
#: of any 12 or more words is substituted, one placement of one of them is untouched.
MASKS = ("111011", "110100011")
MIN_WORDS = 12
IDENTITY = 0.8
#: Code points of item texts in one broadcast block.
BLOCK_CHARS = 8_000_000
#: Pairs of runs that are looked at together.
PORTION = 1 << 18
_BITS = 22


def masks_for(n: int) -> tuple[str, ...]:
    """The masks of an item of n words: of one shorter than MIN_WORDS, every other word (or third, as many as leave one untouched
    when a fifth is substituted), from each start."""
    if n >= MIN_WORDS:
        return MASKS
    apart = n // 5 + 1
    return tuple("".join("1" if k % apart == r else "0" for k in range(n)) for r in range(apart)) if n else ()


def masked(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each placement of a mask."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.full(n, U(int("1" + mask, 2)))
    for k, c in enumerate(mask):
        if c == "1":
            out = (out ^ words[k : k + n]) * U(0x9E3779B97F4A7C15)
            out ^= out >> U(32)
    return mix(out)


def _runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal hashes begin, and their lengths: a word that is repeated on and on is one run."""
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(h)))


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), then those of first[1], and so on."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


class Index:
    """The masked hashes of some items, sorted, with a bit table in front that most hashes of other texts do not pass."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.words = [i for i, _ in items], [word_hashes(t, PUNCTUATED)[0] for _, t in items]
        self.masks = sorted({m for n in {len(w) for w in self.words} for m in masks_for(n)})
        rows: list[tuple[np.ndarray, ...]] = [(np.zeros(0, U), *(np.zeros(0, np.int64),) * 3)]
        for k, words in enumerate(self.words):
            for m in masks_for(len(words)):
                h = masked(words, m)
                first, length = _runs(h)
                rows.append((h[first], np.full(len(first), k), first, length))
        h, owner, place, length = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.argsort(h, kind="stable")
        self.hashes, self.owner, self.place, self.length = h[order], owner[order], place[order], length[order]
        self.table = np.zeros(1 << _BITS, bool)
        self.table[(self.hashes >> U(64 - _BITS)).astype(np.int64)] = True

    def diagonals(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, diagonal) of all hits, without repeats, sorted.

        Runs meet as wholes and give a range of diagonals, and pairs of runs are expanded in portions, so that memory follows the
        number of different diagonals and not that of hits.
        """
        keys = np.zeros(0, np.int64)
        for m in self.masks:
            h = masked(words, m)
            at = np.flatnonzero(self.table[(h >> U(64 - _BITS)).astype(np.int64)])
            if not len(at):
                continue
            first, length = _runs(h)
            kept = self.table[(h[first] >> U(64 - _BITS)).astype(np.int64)]
            first, length = first[kept], length[kept]
            low, high = np.searchsorted(self.hashes, h[first], "left"), np.searchsorted(self.hashes, h[first], "right")
            upto = np.cumsum(high - low)
            a = 0
            while a < len(first) and upto[-1]:
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PORTION, "right")))
                n = high[a:b] - low[a:b]
                here, doc = _spread(low[a:b], n), np.repeat(np.arange(a, b), n)
                least = first[doc] - self.place[here] - self.length[here] + 1
                new = _spread((self.owner[here] << 40) + (1 << 39) + least, length[doc] + self.length[here] - 1)
                keys = np.unique(np.concatenate([keys, new]))
                a = b
        return keys >> 40, (keys & ((1 << 40) - 1)) - (1 << 39)

    def overlaps(self, words: np.ndarray, min_words: int, identity: float) -> list[tuple[int, int, int, int, int, int]]:
        """(item number, first word in the text, end word, and of its longest region: first word in the item, words, words that agree).

        Regions of one item that overlap in the text, on whatever diagonals, are one row.
        """
        found = []
        for k, diagonal in zip(*(x.tolist() for x in self.diagonals(words)), strict=True):
            item = self.words[k]
            low, high = max(0, -diagonal), min(len(item), len(words) - diagonal)
            for a, b, n in regions(item[low:high] == words[low + diagonal : high + diagonal], identity, min(min_words, len(item))):
                found.append((k, low + a + diagonal, low + b + diagonal, low + a, b - a, n))
        out: list[tuple[int, int, int, int, int, int]] = []
        for row in sorted(found):
            if out and out[-1][0] == row[0] and row[1] < out[-1][2]:
                best = max(out[-1], row, key=lambda x: x[4])
                out[-1] = (row[0], out[-1][1], max(out[-1][2], row[2]), *best[3:])
            else:
                out.append(row)
        return out


def regions(same: np.ndarray, identity: float, least: int) -> list[tuple[int, int, int]]:
    """(begin, end, agreeing) of disjoint runs of at least least places: the longest one, then those before and after it."""
    out, todo = [], [(0, len(same))]
    while todo:
        low, high = todo.pop()
        if high - low < least or np.count_nonzero(same[low:high]) < identity * least - 1e-9:
            continue
        found = best_region(same[low:high], identity)
        if found and found[1] - found[0] >= least:
            out.append((low + found[0], low + found[1], found[2]))
            todo += [(low, low + found[0]), (low + found[1], high)]
    return out


def best_region(same: np.ndarray, identity: float) -> tuple[int, int, int] | None:
    """(begin, end, agreeing) of the longest run that begins and ends with agreement and of which at least identity agrees."""
    at = np.flatnonzero(same)
    if not len(at):
        return None
    # for begin a and end b among agreeing places, agreeing - identity * length >= 0 is a rise of this sum over what is before a
    rank = np.arange(len(at))
    before, upto = rank - identity * at, rank + 1 - identity * (at + 1)
    lowest = np.minimum.accumulate(before)
    best = None
    for b in range(len(at) - 1, -1, -1):
        if best is not None and at[b] + 1 - at[0] <= best[1] - best[0]:
            break
        a = int(np.searchsorted(-lowest, -(upto[b] + 1e-9)))  # the first begin from which b is reached with enough agreement
        if a <= b and (best is None or at[b] + 1 - at[a] > best[1] - best[0]):
            best = (int(at[a]), int(at[b]) + 1, b - a + 1)
    return best


def _search(index, min_words: int, identity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = index.value
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                words, start, end = word_hashes(text, PUNCTUATED)
                found = here.overlaps(words, min_words, identity)
                if found:
                    place = code_points(utf8(text))
                    rows += [(doc, here.ids[k], int(place[start[a]]), int(place[end[b - 1]]), i, n, same) for k, a, b, i, n, same in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "item_id", "start", "end", "item_word", "n_words", "n_same"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, identity: float = IDENTITY, block_chars: int = BLOCK_CHARS, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per place of a document that overlaps with a benchmark item: doc_id, item_id, start, end (code points in the
    document, end exclusive), item_word (the first word in the item), n_words, n_same.

    An overlap is an aligned region of at least min_words words (or the whole item, if shorter) that begins and ends with
    agreement and of which at least the share identity agrees; none is missed if that is 0.8 or more. Words are runs of letters and digits, in ASCII lower case. All
    regions count; those of an item that overlap in the document are one row, whose last three columns tell of the longest.

    Defined results: null and empty texts and items overlap with nothing; items with a null id are left out; a repeated
    item_id counts with each of its texts (one row each); rows with repeated or null doc_ids are searched each by itself;
    other columns are ignored; an empty table on either side gives no rows.
    """
    share_code(docs.sparkSession)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    out = None
    for index in indexes(benchmark, block_chars, item_id, item_text):
        part = base.mapInArrow(_search(index, min_words, identity), "doc_id long, item_id long, start long, end long, item_word long, n_words long, n_same long")
        out = part if out is None else out.union(part)
    return out


def indexes(benchmark: DataFrame, block_chars: int = BLOCK_CHARS, item_id: str = "item_id", item_text: str = "text") -> Iterator:
    """Broadcast indexes of the benchmark's blocks, at least one; their number follows the length of all items."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_chars))
    for k in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield benchmark.sparkSession.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in own.orderBy("item_id", "text").toLocalIterator()]))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, identity: float = IDENTITY, block_chars: int = BLOCK_CHARS, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that overlap with no benchmark item, by contaminated()'s rule; all columns stay, and nothing shuffles."""
    share_code(docs.sparkSession)
    at = docs.columns.index(text)

    def clean(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here = index.value
            for batch in batches:
                free = [not here.overlaps(word_hashes(t.as_py(), PUNCTUATED)[0], min_words, identity) for t in batch.column(at)]
                yield batch.filter(pa.array(free, pa.bool_()))

        return run

    for index in indexes(benchmark, block_chars, item_id, item_text):
        docs = docs.mapInArrow(clean(index), docs.schema)
    return docs
