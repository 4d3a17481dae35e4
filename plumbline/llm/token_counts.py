"""Exact token counts by dynamic programming over prefixes.

For a piece of text within which merges happen, the count at every byte prefix follows from shorter prefixes: the last
token of a prefix is the one that ends there, whose predecessor is the last token of the prefix before it, and that the
merge rules would not have merged otherwise; then count[i] = count[i - len(token)] + 1. Tables are kept per distinct
piece. The counts at all prefixes of a text follow by adding the pieces' tables, so that truncation and budget questions
are answered from the tables, without encoding any prefix again, in time that follows the length of the text.

Whole arrays of texts are cut into chunks where a piece surely ends, and the tables of new chunks that are one word are made
in sorted order, each from where it parts from the one before.

Chunks with characters outside SAFE are cut into pieces by the library's own pre-tokenizer, and special strings are taken out
before as the library does. Cuts that change the last pieces have closed forms: white space at the end of a prefix is one
piece from where it begins, and a contraction that is cut is an apostrophe and a letter.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.pieces import MEMORY, Known, Memo, cut, library, specials, split, steps, words
from plumbline.session import share_code


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others take the code points from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else free))
        free += b not in plain
    return out


class PrefixCounter:
    """Prefix tables of one byte-level BPE vocabulary."""

    def __init__(self, path: str):
        self.library, self.marks = library(path), specials(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        back = {c: b for b, c in enumerate(byte_symbols())}
        ids = model["vocab"]
        plain = {t: bytes(back[c] for c in t) for t in ids if all(c in back for c in t)}
        made = {"".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]}
        # a token counts only if merges can make it: others of the vocabulary never come out of an encoding
        self.tokens = {plain[t] for t in made} | {bytes([b]) for b in range(256)}
        self.symbols, self.model = dict(enumerate(byte_symbols())), self.library.model
        ends: dict[bytes, set[int]] = {}
        for t in self.tokens:
            if len(t) > 1:
                ends.setdefault(t[-2:], set()).add(len(t))
        #: The lengths of the tokens that end with two given bytes, longest first.
        self.lengths = {k: (*sorted(v, reverse=True), 1) for k, v in ends.items()}
        self.follows: dict[tuple[bytes, bytes], bool] = {}
        self.pieces = Memo(lambda new: [self.table(p.encode()) for p in new])
        self.known = Known(self.learn, MEMORY)
        # white space by the library's own tables: it ends before a mark, and is neither letter nor digit
        cut = self.library.pre_tokenizer.pre_tokenize_str
        self.white = frozenset(c for c in map(chr, range(0x3001)) if (c.isspace() or unicodedata.category(c)[0] in "ZC") and len(cut(c + "!")) == 2 or c == " ")

    def may_follow(self, a: bytes, b: bytes) -> bool:
        found = self.follows.get((a, b))
        if found is None:
            if len(self.follows) > 2_000_000:
                self.follows.clear()
            # the merge rules decide, as the library applies them: the two must come out as they went in
            out = self.model.tokenize((a + b).decode("latin-1").translate(self.symbols))
            found = self.follows[a, b] = len(out) == 1 + bool(a) and len(out[0].value) == len(a or b)
        return found

    def extend(self, raw: bytes, count: list[int], last: list[bytes]) -> None:
        """Carry the counts and last tokens of some prefixes of a piece, from length 0 on, to its end."""
        one = (1,)
        for end in range(len(count), len(raw) + 1):
            for n in self.lengths.get(raw[max(0, end - 2) : end], one):
                start = end - n
                if start < 0:
                    continue
                token = raw[start:end]
                # the longest token that ends here and is compatible with the encoding of what is before it
                if token in self.tokens and self.may_follow(last[start], token):
                    count.append(count[start] + 1)
                    last.append(token)
                    break
            else:
                raise AssertionError("a byte without a token")

    def table(self, raw: bytes) -> tuple[int, ...]:
        """The number of tokens of each prefix of a piece, from length 0 on."""
        count = [0]
        self.extend(raw, count, [b""])
        return tuple(count)

    def ends_of_tables(self, pieces: list[bytes]) -> list[int]:
        """The last entry of each piece's table. In sorted order, a table begins as the one before as far as the pieces agree."""
        out, count, last, before = [0] * len(pieces), [0], [b""], b""
        for k in sorted(range(len(pieces)), key=pieces.__getitem__):
            raw, same = pieces[k], 0
            for x, y in zip(raw, before):  # noqa: B905
                if x != y:
                    break
                same += 1
            del count[same + 1 :], last[same + 1 :]
            self.extend(raw, count, last)
            out[k], before = count[-1], raw
        return out

    def learn(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of tokens of each chunk, as rows of one number."""
        one = words(chunks) > 0
        for mark in self.marks:
            one[pc.match_substring(chunks, mark).to_numpy(zero_copy_only=False)] = False
        out = np.zeros(len(chunks), np.uint32)
        out[one] = self.ends_of_tables(chunks.filter(pa.array(one)).to_pylist())
        out[~one] = [self.count(c.decode()) for c in chunks.filter(pa.array(~one)).to_pylist()]
        return np.ones(len(chunks), np.int64), out

    def tables(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """The tables of pieces; those of very long ones are not kept."""
        if max(map(len, pieces), default=0) <= LONG:
            return self.pieces.of(pieces)
        short = iter(self.pieces.of([p for p in pieces if len(p) <= LONG]))
        return [next(short) if len(p) <= LONG else self.table(p.encode()) for p in pieces]

    def of_pieces(self, pieces: list[str]) -> int:
        return sum([table[-1] for table in self.tables(pieces)])

    def split(self, text: str) -> list[str]:
        """The pieces of a text without special strings."""
        found = split(text)
        if found is None:
            found = [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return found

    def parts(self, text: str) -> list[str]:
        """The text cut around special strings: every second part is one."""
        out, at = [], 0
        while self.marks:
            found = min(((k, -len(m)) for m in self.marks if (k := text.find(m, at)) >= 0), default=None)
            if found is None:
                break
            out += [text[at : found[0]], text[found[0] : found[0] - found[1]]]
            at = found[0] - found[1]
        return [*out, text[at:]]

    def count(self, text: str) -> int:
        """The number of tokens of a text."""
        if any(m in text for m in self.marks):
            return sum(1 if k % 2 else self.count(p) for k, p in enumerate(self.parts(text)))
        return self.of_pieces(self.split(text))

    def counts_within(self, texts: pa.Array, budget: int) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, length of the longest prefix of at most budget tokens) of each text."""
        chunks, first = cut(texts, self.marks)
        place, _, _, numbers = self.known.of(chunks)
        done = np.concatenate([[0], np.cumsum(numbers[place], dtype=np.int64)])
        totals = np.diff(done[first])
        fits = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        over = np.flatnonzero(totals > budget)
        # the prefix ends in the chunk that goes beyond the budget; chunks before it are whole pieces
        beyond = np.searchsorted(done, done[first[over]] + budget, "right") - 1
        _, offsets, data = chunks.buffers()
        offsets, begins = np.frombuffer(offsets, np.int32), np.frombuffer(data or b"", np.uint8) & 0xC0 != 0x80
        for k, at in zip(over.tolist(), beyond.tolist(), strict=True):
            before = np.count_nonzero(begins[offsets[first[k]] : offsets[at]])
            fits[k] = before + self.longest_prefix(chunks[at].as_py().decode(), budget - int(done[at] - done[first[k]]))
        return totals, fits

    def count_within(self, text: str, budget: int) -> tuple[int, int]:
        """(tokens of the text, length of its longest prefix of at most budget tokens)."""
        totals, fits = self.counts_within(pa.array([text], pa.string()), budget)
        return int(totals[0]), int(fits[0])

    def _within(self, pieces: list[str], tables: list, done: list[int], k: int) -> list[int]:
        """The counts of the prefixes that end inside or at the end of piece k; done has the tokens before each piece."""
        piece, table, out = pieces[k], tables[k], []
        if piece[0] == "'" and len(piece) == 3 and piece[1].isalpha():  # a contraction of two letters, or whole by itself
            return [done[k] + 1, done[k] + 1 + self.of_pieces([piece[1]]), done[k] + table[-1]]
        lead = next((n for n, c in enumerate(piece) if c not in self.white), len(piece))
        if lead:  # white space at the end is one piece from where it begins
            first = k
            while first and all(c in self.white for c in pieces[first - 1]):
                first -= 1
            before = "".join(pieces[first:k])
            run, size = self.tables([before + piece[:lead]])[0], len(before.encode())
            for c in piece[:lead]:
                size += len(c.encode())
                out.append(done[first] + run[size])
        size = len(piece[:lead].encode())
        for c in piece[lead:]:
            size += len(c.encode())
            out.append(done[k] + table[size])
        return out

    def _plain(self, text: str) -> tuple[list[str], list[tuple[int, ...]], list[int]]:
        pieces = self.split(text)
        tables = self.tables(pieces)
        return pieces, tables, list(accumulate((t[-1] for t in tables), initial=0))

    def prefix_counts(self, text: str) -> list[int]:
        """The number of tokens of text[:k] for every k from 0 to its length, each as if encoded on its own."""
        out, base = [0], 0
        parts = self.parts(text)
        for at in range(0, len(parts), 2):
            mark = parts[at + 1] if at + 1 < len(parts) else ""
            # a special string that is cut is plain text after what stands before it
            pieces, tables, done = self._plain(parts[at] + mark[:-1])
            out += [base + n for k in range(len(pieces)) for n in self._within(pieces, tables, done, k)]
            if mark:
                base += self.count(parts[at]) + 1
                out.append(base)
        return out

    def longest_prefix(self, text: str, budget: int) -> int:
        """The largest k for which text[:k] has at most budget tokens."""
        parts, at, base = self.parts(text), 0, 0
        # plain parts and special strings that fit as wholes come first; counts never fall from one part's end to the next
        for k in range(0, len(parts), 2):
            mark = parts[k + 1] if k + 1 < len(parts) else ""
            after = base + self.count(parts[k]) + bool(mark)
            if after > budget or k + 2 >= len(parts):
                break
            at, base = at + len(parts[k]) + len(mark), after
        pieces, tables, done = self._plain(parts[k] + mark[:-1])
        ends = list(accumulate(map(len, pieces), initial=0))
        # a prefix that ends in a piece has a token more than those before it, or before the white space that it ends
        n = bisect_right(done, budget - base)
        for i in range(min(n + 1, len(pieces) - 1), -1, -1):
            fits = [j for j, c in enumerate(self._within(pieces, tables, done, i), 1) if base + c <= budget]
            if fits:
                return at + ends[i] + fits[-1]
        return at


#: Tables of longer pieces are not kept in memory.
LONG = 512
#: Bytes of text that are counted together.
STEP = 1 << 22


@functools.lru_cache(maxsize=2)  # a reused Python worker keeps its tables for its next tasks
def prefix_counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit, fits_chars (code points of the longest prefix of at most
    limit tokens, from the prefix tables).

    Defined results: a null text is empty and has no tokens; rows with a repeated or null doc_id are counted each by itself;
    other columns are ignored; no rows give no rows.
    """
    share_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(path)
        for batch in batches:
            for at, upto in steps(batch.column(2), STEP):
                part = batch.slice(at, upto - at)
                counts, fits = counter.counts_within(part.column(2), limit)
                columns = [part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array(counts > limit, pa.bool_()), pa.array(fits, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fits_chars"])

    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.octet_length(whole).cast("long").alias("n_bytes"), whole.alias("text"))
    return base.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fits_chars long")


def truncate(docs: DataFrame, path: str, budget: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with each text cut to its longest prefix of at most budget tokens, and n_tokens, the tokens of that prefix.

    A null text stays null with 0 tokens; all other columns stay.
    """
    share_code(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(path)
        for batch in batches:
            for begin, end in steps(pc.fill_null(batch.column(at), ""), STEP):
                part = batch.slice(begin, end - begin)
                whole = pc.fill_null(part.column(at), "")
                fits = counter.counts_within(whole, budget)[1].tolist()
                texts = [None if t is None else t[:k] for t, k in zip(part.column(at).to_pylist(), fits, strict=True)]
                counts = counter.counts_within(pa.array([t or "" for t in texts], pa.string()), budget)[0]
                columns = [pa.array(texts, pa.string()) if i == at else part.column(i) for i in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], names=[*part.schema.names, "n_tokens"])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(run, f"{schema}, n_tokens long")


