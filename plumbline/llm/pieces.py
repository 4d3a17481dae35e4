"""Splitting texts into the pieces within which a byte-level BPE merges.

Merges never cross a piece, so a text's ids are those of its pieces in order, and work per distinct piece can be kept in a
bounded memory. cut() finds ends of pieces on which all Unicode tables agree, in whole arrays of texts; what lies between
is left to the library. split() gives the pieces themselves, but not of texts with characters outside SAFE: there, the
library's Unicode tables and the pattern engine's may differ.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Fixed: the published pattern of this vocabulary's pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_split = regex.compile(PATTERN).findall
_unsafe = regex.compile(r"[^\t\n\r\x20-\x7E\xA1-ȳΑ-ΡΣ-ϿЀ-ҁ‐-‧‰-⁞€]").search
MEMORY = 1_000_000
#: Chunks that Known keeps, and their greatest length in bytes.
KEPT, LONG = 500_000, 64


class Memo(dict):
    """Values by piece, made many at a time and forgotten all at once when there are more than limit."""

    def __init__(self, make: Callable[[list[str]], Iterable], limit: int = MEMORY):
        super().__init__()
        self.make, self.limit = make, limit

    def of(self, keys: list[str]) -> list:
        """The values of keys, made where they are missing."""
        found = list(map(self.get, keys))
        if None in found:
            new = list({k for k in keys if k not in self})
            if len(self) + len(new) > self.limit:
                self.clear()
                new = list(set(keys))
            self.update(zip(new, self.make(new), strict=True))
            found = list(map(self.__getitem__, keys))
        return found


def split(text: str) -> list[str] | None:
    """The pieces of a text, or None where only the library can tell."""
    return None if _unsafe(text) else _split(text)


def specials(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f).get("added_tokens", [])]


def library(path: str):
    """The tokenizer of a .json file, single-threaded: Spark's tasks are the parallelism."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


# kinds of bytes: letters and digits, other visible ASCII, white space, those of longer characters, controls (0)
_ALNUM, _MARK, _WHITE, _WIDE = 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = _MARK
_KIND[[b for b in range(128) if chr(b).isalnum()]] = _ALNUM
_KIND[list(b" \n\t\r")] = _WHITE
_KIND[128:] = _WIDE
#: Whether a piece ends between two kinds (first << 3 | second): before white space, and before a mark after a letter or digit.
_ENDS = np.zeros(64, bool)
_ENDS[[_ALNUM << 3 | _WHITE, _MARK << 3 | _WHITE, _ALNUM << 3 | _MARK]] = True
#: First bytes of two-byte characters that are all letters, and of characters none of which is white space.
_LETTERS = np.isin(np.arange(256), [0xD0, 0xD1])
_VISIBLE = np.isin(np.arange(256), [*range(0xC3, 0xE1), *range(0xE4, 0x100)])


def _bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings without nulls, and where each begins in them, with the end."""
    array = array.cast(pa.large_binary() if pa.types.is_binary(array.type) else pa.large_string())
    _, offsets, data = array.buffers()
    bounds = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    raw = np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]]
    return raw, bounds - bounds[0]


def cut(texts: pa.Array, marks: Iterable[str] = ()) -> tuple[pa.Array, np.ndarray]:
    """Cut texts where a piece surely ends: the chunks of all in order, as bytes, and the number of chunks before each text,
    with the total. Together less than 2^31 bytes.

    A piece ends before white space after a visible character, before an ASCII mark after a letter or digit, and after a
    line feed alone between visible characters; the pattern looks no further ahead than one character after white space, and
    no other chunk but the last of a text ends with that. So each chunk, encoded by itself, gives its part of the text's ids.
    Texts that hold one of marks stay whole.
    """
    raw, bounds = _bytes_of(texts)
    ends = np.zeros(len(raw) + 1, bool)
    if len(raw) > 1:
        kind = _KIND[raw]
        pair = kind[:-1] << 3 | kind[1:]
        np.take(_ENDS, pair, out=ends[1:-1])
        at = np.flatnonzero(pair == (_WIDE << 3 | _WHITE)) + 1
        one, two, three, four = (raw[np.maximum(at - k, 0)] for k in (1, 2, 3, 4))
        lead = np.where(two >= 0xC0, two, np.where(three >= 0xC0, three, four))
        ends[at] = _VISIBLE[lead]
        at = np.flatnonzero(pair == (_WIDE << 3 | _MARK)) + 1
        one, two = raw[at - 1], raw[np.maximum(at - 2, 0)]
        ends[at] = _LETTERS[two] | (two == 0xC3) & (one != 0x97) & (one != 0xB7)
        ends[bounds] = True
        at = np.flatnonzero(raw[:-1] == 10)
        after = kind[at + 1]
        ends[at[ends[at] & ((after == _ALNUM) | (after == _MARK))] + 1] = True
    ends[bounds] = True
    for mark in marks:
        for k in np.flatnonzero(pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)):
            ends[bounds[k] + 1 : bounds[k + 1]] = False
    offsets = np.flatnonzero(ends).astype(np.int32)
    chunks = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])
    return chunks, np.searchsorted(offsets, bounds)


def words(chunks: pa.Array) -> np.ndarray:
    """Chunks that are surely one piece: 1 for letters, 2 for a space and letters, 0 for others."""
    raw, bounds = _bytes_of(chunks)
    other = (_KIND[raw] != _ALNUM) | (raw < 65)
    at = np.flatnonzero(raw == 0xC3)
    at = at[(raw[at + 1] != 0x97) & (raw[at + 1] != 0xB7)]
    other[at] = other[at + 1] = False
    before = np.concatenate([[0], np.cumsum(other)])
    begins, sizes = bounds[:-1], np.diff(bounds)
    led = (sizes > 1) & (raw[np.minimum(begins, max(0, len(raw) - 1))] == 32) if len(raw) else np.zeros(len(chunks), bool)
    return ((sizes > 0) & (before[bounds[1:]] - before[begins] == led)) * (1 + led.astype(np.uint8))


def steps(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about size bytes, one text at least."""
    bounds, at = _bytes_of(texts)[1], 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        yield at, end
        at = end


class Known:
    """Rows of numbers by chunk, kept in arrays without an object for each: at most limit chunks, none longer than LONG."""

    def __init__(self, make: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], limit: int = KEPT):
        #: make: from chunks to the sizes of their rows and the rows behind each other
        self.make, self.limit = make, limit
        self.forget()

    def forget(self) -> None:
        self.keys, self.sizes, self.flat = pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def of(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place, begins, sizes, flat): the row of chunk k is flat[begins[place[k]]:][:sizes[place[k]]]."""
        found = chunks.dictionary_encode()
        place, keys = found.indices.to_numpy(), found.dictionary
        at = pc.fill_null(pc.index_in(keys, value_set=self.keys), -1).to_numpy()
        new = np.flatnonzero(at < 0)
        made = keys.take(pa.array(new))
        sizes, flat = self.make(made) if len(new) else (np.zeros(0, np.int64), np.zeros(0, np.uint32))
        at = at.copy()
        at[new] = len(self.keys) + np.arange(len(new))
        all_sizes, all_flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, flat])
        begins = np.cumsum(all_sizes) - all_sizes
        self.keep(made, sizes, flat)
        return at[place], begins, all_sizes, all_flat

    def keep(self, made: pa.Array, sizes: np.ndarray, flat: np.ndarray) -> None:
        if len(self.keys) + len(made) > self.limit:
            self.forget()
        short = pc.less_equal(pc.binary_length(made), LONG).to_numpy(zero_copy_only=False)
        if not short.all():
            flat, made, sizes = flat[np.repeat(short, sizes)], made.filter(pa.array(short)), sizes[short]
        if len(made) > self.limit:
            made, sizes = made[: self.limit], sizes[: self.limit]
            flat = flat[: sizes.sum()]
        self.keys = pa.concat_arrays([self.keys, made])
        self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, flat])


class Encoder:
    """From texts to their ids, equal to the library's without added tokens; chunks are encoded once while they are known."""

    def __init__(self, path: str):
        self.library, self.marks = library(path), specials(path)
        from tokenizers import Tokenizer, pre_tokenizers

        # the same merges for words, whose one piece is known, without the pattern
        self.plain = Tokenizer(self.library.model)
        self.plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.symbols = {c: s for b in [32, *range(128, 256)] if (s := _symbol(b)) != (c := chr(b))}
        self.feed, vocab = _symbol(10), self.library.get_vocab(with_added_tokens=False)
        self.feed_id = vocab[self.feed]
        #: Ids of tokens that begin with a space.
        self.led = np.zeros(max(vocab.values()) + 1, bool)
        self.led[[n for t, n in vocab.items() if t[0] == self.symbols[" "]]] = True
        self.known = Known(self.learn)

    def learn(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each chunk, and the ids behind each other."""
        kinds = words(chunks)
        for mark in self.marks:
            kinds[pc.match_substring(chunks, mark).to_numpy(zero_copy_only=False)] = 0
        sizes, order, flats = np.zeros(len(chunks), np.int64), [], []
        for kind in (0, 1, 2):
            todo = np.flatnonzero(kinds == kind)
            for at in range(0, len(todo), 4096 if kind == 0 else 32768):
                now = todo[at : at + (4096 if kind == 0 else 32768)]
                own = chunks.take(pa.array(now)).to_pylist()
                if kind == 0:
                    found = [x.ids for x in self.library.encode_batch_fast([x.decode() for x in own], add_special_tokens=False)]
                    sizes[now] = [len(x) for x in found]
                    ids = np.fromiter(chain.from_iterable(found), np.uint32)
                else:
                    # a word's first token is the one with a space; words without are set apart by line feeds
                    text = (b"\n" if kind == 2 else b"\n\0\n").join([*own, b""]).decode("latin-1")
                    for c, x in self.symbols.items():
                        text = text.replace(c, x)
                    ids = np.array(self.plain.encode_batch_fast([text.replace("\0", self.feed)], add_special_tokens=False)[0].ids, np.uint32)
                    if kind == 2:
                        sizes[now] = np.diff(np.flatnonzero(self.led[ids]), append=len(ids))
                    else:
                        ends = ids == self.feed_id
                        sizes[now] = np.diff(np.flatnonzero(ends) - np.arange(len(now)), prepend=0)
                        ids = ids[~ends]
                order.append(now)
                flats.append(ids)
        order = np.concatenate(order)
        flat = np.concatenate(flats)
        begins = np.zeros(len(chunks), np.int64)
        begins[order] = np.cumsum(sizes[order]) - sizes[order]
        return sizes, flat[_spread(begins, sizes)]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts behind each other, and where those of each begin, with the end."""
        chunks, first = cut(texts, self.marks)
        place, begins, sizes, flat = self.known.of(chunks)
        sizes = sizes[place]
        before = np.concatenate([[0], np.cumsum(sizes)])
        return flat[_spread(begins[place], sizes)], before[first]


def _spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of rows of sizes that begin at begins, behind each other."""
    out = np.repeat(begins - np.cumsum(sizes) + sizes, sizes)
    out += np.arange(len(out))
    return out


def _symbol(b: int) -> str:
    """The printable character that stands for a byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return chr(b if b in plain else 256 + sum(x not in plain for x in range(b)))


@functools.lru_cache(maxsize=2)  # a reused Python worker keeps what it has learned for its next tasks
def encoder(path: str) -> Encoder:
    return Encoder(path)
