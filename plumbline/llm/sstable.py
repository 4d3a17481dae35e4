"""Token ids in sorted-string-table shards: prefix-compressed blocks, sparse index, Bloom filter and footer.

A shard holds a range of documents in ascending key order::

    magic | data block ... | index | Bloom filter | footer

* key: one byte 0 for a null doc_id, else 1 and the doc_id as 8 bytes, big-endian with the sign bit turned, so that bytes
  sort like numbers; then 4 bytes that number rows of the same doc_id.
* data block: entries (shared key bytes, other key bytes, value bytes as varints; key rest; value). Every RESTART-th entry
  shares nothing; the offsets of these close the block, for a binary search in it. Blocks are compressed one by one and
  carry a CRC-32.
* value: position of the document in its input (8 bytes), width of an id (2 or 4), then the ids, little-endian.
* index: last key, offset and size of each block, loaded whole: one entry for about BLOCK bytes of ids.
* Bloom filter: BITS_PER_KEY bits a document over key hashes; a lookup that it rejects reads no block.
* footer: fixed size, at the end; offsets, counts, CRC-32 and magic.

Shards are written under a name of the attempt and moved to their final name when complete, so a lost or doubled task
leaves either a whole shard or none.
"""

from __future__ import annotations

import bisect
import io
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.pieces import encoder, steps
from plumbline.session import materialize, new_path, share_code

MAGIC = b"PLSST\x00\x01\n"
BLOCK = 1 << 18
RESTART = 16
BITS_PER_KEY = 10
#: Bytes of text that are encoded together.
STEP = 1 << 22
PROBES = 7
_FOOTER = struct.Struct("<QQQQQQI8s")


def key_of(doc_id: int | None, n: int = 0) -> bytes:
    return (b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + (1 << 63))) + struct.pack(">I", n)


def doc_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack_from(">Q", key, 1)[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _bloom_hash(key: bytes) -> int:
    """Of a key without its row number; two CRCs give 64 bits."""
    return zlib.crc32(key) << 32 | zlib.crc32(key, 0x5BD1E995)


def _probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    a, b = (hashes >> np.uint64(32))[:, None], (hashes & np.uint64(0xFFFFFFFF) | np.uint64(1))[:, None]
    return (a + b * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)


def pack_value(ids: bytes, position: int) -> bytes:
    """ids: little-endian unsigned 32-bit."""
    wide = np.frombuffer(ids, "<u4")
    width = 2 if not len(wide) or wide.max() < 1 << 16 else 4
    return struct.pack("<qB", position, width) + (wide.astype("<u2").tobytes() if width == 2 else ids)


def unpack_value(value: bytes) -> tuple[np.ndarray, int]:
    position, width = struct.unpack_from("<qB", value)
    return np.frombuffer(value, f"<u{width}", offset=9).astype("<u4"), position


class Writer:
    """Writes one shard to a binary file object; keys must ascend."""

    def __init__(self, out):
        self.out, self.at, self.index, self.hashes = out, 0, [], []
        self.count = self.tokens = 0
        self._write(MAGIC)
        self._begin()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _begin(self) -> None:
        self.block, self.restarts, self.entries, self.last = bytearray(), [], 0, b""

    def add(self, key: bytes, value: bytes, tokens: int) -> None:
        shared = 0
        if self.entries % RESTART:
            shared = len(os.path.commonprefix([self.last, key]))
        else:
            self.restarts.append(len(self.block))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.entries = key, self.entries + 1
        self.hashes.append(_bloom_hash(key[:-4]))
        self.count, self.tokens = self.count + 1, self.tokens + tokens
        if len(self.block) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if not self.entries:
            return
        raw = bytes(self.block) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
        packed = pa.compress(raw, codec="zstd", asbytes=True)
        self.index.append((self.last, self.at, len(packed) + 8, len(raw)))
        self._write(struct.pack("<II", zlib.crc32(packed), len(raw)) + packed)
        self._begin()

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QII", at, size, raw) for k, at, size, raw in self.index)
        bits = max(64, -(-self.count * BITS_PER_KEY // 64) * 64)
        marks = np.zeros(bits, bool)
        if self.hashes:
            marks[_probes(np.array(self.hashes, np.uint64), bits).ravel()] = True
        bloom = np.packbits(marks, bitorder="little").tobytes()
        where = self.at
        self._write(index)
        self._write(bloom)
        self._write(_FOOTER.pack(where, len(index), where + len(index), len(bloom), self.count, self.tokens, zlib.crc32(index + bloom), MAGIC))


class Reader:
    """Reads a shard from a seekable binary file object."""

    def __init__(self, source):
        self.source = source
        source.seek(0, io.SEEK_END)
        end = source.tell()
        at, size, bloom_at, bloom_size, self.count, self.tokens, crc, magic = _FOOTER.unpack(self._at(end - _FOOTER.size, _FOOTER.size))
        index, self.bloom = self._at(at, size), self._at(bloom_at, bloom_size)
        if magic != MAGIC or zlib.crc32(index + self.bloom) != crc:
            raise ValueError("not a whole shard")
        self.last, self.places, i = [], [], 0
        while i < len(index):
            n, i = _read_varint(index, i)
            self.last.append(index[i : i + n])
            self.places.append(struct.unpack_from("<QII", index, i + n))
            i += n + 16

    def _at(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def _block(self, k: int) -> tuple[bytes, list[int]]:
        at, size, raw_size = self.places[k]
        data = self._at(at, size)
        crc, _ = struct.unpack_from("<II", data)
        if zlib.crc32(data[8:]) != crc:
            raise ValueError("a damaged block")
        raw = pa.decompress(data[8:], decompressed_size=raw_size, codec="zstd", asbytes=True)
        n = struct.unpack_from("<I", raw, len(raw) - 4)[0]
        return raw[: len(raw) - 4 * n - 4], list(struct.unpack_from(f"<{n}I", raw, len(raw) - 4 * n - 4))

    @staticmethod
    def _entries(raw: bytes, at: int, key: bytes = b"") -> Iterator[tuple[bytes, bytes]]:
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            yield key, raw[at + rest : at + rest + size]
            at += rest + size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.places)):
            yield from self._entries(self._block(k)[0], 0)

    def may_have(self, doc_id: int | None) -> bool:
        marks = np.unpackbits(np.frombuffer(self.bloom, np.uint8), bitorder="little")
        return bool(marks[_probes(np.array([_bloom_hash(key_of(doc_id)[:-4])], np.uint64), len(marks))].all())

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every row with this doc_id, by binary search in the index and in the block."""
        wanted, out = key_of(doc_id), []
        if not self.count or not self.may_have(doc_id):
            return out
        for k in range(bisect.bisect_left(self.last, wanted), len(self.last)):
            raw, restarts = self._block(k)
            first = bisect.bisect_right(restarts, wanted, key=lambda at: next(self._entries(raw, at))[0]) - 1
            for key, value in self._entries(raw, restarts[max(0, first)]):
                if key[:-4] == wanted[:-4]:
                    out.append(unpack_value(value)[0])
                elif key > wanted:
                    return out
        return out


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int = 2, shards: int | None = None, doc_id: str = "doc_id", text: str = "text", position: str | None = None) -> DataFrame:
    """Write the token ids of docs to shards in a shared folder; returns the manifest (shard, file, n_docs, n_tokens).

    Documents are dealt to shards by ranges of doc_id, so shards follow each other in order. position names a long column
    that is stored with each document, -1 without one.
    """
    spark = docs.sparkSession
    share_code(spark)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    place = F.coalesce(F.col(position).cast("long"), F.lit(-1)) if position else F.lit(-1).cast("long")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), place.alias("position"), whole.alias("text"))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text", "position")
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        task = TaskContext.get()
        store, where = _filesystem(folder)
        store.create_dir(where, recursive=True)
        name = f"shard-{task.partitionId():06d}.sst"
        attempt = f"{where}/.{name}.{task.taskAttemptId()}"
        with store.open_output_stream(attempt) as out:
            writer = Writer(out)
            before, repeats = object(), 0
            for batch in batches:
                for at, upto in steps(batch.column(2), STEP):
                    part = batch.slice(at, upto - at)
                    ids, bounds = encode(part.column(2))
                    ids = ids.astype("<u4", copy=False)
                    for k, (doc, place) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                        repeats = repeats + 1 if doc == before else 0
                        before = doc
                        packed = ids[bounds[k] : bounds[k + 1]].tobytes() + end
                        writer.add(key_of(doc, repeats), pack_value(packed, place), len(packed) // 4)
            writer.close()
        store.move(attempt, f"{where}/{name}")
        yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "file": [name], "n_docs": [writer.count], "n_tokens": [writer.tokens]})

    return materialize(rows.mapInArrow(run, "shard long, file string, n_docs long, n_tokens long"), "manifest")


def read_shards(manifest: DataFrame, folder: str, ids: bool = True) -> DataFrame:
    """One row per stored document: doc_id, position, start, n_tokens, ids_crc32, ids.

    start counts the ids of all documents before it over all shards. ids=False leaves the ids out.
    """
    spark = manifest.sparkSession
    share_code(spark)
    first = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    todo = manifest.where("n_docs > 0").select("file", "shard", first.alias("first"))  # one row a shard
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = _filesystem(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                with store.open_input_file(f"{where}/{name}") as source:
                    rows = []
                    for key, value in Reader(source):
                        found, position = unpack_value(value)
                        rows.append((doc_of(key), position, start, len(found), zlib.crc32(found.tobytes()), found))
                        start += len(found)
                        if len(rows) == 512:
                            yield _batch(rows, ids)
                            rows = []
                    if rows:
                        yield _batch(rows, ids)

    schema = "doc_id long, position long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    return todo.repartition(n, "shard").mapInArrow(run, schema)


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    *plain, ids = zip(*rows, strict=True)
    names = ["doc_id", "position", "start", "n_tokens", "ids_crc32"]
    if not with_ids:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in plain], names=names)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    arrays = [pa.array(c, pa.int64()) for c in plain]
    arrays.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids).view("<i4"), pa.int32())))
    return pa.RecordBatch.from_arrays(arrays, names=[*names, "ids"])


def token_shards(docs: DataFrame, path: str, folder: str | None = None, **options) -> DataFrame:
    """Write docs to shards, read them back and return read_shards() without the ids.

    Defined results: a null text is empty and has the end id only; rows with the same doc_id follow each other, ordered by a
    hash of the text, then by text, and each is stored; null doc_ids come first; other columns are ignored; no rows give
    empty shards and no rows.
    """
    folder = folder or new_path(docs.sparkSession, "sst")
    return read_shards(write_shards(docs, folder, path, **options), folder, ids=False)
