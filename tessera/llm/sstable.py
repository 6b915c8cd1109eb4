"""Token ids as sorted-string-table shards: write a corpus, look one document up, scan all.

One shard file holds a run of documents in ascending key order:

    block*      zstd of entries; entry = varints (shared, unshared, value bytes), unshared key bytes, value
    index       zstd of, for each block: varint key bytes, first key, varint offset, varint bytes, varint entries before it
    bloom       bits of a Bloom filter of the keys
    footer      72 bytes: eight little-endian u64 (index offset, index bytes, bloom offset, bloom bytes, bloom hashes,
                documents, ids, bytes an id), crc32 of index and bloom, magic

Keys are nine bytes: one that is 0 for a null id, then the id with its sign bit flipped, big-endian, so that byte order is
id order. A key shares a prefix with the one before it in its block; each block starts anew, and the index holds the first
key of each block, so a lookup reads the footer, the index and the filter once and then one block.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.encoding import encoder
from tessera.llm.shared import fresh_path, stored

MAGIC = b"SSTIDS01"
_FOOTER = struct.Struct("<8QI8s")


def key_of(doc_id: int | None) -> bytes:
    return bytes(9) if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _probes(key: bytes, hashes: int, bits: int) -> list[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & ((1 << 64) - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(hashes)]


class ShardWriter:
    """Writes entries that come in ascending key order; holds one block, the index and the keys' filter hashes."""

    def __init__(self, sink, id_bytes: int, block_bytes: int = 1 << 17, bits_per_key: int = 10):
        import zstandard

        self.sink, self.id_bytes, self.block_bytes, self.bits_per_key = sink, id_bytes, block_bytes, bits_per_key
        self.zstd = zstandard.ZstdCompressor(level=1)
        self.block, self.index, self.keys = bytearray(), bytearray(), []
        self.last, self.first, self.before = b"", b"", 0
        self.at = self.n_ids = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if not self.block:
            self.first, self.last, self.before = key, b"", len(self.keys)
        shared = 0
        while shared < len(self.last) and self.last[shared] == key[shared]:
            shared += 1
        value = ids.astype(f"<u{self.id_bytes}").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.n_ids = key, self.n_ids + len(ids)
        self.keys.append(key)
        if len(self.block) >= self.block_bytes:
            self._end_block()

    def _end_block(self) -> None:
        if self.block:
            data = self.zstd.compress(bytes(self.block))
            self.index += _varint(len(self.first)) + self.first + _varint(self.at) + _varint(len(data)) + _varint(self.before)
            self.sink.write(data)
            self.at += len(data)
            self.block = bytearray()

    def close(self) -> None:
        self._end_block()
        index, hashes = self.zstd.compress(bytes(self.index)), max(1, round(self.bits_per_key * 0.69))
        bits = max(64, len(self.keys) * self.bits_per_key)
        filled = np.zeros((bits + 7) // 8 * 8, bool)
        for key in self.keys:
            filled[_probes(key, hashes, bits)] = True
        bloom = np.packbits(filled, bitorder="little").tobytes()
        self.sink.write(index)
        self.sink.write(bloom)
        self.sink.write(_FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), bits << 8 | hashes, len(self.keys), self.n_ids, self.id_bytes, zlib.crc32(bloom, zlib.crc32(index)), MAGIC))


class Shard:
    """Reads one shard from a seekable binary file."""

    def __init__(self, source):
        import zstandard

        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        source.seek(0, io.SEEK_END)
        size = source.tell()
        index_at, index_n, bloom_at, bloom_n, bloom, self.n_docs, self.n_ids, self.id_bytes, crc, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        index, self.bloom = self._read(index_at, index_n), self._read(bloom_at, bloom_n)
        if magic != MAGIC or crc != zlib.crc32(self.bloom, zlib.crc32(index)):
            raise ValueError("not a whole shard")
        self.bits, self.hashes = bloom >> 8, bloom & 255
        self.firsts, self.blocks = [], []
        index, at = self.zstd.decompress(index), 0
        while at < len(index):
            n, at = _read_varint(index, at)
            self.firsts.append(index[at : at + n])
            offset, at = _read_varint(index, at + n)
            length, at = _read_varint(index, at)
            _, at = _read_varint(index, at)
            self.blocks.append((offset, length))

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        data, at, key = self.zstd.decompress(self._read(*self.blocks[block])), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            yield key, np.frombuffer(data, f"<u{self.id_bytes}", n // self.id_bytes, at + own)
            at += own + n

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for block in range(len(self.blocks)):
            for key, ids in self._entries(block):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each document with this id in the shard (several if the id repeats)."""
        key, found = key_of(doc_id), []
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.hashes, self.bits)):
            return found
        block = max(0, bisect_right(self.firsts, key) - 1)
        while block > 0 and self.firsts[block] == key:  # a repeated id may start in an earlier block
            block -= 1
        for b in range(block, len(self.blocks)):
            if self.firsts[b] > key:
                break
            found += [ids for k, ids in self._entries(b) if k == key]
        return found


def open_shard(path: str) -> Shard:
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return Shard(store.open_input_file(inner))


_MANIFEST = "part long, roll long, path string, n_docs long, n_ids long, first_id long, last_id long"


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 256 << 20) -> DataFrame:
    """Encodes all texts, appends end_id to each and writes them as shards in ascending id order; returns the manifest.

    A null text counts as empty, a null id sorts before all others, rows with one id are ordered by a hash of their text.
    Files have names of their own for each attempt of a task and count only if the (stored) manifest lists them, so a
    task that runs twice, or dies half way, leaves no wrong data. No table is held: each task streams one range of ids.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "sst")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, inner = fs.FileSystem.from_uri(folder)
        store.create_dir(inner, recursive=True)
        encode, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        id_bytes = 2 if encode.size <= 1 << 16 and end_id < 1 << 16 else 4
        end, made, writer = np.array([end_id], "<u4").tobytes(), [], None

        def over() -> None:
            writer.close()
            writer.sink.close()
            made.append({"part": part, "roll": len(made), "path": path, "n_docs": len(writer.keys), "n_ids": writer.n_ids, "first_id": id_of(writer.keys[0]), "last_id": id_of(writer.keys[-1])})

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if writer is None:
                    name = f"shard-{part:06d}-{len(made):04d}-{uuid.uuid4().hex}.sst"
                    path = f"{folder}/{name}"
                    writer = ShardWriter(store.open_output_stream(f"{inner}/{name}"), id_bytes)
                writer.add(key_of(doc_id), np.frombuffer(encode(text) + end, "<u4"))
                if writer.at >= shard_bytes:
                    over()
                    writer = None
        if writer is not None:
            over()
        yield pa.RecordBatch.from_pylist(made, schema=pa.schema([(c.split()[0], pa.string() if c.split()[1] == "string" else pa.int64()) for c in _MANIFEST.split(", ")]))

    return stored(rows.mapInArrow(write, _MANIFEST), "sst-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every document of the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The manifest has a row for each shard file, so the running sum over it is small; each task then reads whole files.
    """
    spark = manifest.sparkSession
    before = F.sum("n_ids").over(Window.orderBy("part", "roll").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_ids")
    files = manifest.select("path", before.alias("start")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist(), strict=True):
                out: list[tuple] = []
                for doc_id, ids in open_shard(path).scan():
                    out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(out) == 10_000:
                        yield _columns(out)
                        out = []
                yield _columns(out)

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def lookup(manifest: DataFrame, doc_id: int) -> list[np.ndarray]:
    """The ids of one document: the manifest's ranges pick the shards, filter and index the block."""
    rows = manifest.where((F.col("first_id") <= doc_id) | F.col("first_id").isNull()).where(F.col("last_id") >= doc_id).select("path").collect()
    return [ids for r in rows for ids in open_shard(r["path"]).get(doc_id)]
